"""Audit log, key-value cache, conversations, memory and the rate limiter as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import materialize


def audit_latest(log: DataFrame, n: int = 50, order: str = "id") -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def numbered(rows: DataFrame, *order: str, number: str = "_k") -> DataFrame:
    """Rows with numbers from 1 in an order: range partitions, each counted on from those before."""
    from pyspark.sql import Window

    x = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = x.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    # a row a partition
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    x = x.join(F.broadcast(parts.withColumn("_before", before)), F.col("_part") == F.col("_p"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return x.withColumn(number, F.col("_before") + at).drop("_part", "_p", "_c", "_before")


def append_numbered(stored: DataFrame, new: DataFrame, order: str, number: str = "id") -> DataFrame:
    """New rows with numbers that follow the stored ones."""
    last = stored.agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    x = numbered(new, order).join(F.broadcast(last), F.lit(True))
    return x.withColumn(number, F.col("_last") + F.col("_k")).drop("_last", "_k").select(stored.columns)


def append_message(stored: DataFrame, conv_id, role: str, text: str) -> DataFrame:
    """A conversation table (conv_id, turn, role, text) with one more message at the end of a conversation."""
    one = stored.where(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn") + 1, F.lit(0)).alias("turn"))
    kind = {f.name: f.dataType for f in stored.schema}
    new = one.select(F.lit(conv_id).cast(kind["conv_id"]).alias("conv_id"), F.col("turn").cast(kind["turn"]).alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return stored.select(new.columns).unionByName(new)


def conversation_text(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, history): turns in order as 'User: ...' and 'Assistant: ...'."""
    who = F.concat(F.upper(F.left("role", F.lit(1))), F.substring("role", F.lit(2), F.length("role")))
    line = F.concat(who, F.lit(": "), F.coalesce("text", F.lit("")))
    x = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return x.select("conv_id", F.size("l").cast("long").alias("n_turns"), F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("history"))


# A repository's profile and questions before any are stored
PROFILE = {"tech_stack": [], "primary_language": "Unknown", "architecture_style": "Monolith", "description": "No repository description provided.", "design_patterns": []}
FAQS = (
    ("How do I run the test suite?", "Run `pytest` using the command `PYTHONPATH=. ./venv/bin/pytest tests/` in the project root."),
    ("How do I perform a full repository ingestion?", "Instantiate the `RepoIngestionPipeline` and call `ingest_repository(repo_url)`."),
)


def merge_profile(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """(key, value): stored fields, overwritten by updates."""
    return updates.unionByName(stored.join(updates.select("key"), "key", "left_anti"))


def rate_limit(events: DataFrame, most: int, seconds: int, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(order, accepted): a call passes if fewer than ``most`` calls of its key passed within the last ``seconds``.

    Rejected calls don't count, so this is no window function: rows stream through a task sorted by key and time, and
    only the accepted times of the present key are held.
    """
    import numpy as np
    import pyarrow as pa

    span = seconds * 1_000_000

    def run(batches):
        now, inside = object(), []
        for b in batches:
            keys, times = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = np.zeros(len(keys), bool)
            for i, (k, t) in enumerate(zip(keys, times, strict=True)):
                if k != now:
                    now, inside = k, []
                inside = [x for x in inside if t - x < span]
                if len(inside) < most:
                    inside.append(t)
                    out[i] = True
            yield pa.record_batch([b.column(2), pa.array(out)], names=[order, "accepted"])

    x = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), order).repartition(key).sortWithinPartitions(key, "_us", order)
    return x.mapInArrow(run, f"{order} long, accepted boolean")


def access(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests(token, allowed array) with status 200, 401 (missing or unknown token) or 403 (role not allowed). keys(token, role)."""
    x = requests.join(keys.withColumnRenamed("token", "_t"), F.col("token") == F.col("_t"), "left")
    status = F.when(F.coalesce("token", F.lit("")) == "", 401).when(F.col("role").isNull(), 403).when(F.array_contains("allowed", F.col("role")), 200).otherwise(403)
    return x.withColumn("status", status).drop("_t")


def gate(requests: DataFrame, keys: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """requests(event_id, token, ts, allowed array) with status: 401 or 403 by key and role, else 429 beyond ``most`` requests of a token in ``seconds``, else 200.

    Requests that key or role refuse don't count to the limit.
    """
    x = access(requests, keys)
    passed = rate_limit(x.where("status = 200"), most, seconds, key="token")
    y = x.join(passed.withColumnRenamed("event_id", "_e"), F.col("event_id") == F.col("_e"), "left")
    return y.withColumn("status", F.when((F.col("status") == 200) & ~F.col("accepted"), 429).otherwise(F.col("status"))).drop("_e", "accepted")
