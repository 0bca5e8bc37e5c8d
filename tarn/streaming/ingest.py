"""Incremental ingest of a source tree's snapshots as a stream of file rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.incremental import upsert_latest
from tarn.sources import versioned


#: Parts of a kept table; a batch rewrites those that it has keys of.
BUCKETS = 64


def stream_upsert(stream: DataFrame, table: str, keys: list[str], seq: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """A query that keeps in ``table`` the last row of each key of all batches.

    Rows are dealt to buckets by a hash of their key. A batch reads and writes the buckets that it has keys of, as a new
    version that is visible once it is whole; a repeated batch gives the same rows again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = (transform(batch) if transform else batch).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}
        if not touched:
            return
        stored = [p for b, p in versioned.buckets(spark, table).items() if b in touched]
        if stored:
            old = spark.read.schema(new.drop("_bucket").schema).parquet(*stored)
            old = old.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        else:
            old = new.limit(0)
        versioned.save_buckets(upsert_latest(old, new, keys, seq).repartition("_bucket"), table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark, table: str) -> DataFrame | None:
    """The table as it is, None before the first batch."""
    found = versioned.buckets(spark, table)
    return spark.read.parquet(*sorted(found.values())) if found else None


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Session windows with a watermark: (key, start, end, n)."""
    x = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    y = x.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return y.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
