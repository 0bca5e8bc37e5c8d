"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Plan, all in DataFrame expressions: words of each document -> source sizes -> capped targets -> block quotas of
sources -> block quotas of shards (hash slices of one source of about SHARD_WORDS words) -> a run of blocks of each
shard, beginning at a seeded block of the shard's documents in seeded order, round and round.

Both apportionments give the result of handing out seats one by one to the highest quotient votes / (2 seats + 1).
They start from the seats that a divisor slightly too large gives, so that only about as many seats as there are
units are ranked, and no row exists for a block. Totals are aggregates; the ranking is a range partitioning by
quotient whose ranks are counted on from the partitions before, so the shards of one source never meet in one task.

Defined cases: null and empty texts have size 0 and take nothing; a null source is a source of its own, last in order; documents
of one doc_id are rows of their own; rows without doc_id are dealt by a hash of their text; an empty table gives an
empty result; a source whose size is 0 has target 0; block size is 1/200 of the smallest target, at least 1 and at
most 1024 words, so that small sources come near their targets too. The table of sources (a row for each source) meets
in one task, and a shard's documents (about SHARD_WORDS words) do. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import WORD, materialize, spread_join

WEIGHTS, MOST_EPOCHS, SHARD_WORDS, SEED = (1, 2, 3), 3, 1 << 18, 17


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def apportion(units: DataFrame, group: str | list[str], votes: str, seats: str, unit: str | list[str]) -> DataFrame:
    """Adds ``quota``: the whole seats of each unit within its group. Ties go to the first by ``unit``.

    ``group`` and ``unit`` are a column or a list of columns that name one together.
    """
    if not isinstance(group, str) or not isinstance(unit, str):
        names = {k: [c] if isinstance(c, str) else list(c) for k, c in (("_group", group), ("_unit", unit))}
        packed = units.withColumns({k: F.struct(*cs) for k, cs in names.items()})
        return apportion(packed, "_group", votes, seats, "_unit").drop(*names)
    share, zero = F.col(votes).cast("double"), F.lit(0).cast("long")
    totals = units.groupBy(F.col(group).alias("_g")).agg(F.sum(share).alias("_v"), F.count(F.lit(1)).alias("_n"))
    x = spread_join(units, totals, group, "_g", unit).drop("_g")
    divisor = F.col("_v") / (F.col(seats) - F.col("_n") / 2)
    base = F.when((F.col(seats) > F.col("_n") / 2) & (F.col("_v") > 0), F.greatest(zero, F.floor(share / divisor + 0.5) - 1)).otherwise(zero)
    x = materialize(x.withColumn("_base", base), "units")
    left = x.groupBy(F.col(group).alias("_g")).agg((F.first(seats) - F.sum("_base")).alias("_left"))
    tries = F.when(share > 0, F.sequence(zero, F.ceil(F.col("_n") * share / F.col("_v")) + 3)).otherwise(F.array().cast("array<bigint>"))
    asked = x.select(group, unit, "_base", share.alias("_share"), F.explode(tries).alias("_j"))
    asked = asked.withColumn("_q", F.col("_share") / (2 * (F.col("_base") + F.col("_j")) + 1))
    # a group's quotients lie in falling order over partitions; its ranks go on where the partition before ends
    ranged = materialize(asked.repartitionByRange(group, F.desc("_q"), unit).select(group, unit, "_q", F.spark_partition_id().alias("_part")), "quotients")
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), zero)).join(left, "_g").where("_before < _left")
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.desc("_q"), unit))
    won = ranged.join(parts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_before") + rank)
    won = won.where("_rank <= _left").groupBy(F.col(group).alias("_g"), F.col(unit).alias("_u")).agg(F.count(F.lit(1)).alias("_more"))
    y = x.join(won, (F.col(group) == F.col("_g")) & (F.col(unit) == F.col("_u")), "left")
    return y.withColumn("quota", F.col("_base") + F.coalesce("_more", zero)).drop("_v", "_n", "_base", "_g", "_u", "_more")


def source_targets(sized: DataFrame) -> DataFrame:
    """skey, rank, source_size, target of each source: weights share all words; what a cap cuts off is shared again."""
    one = Window.partitionBy(F.lit(0))
    x = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    x = x.withColumn("rank", F.row_number().over(one.orderBy(F.desc(F.length("skey") > 0), "skey")).cast("long"))
    x = x.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    x = x.withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    by_ratio = one.orderBy(F.col("cap") / F.col("w"), "rank")
    x = x.withColumns({
        "total": F.sum("source_size").over(one), "at": F.row_number().over(by_ratio),
        "before": F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
        "rest": F.sum("w").over(one) - F.sum("w").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"),
    })
    fits = (F.col("total") - F.col("before")).cast("decimal(19,0)") * F.col("w").cast("decimal(10,0)") <= F.col("cap").cast("decimal(19,0)") * F.col("rest").cast("decimal(19,0)")
    x = x.withColumn("stop", F.min(F.when(fits, F.col("at"))).over(one))
    level = lambda c: F.max(F.when(F.col("at") == F.col("stop"), F.col(c))).over(one)
    x = x.withColumns({"spare": level("total") - level("before"), "weights": level("rest")})
    target = F.when(F.col("at") < F.col("stop"), F.col("cap").cast("double")).otherwise((F.col("spare") * F.col("w")).cast("double") / F.col("weights").cast("double"))
    return x.withColumn("target", target).select("skey", "rank", "source_size", "target", "total")


def mix(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS, carry: list[str] | None = None) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken; and the columns named by ``carry``."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    sized = materialize(docs.select(F.col("doc_id"), key.alias("skey"), word_count().alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), named)).alias("h"), *(carry or [])), "sizes")
    one = Window.partitionBy(F.lit(0))
    block = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(one) / 200))).cast("long")
    sources = source_targets(sized).withColumn("block", F.coalesce(block, F.lit(1).cast("long")))
    sources = sources.withColumns({"seats": (F.col("total") / F.col("block")).cast("long"), "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")})
    sources = apportion(sources.withColumn("_all", F.lit(0)), "_all", "target", "seats", "rank").select("skey", "source_size", "target", "block", "shards", F.col("quota").alias("source_quota"))
    sources = materialize(sources, "sources")
    number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    named = sources.withColumnRenamed("skey", "_s")
    dealt = spread_join(sized, named, "skey", "_s", "h").drop("_s").withColumn("shard", number(F.col("h")) % F.col("shards"))
    cells = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("cell"), F.first("block").alias("block"), F.first("source_quota").alias("source_quota"))
    cells = apportion(cells, "skey", "cell", "source_quota", "shard")
    first = number(F.md5(F.concat(F.lit(f"{seed}:"), "skey", F.lit(":"), F.col("shard").cast("string"))))
    cells = cells.withColumn("words", F.least(F.col("quota") * F.col("block"), F.col("cell") * MOST_EPOCHS)).where("cell > 0").select(
        "skey", "shard", "cell", F.expr("words div cell").alias("full"), F.expr("words % cell").alias("rest"),
        (first % F.ceil(F.col("cell") / F.col("block")) * F.col("block")).alias("start"),
    )
    in_order = Window.partitionBy("skey", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    x = dealt.withColumn("b", F.sum("size").over(in_order)).withColumn("a", F.col("b") - F.col("size")).join(cells, ["skey", "shard"], "left")
    zero, end = F.lit(0).cast("long"), F.col("start") + F.col("rest")
    part = F.greatest(zero, F.least("b", end) - F.greatest("a", "start")) + F.greatest(zero, F.least(F.col("b"), end - F.col("cell")) - F.col("a"))
    taken = F.when(F.col("size") > 0, F.coalesce(F.col("full") * F.col("size") + part, zero)).otherwise(zero)
    return x.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(carry or []))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS skey, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY (skey = ''), skey) AS rank FROM s0),
s2 AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, row_number() OVER r AS pos, (sum(cap) OVER r)::BIGINT - cap AS before,
              (sum(w) OVER ())::BIGINT - (sum(w) OVER r)::BIGINT + w AS rest FROM s2 WINDOW r AS (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING)),
s4 AS (SELECT *, min(pos) FILTER (WHERE (total - before)::HUGEINT * w <= cap::HUGEINT * rest) OVER () AS stop FROM s3),
s5 AS (SELECT *, max(total - before) FILTER (WHERE pos = stop) OVER () AS spare, max(rest) FILTER (WHERE pos = stop) OVER () AS weights FROM s4),
s6 AS (SELECT *, CASE WHEN pos < stop THEN cap::DOUBLE ELSE (spare * w)::DOUBLE / weights::DOUBLE END AS target FROM s5),
s7 AS (SELECT *, coalesce(greatest(1, least(1024, floor(min(target) FILTER (WHERE target > 0) OVER () / 200)))::BIGINT, 1) AS block, count(*) OVER () AS n FROM s6),
s8 AS (SELECT *, total // block AS seats, greatest(1, ceil(source_size / 262144))::BIGINT AS shards, sum(target) OVER () AS v FROM s7),
sq AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank) AS turn, seats FROM s8, unnest(range(0, seats)) AS t(j) WHERE target > 0 AND target / v * seats + n + 2 > j),
s9 AS (SELECT s8.*, coalesce(q.quota, 0) AS source_quota FROM s8 LEFT JOIN (SELECT rank, count(*) AS quota FROM sq WHERE turn <= seats GROUP BY 1) q USING (rank)),
d AS (SELECT sized.*, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h, source_size, target, block, shards, source_quota FROM sized JOIN s9 USING (skey)),
d1 AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard FROM d),
c0 AS (SELECT skey, shard, sum(size)::BIGINT AS cell, first(block) AS block, first(source_quota) AS source_quota FROM d1 GROUP BY 1, 2),
cq AS (SELECT skey, shard, row_number() OVER (PARTITION BY skey ORDER BY cell / (2 * j + 1) DESC, shard) AS turn, source_quota FROM c0, unnest(range(0, source_quota)) AS t(j) WHERE cell > 0),
c1 AS (SELECT c0.*, least(coalesce(q.quota, 0) * block, cell * 3) AS words FROM c0 LEFT JOIN (SELECT skey, shard, count(*) AS quota FROM cq WHERE turn <= source_quota GROUP BY 1, 2) q USING (skey, shard) WHERE cell > 0),
c2 AS (SELECT skey, shard, cell, words // cell AS full_, words % cell AS rest,
              (('0x' || substr(md5('17:' || skey || ':' || shard), 1, 8))::BIGINT % ceil(cell / block)::BIGINT) * block AS start FROM c1),
d2 AS (SELECT *, (sum(size) OVER (PARTITION BY skey, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS b FROM d1)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN coalesce(full_ * size + greatest(0, least(b, start + rest) - greatest(b - size, start)) + greatest(0, least(b, start + rest - cell) - (b - size)), 0) ELSE 0 END::BIGINT AS taken
FROM d2 LEFT JOIN c2 USING (skey, shard)
"""
