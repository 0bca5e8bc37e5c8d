"""From documents to packed training sequences: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of
documents. Columns besides USED go through untouched under names that nothing inside can meet; an empty table gives an
empty table; very long texts are handled whole; what ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tarn.llm.common import SPACE, WORD, materialize, spread_join
from tarn.session import table


#: Columns that stages look at.
USED = ("doc_id", "text", "source", "n_chars")


def apart(stage):
    """A stage that meets no column names but USED and x0, x1, ...; the others come back under their own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = {c: c if c in USED else f"x{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in inner.items()])

    return run


@apart
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model predicts toxic.

    Null and empty texts get the calibrated rate of the examples without terms, so they stay unless most of those are
    toxic; rows are scored one by one, so repeated rows and rows that share or lack a doc_id fare alike.
    """
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    names = ("_tox_score", "_tox_predicted", "_tox_evidence")
    return toxicity.score(docs, model, names=names).where("_tox_predicted = 0").select(docs.columns)


@apart
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    A null text counts as empty. A null doc_id stays only where no other row has the text; of rows that share doc_id and
    text one stays, any of them.
    """
    keys = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), exact_dedup.text_key().alias("key")), "keys")
    groups = exact_dedup.exact_groups(keys, exact_dedup.buckets_for(keys.count())).where("group_size > 1").select(F.col("key").alias("_gone_key"), "keep_id")
    dropped = spread_join(keys, groups, "key", "_gone_key", "doc_id").where(~F.col("keep_id").eqNullSafe(F.col("doc_id")))
    dropped = dropped.select("_gone_key", F.col("doc_id").alias("_gone_id")).distinct()
    x = docs.withColumn("_key", exact_dedup.text_key())
    x = x.join(dropped, (F.col("_key") == F.col("_gone_key")) & F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left_anti")
    if keys.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        x = x.dropDuplicates(["doc_id", "_key"])
    return x.select(docs.columns)


@apart
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; where texts share it, that of the least hash.

    Null and empty texts are nobody's copies. Rows with a null doc_id can't be named by a decision and stay; rows that
    share a doc_id are decided by doc_id and text.
    """
    x = materialize(ngram_join.ngram_join(docs, rows=True).where("component IS NOT NULL"), "classes")
    kept = x.where("doc_id = class_id").groupBy("component").agg(F.min("th").alias("_kept"))
    dropped = x.join(kept, "component").where("doc_id != class_id OR th != _kept").where("doc_id IS NOT NULL")
    dropped = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(dropped, (F.col("doc_id") == F.col("_gone_id")) & (th == F.col("_gone_th")), "left_anti").select(docs.columns)


@apart
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, the last time only its first words.

    Null and empty texts have no words and go. A null source is a source of its own. Rows that share doc_id and text get
    equal parts of what they take together (exact dedup leaves none of these).
    """
    hashed = docs.withColumn("_th", F.xxhash64("text"))
    plan = mixing.mix(hashed, carry=["_th"])
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")).agg(F.expr("sum(taken) div count(*)").alias("_taken"), F.max("size").alias("_size")).where("_taken > 0")
    x = hashed.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")))
    rest = F.col("_taken") % F.col("_size")
    begin = F.concat(F.lit(f"^(?:{SPACE})?+(?:{WORD}{SPACE}){{"), (rest - 1).cast("string"), F.lit(f"}}+{WORD}"))
    x = x.withColumn("_begin", begin)
    part = F.when(rest > 0, F.array(F.expr("regexp_extract(text, _begin, 0)"))).otherwise(F.array().cast("array<string>"))
    x = x.withColumn("_texts", F.concat(F.array_repeat("text", F.expr("_taken div _size").cast("int")), part))
    x = x.withColumn("_text", F.explode("_texts"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return x.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Null and empty texts are one id; rows that share a doc_id are documents of their own, in any order; a null doc_id is
    reported as null.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict = {}
