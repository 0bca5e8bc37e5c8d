"""BM25 over stored postings: texts are tokenised once, at fit; a question reads the postings of its terms.

Postings are range-partitioned by (term, key) and sorted, so a term in every document spans many files, and a question's
filter on terms skips files and row groups by their statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import TOKEN, code_tokens
from tarn.session import materialize, spread

K1, B = 1.5, 0.75


def term_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf)"""
    return docs.select(key, F.explode(code_tokens(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df)"""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(code_tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: documents and mean length (0 of none)."""
    return lengths(docs, key, text).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len"))


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


@dataclass
class Index:
    """postings(term, key, tf, dl), keys(key) of all documents, and the corpus' size and mean length."""

    postings: DataFrame
    keys: DataFrame
    n: int
    avgdl: float


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl), in order of term and key."""
    # lower case by way of one string, which unlike a lambda over the tokens is compiled
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    x = spread(docs.select(key, text), key).select(key, F.size(raw).cast("long").alias("dl"), F.sort_array(F.split(F.lower(F.array_join(raw, " ")), " ")).alias("words"))
    # equal words lie in runs, counted within the text's row: nothing is taken from the text beside the generator, which would
    # take it once a word, and only postings are dealt out. Of a generator that isn't outer, Spark infers a filter that takes the words twice.
    x = x.select("*", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))).alias("at"))
    run = F.transform("at", lambda a, i: F.struct(F.get("words", a).alias("term"), (F.coalesce(F.get("at", i + 1), F.size("words")) - a).cast("long").alias("tf")))
    x = x.select(key, "dl", F.inline_outer(run)).where("term != ''")
    return x.select("term", F.col(key).alias("key"), "tf", "dl").repartitionByRange("term", "key").sortWithinPartitions("term", "key")


def index_of(stored: DataFrame, docs: DataFrame, key: str = "doc_id") -> Index:
    """An index of stored postings. Sizes come from the postings, so texts aren't read again."""
    keys = docs.select(F.col(key).alias("key"))
    n, total = keys.count(), stored.agg(F.sum("tf")).first()[0] or 0
    return Index(stored, keys, n, total / n if n else 0.0)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """An index whose postings are written to the shared folder."""
    return index_of(materialize(postings(docs, key, text), "postings"), docs, key)


def bm25_scores(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents that hold a term of the query; a term counts as often as it is asked for."""
    asked: dict[str, int] = {}
    for t in re.findall(TOKEN, query):
        asked[t.lower()] = asked.get(t.lower(), 0) + 1
    hits = index.postings.where(F.col("term").isin(*sorted(asked)) if asked else F.lit(False))
    # rows of one key and length are one document
    hits = hits.repartition("key").groupBy("term", "key", "dl").agg(F.sum("tf").alias("tf"))
    # as many rows as the query has terms
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    often = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(asked.items()) for x in kv]), F.col("term")) if asked else F.lit(0)
    tf = F.col("tf")
    weight = often * idf(F.lit(index.n), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl or 1.0)))
    return hits.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(weight).alias("score"))


def bm25_topk(index: Index, query: str, k: int = 5, key: str = "doc_id") -> DataFrame:
    """The k best, ties by key; documents without a term fill up with score 0."""
    best = bm25_scores(index, query).orderBy(F.round("score", 9).desc(), "key").limit(k)
    # where less than k have a score, all of them are in best, so 2 k keys hold enough others
    fill = index.keys.orderBy("key").limit(2 * k).select("key", F.lit(0.0).alias("score"))
    return best.unionByName(fill).groupBy("key").agg(F.max("score").alias("score")).orderBy(F.round("score", 9).desc(), "key").limit(k).withColumnRenamed("key", key)
