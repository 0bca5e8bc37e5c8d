"""Hybrid retrieval as one DataFrame DAG: vector and lexical seeds, graph expansion, keep-first fusion, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import code_tokens
from tarn.operators.lexical import Index, bm25_topk
from tarn.operators.vector_search import vector_topk, vector_topk_semi
from tarn.session import materialize


def keep_first(ranked: list[DataFrame], key: str) -> DataFrame:
    """Union of lists (key, pos), each key once: from the earliest list, at its best place. Adds source_rank."""
    x = None
    for i, df in enumerate(ranked):
        y = df.select(key, F.col("pos").cast("long").alias("pos"), F.lit(i).cast("long").alias("source_rank"))
        x = y if x is None else x.unionByName(y)
    w = Window.partitionBy(key).orderBy("source_rank", "pos")
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def placed(topk: DataFrame, *order: Column | str) -> DataFrame:
    """A top-k list with pos from 1. A list has at most k rows, so one task numbers it."""
    return topk.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def overlap_score(text: Column, query: str) -> Column:
    """Jaccard similarity of the token sets of a text and a query: a deterministic stand-in for a reranking model."""
    a, b = F.array_distinct(code_tokens(F.coalesce(text, F.lit("")))), F.array_distinct(code_tokens(F.lit(query)))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 9)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, query: str, k: int = 5, text: str = "text", key: str = "doc_id", score=overlap_score) -> DataFrame:
    """The k candidates of the best score, ties by key. ``score`` makes a Column; a pandas UDF of a model fits too."""
    return candidates.withColumn("score", score(F.col(text), query)).orderBy(F.desc("score"), key).limit(k)


def hybrid_candidates(index: Index, vectors: DataFrame, query: str, embedding: list[float], k: int = 20) -> DataFrame:
    """(doc_id, pos, source_rank): vector hits, then lexical hits that aren't among them."""
    v = placed(vector_topk(vectors, embedding, k).withColumnRenamed("vec_id", "doc_id"), "distance", "doc_id")
    b = placed(bm25_topk(index, query, k), F.round("score", 9).desc(), "doc_id")
    return keep_first([v, b], "doc_id")


def expand(seeds: DataFrame, docs: DataFrame, by: str = "source", key: str = "doc_id") -> DataFrame:
    """Keys of the rows that share ``by`` with a seed, seeds left out."""
    near = docs.join(seeds.select(key).distinct(), key, "left_semi").select(by).distinct()
    return docs.join(near, by, "left_semi").select(key).join(seeds.select(key), key, "left_anti")


def graph_aware(docs: DataFrame, index: Index, vectors: DataFrame, query: str, embedding: list[float], seeds: int = 20, more: int = 50, k: int = 5) -> DataFrame:
    """The k best of the seeds and of the nearest among their neighbours, reranked once; retrieval runs once.

    The seeds (2 * seeds rows at most) are written before what three branches of the plan make of them.
    """
    first = materialize(hybrid_candidates(index, vectors, query, embedding, seeds), "seeds")
    near = expand(first, docs).withColumnRenamed("doc_id", "vec_id")
    extra = placed(vector_topk_semi(vectors, embedding, near, "vec_id", more).withColumnRenamed("vec_id", "doc_id"), "distance", "doc_id")
    found = keep_first([first.select("doc_id", (F.col("source_rank") * 1000 + F.col("pos")).alias("pos")), extra], "doc_id")
    # at most 2 * seeds + more keys
    return rerank(docs.join(F.broadcast(found.select("doc_id")), "doc_id"), query, k)


def context_part(text: str = "text") -> Column:
    """A numbered result (pos, file_path, symbol_name, symbol_type, start_line, end_line, score, text): its whole text, and where it stands."""
    known = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    return F.concat(
        F.lit("["), F.col("pos").cast("string"), F.lit("] File: "), known("file_path"), F.lit("\nSymbol: "), known("symbol_name"), F.lit(" ("), known("symbol_type"), F.lit(")\nLines: "), known("start_line"), F.lit("-"), known("end_line"),
        F.lit("\nScore: "), F.when(F.col("score").isNotNull(), F.format_string("%.4f", F.col("score").cast("double"))).otherwise("unknown"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")),
    )


def context_block(hits: DataFrame, text: str = "text") -> DataFrame:
    """One row: the parts of a short list in order."""
    x = hits.select("pos", context_part(text).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return x.select(F.array_join(F.transform("p", lambda s: s["part"]), "\n\n").alias("context"))


def citations(results: DataFrame) -> DataFrame:
    """(file, symbol, type, lines) of results that have all of file_path, symbol_name, symbol_type, start_line, end_line."""
    need = ["file_path", "symbol_name", "symbol_type", "start_line", "end_line"]
    ok = None
    for c in need:
        t = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        ok = t if ok is None else ok & t
    return results.where(ok).select(F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol"), F.col("symbol_type").alias("type"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"))
