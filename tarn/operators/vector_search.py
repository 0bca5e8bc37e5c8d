"""Exact vector search: a block of queries against all rows, with a pruned top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.vector import cosine_distance


def vector_topk(rows: DataFrame, query: list[float], k: int = 5, where: Column | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, distance) of the k nearest rows that pass ``where``; ties by key. Filters reach the scan; the sort is a bounded heap a task."""
    x = rows if where is None else rows.where(where)
    q = F.array(*[F.lit(float(v)) for v in query])
    d = F.round(cosine_distance(F.col(embedding), q), 9)
    return x.select(key, d.alias("distance")).orderBy("distance", key).limit(k)


def vector_topk_semi(rows: DataFrame, query: list[float], keys: DataFrame, on: str, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Top-k among the rows whose ``on`` is in a table of any size."""
    return vector_topk(rows.join(keys.select(on).distinct(), on, "left_semi"), query, k, None, key, embedding)
