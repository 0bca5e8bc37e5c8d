"""Quality of retrieval over a suite of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(suite: DataFrame) -> DataFrame:
    """suite(query, expected array, cited array) with precision, recall and citation_accuracy; a null citation list is a failed query."""
    cited, expected = F.array_distinct("cited"), F.array_distinct("expected")
    hit = F.size(F.array_intersect(cited, expected))
    precision = F.when(F.size(cited) > 0, hit / F.size(cited)).otherwise(0.0)
    recall = F.when(F.size(expected) > 0, hit / F.size(expected)).otherwise(0.0)
    return suite.select("query", *[F.when(F.col("cited").isNotNull(), v).alias(n) for n, v in (("precision", precision), ("recall", recall), ("citation_accuracy", F.when(hit > 0, 1.0).otherwise(0.0)))])


def averages(suite: DataFrame) -> DataFrame:
    """Means over the whole suite: failed queries count as 0."""
    x = per_query(suite)
    return x.agg(F.count(F.lit(1)).alias("queries"), *[(F.sum(F.coalesce(c, F.lit(0.0))) / F.count(F.lit(1))).alias(f"avg_{c}") for c in ("precision", "recall", "citation_accuracy")])
