"""Counters of streaming queries: batches, rows and seconds, and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds in seconds of a latency histogram's buckets.
BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(rows: DataFrame, seconds: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(bound, n): rows at or below each bound, and all (bound null). One pass, a row of counts a task."""
    x = rows.agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(seconds).alias("b"))
    cells = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return x.select(F.explode(F.array(*cells, F.struct(F.lit(None).cast("double").alias("bound"), F.col("b").alias("n")))).alias("c")).select("c.*")


class Counters(StreamingQueryListener):
    """spark.streams.addListener(Counters()): totals by query name."""

    def __init__(self):
        self.totals: dict[str, dict[str, float]] = {}
        self.failures = 0

    def onQueryStarted(self, event) -> None:
        self.totals.setdefault(event.name or str(event.id), {"batches": 0, "rows": 0, "seconds": 0.0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        t = self.totals.setdefault(p.name or str(p.id), {"batches": 0, "rows": 0, "seconds": 0.0})
        t["batches"] += 1
        t["rows"] += p.numInputRows
        t["seconds"] += p.durationMs.get("triggerExecution", 0) / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None
