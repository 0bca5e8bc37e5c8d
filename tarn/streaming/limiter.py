"""The sliding rate limiter on a stream: keyed state holds the times of accepted calls only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

OUT = "key long, event_id long, accepted boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """At most ``most`` accepted calls of a key within ``seconds``; rejected calls leave no trace. State per key: at most ``most`` times.

    Times are those of the events, so nothing is forgotten by the clock of the machine: a pause or a slow replay changes
    no result. Rows of one key must come in order over batches, as the log's own order is.
    """

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", StructType([StructField("t", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        inside = list(self.times.get()[0]) if self.times.exists() else []
        ok = []
        for t in pdf["us"].tolist():
            inside = [x for x in inside if t - x < self.span]
            ok.append(len(inside) < self.most)
            if ok[-1]:
                inside.append(t)
        self.times.update((inside,))
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"], "accepted": ok})

    def close(self) -> None:
        pass


def limited(events: DataFrame, most: int, seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """events (streaming) to (key, event_id, accepted). The session's state store must be STORE."""
    x = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), "event_id")
    return x.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(most, seconds), outputStructType=OUT, outputMode="Append", timeMode="None")
