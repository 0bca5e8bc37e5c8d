"""Embedding chunks: a pluggable model over Arrow batches, and a cache keyed by text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import materialize


class HashEmbedder:
    """Signed hashes of words, normed: deterministic, needs no model."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).astype(np.float32).tolist()


class Transient(Exception):
    """A failure that may pass: a quota or a busy service. An adapter of a service raises it; other errors aren't repeated."""


class Pace:
    """At most one call in ``gap`` seconds; a failed one waits ``wait`` seconds, at most ``tries`` times in a row."""

    def __init__(self, gap: float = 0.0, tries: int = 5, wait: float = 15.0, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.tries, self.wait, self.clock, self.sleep, self.next = gap, tries, wait, clock, sleep, 0.0

    def call(self, do: Callable):
        for left in range(self.tries - 1, -1, -1):
            self.sleep(max(0.0, self.next - self.clock()))
            self.next = self.clock() + self.gap
            try:
                return do()
            except Transient:
                if not left:
                    raise
                self.next = self.clock() + self.wait


class Paced:
    """Another embedder, asked for some texts at a time under a pace."""

    def __init__(self, inner, size: int = 20, pace: Pace | None = None):
        self.inner, self.size, self.pace = inner, size, pace or Pace()

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        parts = [texts[i : i + self.size] for i in range(0, len(texts), self.size)]
        return [normalized(v) for part in parts for v in self.pace.call(lambda part=part: self.inner.embed_texts(part))]


def normalized(reply) -> list[float]:
    """A vector of a service's reply: numbers, or an object or mapping that holds them as ``embedding`` or ``values``."""
    for name in ("embedding", "values"):
        reply = reply.get(name, reply) if isinstance(reply, dict) else getattr(reply, name, reply) if not callable(getattr(reply, name, None)) else reply
    return [float(x) for x in reply]


def embed(rows: DataFrame, make: Callable[[], object], text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column; ``make`` builds the model once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(model.embed_texts(s.fillna("").tolist()))

    return rows.withColumn(out, run(F.col(text)))


def embed_cached(rows: DataFrame, cache: DataFrame, make: Callable[[], object], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, cache with the new entries). cache(key, value array<float>), key: SHA-256 of the text.

    What is missing is embedded once, whatever is done with the two tables.
    """
    keyed = rows.withColumn("key", F.sha2(F.coalesce(text, F.lit("")), 256))
    texts = keyed.groupBy("key").agg(F.first(F.coalesce(text, F.lit(""))).alias("_t")).join(cache.select("key"), "key", "left_anti")
    new = materialize(embed(texts, make, "_t", "value").select("key", "value"), "embedded")
    values = cache.select("key", "value").unionByName(new)
    return keyed.join(values.withColumnRenamed("value", "embedding"), "key").drop("key"), values
