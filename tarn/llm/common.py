"""What the operators share: spread joins, sorted groups and connected components."""

from __future__ import annotations

import ctypes
import functools
import re
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import fresh_path, materialize, shared_dir

__all__ = ["Kept", "SPACE", "WORD", "bounded_batches", "components", "fresh_path", "give_back", "materialize", "one_blas_thread", "remove", "shared_dir", "sorted_groups", "spread_join"]

#: White space and words of the contracts, as Java and Python patterns alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Batches of whole texts between Spark and Python hold fewer rows than usual, as a text may be long; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Memory that a worker has freed goes back to the machine, where its libraries can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


class Kept:
    """One object that the tasks of a worker share while they follow each other; idle for some seconds, it is let go."""

    def __init__(self, seconds: float = 5.0):
        self.seconds, self.held, self.timer = seconds, {}, None

    def get(self, key, make):
        self._stop()
        if key not in self.held:
            self.held.clear()
            self.held[key] = make()
            give_back()
        return self.held[key]

    def done(self) -> None:
        """A task has ended: if none follows, the object goes."""
        self._stop()
        give_back()
        self.timer = threading.Timer(self.seconds, self._drop)
        self.timer.daemon = True
        self.timer.start()

    def _drop(self) -> None:
        self.held.clear()
        give_back()

    def _stop(self) -> None:
        if self.timer:
            self.timer.cancel()
            self.timer = None


@functools.cache
def one_blas_thread() -> None:
    """Matrix products of a worker on its task's one core: more threads than cores only wait for each other. No library found: no change."""
    np.ones(1) @ np.ones(1)
    try:
        with open("/proc/self/maps") as f:
            found = sorted(set(re.findall(r"/\S*openblas\S*\.so\S*", f.read())))
    except OSError:
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


#: Copies of a small side in a spread join: rows of a hot key meet in so many tasks.
SPREAD = 16


def spread_join(big: DataFrame, small: DataFrame, key: str, small_key: str, by: str, how: str = "inner") -> DataFrame:
    """big joined with small (a row for each small_key), where rows of one key go to SPREAD tasks, dealt by a hash of ``by``.

    Both keys are in the result. Nothing is gathered, and small is repeated SPREAD times, whatever the data.
    """
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = big.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    return dealt.join(copies, (F.col(key) == F.col(small_key)) & (F.col("_slot") == F.col("_copy")), how).drop("_slot", "_copy")


def sorted_groups(batches, keys: tuple[str, ...]):
    """Tables of the rows that agree in the keys, of batches sorted by them; only the present group is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = (np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist()
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in keys):
            cuts = [0, *cuts]
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Vertices that a task holds before it passes their stars on.
HELD_VERTICES = 500_000


def _forest(batches):
    """Edges of one partition to stars that connect the same: (vertex, smallest vertex), in bounded memory."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def out():
        rows = [(v, r) for v in list(parent) if (r := find(v)) != v]
        parent.clear()
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.record_batch([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["v", "u"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD_VERTICES:
            yield from out()
    yield from out()
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex on an edge but the roots' own; component is the smallest id reachable.

    ``edges``: two long columns; direction, repeats and loops don't matter. Each round contracts what one partition
    knows to stars (v, u) with u < v, joins every u that is above a smaller vertex to the least of those, and so on until
    nothing changes. Rows are keyed by the lower end, which has one row a partition at most, and the join on a hub is
    spread, so a hub is never gathered. Vertices that stand alone are not in the result; a root is there with itself.
    """
    a, b = edges.columns[:2]
    local = lambda df: df.mapInArrow(_forest, "v long, u long")
    now = materialize(local(edges.select(F.col(a).cast("long"), F.col(b).cast("long")).where(f"`{a}` != `{b}`")), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        least = now.groupBy("v").agg(F.min("u").alias("m"))
        # the other ends of v's edges hang below v's least one
        low = now.join(least, "v")
        small = low.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        # and what hangs below a vertex that is no root moves up to that vertex' own
        up = spread_join(small.distinct(), least.select(F.col("v").alias("_at"), F.col("m").alias("_m")), "u", "_at", "v", "left")
        now = materialize(local(up.select("v", F.coalesce("_m", "u").alias("u")).where("v != u")), "edges")
    stars = now.groupBy("v").agg(F.min("u").alias("u"))
    roots = now.select(F.col("u").alias("v")).distinct()
    return stars.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
