"""Near-duplicate embeddings by exact cosine in PCA-ordered tiles.

1. Vectors that are null, zero, or hold null or non-finite components link with nothing. Identical vectors become one
   with a count, so copies are never compared.
2. A rotation by the principal axes of at most SAMPLE unit vectors (those of the least hashes) orders the dimensions.
   The same sample gives a k-d tree over the leading coordinates. Its leaves are cut by a hash into tiles of about
   TILE_FLOATS coordinates, by their true counts, so that neither a dense region nor a table beyond the sample makes a
   tile large.
3. A vector is sent to the pairs of tiles whose other leaf it can reach within the distance that the threshold allows;
   leaves are found by descending the tree.
4. Two tiles are compared in parts: products of the leading dimensions are accumulated step by step (STEPS, then all).
   After each step, what the remaining ones can add is bounded by the product of the suffix norms, and rows and columns
   without a pair that can still reach the threshold are dropped; where none is left the part is done. Comparisons are
   in double precision; cosines within 1e-9 of the threshold are computed anew from the vectors as given.
5. A tile pair returns link counts and a spanning forest of its links, never the pairs.

The rotation and the tree only order the work: any sample gives the same links. Where vectors have no near neighbours
in the leading coordinates every tile meets every other, so a vector crosses the network once for each tile.

Defined cases: vectors of different lengths don't link; repeated vec_ids are vectors of their own which share a row's
id; a null vec_id links like any other and is reported with its component's smallest id, null if it has none; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import components, materialize, one_blas_thread, sorted_groups, spread_join
from tarn.llm.words import scramble

THRESHOLD, TILE_FLOATS, SAMPLE, STEPS, AXES, PART = 0.9, 1 << 20, 20_000, (16, 32, 64, 128, 256), 8, 1024


class Plan:
    """Rotation and tiles for vectors of one length."""

    def __init__(self, sample: np.ndarray, tiles: int, axes: int = AXES):
        d = sample.shape[1]
        if len(sample) > 1:
            _, v = np.linalg.eigh(sample.T @ sample)
            self.rotation = np.ascontiguousarray(v[:, ::-1])
        else:
            self.rotation = np.eye(d)
        self.axes = min(axes, d)
        lead = sample @ self.rotation[:, : self.axes]
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes: list[tuple[int, float, int, int]] = []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, want: int) -> int:
            """Returns the node's number, or ~tile for a leaf."""
            spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(self.axes)
            axis = int(spread.argmax())
            cut = float(np.median(rows[:, axis])) if len(rows) > 1 else 0.0
            if want <= 1 or spread[axis] <= 0 or not (rows[:, axis] < cut).any():
                boxes.append((low, high))
                return ~(len(boxes) - 1)
            at = len(self.nodes)
            self.nodes.append((axis, cut, 0, 0))
            left, right = high.copy(), low.copy()
            left[axis] = right[axis] = cut
            side = rows[:, axis] < cut
            a = grow(rows[side], low, left, (want + 1) // 2)
            b = grow(rows[~side], right, high, want // 2)
            self.nodes[at] = (axis, cut, a, b)
            return at

        self.root = grow(lead, np.full(self.axes, -np.inf), np.full(self.axes, np.inf), tiles)
        self.low, self.high = (np.array(x) for x in zip(*boxes, strict=True))

    @property
    def tiles(self) -> int:
        return len(self.low)

    def tile_of(self, lead: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lead), np.int64)
        todo = [(self.root, np.arange(len(lead)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            else:
                axis, cut, a, b = self.nodes[node]
                left = lead[rows, axis] < cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def reach(self, lead: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) where the row's squared distance to the leaf's box is at most ``most``."""
        rows, leaves = [], []
        # distances so far by axis: beyond a cut, an axis is as far as the farthest cut passed
        todo = [(self.root, np.arange(len(lead)), np.zeros((len(lead), self.axes)))]
        while todo:
            node, at, far = todo.pop()
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), ~node))
                continue
            axis, cut, a, b = self.nodes[node]
            for child, beyond in ((a, lead[at, axis] - cut), (b, cut - lead[at, axis])):
                new = far.copy()
                new[:, axis] = np.maximum(new[:, axis], beyond)
                near = (new * new).sum(1) <= most
                if near.any():
                    todo.append((child, at[near], new[near]))
        return np.concatenate(rows), np.concatenate(leaves)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _leaf(plans: dict[int, Plan]):
    """Rows (id, n, embedding) with their leaf: of which tile a row is follows from the leaf's count."""

    def run(batches):
        one_blas_thread()
        for batch in batches:
            for b, plan, d in _by_length(batch, plans):
                lead = unit(_matrix(b.column("embedding"))) @ plan.rotation[:, : plan.axes]
                leaf = plan.tile_of(lead)
                yield pa.record_batch([pa.array(np.full(len(leaf), d, np.int32)), pa.array(leaf)], names=["dim", "leaf"])

    return run


def _by_length(batch: pa.RecordBatch, plans: dict[int, Plan]):
    for i in range(0, batch.num_rows, 4096):
        b = batch.slice(i, 4096)
        lengths = pa.compute.list_value_length(b.column("embedding")).to_numpy()
        for d in np.unique(lengths).tolist():
            yield b.filter(pa.array(lengths == d)), plans[d], d


def _deal(plans: dict[int, Plan], tiles: dict[int, np.ndarray], threshold: float):
    """Rows (id, n, embedding) to the tile pairs they take part in. tiles: for each length, where the leaves' tiles begin and the last end."""

    def run(batches):
        one_blas_thread()
        for batch in batches:
            for x, plan, d in _by_length(batch, plans):
                lead = unit(_matrix(x.column("embedding"))) @ plan.rotation[:, : plan.axes]
                begin = tiles[d]
                parts = np.diff(begin)
                own = plan.tile_of(lead)
                mixed = scramble(x.column("id").to_numpy().astype(np.uint64)) >> np.uint64(33)
                own = begin[own] + (mixed % parts[own].astype(np.uint64)).astype(np.int64)
                row, leaf = plan.reach(lead, 2 - 2 * threshold + 1e-9)
                # every tile of a reached leaf
                n = parts[leaf]
                tile = np.repeat(begin[leaf], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                first, second = np.minimum(own[row], tile), np.maximum(own[row], tile)
                side = (own[row] == second) & (first != second)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), d, np.int32)), pa.array(first), pa.array(second), pa.array(side), x.column("id").take(take), x.column("n").take(take), x.column("embedding").take(take)],
                    names=["dim", "first", "second", "side", "id", "n", "embedding"],
                )

    return run


def links_of(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, sa: np.ndarray, sb: np.ndarray, threshold: float, steps: list[int]) -> np.ndarray | None:
    """Which rows of a and b (unit vectors) are linked; None: no pair can be.

    y: rotated; s: norms of the dimensions after each step's leading ones (a column a step, the last for all dimensions).
    """
    rows, cols = np.arange(len(a)), np.arange(len(b))
    s, done = 0.0, 0
    for k, stop in enumerate(steps):
        s = s + ya[rows, done:stop] @ yb[cols, done:stop].T
        done = stop
        can = s + np.outer(sa[rows, k], sb[cols, k]) >= threshold - 1e-9
        i, j = can.any(1), can.any(0)
        if not i.any():
            return None
        rows, cols, s = rows[i], cols[j], s[np.ix_(i, j)]
    part = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    if len(i):
        part[i, j] = np.einsum("ij,ij->i", a[rows[i]], b[cols[j]]) >= threshold
    hit = np.zeros((len(a), len(b)), bool)
    hit[np.ix_(rows, cols)] = part
    return hit


def forest(hit: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links of a part connect: each linked vector with the smallest id of its component."""
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    h = hit[np.ix_(rows, cols)]
    la, lb = ids_a[rows], ids_b[cols]
    most = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(h, lb, most).min(1))
        nb = np.minimum(lb, np.where(h.T, na, most).min(1))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    v, u = np.concatenate([ids_a[rows], ids_b[cols]]), np.concatenate([la, lb])
    return v[v != u], u[v != u]


def _compare(plans: dict[int, Plan], threshold: float, part: int):
    """Rows sorted by tile pair and side to (link, a, b): counts of a's links (link false) and edges (link true)."""

    def group(t: pa.Table):
        plan = plans[t["dim"][0].as_py()]
        d = len(plan.rotation)
        steps = [*(k for k in STEPS if k < d), d]
        same = t["first"][0] == t["second"][0]
        side, ids, n = t["side"].to_numpy(), t["id"].to_numpy(), t["n"].to_numpy()
        x = unit(_matrix(t["embedding"]))
        y = x @ plan.rotation
        rest = np.stack([np.sqrt((y[:, k:] ** 2).sum(1)) * (1 + 1e-12) for k in steps], 1)
        left, right = (np.arange(len(t)), np.arange(len(t))) if same else (np.flatnonzero(~side), np.flatnonzero(side))
        counts = np.zeros(len(t))
        edges = []
        for i in range(0, len(left), part):
            a = left[i : i + part]
            for j in range(i if same else 0, len(right), part):
                b = right[j : j + part]
                hit = links_of(x[a], x[b], y[a], y[b], rest[a], rest[b], threshold, steps)
                if hit is None:
                    continue
                if same and i == j:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                counts[a] += hit @ n[b]
                if not (same and i == j):
                    counts[b] += hit.T @ n[a]
                edges.append(forest(hit, ids[a], ids[b]))
        has = np.flatnonzero(counts)
        if len(has):
            yield pa.record_batch([pa.array(np.zeros(len(has), bool)), pa.array(ids[has]), pa.array(counts[has].astype(np.int64))], names=["link", "a", "b"])
        for v, u in edges:
            yield pa.record_batch([pa.array(np.ones(len(v), bool)), pa.array(v), pa.array(u)], names=["link", "a", "b"])

    def run(batches):
        one_blas_thread()
        for t in sorted_groups(batches, ("dim", "first", "second")):
            yield from group(t)

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tile_floats: int = TILE_FLOATS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: row's key, vec_id; distinct: key, id, copies; found: link counts and edges between ids)."""
    e = F.col(embedding)
    number = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(e.isNotNull() & number & F.exists(e, lambda x: x != 0), F.lit(False))
    kind = vectors.schema[embedding].dataType.simpleString()
    x = materialize(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable, e).alias("embedding"), F.monotonically_increasing_id().alias("row")), "vectors")
    # an id of its own for each distinct vector: the least row number of its copies
    distinct = materialize(x.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "distinct")
    counts = {r["d"]: r["c"] for r in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()}
    plans = {}
    for d, c in counts.items():
        some = distinct.where(F.size("embedding") == d).orderBy(F.xxhash64("embedding"), "id").limit(max(2, min(SAMPLE, 4_000_000 // d))).select("embedding").toArrow()
        plans[d] = Plan(unit(_matrix(some["embedding"])), max(1, round(c * d / tile_floats)))
    if not plans:
        return x, distinct, distinct.select(F.lit(True).alias("link"), F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    # a row for each leaf, as many as the sample has at most
    held = distinct.select("embedding").mapInArrow(_leaf(plans), "dim int, leaf long").groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("c")).collect()
    tiles = {}
    for d, plan in plans.items():
        parts = np.ones(plan.tiles, np.int64)
        for r in held:
            if r["dim"] == d:
                parts[r["leaf"]] = max(1, -(-r["c"] * d // (2 * tile_floats)))
        tiles[d] = np.concatenate([[0], np.cumsum(parts)])
    dealt = distinct.select("id", "n", "embedding").mapInArrow(_deal(plans, tiles, threshold), f"dim int, first long, second long, side boolean, id long, n long, embedding {kind}")
    dealt = dealt.repartition("dim", "first", "second").sortWithinPartitions("dim", "first", "second", "side")
    return x, distinct, materialize(dealt.mapInArrow(_compare(plans, threshold, PART), "link boolean, a long, b long"), "links")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile_floats: int = TILE_FLOATS) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    x, distinct, found = embedding_links(vectors, threshold, tile_floats)
    links = found.where("NOT link").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    parts = components(found.where("link").select("a", "b"))
    classes = distinct.select("embedding", "id", "n", "least").join(links, "id", "left").join(parts, "id", "left")
    classes = materialize(classes.select("embedding", "n", "least", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("component", "id").alias("component")), "classes")
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    smallest = smallest.withColumnRenamed("component", "_c")
    named = spread_join(classes.where("n > 1 OR links > 0"), smallest, "component", "_c", "embedding").select(F.col("embedding").alias("e"), "links", "n", "component_id")
    y = spread_join(x, named, "embedding", "e", "row", "left")
    own = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    n_links = F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0).cast("long"))
    return y.select("vec_id", n_links.alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(i, j) AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i AS vec_id, min(j) AS low FROM r GROUP BY 1),
n AS (SELECT i AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, least(e.vec_id, coalesce(low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
