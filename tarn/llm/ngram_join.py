"""Jaccard self-join of documents' word shingles by chosen paths.

1. Each document's set of shingles (SHINGLE consecutive words, unchanged; all words of a shorter text) gets a 128-bit
   key, paths, and a sketch (the least hash in each of BINS slices, a byte each). Documents of equal sets become one
   class with a count.
2. A run splits all sets by sampled shared tokens (min-hashes, which two sets share with the probability of their
   similarity). A node of at most SMALL sets is a bucket and is split no further; sets that were in a larger node go
   through the runs of the next depth in DEPTHS, up to the last, where a node of any size is a bucket. Each depth has
   coordinates of its own and as many runs as find a pair at the threshold with its share of TARGET_RECALL: a pair is
   lost only if all runs of one depth miss it, and the chances of that add up to 1 - TARGET_RECALL at most (8, 13, 18,
   32 and 68 runs).
3. A small bucket is searched by brute force on the sketches: pairs whose estimate is six standard deviations or more
   below the threshold are no candidates (one true pair in 10^9). Candidates of all runs are merged to blocks, so that
   each text crosses the network once and no pair is compared twice; sets that only share a bucket don't join blocks.
   Within a block all pairs are compared with exact intersections: blocks beyond TILE sets are cut into tiles, and each
   pair of tiles is a task's work.
4. A tile pair returns the link counts of its sets and a spanning forest of its links, never the pairs.

Defined cases: null and empty texts have no shingles and link with nothing; a link joins documents whose Jaccard
similarity is at least the threshold, copies included; rows that share a doc_id are documents of their own that share
an id; a null doc_id is reported as null and never represents a class with other ids; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches, components, give_back, materialize, one_blas_thread, sorted_groups, spread_join
from tarn.llm.words import Sequences, fixed_runs, scramble, split_words, word_hashes

SHINGLE, THRESHOLD, DEPTHS, SMALL, TILE, TARGET_RECALL, SEED, BINS = 5, 0.8, (1, 2, 3, 5, 8), 64, 1024, 0.99998, 1234, 128
#: Pairs of a bucket search, and texts, that are held at a time.
PAIRS, ROWS = 25_000, 250
#: Depths whose paths are made with the first look at a text; those of the others only for sets that get there.
EARLY = 3


def runs_for(threshold: float, recall: float = TARGET_RECALL, depth: int = DEPTHS[0]) -> int:
    """Runs that find a pair at the threshold with the target recall, where one run finds it with threshold ** depth."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch's texts in a row, and where each text's begin and the last ends."""
    words, offsets = split_words(texts)
    hashes = word_hashes(words)
    seq = Sequences(hashes)
    starts, text = fixed_runs(offsets, size)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < size))
    values = np.concatenate([seq.of(starts, starts + size), seq.of(offsets[short], offsets[short + 1])])
    text = np.concatenate([text, short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(offsets)))


def level_runs(threshold: float, recall: float, depth: int) -> int:
    """Runs of one depth: each depth may lose an equal part of what the recall leaves."""
    return runs_for(threshold, 1 - (1 - recall) / len(DEPTHS), depth)


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int, seed: int = SEED) -> np.ndarray:
    """Min-hashes (rows of 32 bits) of sets that aren't empty."""
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 1 << 63, coordinates, np.uint64)
    for k in range(coordinates):
        x = values * factors[k] + adds[k]
        x ^= x >> np.uint64(32)
        out[:, k] = (np.minimum.reduceat(x * factors[k - 1], offsets[:-1]) >> np.uint64(32)).astype(np.uint32)
    return out


def run_paths(values: np.ndarray, offsets: np.ndarray, runs: int, depth: int) -> pa.ListArray:
    """For each set that isn't empty, a hash of the run and its tokens for every run of a depth."""
    tokens = signatures(values, offsets, runs * depth, SEED + depth)
    paths = np.tile(scramble(np.arange(runs, dtype=np.uint64) + np.uint64(depth << 32)), (len(tokens), 1))
    for k in range(depth):
        paths = scramble(paths + tokens[:, k::depth])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, runs), pa.int32()), pa.array(paths.view(np.int64).ravel()))


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least hash of each slice of the hash space as a byte (0: the slice is empty). values: ascending within each set."""
    out = np.zeros((len(offsets) - 1, BINS), np.uint8)
    text = np.repeat(np.arange(len(out)), np.diff(offsets))
    slice_ = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (slice_[1:] != slice_[:-1]) | (text[1:] != text[:-1])
    out[text[first], slice_[first]] = np.maximum(1, (values[first] >> np.uint64(40)) & np.uint64(0xFF))
    return out


def least_estimate(threshold: float) -> float:
    """Estimates of pairs at the threshold fall below this once in 10^9 times."""
    return max(0.0, threshold - 6 * math.sqrt(threshold * (1 - threshold) / BINS))


def bucket_candidates(ids: np.ndarray, begin: np.ndarray, marks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs of candidates connect. begin: for each row, where its bucket begins."""
    before = np.arange(len(ids)) - begin
    some = [np.zeros((2, 0), np.int64)]
    ends = np.searchsorted(np.cumsum(before), np.arange(PAIRS, max(1, before.sum()) + PAIRS, PAIRS), "right")
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        n = before[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = begin[i] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = marks[i], marks[j]
        union = ((x | y) != 0).sum(1)
        good = ((x == y) & (x != 0)).sum(1) >= least * union
        some.append(np.stack([i[good], j[good]]))
    i, j = np.concatenate(some, 1)
    # a bucket's sets that are like its first one need no edges among themselves
    star = np.zeros(len(ids), bool)
    star[i[j == begin[i]]] = True
    star[begin] = True
    keep = (j == begin[i]) | ~(star[i] & star[j])
    return ids[i[keep]], ids[j[keep]]


def _search(least: float):
    """Rows (path, id, sketch) sorted by path to edges (id, leader) of each bucket's candidates."""

    def edges(t: pa.Table, full: int):
        path = t["path"].to_numpy()[:full]
        new = np.flatnonzero(np.diff(path, prepend=~path[:1]) != 0)
        begin = np.repeat(new, np.diff(np.append(new, full)))
        marks = np.frombuffer(b"".join(t["sketch"].slice(0, full).to_pylist()), np.uint8).reshape(full, BINS)
        a, b = bucket_candidates(t["id"].to_numpy()[:full], begin, marks, least)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["id", "leader"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            path = held["path"].to_numpy()
            last = int(np.searchsorted(path != path[-1], False)) if path[0] == path[-1] else int(np.flatnonzero(path != path[-1])[-1]) + 1
            if last:
                yield from edges(held, last)
                held = held.slice(last)
        if held is not None and len(held):
            yield from edges(held, len(held))
        held = None
        give_back()

    return run


def _sign(size: int, runs: list[int]):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                values, offsets = shingle_sets(b.column("text"), size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                keys, marks = [None] * b.num_rows, [None] * b.num_rows
                paths = [pa.nulls(b.num_rows, pa.list_(pa.int64()))] * len(runs)
                if len(full):
                    begin = offsets[:-1][full]
                    ends = np.append(begin, offsets[-1])
                    x = np.add.reduceat(scramble(values), begin)
                    y = np.add.reduceat(scramble(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                    for k, p, q, m in zip(full.tolist(), x.tolist(), y.tolist(), sketches(values, ends), strict=True):
                        keys[k], marks[k] = p.to_bytes(8, "little") + q.to_bytes(8, "little"), m.tobytes()
                    at = np.full(b.num_rows, -1)
                    at[full] = np.arange(len(full))
                    paths = [run_paths(values, ends, r, d).take(pa.array(at, mask=at < 0)) for r, d in zip(runs, DEPTHS, strict=False)]
                yield pa.record_batch([b.column("doc_id"), b.column("th"), b.column("row"), pa.array(keys, pa.binary()), pa.array(n), pa.array(marks, pa.binary()), *paths], names=["doc_id", "th", "row", "set_key", "set_size", "sketch", *(f"paths{d}" for _, d in zip(runs, DEPTHS, strict=False))])
            give_back()

    return run


def _deeper(size: int, runs: int, depth: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                values, offsets = shingle_sets(b.column("text"), size)
                yield pa.record_batch([b.column("id"), run_paths(values, offsets, runs, depth)], names=["id", "paths"])

    return run


def candidates(classes: DataFrame, docs: DataFrame, size: int, threshold: float, recall: float, small: int) -> DataFrame:
    """(id, leader): edges between the sets that are to be compared. docs: doc_id, text, th."""
    crowd, texts, out = None, None, None
    for level, d in enumerate(DEPTHS):
        last = level == len(DEPTHS) - 1
        if level < EARLY:
            x = classes if crowd is None else classes.join(crowd, "id", "left_semi")
            paths = x.select("id", F.col(f"paths{d}").alias("paths"))
        else:
            if texts is None:
                named = classes.join(crowd, "id", "left_semi").select("id", F.col("doc_id").alias("_doc"), F.col("th").alias("_th"))
                texts = docs.join(named, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "text")
                texts = materialize(texts, "crowded")
            else:
                texts = texts.join(crowd, "id", "left_semi")
            # rows that repeat a document bring its set again
            deeper = texts.mapInArrow(_deeper(size, level_runs(threshold, recall, d), d), "id long, paths array<long>")
            paths = materialize(deeper.dropDuplicates(["id"]), "deeper")
        rows = paths.select("id", F.explode("paths").alias("path"))
        leaf = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).where("n > 1")
        met = materialize(rows.join(leaf, "path"), f"met{d}")
        bucket = met.where(F.col("n") <= small).select("id", "path").join(classes.select("id", "sketch"), "id")
        bucket = bucket.repartition("path").sortWithinPartitions("path")
        edges = bucket.mapInArrow(_search(least_estimate(threshold)), "id long, leader long")
        large = met.where(F.col("n") > small)
        if last:
            edges = edges.unionByName(large.where("id != leader").select("id", "leader"))
        # written, as a task that went on to components would keep a second Python worker
        edges = materialize(edges, "edges")
        out = edges if out is None else out.unionByName(edges)
        crowd = materialize(large.select("id").distinct(), "crowd")
        if last or crowd.isEmpty():
            return out


def intersections(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the common parts of the sets ``rows`` and the sets ``cols`` (numbers of sets in values)."""
    sets = np.unique(np.concatenate([rows, cols]))
    n = np.diff(offsets)[sets]
    begin = offsets[sets]
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    token, owner = values[at], np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    df = np.diff(np.append(first, len(token)))
    i, j = np.searchsorted(sets, rows), np.searchsorted(sets, cols)
    to_row, to_col = np.full(len(sets), -1), np.full(len(sets), -1)
    to_row[i], to_col[j] = np.arange(len(rows)), np.arange(len(cols))
    out = np.zeros((len(rows), len(cols)), np.float32)
    for d in np.unique(df[(df > 1) & (df <= 16)]).tolist():
        who = owner[first[df == d][:, None] + np.arange(d)]
        a, b = np.repeat(to_row[who], d, 1).ravel(), np.tile(to_col[who], (1, d)).ravel()
        ok = (a >= 0) & (b >= 0)
        out += np.bincount(a[ok] * len(cols) + b[ok], minlength=out.size).reshape(out.shape).astype(np.float32)
    many = np.flatnonzero(df > 16)
    for c in range(0, len(many), 2048):
        part = many[c : c + 2048]
        x = np.zeros((len(sets), len(part)), np.float32)
        size = df[part]
        where = np.repeat(first[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x[owner[where], np.repeat(np.arange(len(part)), size)] = 1
        out += x[i] @ x[j].T
    return out


def _compare(size: int, threshold: float):
    from tarn.llm.embedding_dedup import forest

    def group(t: pa.Table):
        # rows that repeat a document bring its set again
        _, once = np.unique(np.stack([t["id"].to_numpy(), t["side"].to_numpy()]), axis=1, return_index=True)
        if len(once) < len(t):
            t = t.take(pa.array(np.sort(once))).combine_chunks()
        ids, copies, side = t["id"].to_numpy(), t["copies"].to_numpy(), t["side"].to_numpy()
        same = t["first"][0] == t["second"][0]
        values, offsets = shingle_sets(t["text"], size)
        n = np.diff(offsets)
        left, right = (np.arange(len(t)), np.arange(len(t))) if same else (np.flatnonzero(~side), np.flatnonzero(side))
        if len(left) * len(right) <= same:
            return
        common = intersections(values, offsets, left, right)
        hit = common >= threshold * (n[left][:, None] + n[right][None, :] - common) * (1 - 1e-6)
        i, j = np.nonzero(hit)
        c = np.rint(common[i, j]).astype(np.int64)
        union = n[left[i]] + n[right[j]] - c
        good = c >= threshold * union - 1e-9 * union
        hit[i[~good], j[~good]] = False
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        counts = np.zeros(len(t), np.int64)
        counts[left] += np.where(hit, copies[right][None, :], 0).sum(1)
        if not same:
            counts[right] += np.where(hit, copies[left][:, None], 0).sum(0)
        has = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.zeros(len(has), bool)), pa.array(ids[has]), pa.array(counts[has])], names=["link", "a", "b"])
        v, u = forest(hit, ids[left], ids[right])
        yield pa.record_batch([pa.array(np.ones(len(v), bool)), pa.array(v), pa.array(u)], names=["link", "a", "b"])

    def run(batches):
        one_blas_thread()
        for t in sorted_groups(batches, ("block", "first", "second")):
            yield from group(t)
        give_back()

    return run


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = TARGET_RECALL, small: int = SMALL, tile: int = TILE, rows: bool = False) -> DataFrame:
    """A row for each document: doc_id, class_id (smallest doc_id reachable by links), n_links, set_id (smallest doc_id of its set).

    rows: also th (xxhash64 of the text) and component (a number of the class, null where nothing is linked).
    """
    bounded_batches(docs.sparkSession)
    runs = [level_runs(threshold, recall, d) for d in DEPTHS[:EARLY]]
    made = ["sketch", *(f"paths{d}" for d in DEPTHS[:EARLY])]
    text = F.coalesce("text", F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    # rows get numbers, so that repeated and null doc_ids are told apart
    schema = "doc_id long, th long, row long, set_key binary, set_size long, sketch binary, " + ", ".join(f"{c} array<long>" for c in made[1:])
    signed = materialize(x.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sign(size, runs), schema), "signed")
    keyed = signed.where("set_key IS NOT NULL")
    classes = keyed.groupBy("set_key").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    classes = materialize(classes.join(keyed.select(F.col("row").alias("id"), "doc_id", "th", *made), "id"), "classes")
    blocks = components(candidates(classes, x, size, threshold, recall, small))
    blocks = materialize(blocks.withColumnRenamed("component", "block"), "blocks")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("of"))
    tiles = F.ceil(F.col("of") / tile).cast("int")
    member = spread_join(blocks, sizes.withColumnRenamed("block", "_b"), "block", "_b", "id").select("id", "block", tiles.alias("tiles"), F.pmod(F.xxhash64("id"), tiles).cast("int").alias("own")).join(classes.select("id", "copies", F.col("doc_id").alias("_doc"), F.col("th").alias("_th")), "id")
    texts = x.join(member, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "text", "block", "tiles", "own", "copies")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("first"), F.greatest(F.col("own"), j).alias("second"), (F.col("own") > j).alias("side"))))
    dealt = texts.select("id", "text", "block", "copies", pair.alias("p")).select("id", "text", "block", "copies", "p.*")
    dealt = dealt.repartition("block", "first", "second").sortWithinPartitions("block", "first", "second", "side")
    found = materialize(dealt.mapInArrow(_compare(size, threshold), "link boolean, a long, b long"), "links")
    links = found.where("NOT link").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    parts = components(found.where("link").select("a", "b"))
    y = classes.select("set_key", "id", "copies", "least").join(links, "id", "left").join(parts, "id", "left")
    y = materialize(y.select("set_key", "copies", "least", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("component", "id").alias("component")), "linked")
    smallest = y.groupBy("component").agg(F.min("least").alias("class_id"))
    smallest = smallest.withColumnRenamed("component", "_c")
    named = spread_join(y.where("copies > 1 OR links > 0"), smallest, "component", "_c", "set_key").select(F.col("set_key").alias("k"), "copies", "least", "links", "class_id", "component")
    z = spread_join(signed.select("doc_id", "set_key", "th", "row"), named, "set_key", "k", "row", "left")
    own = lambda c: F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col(c))
    return z.select("doc_id", own("class_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"), own("least").alias("set_id"), *(["th", "component"] if rows else []))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[p:p+4] END, ' ') AS g FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM b JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j WHERE c >= 0.8 * (p.n + q.n - c)),
r(i, j) AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
low AS (SELECT i AS doc_id, min(j) AS low FROM r GROUP BY 1),
k AS (SELECT i AS doc_id, count(*) AS n_links FROM l GROUP BY 1),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS set_id FROM (SELECT doc_id, string_agg(g, chr(1) ORDER BY g) AS gs FROM s GROUP BY 1))
SELECT w.doc_id, least(w.doc_id, coalesce(low, w.doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(set_id, w.doc_id) AS set_id
FROM w LEFT JOIN low USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id)
"""
