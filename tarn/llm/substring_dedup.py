"""Substring dedup by relative Lempel-Ziv parsing: in each block greedily, across blocks through an index of all blocks.

The reference of a document is all text before it (smaller doc_id, or the same document further left). A factor is a
run of WINDOW words or more that stands in that reference at a known place; its words are removed.

1. A block is what a task holds (BLOCK_WORDS words). Its index maps every WINDOW consecutive words to their first place.
   Each document, in order, is parsed greedily against the block's text before it: a factor begins at the first window
   that the index has earlier, takes the first place as its source, and goes on as long as the source does. The next
   factor may begin inside the last WINDOW - 1 words of one, so windows across a factor's boundary are looked up too.
2. What a block has first is offered to all blocks as phrases: runs of windows that share one content-defined anchor
   (the least hash of ANCHOR consecutive words in the window), which is the same wherever the windows stand. The index
   of all blocks maps anchors to phrases. Of equal phrases all but the first are factors, with the first as source.
3. First phrases whose anchor has others too may meet a factor's boundary: these are looked up window by window. So is
   every phrase of an anchor that has more than HOT phrases in a block; the block then tells the index only that the
   anchor is shared, so no task gathers the phrases of a common line.
4. Pieces of factors that go on where the one before ends, in text and source, are joined (``parse``).

A parse of every document against every block would give the same words and cost blocks times documents; the index
finds the blocks that a phrase has in common with others. Equality is decided on two independent 64-bit hashes.

Defined cases: a null text has no words; documents of less than WINDOW words lose nothing; rows that share doc_id
and text are one document and share its result; rows that share only doc_id are ordered by a hash of the text; a
null doc_id comes last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialize
from tarn.llm.words import Sequences, fixed_runs, scramble, split_words, word_hashes

WINDOW, ANCHOR = 20, 8
LAST = (1 << 63) - 1
#: Words of a block, windows that a task settles before it sends them, and phrases of an anchor in a block beyond which it is common.
BLOCK_WORDS, HELD, HOT = 1_000_000, 1_000_000, 8
#: settled: whole (n > 0; anchor and phrase are the source's doc and place) or to be asked (n < 0). Else a phrase, or a shared anchor's mark (n = 0).
ROW = pa.schema([("settled", pa.bool_()), ("anchor", pa.int64()), ("phrase", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])
ROW_SQL = "settled boolean, anchor long, phrase long, doc long, th long, pos int, n int"
FIRST = np.iinfo(np.int64).min


def phrases(hashes: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, phrase hash, text, start (of its first window) and windows of each phrase of a batch."""
    grams, gram_text = fixed_runs(offsets, anchor)
    wins, win_text = fixed_runs(offsets, window)
    seq = Sequences(hashes, 0)
    if not len(wins):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    mark = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    mark[grams] = seq.of(grams, grams + anchor)
    best, where = mark[wins], wins.copy()
    for k in range(1, window - anchor + 1):
        other = mark[wins + k]
        less = other < best
        best = np.where(less, other, best)
        where = np.where(less, wins + k, where)
    new = np.ones(len(wins), bool)
    new[1:] = (where[1:] != where[:-1]) | (win_text[1:] != win_text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(wins)))
    start = wins[at]
    whole = Sequences(hashes, 1).of(start, start + n + window - 1)
    shift = (where[at] - start).astype(np.uint64)
    return best[at], scramble(whole + shift), win_text[at], start - offsets[win_text[at]], n


def _rows(settled, anchor, phrase, doc, th, pos, n):
    for i in range(0, len(anchor), 200_000):
        s = slice(i, i + 200_000)
        yield pa.record_batch([pa.array(np.full(len(anchor[s]), settled)), pa.array(anchor[s].view(np.int64)), pa.array(phrase[s].view(np.int64)), pa.array(doc[s]), pa.array(th[s]), pa.array(pos[s].astype(np.int32)), pa.array(n[s].astype(np.int32))], schema=ROW)


def first_places(hashes: np.ndarray, wins: np.ndarray, window: int) -> np.ndarray:
    """For each window, the number of the first window of the same words."""
    h, g = Sequences(hashes, 0).of(wins, wins + window), Sequences(hashes, 1).of(wins, wins + window)
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    if (same != (h[order][1:] == h[order][:-1])).any():
        order = np.lexsort((np.arange(len(h)), g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, int)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    return out


def block_factors(hashes: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy parse of a block's texts against the text before: (start, windows, start of the source) of each factor, and which windows are in one."""
    wins, text = fixed_runs(offsets, window)
    source = first_places(hashes, wins, window)
    found = source != np.arange(len(wins))
    at = np.flatnonzero(found)
    # a factor goes on while its next window stands right after the one before, in the text and in the source
    on = (np.diff(at) == 1) & (text[at[1:]] == text[at[:-1]]) & (wins[source[at[1:]]] == wins[source[at[:-1]]] + 1) & (text[source[at[1:]]] == text[source[at[:-1]]])
    head = np.flatnonzero(np.concatenate([[True], ~on])) if len(at) else np.zeros(0, int)
    return wins[at[head]], np.diff(np.append(head, len(at))), wins[source[at[head]]], found


def parse_block(parts: list[tuple], window: int, anchor: int):
    """A block's texts (hashes, lengths, doc, th): factors within it, and phrases with something that the block has first."""
    if not parts:
        return
    hashes, length, doc, th = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((th, doc))
    begin = np.cumsum(length) - length
    length, begin, doc, th = length[order], begin[order], doc[order], th[order]
    offsets = np.concatenate([[0], np.cumsum(length)])
    hashes = hashes[np.repeat(begin - offsets[:-1], length) + np.arange(len(hashes))]
    text_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    start, n, source, found = block_factors(hashes, offsets, window)
    text, origin = text_of(start), text_of(source)
    yield from _rows(True, doc[origin], source - offsets[origin], doc[text], th[text], start - offsets[text], n)
    a, p, text, pos, n = phrases(hashes, offsets, window, anchor)
    # phrases come in order of their windows: those that are all in factors need no look elsewhere
    ends = np.cumsum(n)
    seen = np.concatenate([[0], np.cumsum(found)])
    fresh = seen[ends] - seen[ends - n] < n
    a, p, text, pos, n = (x[fresh] for x in (a, p, text, pos, n))
    kinds, of = np.unique(a, return_inverse=True)
    common = (np.bincount(of, minlength=len(kinds)) > HOT)[of]
    yield from _rows(False, *(x[~common] for x in (a, p, doc[text], th[text], pos, n)))
    a, p, text, pos, n = (x[common] for x in (a, p, text, pos, n))
    yield from _rows(True, a, p, doc[text], th[text], pos, -n)
    a = np.unique(a)
    zero = np.zeros(len(a), np.int64)
    yield from _rows(False, a, np.full(len(a), FIRST), zero, zero, zero, zero)


def _emit_phrases(window: int, anchor: int):
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                words, offsets = split_words(b.column("text"))
                parts.append((word_hashes(words), np.diff(offsets), b.column("doc").to_numpy(), b.column("th").to_numpy()))
                held += len(words)
                if held > BLOCK_WORDS:
                    yield from parse_block(parts, window, anchor)
                    parts, held = [], 0
        yield from parse_block(parts, window, anchor)

    return run


def settle(parts: list[tuple]):
    """Windows of one task: the first of equal ones goes on, the others are settled here."""
    if not parts:
        return
    x, y, doc, th, pos, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((pos, th, doc, y, x))
    x, y, doc, th, pos, n = (v[order] for v in (x, y, doc, th, pos, n))
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    yield from _rows(False, *(v[first] for v in (x, y, doc, th, pos, n)))
    yield from _rows(True, *(v[~first] for v in (doc[head], pos[head], doc, th, pos, n)))


def _emit_windows(window: int):
    """Windows of the asked phrases of each document, keyed by two hashes."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                words, offsets = split_words(b.column("text"))
                hashes = word_hashes(words)
                asked = b.column("asked")
                spans = asked.flatten()
                row = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
                n = spans.field("n").to_numpy().astype(np.int64)
                begin = np.repeat(offsets[row] + spans.field("pos").to_numpy(), n)
                start = begin + np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
                text = np.repeat(row, n)
                doc, th = b.column("doc").to_numpy(), b.column("th").to_numpy()
                x, y = Sequences(hashes, 0), Sequences(hashes, 1)
                parts.append((x.of(start, start + window), y.of(start, start + window), doc[text], th[text], start - offsets[text], np.ones(len(start), np.int64)))
                held += len(start)
                if held > HELD:
                    yield from settle(parts)
                    parts, held = [], 0
        yield from settle(parts)

    return run


FOUND = pa.schema([("whole", pa.bool_()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("src_doc", pa.int64()), ("src_pos", pa.int64())])
FOUND_SQL = "whole boolean, doc long, th long, pos int, n int, src_doc long, src_pos long"


def _match(batches):
    """Rows sorted by anchor, phrase and place: later copies are factors; first phrases of a shared anchor are to be asked.

    Rows go by in a stream: of an anchor only its first phrase is held, until another one or a mark shows that it is shared.
    """
    anchor = phrase = doc0 = pos0 = None
    shared, pending = False, None
    for t in batches:
        if not t.num_rows:
            continue
        c = {name: t.column(name).to_numpy(zero_copy_only=False) for name in ROW.names}
        done = c["settled"]
        if done.any():
            n = c["n"][done]
            yield pa.record_batch([n > 0, c["doc"][done], c["th"][done], c["pos"][done], abs(n), c["anchor"][done], c["phrase"][done]], schema=FOUND)
            c = {k: v[~done] for k, v in c.items()}
        size = len(c["anchor"])
        if not size:
            continue
        goes_on = anchor is not None and c["anchor"][0] == anchor
        new = np.concatenate([[not goes_on], c["anchor"][1:] != c["anchor"][:-1]])
        other = new | np.concatenate([[not goes_on or c["phrase"][0] != phrase], c["phrase"][1:] != c["phrase"][:-1]])
        mark = c["n"] == 0
        first = other & ~mark
        group = np.cumsum(new) - new[0]
        several = np.bincount(group, weights=first + 2.0 * mark)
        if goes_on:
            several[0] += 2 if shared else pending is not None
            if pending is not None and several[0] > 1:
                yield pending
                pending = None
        else:
            pending = None
        # places of the first of each phrase; a phrase that goes on from the batch before has its first there
        head = np.maximum.accumulate(np.where(other, np.arange(size), -1))
        src_doc, src_pos = c["doc"][head], c["pos"][head].astype(np.int64)
        if not other[0]:
            src_doc[head < 0], src_pos[head < 0] = doc0, pos0
        out = lambda take, whole: pa.record_batch([np.full(take.sum(), whole), c["doc"][take], c["th"][take], c["pos"][take], c["n"][take], src_doc[take], src_pos[take]], schema=FOUND)  # noqa: B023, E731
        yield out(~other & ~mark, True)
        yield out(first & (several[group] > 1), False)
        anchor, phrase, doc0, pos0 = c["anchor"][-1], c["phrase"][-1], src_doc[-1], src_pos[-1]
        shared = several[-1] > 1
        last = first & (group == group[-1])
        if not shared and last.any():
            pending = out(last, False)


def _matched(rows: DataFrame) -> DataFrame:
    key = F.when(F.col("settled"), F.xxhash64("doc", "pos")).otherwise(F.col("anchor"))
    dealt = rows.withColumn("key", key).repartition("key").drop("key").sortWithinPartitions("settled", "anchor", "phrase", "doc", "th", "pos")
    return dealt.mapInArrow(_match, FOUND_SQL)


def places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, th, pos, n, src_doc, src_pos): n windows from the pos-th word on stand earlier, at src_pos of src_doc."""
    found = materialize(_matched(docs.mapInArrow(_emit_phrases(window, anchor), ROW_SQL)), "phrases")
    asked = found.where("NOT whole").groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "n")).alias("asked"))
    checked = docs.join(asked, ["doc", "th"]).mapInArrow(_emit_windows(window), ROW_SQL)
    return found.where("whole").unionByName(_matched(checked).where("whole")).drop("whole")


def parse(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The factors of each document: doc_id, start, words, source_doc, source_start. Pieces that go on, in text and source, are one factor."""
    from pyspark.sql import Window

    x = factors(places(docs), window, anchor).distinct()
    line = Window.partitionBy("doc", "th", "src_doc", F.col("src_pos") - F.col("pos")).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_end", F.max(F.col("pos") + F.col("n")).over(line))
    x = x.withColumn("_new", F.when(F.col("pos") <= F.col("_end"), 0).otherwise(1))
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_run", F.sum("_new").over(so_far)).groupBy("doc", "th", "src_doc", (F.col("src_pos") - F.col("pos")).alias("_line"), "_run")
    x = x.agg(F.min("pos").cast("long").alias("start"), (F.max(F.col("pos") + F.col("n")) - F.min("pos") + window - 1).cast("long").alias("words"), F.min("src_pos").alias("source_start"))
    id_ = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return x.select(id_("doc").alias("doc_id"), "start", "words", id_("src_doc").alias("source_doc"), "source_start")


def _cut(window: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                words, offsets = split_words(b.column("text"))
                gone = b.column("gone")
                spans = gone.flatten()
                counts = np.diff(gone.offsets.to_numpy())
                row = np.repeat(np.arange(b.num_rows), pa.compute.fill_null(pa.compute.list_value_length(gone), 0).to_numpy() if gone.null_count else counts)
                step = np.zeros(len(words) + 1, np.int64)
                if len(row):
                    begin = offsets[row] + spans.field("pos").to_numpy()
                    np.add.at(step, begin, 1)
                    np.add.at(step, np.minimum(begin + spans.field("n").to_numpy() + window - 1, offsets[row + 1]), -1)
                out = np.cumsum(step[:-1]) > 0
                total = np.diff(offsets)
                lost = np.diff(np.concatenate([[0], np.cumsum(out)])[offsets])
                every = words.to_pylist()
                texts = [" ".join(every[a:z] if not x else [w for w, o in zip(every[a:z], out[a:z], strict=True) if not o]) for a, z, x in zip(offsets[:-1], offsets[1:], lost, strict=True)]
                cols = [b.column("doc_id"), pa.array(total), pa.array(lost), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    cols, names = [*cols, pa.array(texts)], [*names, "kept_text"]
                yield pa.record_batch(cols, names=names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text."""
    x = places(docs)
    gone = factors(x, window, anchor).groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "n")).alias("gone"))
    ids = x.join(gone, ["doc", "th"], "left").select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "text", "gone")
    return ids.mapInArrow(_cut(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p+19], ' ')) AS h FROM w, unnest(range(1, greatest(1, len(ws) - 18))) AS t(p)),
seen AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM seen, range(0, 20) AS t(o)),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
