r"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents, in order of doc_id, form streams of about STREAM_BYTES of text (a range partition of the table). Within a
stream the windows' cuts are chosen at document or sentence boundaries so that

    padding of all sequences + SENTENCE_CUT per cut within a document at a sentence's end + HARD_CUT per other cut

is least. A sentence longer than a window may be cut anywhere, at every HARD_STEP tokens. With s(i) the tokens before
boundary i, the best cost is f(i) = penalty(i) + min over s(i) - s(j) <= size of f(j) + size - (s(i) - s(j)): the
least of f(j) + s(j) over a sliding range, which a monotone queue gives in constant time. Sequences whose length is a
power of two are not padded: at most log2(size) further transitions, looked up by place.

Token ids are those of byte_bpe_50k.json. The same vocabulary in tiktoken gives them six times faster; texts that hold
the special token's string or characters beyond the common Latin and punctuation blocks, on whose classes Unicode
versions might differ, go to the tokenizers library itself.

Defined cases: a null or empty text is the end token alone; null doc_ids come last; rows that share a doc_id are
documents of their own in the order of their texts' hashes; a document longer than a stream is one stream's;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Kept

SIZE, END, SENTENCE_CUT, HARD_CUT, HARD_STEP = 2048, 1, 4.0, 24.0, 64
STREAM_BYTES = 24 << 20
#: Above U+024F only general punctuation is taken on the fast way.
RARE = re.compile(r"[^\x00-ɏ‐-‧‰-›€]|<\|endoftext\|>")
_KEPT = Kept()


def tokenizer(name: str = "byte_bpe_50k"):
    """(ids of a text, flags of ids that may end a sentence, flags of ids that may follow it); loaded once for tasks that follow each other."""
    return _KEPT.get(name, lambda: _loaded(name))


def _loaded(name: str) -> tuple:
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(f"{name}.tiktoken"), "rb"))}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(public.path(f"{name}.json"))
    ends, follows = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for raw, i in ranks.items():
        ends[i] = bool(re.fullmatch(rb"[.!?]+[\"')\]]*|[.!?]*\n+", raw))
        follows[i] = raw[:1] in (b" ", b"\n", b"\t", b"\r") or raw[:1].isupper()

    def encode(text: str) -> list[int]:
        if RARE.search(text):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode, ends, follows


def boundaries(ids: np.ndarray, ends: np.ndarray, follows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places within one document (its end token included) where it may be cut, and the penalty of each."""
    at = np.flatnonzero(ends[ids[:-1]] & follows[ids[1:]]) + 1 if len(ids) > 1 else np.zeros(0, np.int64)
    edges = np.concatenate([[0], at, [len(ids)]])
    long = np.flatnonzero(np.diff(edges) > size // 4)
    if not len(long):
        return at, np.full(len(at), SENTENCE_CUT)
    hard = np.concatenate([np.arange(edges[i] + HARD_STEP, edges[i + 1], HARD_STEP) for i in long])
    places = np.concatenate([at, hard])
    order = np.argsort(places, kind="stable")
    return places[order], np.concatenate([np.full(len(at), SENTENCE_CUT), np.full(len(hard), HARD_CUT)])[order]


def best_cuts(s: list[int], penalty: list[float], size: int) -> list[int]:
    """Indexes of the boundaries that end the windows. s: ascending places from 0; neighbours are at most size apart."""
    n = len(s)
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()
    key = [0.0] * n
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    where = {}
    for i in range(n):
        x = s[i]
        if i:
            low = x - size
            while s[queue[0]] < low:
                queue.popleft()
            j = queue[0]
            best = key[j] + size - x
            for p in powers:
                k = where.get(x - p)
                if k is not None and cost[k] < best:
                    best, j = cost[k], k
            cost[i] = best + penalty[i]
            back[i] = j
        key[i] = cost[i] + x
        where[x] = i
        while queue and key[queue[-1]] > key[i]:
            queue.pop()
        queue.append(i)
    out, i = [], n - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack_stream(doc_ids: list, ids_of: list[np.ndarray], first_id: int, size: int, with_ids: bool, cuts_of: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.RecordBatch, int]:
    """Pieces of one stream's documents, given each one's ids (end token included) and inner boundaries, and the number of sequences."""
    lengths = np.array([len(x) for x in ids_of])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    s, penalty = [np.zeros(1, np.int64)], [np.zeros(1)]
    for d, (at, cost) in enumerate(cuts_of):
        s += [at + starts[d], starts[d + 1 : d + 2]]
        penalty += [cost, np.zeros(1)]
    s, penalty = np.concatenate(s), np.concatenate(penalty)
    ends = s[best_cuts(s.tolist(), penalty.tolist(), size)]
    # every window's end and every document's end ends a piece
    edges = np.unique(np.concatenate([[0], ends, starts[1:]]))
    a, b = edges[:-1], edges[1:]
    doc, window = np.searchsorted(starts, a, "right") - 1, np.searchsorted(ends, a, "right")
    begun = np.concatenate([[0], ends])[window]
    first = a - starts[doc]
    data = [ids_of[d][i : i + n].astype("<u4").tobytes() for d, i, n in zip(doc.tolist(), first.tolist(), (b - a).tolist(), strict=True)]
    columns = [pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()), first, b - a, [zlib.crc32(x) for x in data], lengths[doc], first_id + window, a - begun, data if with_ids else [None] * len(data)]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES), len(ends)


def _pack(size: int, with_ids: bool, stream_bytes: int):
    def run(batches):
        try:
            yield from packed(batches)
        finally:
            _KEPT.done()

    def packed(batches):
        from pyspark import TaskContext

        encode, ends, follows = tokenizer()
        held, next_id = 0, TaskContext.get().partitionId() << 32
        docs, ids_of, cuts = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], np.uint16)
                docs.append(doc)
                ids_of.append(ids)
                cuts.append(boundaries(ids, ends, follows, size))
                held += len(text or "")
                if held >= stream_bytes:
                    out, n = pack_stream(docs, ids_of, next_id, size, with_ids, cuts)
                    yield out if with_ids else out.select(PIECES.names[:-1])
                    docs, ids_of, cuts, held, next_id = [], [], [], 0, next_id + n
        if docs:
            out, _ = pack_stream(docs, ids_of, next_id, size, with_ids, cuts)
            yield out if with_ids else out.select(PIECES.names[:-1])

    return run


def pack(docs: DataFrame, size: int = SIZE, with_ids: bool = False, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.select(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    parts = max(1, -(-total // stream_bytes))
    if parts == 1:
        x = x.coalesce(1)
    else:
        x = x.repartitionByRange(int(parts), F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    x = x.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return x.select("doc_id", "text").mapInArrow(_pack(size, with_ids, 2 * stream_bytes), schema)
