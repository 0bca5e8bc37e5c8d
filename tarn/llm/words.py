"""Words of texts and hashes of word sequences, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of what isn't \\x20 or \\x09-\\x0D) of a batch in a row, and where each text's words begin and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), kept[offsets]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=U64, count=len(coded.dictionary))
    return of[coded.indices.to_numpy()] if len(words) else np.zeros(0, U64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Sequences:
    """Hashes of any run of words of a batch in constant time."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        base = _BASES[which] | 1
        n = len(hashes)
        self.down = np.full(n + 1, pow(base, -1, 1 << 64), U64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        up = np.full(n + 1, base, U64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, stop)."""
        return scramble((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(U64))


def fixed_runs(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``length`` words that lie in one text, and the text of each."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(len(text)), text
