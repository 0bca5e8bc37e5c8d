"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index.

Fitting takes at most MOST_EXAMPLES labelled documents of each label (those of the least hashes), weighted back to
the labels' true counts. Terms are words and beginnings of words (STEMS letters); the index holds all that LEAST_DF
examples have, whatever their label, and every word of a text is looked up. A term weighs its TF-IDF, by document
frequencies of the whole corpus, times how far its presence depends on the label (standard errors, LEAST_WEIGHT
added). Examples of equal vectors are one exemplar with the sum of their votes. The index holds, for each term,
postings by blocks of exemplars and the largest weight in each block: a block is scored only while the
bound of its cosine reaches what the K-th vote has at least, so the result is the exact one. Postings lie by term and block, and
similar exemplars share blocks, so those of blocks that are ruled out are not read.

Neighbours vote with their cosine; the share of the toxic votes, drawn towards the prior, is calibrated by a logistic
curve fitted on the examples, each scored without its own vote.

Defined cases: null and empty texts, and texts without a term of the index, get the calibrated rate of the examples
without terms; a labelled example that is scored finds itself among its neighbours (only the calibration leaves its
vote out), rows that may not be learned from never do; without any labelled row all scores are 0; repeated doc_ids are
rows of their own; rows with a null label don't count; equal cosines are ordered by exemplar, those of the last rank
all vote; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Kept, bounded_batches, give_back, materialize, one_blas_thread

MOST_EXAMPLES, LEAST_DF, LEAST_WEIGHT, BLOCK, DENSE, K, PRIOR_VOTES, THRESHOLD = 2500, 5, 0.1, 128, 16, 40, 2.0, 0.3
STEMS = (4, 6)
TERM = re.compile(r"[^\W_]+")
BEGINNINGS = [itemgetter(slice(n)) for n in STEMS]


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text, as often as they occur."""
    return TERM.findall((text or "").lower())


def parts(word: str) -> dict[str, None]:
    """The terms of a word: itself and its beginnings."""
    return dict.fromkeys([*(word[:n] for n in STEMS if len(word) >= n), word])


class Vocabulary:
    """The terms of an index by number. Nothing is remembered of the words met."""

    def __init__(self, terms: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}

    def __reduce__(self):
        return Vocabulary, (list(self.terms),)

    def present(self, words: list[str]) -> np.ndarray:
        """The terms in a text's words, each once."""
        get, once = self.terms.get, set(words)
        found = set(map(get, once))
        for beginning in BEGINNINGS:
            # a shorter word's beginning is the word
            found.update(map(get, map(beginning, once)))
        found.discard(None)
        return np.fromiter(found, np.int64, len(found))

    def counts(self, words: list[str] | Counter) -> tuple[np.ndarray, np.ndarray]:
        """The terms in a text's words (or in their counts), ascending, and how often they occur."""
        get, often, none = self.terms.get, Counter(words), repeat(-1)
        size, ways = len(often), 1 + len(STEMS)
        ids = chain(map(get, often, none), *(map(get, map(beginning, often), none) for beginning in BEGINNINGS))
        term = np.fromiter(ids, np.int64, size * ways)
        n = np.tile(np.fromiter(often.values(), np.int64, size), ways)
        length = np.fromiter(map(len, often), np.int64, size)
        known = (term >= 0) & (np.tile(length, ways) > np.repeat((0, *STEMS), size))
        term, n = term[known], n[known]
        order = np.argsort(term, kind="stable")
        term, n = term[order], n[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        return term[first], np.add.reduceat(n, first) if len(first) else n

    def key(self, words: list[str] | Counter) -> bytes:
        """The terms in a text, ascending, and their counts (rows of 32 bits)."""
        return np.array(self.counts(words), np.int32).tobytes()


def held_out(doc_id: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def choose_terms(examples: Iterable[Counter], label: np.ndarray) -> dict[str, float]:
    """Terms that LEAST_DF examples have, and the standard errors by which their share differs between the labels (LEAST_WEIGHT added)."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in zip(examples, label.tolist(), strict=True):
        counts[y].update({t for w in words for t in parts(w)})
    n = np.bincount(label, minlength=2).astype(float)
    if not n.all():
        return {}
    out = {}
    for t in sorted(counts[0].keys() | counts[1].keys()):
        a, b = counts[1][t], counts[0][t]
        if a + b >= LEAST_DF:
            p = (a + b) / n.sum()
            out[t] = LEAST_WEIGHT + abs(a / n[1] - b / n[0]) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n[1] + 1 / n[0]))
    return out


class BlockMaxIndex:
    """Postings by term and block, with the largest weight of each; terms of one in DENSE exemplars or more are columns of a matrix.

    Vectors are dicts, or arrays of terms (ascending) and weights.
    """

    def __init__(self, vectors: Iterable, terms: int, block: int = BLOCK):
        pairs = [(t.astype(np.int32), w) for t, w in map(self.arrays, vectors)]
        self.n, self.block, self.blocks = len(pairs), block, max(1, -(-len(pairs) // block))
        term = np.concatenate([t for t, _ in pairs] or [np.zeros(0, np.int32)])
        ids = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in pairs])
        weights = np.concatenate([w for _, w in pairs] or [np.zeros(0)])
        del pairs
        dense = np.flatnonzero(np.bincount(term, minlength=terms) * DENSE > max(self.n, block))
        self.column = np.full(terms, -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        at = self.column[term]
        self.matrix = np.zeros((len(dense), self.n))
        self.matrix[at[at >= 0], ids[at >= 0]] = weights[at >= 0]
        term, ids, weights = term[at < 0], ids[at < 0], weights[at < 0]
        order = np.argsort(term, kind="stable")
        self.ids, self.weights = ids[order], weights[order]
        cell = term[order].astype(np.int64) * self.blocks + self.ids // block
        del term, ids, weights, order, at
        self.at = np.zeros(terms * self.blocks + 1, np.int32)
        np.cumsum(np.bincount(cell, minlength=terms * self.blocks), out=self.at[1:])
        self.most = np.zeros(terms * self.blocks, np.float32)
        np.maximum.at(self.most, cell, np.nextafter(self.weights.astype(np.float32), np.float32(np.inf)))
        self.most = self.most.reshape(terms, self.blocks)
        self.edges = np.arange(0, max(self.n, 1), block)

    @staticmethod
    def arrays(vector) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(vector, dict):
            terms = sorted(vector)
            return np.array(terms, np.int64), np.array([vector[t] for t in terms], float)
        return vector

    def dense_sums(self, queries: list) -> np.ndarray:
        """For each query, what the terms of the matrix add to the cosines of the exemplars."""
        q = np.zeros((len(queries), len(self.matrix)))
        for row, (terms, weights) in zip(q, map(self.arrays, queries), strict=True):
            at = self.column[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return q @ self.matrix

    def nearest(self, query, votes: np.ndarray, k: float, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exemplars, nearest first, until their votes reach k (with all ties of the last), and their cosines."""
        terms, weights = self.arrays(query)
        base = self.dense_sums([(terms, weights)])[0] if base is None else base
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        bound = weights @ self.most[terms] + (np.maximum.reduceat(base, self.edges) if self.n else 0)
        # weights aren't negative, so the dense part alone bounds the K-th vote's cosine from below
        few = self.n <= k
        least = 0.0 if few else np.partition(base, self.n - int(k))[self.n - int(k)]
        now = np.flatnonzero((bound > 0) & (bound >= least - 1e-12))
        if not len(now):
            return np.zeros(0, np.int64), np.zeros(0)
        # a term's postings lie by block: those of blocks in a row are read together
        cut = np.flatnonzero(np.diff(now) > 3)
        low, high = now[np.append(0, cut + 1)], now[np.append(cut, len(now) - 1)] + 1
        cell = terms[:, None] * self.blocks
        first = self.at[cell + low].ravel()
        n = self.at[cell + high].ravel() - first
        posting = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        w = np.repeat(np.repeat(weights, len(low)), n)
        sums = np.bincount(self.ids[posting], w * self.weights[posting], self.n) + base
        if not few:
            # every exemplar has a vote at least; rows of blocks that were ruled out can only be too low
            least = np.partition(sums, self.n - int(k))[self.n - int(k)]
        found = np.flatnonzero(sums >= max(least - 1e-12, 1e-12))
        cosines = sums[found]
        place = np.lexsort((found, -np.round(cosines, 12)))
        found, cosines = found[place], cosines[place]
        cum = np.cumsum(votes[found])
        if len(cum) and cum[-1] >= k:
            keep = int(np.searchsorted(-cosines, -(cosines[int(np.searchsorted(cum, k))] - 1e-12), "right"))
            found, cosines = found[:keep], cosines[:keep]
        return found, cosines


def alike_together(vectors: Iterable[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK, dims: int = 64) -> np.ndarray:
    """An order that puts similar vectors into one block, so that most blocks are ruled out: halves along the main axis of a random projection."""
    rng, signs = np.random.default_rng(0), np.empty((terms, dims), np.int8)
    for i in range(0, terms, 4096):
        signs[i : i + 4096] = rng.choice([-1.0, 1.0], signs[i : i + 4096].shape)
    x = np.array([w @ signs[t].astype(float) for t, w in vectors]).reshape(-1, dims)
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        y = x[rows] - x[rows].mean(0)
        rows = rows[np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")]
        half = -(-len(rows) // (2 * block)) * block
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_KEPT = Kept()


def _restored(uid: str, packed: bytes) -> ToxicityModel:
    """A shipped model; a worker makes the index once for the tasks that follow each other."""

    def make() -> ToxicityModel:
        model = ToxicityModel.__new__(ToxicityModel)
        model.__dict__.update(pickle.loads(zlib.decompress(packed)))
        # a worker scores only: the examples are in its index
        _ = model.index
        model.order = []
        return model

    return _KEPT.get(uid, make)


class ToxicityModel:
    """keys: of the examples, by Vocabulary.key. The index is made when it is first used, and the driver lets it go after the fit."""

    def __init__(self, vocabulary: dict[str, float], df: dict[str, int], documents: int, keys: list[bytes], ids: list, weight: np.ndarray, label: np.ndarray):
        self.terms = Vocabulary(list(vocabulary))
        self.idf = np.array([(math.log((1 + documents) / (1 + df.get(t, 0))) + 1) * z for t, z in vocabulary.items()])
        groups: dict[bytes, list] = {}
        for key, i, w, y in zip(keys, ids, weight.tolist(), label.tolist(), strict=True):
            g = groups.setdefault(key, [0.0, 0.0, 0, i])
            g[y] += w
            g[2] += 1
        order = sorted(k for k in groups if k)
        order = [order[i] for i in alike_together(map(self.vector, order), len(self.idf))]
        self.votes = np.array([groups[k][2] for k in order], float)
        self.toxic, self.clean = np.array([groups[k][1] for k in order]), np.array([groups[k][0] for k in order])
        self.example = [groups[k][3] for k in order]
        self.uid, self.order = uuid.uuid4().hex, order
        self.scale = max(1e-9, (self.toxic.sum() + self.clean.sum()) / max(1, self.votes.sum()))
        total = weight.sum()
        self.prior = float((weight * label).sum() / total) if total else 0.0
        none = groups.get(b"", [0.0, 0.0, 0, None])
        self.none = (none[1] + PRIOR_VOTES * self.prior) / (none[0] + none[1] + PRIOR_VOTES) if total else 0.0
        self.line = (0.0, 1.0)
        if total:
            own = {k: i for i, k in enumerate(order)}
            memo: dict = {}
            raw = []
            for i, (k, w, y) in enumerate(zip(keys, weight.tolist(), label.tolist(), strict=True)):
                if i % 128 == 0:
                    vectors = [self.vector(x) for x in keys[i : i + 128]]
                    bases = self.index.dense_sums(vectors)
                if (r := memo.get((k, y))) is None:
                    r = memo[k, y] = self.raw(vectors[i % 128], (own.get(k), w, y), bases[i % 128])[0]
                raw.append(r)
            self.line = fit_line(np.array(raw), label, weight)
        self.__dict__.pop("index", None)

    @functools.cached_property
    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(map(self.vector, self.order), len(self.idf))

    def __reduce__(self):
        state = {k: v for k, v in self.__dict__.items() if k != "index"}
        return _restored, (self.uid, zlib.compress(pickle.dumps(state), 1))

    def key(self, words: list[str] | Counter) -> bytes:
        return self.terms.key(words)

    def vector(self, key: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of length 1; nothing of a text without terms."""
        terms, n = np.frombuffer(key, np.int32).reshape(2, -1).astype(np.int64)
        v = (1 + np.log(n)) * self.idf[terms]
        return terms, v / math.sqrt(v @ v) if key else v

    def raw(self, vector: tuple[np.ndarray, np.ndarray], without: tuple | None = None, base: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of the toxic votes, the exemplars and their cosines. without: (exemplar, weight, label) of a vote that doesn't count."""
        if not len(vector[0]) or not len(self.votes):
            return self.none, np.zeros(0, np.int64), np.zeros(0)
        found, cosines = self.index.nearest(vector, self.votes, K, base)
        a, b = self.toxic[found], self.clean[found]
        if without and without[0] is not None:
            (a if without[2] else b)[found == without[0]] -= without[1]
        sure = cosines * cosines
        prior = PRIOR_VOTES * self.scale
        return float((a @ sure + prior * self.prior) / ((a + b) @ sure + prior)), found, cosines

    def scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """Calibrated scores, and the nearest examples as evidence (doc_id:cosine)."""
        vectors = [self.vector(self.key(words_of(t))) for t in texts]
        return [self._score(*x) for x in zip(vectors, self.index.dense_sums(vectors), strict=True)]

    def score(self, key: bytes) -> tuple[float, str]:
        return self._score(self.vector(key), None)

    def _score(self, vector: tuple[np.ndarray, np.ndarray], base: np.ndarray | None) -> tuple[float, str]:
        r, found, cosines = self.raw(vector, None, base)
        r = min(max(r, 1e-6), 1 - 1e-6)
        x = self.line[0] + self.line[1] * math.log(r / (1 - r))
        s = 1 / (1 + math.exp(-x)) if self.prior else 0.0
        return s, ",".join(f"{self.example[i]}:{c:.4f}" for i, c in zip(found[:3].tolist(), cosines[:3].tolist(), strict=True))


def fit_line(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of the logistic curve of labels over the logits of raw shares."""
    r = np.clip(raw, 1e-6, 1 - 1e-6)
    x = np.stack([np.ones(len(r)), np.log(r / (1 - r))], 1)
    w = weight / weight.mean()
    beta = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (label - p)) - 1e-2 * (beta - [0, 1])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def _terms(batches):
    for b in batches:
        words = [Counter(words_of(t)) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "n"])


def _frequencies(terms: list[str]):
    def run(batches):
        known = Vocabulary(terms)
        seen = np.zeros(len(terms), np.int64)
        n = 0
        for b in batches:
            n += b.num_rows
            for t in b.column("text").to_pylist():
                if t:
                    seen[known.present(words_of(t))] += 1
        del known
        give_back()
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(["", *(terms[i] for i in some)]), pa.array([n, *seen[some]], pa.int64())], names=["term", "n"])

    return run


class Examples:
    """Word counts of a table's rows, made anew at each iteration: only the Arrow table is held."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __iter__(self):
        for b in self.table.to_batches(max_chunksize=64):
            for words, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist(), strict=True):
                yield Counter(dict(zip(words, n, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> ToxicityModel:
    """A model from rows of labels (doc_id, toxic) on documents; corpus counts are over all documents."""
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # a row for each doc_id, so that an id of very many rows isn't gathered
    present = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    known = materialize(known.join(present, "doc_id"), "labelled")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.sum("_rows").alias("n")).collect()}
    known = known.drop("_rows")
    asked = None
    for y, n in counts.items():
        ids = known.where(F.col("toxic") == y)
        if n > most:
            ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        asked = ids if asked is None else asked.unionByName(ids)
    if asked is None:
        return ToxicityModel({}, {}, 0, [], [], np.zeros(0), np.zeros(0, int))
    table = docs.select("doc_id", "text").join(asked, "doc_id").mapInArrow(_terms, "doc_id long, toxic int, words array<string>, n array<int>").toArrow()
    table = table.sort_by("doc_id")
    label = table["toxic"].to_numpy()
    of = np.bincount(label, minlength=2)
    weight = np.array([counts.get(y, 0) / max(1, of[y]) for y in (0, 1)])[label]
    examples = Examples(table)
    vocabulary = choose_terms(examples, label)
    known_terms = Vocabulary(list(vocabulary))
    keys, ids = [known_terms.key(words) for words in examples], table["doc_id"].to_pylist()
    del table, examples
    give_back()
    found = docs.select("text").mapInArrow(_frequencies(list(vocabulary)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(found["term"].to_pylist(), found["n"].to_pylist(), strict=True))
    model = ToxicityModel(vocabulary, df, df.get("", 0), keys, ids, weight, label)
    # the driver has no memory to spare for what the fit has needed
    del found, df, keys, ids, vocabulary
    give_back()
    return model


def _score(model: ToxicityModel, threshold: float, names: tuple[str, str, str]):
    def run(batches):
        one_blas_thread()
        try:
            yield from scored(batches)
        finally:
            _KEPT.done()

    def scored(batches):
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 128):
                out += model.scores(b.column("text").slice(i, 128).to_pylist())
            scores = pa.array([s for s, _ in out], pa.float64())
            extra = [pa.array([int(s >= threshold) for s, _ in out], pa.int32()), pa.array([e for _, e in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), scores, *extra], names=[*b.schema.names, *names])

    return run


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, names: tuple[str, str, str] = ("score", "predicted", "evidence")) -> DataFrame:
    """All columns of docs, and score, predicted and evidence under ``names`` (columns that docs has by these names are replaced)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(model, threshold, names), f"{fields}, {names[0]} double, {names[1]} int, {names[2]} string")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from."""
    return labels.where(~held_out())
