import math
import random

import numpy as np

from tarn.llm import embedding_dedup as emb
from tarn.llm import ngram_join as ng
from tarn.llm.common import components


def union(edges, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(60)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == union(edges, ids)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    """10^5 vertices in one row over many partitions, and a task that holds few vertices at a time."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100_000)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(16))
    assert [tuple(r) for r in got.groupBy("component").count().collect()] == [(0, 100_001)]


def test_forest_in_little_memory(monkeypatch):
    import pyarrow as pa

    from tarn.llm import common

    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(350)]
    monkeypatch.setattr(common, "HELD_VERTICES", 10)
    batches = [pa.record_batch([pa.array([a]), pa.array([b])], names=["a", "b"]) for a, b in edges]
    out = [(v, u) for b in common._forest(batches) for v, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    ids = {x for e in edges for x in e}
    assert all(v > u for v, u in out) and union(out, ids) == union(edges, ids)


def shingles(text):
    w = (text or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_jaccard(docs):
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    n = {d: 0 for d in sets}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = union(links, list(sets))
    return {d: (low[d], n[d]) for d in sets}


def near_docs(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 2000)}"
    docs, base = [], [[word() for _ in range(rng.choice([6, 40, 120]))] for _ in range(8)]
    for i in range(150):
        w = list(base[min(rng.randint(0, 12), 7)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    return [*docs, (200, ""), (201, None), (202, "a b"), (203, "a b"), (204, "b a")]


def test_ngram_against_brute_force(spark):
    for seed, tile in ((0, 1024), (1, 16)):
        docs = near_docs(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ng.ngram_join(df, tile=tile, small=8).collect()}
        assert got == brute_jaccard(docs)


def test_ngram_links_in_a_crowd(spark):
    """Pairs just above the threshold that meet only in nodes of more than SMALL sets."""
    rng = random.Random(2)
    docs = []
    for t in range(40):
        shared, at = [f"t{t}-{i}" for i in range(95)], 100 * t
        docs += [(at + i, [*shared, *(f"v{at + i}-{k}" for k in range(5))]) for i in range(90)]
        docs.append((at + 90, [*rng.sample(shared, 89), *(f"x{t}-{k}" for k in range(11))]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ng.ngram_join(df, size=1).collect()}
    # 89 shared words of 111 are 0.802, 95 of 105 are 0.905
    assert got == {i: (i - i % 100, 90) for i, _ in docs}


def test_ngram_recall_under_boilerplate(spark):
    """Every document shares long passages with hundreds that are no copies; near copies are found all the same."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    common = [[word() for _ in range(60)] for _ in range(3)]
    docs = []
    for i in range(0, 900, 3):
        own = [word() for _ in range(rng.choice([40, 80, 160]))]
        text = common[rng.randint(0, 2)] + own + common[rng.randint(0, 2)]
        docs.append((i, " ".join(text)))
        for k in (1, 2):
            changed = list(text)
            for _ in range(rng.choice([1, 2, 4])):
                changed[rng.randrange(len(changed))] = word()
            docs.append((i + k, " ".join(changed)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ng.ngram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    want = brute_jaccard(docs)
    assert sum(n for _, n in want.values()) > 500 and got == want


def test_sketch_estimates():
    """Estimates lie near the similarity, whatever the sizes, and the search in buckets connects what all its pairs connect."""
    rng = np.random.default_rng(6)
    for n in (6, 60, 600, 6000):
        a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10, np.uint64) * np.uint64(2)])
        values, offsets = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
        x, y = ng.sketches(values, offsets)
        estimate = ((x == y) & (x > 0)).sum() / ((x | y) > 0).sum()
        assert abs(estimate - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2
    marks = rng.integers(1, 3, (300, ng.BINS)).astype(np.uint8)
    marks[rng.integers(0, 300, 100)] = marks[rng.integers(0, 300, 100)]
    begin = np.repeat(np.arange(0, 300, 10), 10)
    i, j = ng.bucket_candidates(np.arange(300), begin, marks, 0.55)
    pairs = [(a, b) for a in range(300) for b in range(begin[a], a) if (marks[a] == marks[b]).mean() >= 0.55]
    assert union(list(zip(i.tolist(), j.tolist(), strict=True)), range(300)) == union(pairs, range(300))


def test_ngram_odd_rows(spark, odd_docs, no_docs):
    got = ng.ngram_join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    of = {r["doc_id"]: r for r in got}
    assert of[8]["class_id"] == 7 and of[3]["class_id"] == 3 and of[12]["class_id"] == 3 and of[13]["class_id"] == 4 and of[1]["n_links"] == 0
    assert ng.ngram_join(no_docs).count() == 0


def brute_cosine(rows, threshold):
    ok = {i: v for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= threshold]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = union(links, [i for i, _ in rows])
    return {i: (n[i], low[i], low[i] == i) for i, _ in rows}


def test_embeddings_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = []
    for i in range(220):
        b = base[rng.randrange(12)]
        s = rng.choice([0.0, 0.15, 0.3, 0.6])
        rows.append((i, [float(x + rng.gauss(0, s)) for x in b]))
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] + [1.0] * 23), (303, [None] + [1.0] * 23), (304, [float("inf")] * 24), (305, [1.0, 0.0]), (306, [1.0, 0.1]), (307, [2.0 * x for x in base[0]]), (308, []), (309, [1e30 * x for x in base[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute_cosine(rows, 0.9)
    for floats in (1 << 20, 400):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in emb.embedding_dedup(df, tile_floats=floats).collect()}
        assert got == want
    assert emb.embedding_dedup(df.limit(0)).count() == 0
    assert emb.embedding_dedup(df.where("vec_id = 301")).first()["kept"] is True


def test_embedding_steps_drop_nothing():
    """Accumulated products with suffix bounds against plain ones, in 150 dimensions."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 150)) * np.geomspace(5, 0.1, 150)
    x = emb.unit(np.repeat(base, 10, 0) + rng.normal(size=(200, 150)) * rng.choice([0.0, 0.1, 0.3, 0.6], (200, 1)))
    plan = emb.Plan(x, 7)
    y, steps = x @ plan.rotation, [16, 32, 64, 128, 150]
    rest = np.stack([np.sqrt((y[:, k:] ** 2).sum(1)) for k in steps], 1)
    hit = emb.links_of(x, x, y, y, rest, rest, 0.9, steps)
    assert (hit == (x @ x.T >= 0.9)).all()
    # the tree finds every leaf that a plain look at all boxes finds
    lead = y[:, : plan.axes]
    far = sum(np.maximum(0, np.maximum(plan.low[:, k] - lead[:, k, None], lead[:, k, None] - plan.high[:, k])) ** 2 for k in range(plan.axes))
    want = set(zip(*(v.tolist() for v in np.nonzero(far <= 0.2)), strict=True))
    assert set(zip(*(v.tolist() for v in plan.reach(lead, 0.2)), strict=True)) == want


def test_embeddings_in_one_dense_cluster(spark):
    """Thousands of distinct near copies: one leaf, cut into many tiles."""
    rng = np.random.default_rng(2)
    v = np.ones(8) + rng.normal(size=(6000, 8)) * 0.01
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = emb.embedding_dedup(df, tile_floats=4096).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(5999, 0, 6000)]


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.01], "x"), (None, [1.0, 0.0], "x"), (None, [0.0, 1.0], None), (2, [0.0, -1.0], "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string")
    df = df.withColumns({c: df["row"] for c in ("id", "n", "e", "least", "links", "component", "leaf", "dim")})
    got = sorted((tuple(r) for r in emb.embedding_dedup(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 0, 2, True), (2, 0, 2, True)], key=str)
