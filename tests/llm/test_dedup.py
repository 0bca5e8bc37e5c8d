import hashlib
import random
import re

from tarn.llm import exact_dedup as ex
from tarn.llm import substring_dedup as sub

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def test_cuckoo_filter_inserts_deletes_and_resizes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    b = ex.Bucket(places=4)
    for i, k in enumerate(keys):
        b.add(k, i)
    assert b.resizes > 0 and all(b.get(k) == [i, 1] for i, k in enumerate(keys))
    other = [hashlib.sha256(f"o{i}".encode()).digest() for i in range(5000)]
    assert not any(b.get(k) for k in other)
    for k in keys[:2500]:
        assert b.remove(k)
    assert not any(k in b.content for k in keys[:2500]) and all(b.get(k) for k in keys[2500:])
    assert sum(k in b.filter for k in keys[:2500]) < 50
    assert not b.remove(keys[0])
    again = ex.Bucket(dict(b.content), b.filter.places, b.filter.table.tobytes())
    assert all(again.get(k) for k in keys[2500:]) and again.filter.used == b.filter.used == 2500


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(hashlib.sha256(re.sub(SPACE, " ", r["text"] or "").encode()).hexdigest(), []).append(r["doc_id"])
    return {k: (min((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def test_exact_odd_rows(spark, odd_docs, no_docs):
    want = brute_exact(odd_docs.collect())
    got = ex.exact_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]] and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert ex.exact_dedup(no_docs).count() == 0


CHANGES = "op string, doc_id long, seq long, text string"


def test_index_updates(spark):
    """Random insertions and deletions, in several rounds, against a plain multiset."""
    rng = random.Random(7)
    index, live = spark.createDataFrame([], ex.INDEX_SCHEMA), spark.createDataFrame([], ex.LIVE_SCHEMA)
    want: dict[str, list] = {}
    for step in range(3):
        log = []
        for seq in range(300):
            op, doc, text = rng.choice(["insert", "insert", "delete"]), rng.choice([*range(30), None]), rng.choice([f"t{i}" for i in range(40 * (step + 1))] + [None, "a  b", "a\tb"])
            log.append((op, doc, seq, text))
            ids = want.setdefault(re.sub(SPACE, " ", text or ""), [])
            if op == "insert":
                ids.append(doc)
            elif doc in ids:
                ids.remove(doc)
        index, live = ex.update_index(index, live, spark.createDataFrame(log, CHANGES), bucket_keys=1 if step == 1 else 50_000)
        rows = index.collect()
        index, live = spark.createDataFrame(rows, ex.INDEX_SCHEMA), spark.createDataFrame(live.collect(), ex.LIVE_SCHEMA)
        got = {bytes(c["key"]): (c["keep_id"], c["n"]) for r in rows for c in r["content"]}
        least = lambda ids: min((i for i in ids if i is not None), default=None)
        assert got == {hashlib.sha256(t.encode()).digest(): (least(v), len(v)) for t, v in want.items() if v}
        for r in rows:
            b = ex.Bucket({bytes(c["key"]): [c["keep_id"], c["n"]] for c in r["content"]}, r["places"], bytes(r["fingerprints"]))
            assert all(b.get(bytes(c["key"])) for c in r["content"]) and b.filter.used == len(r["content"])
    assert len({r["buckets"] for r in rows}) == 1 and rows[0]["buckets"] > 64


def test_keeper_is_promoted_and_unknown_rows_are_refused(spark):
    def after(index, live, *log):
        index, live = ex.update_index(index, live, spark.createDataFrame([(op, d, i, "x") for i, (op, d) in enumerate(log)], CHANGES))
        index, live = spark.createDataFrame(index.collect(), ex.INDEX_SCHEMA), spark.createDataFrame(live.collect(), ex.LIVE_SCHEMA)
        return index, live, [(c["keep_id"], c["n"]) for r in index.collect() for c in r["content"]]

    index, live, got = after(spark.createDataFrame([], ex.INDEX_SCHEMA), spark.createDataFrame([], ex.LIVE_SCHEMA), ("insert", 1), ("insert", 2), ("insert", 3))
    assert got == [(1, 3)]
    index, live, got = after(index, live, ("delete", 1), ("delete", 777))
    assert got == [(2, 2)]
    index, live, got = after(index, live, ("insert", 9))
    assert got == [(2, 3)]
    # a bucket overflows while it holds stored keys
    many = spark.createDataFrame([("insert", i, i, f"n{i}") for i in range(30_000)], CHANGES)
    index, live = ex.update_index(index, live, many)
    rows = index.collect()
    assert sum(len(r["content"]) for r in rows) == 30_001 and max(r["places"] for r in rows) > 64
    index, live, got = after(spark.createDataFrame(rows, ex.INDEX_SCHEMA), live, ("delete", 2), ("delete", 3), ("delete", 9))
    assert len(got) == 30_000
    same, _ = ex.update_index(index, live, spark.createDataFrame([], CHANGES))
    assert sum(len(r["content"]) for r in same.collect()) == 30_000


def brute_windows(docs, window=20):
    """docs: (doc_id, text) in order -> {doc_id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for doc, text in docs:
        w = re.findall(WORD, text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def random_docs(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 10
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages)[rng.randint(0, 8) :] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.15:
            words += ["ha"] * rng.randint(10, 60)
        docs.append((i, " ".join(words) if rng.random() > 0.05 else None))
    return docs


def test_substring_against_brute_force(spark):
    for seed in range(3):
        docs = random_docs(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.substring_dedup(df).collect()}
        assert got == brute_windows(docs)


def greedy(docs, window=20):
    """Plain greedy parse of one block: at each place the first earlier stand of the window, followed as far as it is the first stand of each next one."""
    first, out = {}, set()
    for doc, text in docs:
        w = re.findall(WORD, text or "")
        at = [first.setdefault(tuple(w[i : i + window]), (doc, i)) for i in range(len(w) - window + 1)]
        i = 0
        while i < len(at):
            if at[i] == (doc, i):
                i += 1
                continue
            k = 1
            while i + k < len(at) and at[i + k] == (at[i][0], at[i][1] + k) and at[i + k] != (doc, i + k):
                k += 1
            out.add((doc, i, k + window - 1, *at[i]))
            i += k
    return out


def test_factors_equal_a_plain_greedy_parse(spark):
    for seed in (11, 12):
        docs = random_docs(seed)
        got = {tuple(r) for r in sub.parse(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
        assert got == greedy(docs)


def test_factors_over_blocks_stand_where_they_say(spark, monkeypatch):
    docs = random_docs(13, 90)
    words = {d: re.findall(WORD, t or "") for d, t in docs}
    gone = {d: set() for d in words}
    for r in sub.parse(spark.createDataFrame(docs, "doc_id long, text string").repartition(9)).collect():
        a, z = r["start"], r["source_start"]
        assert r["words"] >= 20 and (r["source_doc"], z) < (r["doc_id"], a)
        assert words[r["doc_id"]][a : a + r["words"]] == words[r["source_doc"]][z : z + r["words"]]
        gone[r["doc_id"]].update(range(a, a + r["words"]))
    assert {d: len(g) for d, g in gone.items()} == {d: n for d, (_, n, _) in brute_windows(docs).items()}


def test_a_common_line_gathers_nowhere(spark):
    """A 12-word line with other neighbours each time: a block says once that its anchors are shared; results stay right."""
    rng = random.Random(14)
    line = [f"line{i}" for i in range(12)]
    docs = []
    for i in range(400):
        around = [[f"w{rng.randint(0, 3)}" for _ in range(rng.randint(4, 12))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + line + around[1])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.substring_dedup(df).collect()}
    assert got == brute_windows(docs)
    rows = sub.places(df).mapInArrow(sub._emit_phrases(20, 8), sub.ROW_SQL).where("NOT settled").groupBy("anchor").count()
    assert rows.agg({"count": "max"}).first()[0] <= 4 * sub.HOT


def test_the_stream_of_phrases_needs_no_whole_anchor():
    """Batches of any size give the same rows."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(15)
    rows = sorted({(int(rng.integers(0, 30)), int(rng.integers(0, 3)), int(rng.integers(0, 50)), 0, int(rng.integers(0, 9)), 2) for _ in range(300)} | {(3, int(sub.FIRST), 0, 0, 0, 0), (99, 1, 1, 0, 0, 2)})

    def run(step):
        out = []
        for i in range(0, len(rows), step):
            cols = list(zip(*rows[i : i + step], strict=True))
            out.append(pa.record_batch([pa.array([False] * len(cols[0])), *(pa.array(c, f.type) for c, f in zip(cols, list(sub.ROW)[1:], strict=True))], schema=sub.ROW))
        return sorted(tuple(r.values()) for b in sub._match(out) for r in b.to_pylist())

    assert run(1000) == run(1) == run(7) and len(run(1000)) > 200


def test_substring_odd_rows(spark, odd_docs, no_docs):
    got = sub.substring_dedup(odd_docs, keep_text=True).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert 0 <= r["n_removed"] <= r["n_words"] and len(re.findall(WORD, r["kept_text"])) == r["n_words"] - r["n_removed"]
    n = {r["doc_id"]: r for r in got}
    assert n[7]["n_removed"] > 99_000 and n[8]["n_words"] - n[8]["n_removed"] <= 20 and n[5]["n_removed"] == 0
    assert sub.substring_dedup(no_docs).count() == 0
