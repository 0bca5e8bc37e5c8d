import hashlib
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from tarn.llm import toxicity
from tarn.llm.common import materialize

SF = "/root/testdata/sf0.001"
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stage_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_toxicity_stage_follows_the_model(spark, steps):
    model = toxicity.fit(steps[0], toxicity.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    want = {r["doc_id"] for r in rows(steps[0]) if model.score(model.key(toxicity.words_of(r["text"])))[0] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in rows(steps[1])} == want


def test_exact_stage(steps):
    first = {}
    for r in sorted(rows(steps[1]), key=lambda r: r["doc_id"]):
        first.setdefault(hashlib.sha256(re.sub(SPACE, " ", r["text"] or "").encode()).digest(), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(steps[2])) == sorted(first.values())


def test_near_stage(steps):
    sets = {}
    for r in rows(steps[2]):
        w = re.findall(WORD, r["text"] or "")
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in rows(steps[3])} == {d for d in sets if find(d) == d}


def test_near_stage_tells_rows_of_one_id_apart(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    docs = [(1, a), (1, a + " end"), (5, a + " tail"), (5, b)]
    got = rows(cp.ngram_join_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF))
    assert sorted(r["doc_id"] for r in got) == [1, 5] and (5, b) in {(r["doc_id"], r["text"]) for r in got}


def test_mixing_stage_takes_what_the_plan_says(steps):
    from tarn.llm import mixing

    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(steps[3]).collect() if r["taken"]}
    text = {r["doc_id"]: r["text"] for r in rows(steps[3])}
    got = defaultdict(list)
    for r in rows(steps[4]):
        got[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {d: sum(len(re.findall(WORD, t)) for t in ts) for d, ts in got.items()} == plan
    for d, ts in got.items():
        assert all(text[d].startswith(t) for t in ts) and sum(t != text[d] for t in ts) <= 1


def test_packing_stage_holds_every_token(steps):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for r in rows(steps[4]):
        want[r["doc_id"]] += len(full.encode(r["text"], add_special_tokens=False).ids) + 1
    have, sequences = defaultdict(int), defaultdict(int)
    for r in rows(steps[5]):
        have[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    assert have == want and max(sequences.values()) <= 2048
    one = [r for r in rows(steps[5]) if r["length"] == r["doc_tokens"]][0]
    texts = [r["text"] for r in rows(steps[4]) if r["doc_id"] == one["doc_id"]]
    assert one["ids_crc32"] in {zlib.crc32(np.array([*full.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts}


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            assert name == "packing" or out.columns == df.columns
            assert n or df is no_docs
    once = cp.exact_dedup_stage(spark, odd_docs, SF).collect()
    keys = [re.sub(SPACE, " ", r["text"] or "") for r in once]
    assert len(keys) == len(set(keys))
