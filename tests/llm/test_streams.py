import hashlib
import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import chat, mixing, packing, toxicity, warc

WORD = r"[^\x20\x09-\x0D]+"


def test_packing_round_trip(spark, odd_docs, no_docs):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()
    ids = {r["doc_id"]: [*full.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, with_ids=True, stream_bytes=200_000).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = np.array(ids[d][at : at + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["ids_crc32"] == zlib.crc32(part) and bytes(p["ids"]) == part
            at += p["length"]
        assert at == len(ids[d])
    pad = total = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else 2048 - at)
    assert pad < 0.03 * total
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs).select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()


def test_best_cuts_are_the_best():
    def brute(s, penalty, size):
        cost = [0.0]
        for i in range(1, len(s)):
            fit = [(cost[j], s[i] - s[j]) for j in range(i) if s[i] - s[j] <= size]
            cost.append(min(c + (0 if n & (n - 1) == 0 else size - n) for c, n in fit) + penalty[i])
        return cost[-1]

    rng = random.Random(0)
    for _ in range(200):
        size = rng.choice([8, 16, 32])
        s = [0]
        for _ in range(rng.randint(1, 30)):
            s.append(s[-1] + rng.randint(1, size // 2))
        penalty = [0.0, *[rng.choice([0.0, 1.0, 4.0]) for _ in s[2:]], 0.0]
        ends = packing.best_cuts(s, penalty, size)
        cost, at = 0.0, 0
        for e in ends:
            n = s[e] - at
            assert 0 < n <= size
            cost, at = cost + (0 if n & (n - 1) == 0 else size - n) + penalty[e], s[e]
        assert ends[-1] == len(s) - 1 and abs(cost - brute(s, penalty, size)) < 1e-9


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "d", None]) if rng.random() < 0.6 else "hot") for i in range(900)]
    rows.append((1000, "one", "tiny"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=1000).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(9), shard_words=1000).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again
    source = {i: s for i, _, s in rows}
    by, total = defaultdict(list), sum(r["size"] for r in got)
    for r in got:
        by[source[r["doc_id"]]].append(r)
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-6 * total
    for x in by.values():
        target = x[0]["target"]
        assert target <= 3 * x[0]["source_size"] and abs(sum(r["taken"] for r in x) - target) <= max(3, 0.02 * target)
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["size"] == len(re.findall(WORD, t or "")) for r, t in zip(sorted(odd, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"])), [x["text"] for x in sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, len(re.findall(WORD, r["text"] or ""))))], strict=True))
    assert mixing.mix(no_docs).count() == 0


def seats_one_by_one(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0, 1, 5, 40, 1000]) * rng.random() for _ in range(rng.randint(1, 9))]
        seats = rng.choice([0, 1, 3, 17, 200]) if any(votes) else 0
        won = seats_one_by_one(votes, seats)
        for i, v in enumerate(votes):
            rows.append((g, i, v, seats))
            want[g, i] = won[i]
    df = spark.createDataFrame(rows, "g int, i int, v double, s long")
    assert {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], "v", "s", ["i"]).collect()} == want


def test_apportion_by_several_columns(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(6):
        votes = [rng.choice([0, 5, 5, 40, 1000]) for _ in range(rng.randint(2, 8))]
        seats = rng.choice([1, 3, 17, 60]) if any(votes) else 0
        for i, (v, w) in enumerate(zip(votes, seats_one_by_one(votes, seats), strict=True)):
            rows.append((g // 2, g % 2, i // 3, i % 3, float(v), seats))
            want[g, i] = w
    df = spark.createDataFrame(rows, "g int, h int, i int, j int, v double, s long")
    out = mixing.apportion(df, ["g", "h"], "v", "s", ["i", "j"])
    assert out.columns == [*df.columns, "quota"]
    assert {(2 * r["g"] + r["h"], 3 * r["i"] + r["j"]): r["quota"] for r in out.collect()} == want


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, "m1", 0, "start", "user", None), (1, "m1", 1, "delta", None, "Hel"), (1, "m1", 2, "delta", None, "lo"), (1, "m2", 3, "start", "assistant", None), (1, "m2", 4, "delta", None, "bad"),
        (1, "m2", 5, "regenerate", None, None), (1, "m2", 6, "delta", None, "go"), (1, "m2", 7, "delta", None, "od"), (1, "m1", 8, "edit", None, "Hi"), (1, "m1", 9, "delta", None, "!"), (1, "m3", 10, "start", "user", None), (1, "m3", 11, "delete", None, None), (None, "m", 1, "delta", None, None),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, message_id string, seq long, kind string, role string, text string")).orderBy("conv_id", "first_seq").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(None, "", ""), (1, "user", "Hi!"), (1, "assistant", "good")]


def test_chat_round_trip(spark, no_docs):
    texts = [None, "", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\/s> <\\\\s> [\\INST]", "<<SYS>> <</SYS>> <<<s>>>", "é😀</s>\n", "a" * 100_000 + "</s>", "\\", "[[INST]]"]
    rows = [(c, t, r, texts[(c + t) % len(texts)]) for c in range(5) for t, r in enumerate(["system", "user", "assistant", "assistant", "us\ner%0A<", None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.summaries(chat.format_chat(df)).collect()}
    for c in range(5):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert got[c]["n_turns"] == 6 and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in chat.format_chat(df).collect():
        assert chat.parse(r["segment"]) == (r["role"], r["text"])
        inner = r["segment"][len(chat.OPEN) : -len(chat.CLOSE) - 1]
        assert not re.search(r"<\|[a-z_]+\|>|\[/?INST\]|</?s>", inner)
    assert chat.summaries(chat.format_chat(df.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "http://c", big), (4, "http://d", None), (5, "http://e", "short"), (6, "http://f", "short"), (3, "http://c2", big), (7, "http://g", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    path = warc.archive(pages, str(tmp_path / "w"))
    got = warc.listing(spark, path).collect()
    raw = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        data = raw[r["page_id"]]
        again = len(data) >= 1000 and r["page_id"] in (1, 2)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))
    one = spark.read.format("warc").load(path).where("record_id = 'urn:page:1'").first()
    assert one["payload"] == b"" and one["target_uri"] == "http://a/%20b%0D%0AX:%20y" and one["payload_length"] == len(raw[1])
    archive_of_none = warc.archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.listing(spark, archive_of_none).count() == 0


def test_warc_of_others(spark, tmp_path):
    import gzip

    rec = warc.record("response", "urn:x:1", "http://a", "ab", b"hello", 5, None)
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec) + gzip.compress(other))
    (tmp_path / "b.warc").write_bytes(rec + other)
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r["record_type"], bytes(r["payload"])) for r in df.collect()) == [("resource", b"abc")] * 2 + [("response", b"hello")] * 2
    assert df.where("record_type = 'resource'").count() == 2


def test_block_max_equals_brute_force():
    rng = random.Random(4)
    vectors = []
    for _ in range(400):
        v = {t: rng.random() for t in rng.sample(range(30), rng.randint(1, 6))}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()})
    index, votes = toxicity.BlockMaxIndex(vectors, 30, block=16), np.ones(400)
    for q in vectors[:60]:
        cos = np.array([sum(q.get(t, 0) * x for t, x in v.items()) for v in vectors])
        kth = np.sort(cos)[::-1][9]
        want = set(np.flatnonzero((cos >= kth - 1e-12) & (cos > 0)).tolist())
        assert set(index.nearest(q, votes, 10)[0].tolist()) == want


def test_toxicity_rare_insults_are_seen(spark):
    """Words that under 1 % of the toxic documents hold, short ones too, have their part in the vectors."""
    rng = random.Random(8)
    text = lambda extra: " ".join([*(f"w{rng.randint(0, 300)}" for _ in range(40)), *extra])
    insults = ["grubblix", "zq", "wonderfulness", *(f"vile{c}norg" for c in "abcdefgh")]
    rows = [(i, text([])) for i in range(2000)] + [(2000 + i, text(["blorp"] if i >= 100 else [insults[i % 11]] * 3)) for i in range(1500)]
    labels = [(i, int(i >= 2000)) for i, _ in rows]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    assert {*insults} <= {*model.terms.terms}
    got = {w: model.score(model.key(toxicity.words_of(text([w] * 3))))[0] for w in insults}
    assert min(got.values()) > model.score(model.key(toxicity.words_of(text([]))))[0], got


def test_toxicity_samples_labels_of_present_documents(spark):
    docs = spark.createDataFrame([(i, "gamma beta" if i % 2 else "alpha beta") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6000)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, most=20).votes.sum() == 40


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        if toxic := rng.random() < 0.2:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vilenorg", "grubblix", "snarfen"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(lab))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    test = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 50 and all(got[i]["predicted"] == y for i, y in labels if i in test)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = toxicity.score(odd_docs, model)
    assert odd.count() == odd_docs.count() and set(odd.columns) == {*odd_docs.columns, "evidence"}
    none = toxicity.fit(docs, lab.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_fit_leaves_the_driver_no_index(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    # the examples' keys are all that is held of them; workers, and whoever scores with it, make the index anew
    assert len(model.order) > 10 and "index" not in vars(model)
    texts = [None, "", *[r["text"] for r in docs.limit(20).collect()]]
    shipped = pickle.loads(pickle.dumps(model))
    assert "index" in vars(shipped) and not shipped.order
    assert shipped.scores(texts) == model.scores(texts)
