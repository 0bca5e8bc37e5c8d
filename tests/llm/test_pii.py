import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import pii

TEXTS = [
    None,
    "",
    "write to a.b@x.example.com or c@d.e, not a@b or a@b..c; a@b.c_d@e.f a@b@c.d %x@y-z.co.uk",
    "hosts 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 255.255.255.255 9999999999.1.1.1",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004, 1 2 3, 0000000000000000000000",
    "call +1 (386) 555-8773 or +49 30 123 or +123456789012345678 +1.2.3 +44 20 7946 0958. é😀 +1 (743) 555-3824",
    'é token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" und version 12345678901234567890',
    "x" * 5000 + "@" + "y" * 3000,
    "1-" * 8000 + "1",
    "a@b.co " * 1500,
    ". +1" * 50,
]


def plain(text):
    text = text or ""
    found = []
    for k, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(pattern, text):
            s, d = m[0], re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in s.split(".")):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card":
                total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            found.append((m.start(), k, kind, m.end()))
    return sorted(found)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        base = ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in want)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (r["doc_id"], base, r["spans"])
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    check(pii.find_pii(docs).collect(), TEXTS)


def test_corpus_and_added_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = pii.find_pii(docs).collect()
    check(rows, texts)
    secrets = {i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    found = {r["doc_id"] for r in rows if "secret:" in r["spans"]}
    assert len(secrets & found) >= 0.9 * len(secrets)
    assert len(found - secrets) <= 0.05 * len(secrets) + 2


def test_reliabilities_follow_the_votes(spark):
    # labeler 0 always agrees with labeler 1; labeler 3 votes at random
    rows = []
    for truth in (1, 2):
        for v3 in (1, 2):
            rows.append((((truth * 3 + truth) * 3 + truth) * 3 + v3, 50))
    em = pii.reliabilities(spark.createDataFrame(rows, "votes int, n long")).first()
    assert em["a"][0] > 0.9 and em["b"][0] < 0.1 and 0.4 < em["a"][3] < 0.6


def test_estimation_and_classifier_equal_plain_ones(spark):
    """EM over vote patterns and naive Bayes over features, against numpy."""
    rng = np.random.default_rng(3)
    truth = rng.random(600) < 0.4
    votes = np.zeros(600, int)
    for right in (0.9, 0.8, 0.7, 0.6):
        agrees = rng.random(600) < right
        v = np.where(rng.random(600) < 0.3, 0, np.where(agrees == truth, 1, 2))
        votes = votes * 3 + v
    features = ((rng.integers(0, 3, 600) * 8 + rng.integers(0, 8, 600)) * 4 + rng.integers(0, 4, 600)) * 8 + np.where(truth, 7, rng.integers(0, 8, 600))
    rows = [(i, [(int(v), int(f))]) for i, (v, f) in enumerate(zip(votes, features, strict=True))]
    found = spark.createDataFrame(rows, "doc_id long, candidates array<struct<votes:int,features:int>>")
    each = np.stack([votes // 27 % 3, votes // 9 % 3, votes // 3 % 3, votes % 3], 1)
    pi, a, b = 0.5, np.full(4, 0.8), np.full(4, 0.2)
    like = lambda p: np.where(each == 1, p, np.where(each == 2, 1 - p, 1.0)).prod(1)
    for _ in range(pii.EM_STEPS):
        r = pi * like(a) / (pi * like(a) + (1 - pi) * like(b))
        pi = (r.sum() + 1) / (len(r) + 2)
        a, b = (((w[:, None] * (each == 1)).sum(0) + 1) / ((w[:, None] * (each > 0)).sum(0) + 2) for w in (r, 1 - r))
    em = pii.reliabilities(spark.createDataFrame([(int(v), 1) for v in votes], "votes int, n long").groupBy("votes").agg({"n": "sum"}).toDF("votes", "n")).first()
    assert abs(em["pi"] - pi) < 1e-9 and np.allclose(em["a"], a) and np.allclose(em["b"], b)
    r = pi * like(a) / (pi * like(a) + (1 - pi) * like(b))
    t, f = r.sum(), (1 - r).sum()
    slots = [features // 256 % 4, features // 32 % 8, features // 8 % 4, features // 4 % 2, features // 2 % 2, features % 2]
    logit = np.log((t + 1) / (f + 1)) + sum(np.log(((r[:, None] * (s[:, None] == s)).sum(0) + 1) / (t + 8) * (f + 8) / (((1 - r)[:, None] * (s[:, None] == s)).sum(0) + 1)) for s in slots)
    assert pii.accepted_features(found) == sorted(set(features[1 / (1 + np.exp(-logit)) >= pii.ACCEPT].tolist()))


def test_added_kinds(spark):
    """Recall and precision of each added kind, planted in shapes that labelers only partly know."""
    rng = random.Random(9)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkABCDEFGH0123456789") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban(good=True):
        body = digits(18)
        check = 98 - int(body + "1314" + "00") % 97
        return f"DE{(check if good else check % 96 + 1):02d}{body}"

    docs, want = [], {}
    for i in range(900):
        kind = ("secret", "iban", "number", None)[i % 4]
        text = {"secret": lambda: f'api key = "{mixed(40) if i % 8 else hexed(40)}"', "iban": lambda: f"please pay to iban {iban()} soon", "number": lambda: f"my phone: ({digits(3)}) {digits(3)}-{digits(4)} thanks", None: lambda: f"version 1.{digits(2)}.{digits(4)}.{digits(2)} of chapter {digits(3)} and {'la' * 12} plus page 10.20.30.40.50"}[kind]()
        docs.append((i, f"Some words before, and {text} and after."))
        want[i] = kind
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind in ("secret", "iban", "number"):
        hits = {i for i, s in got.items() if f"{kind}:" in s}
        true = {i for i, k in want.items() if k == kind}
        assert len(hits & true) >= 0.9 * len(true) and len(hits & true) >= 0.9 * len(hits), (kind, len(hits & true), len(true), len(hits))


def test_overlaps_are_those_of_a_plain_look(spark):
    rng = random.Random(10)
    rows = []
    for i in range(60):
        at, spans = 0, []
        for _ in range(rng.randint(0, 9)):
            at += rng.randint(0, 5)
            spans.append((at, at + rng.randint(1, 6)))
            at = spans[-1][1]
        rows += [(i, spans, (a := rng.randint(0, 40), a + rng.randint(1, 6))) for _ in range(6)]
    df = spark.createDataFrame(rows, "i long, spans array<struct<start:int,end:int>>, c struct<start:int,end:int>")
    for r in df.select("spans", "c", pii.overlaps(F.col("spans"), F.col("c")).alias("got")).collect():
        assert r["got"] == any(s["start"] < r["c"]["end"] and s["end"] > r["c"]["start"] for s in r["spans"])


def test_odd_rows(spark, odd_docs):
    got = pii.find_pii(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r["n_spans"] for r in got} == {0}
    twice = spark.createDataFrame([(1, "a@b.co"), (1, "1.2.3.4"), (None, "a@b.co"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_spans"]) for r in pii.find_pii(twice).collect()) == [(0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (1, 1, 0, 1)]


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
