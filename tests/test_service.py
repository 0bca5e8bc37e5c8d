import pytest
from pyspark.sql import functions as F

from tarn.functions import tokens
from tarn.operators import embed
from tarn.sources import files


def test_tokens(spark):
    t = tokens.sign({"sub": "a", "exp": 100}, "secret")
    assert tokens.verify(t, "secret", 50) == {"sub": "a", "exp": 100}
    assert tokens.verify(t, "other", 50) is None and tokens.verify(t, "secret", 101) is None and tokens.verify("x.y", "secret") is None and tokens.verify(None, "secret") is None
    got = spark.createDataFrame([(t,), ("no",), (None,)], "t string").select(tokens.verified(F.col("t"), "secret", 50).alias("p")).collect()
    assert [r["p"] for r in got] == ['{"exp": 100, "sub": "a"}', None, None]


def test_embedding_cache_asks_for_misses_only(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    empty = spark.createDataFrame([], "key string, value array<float>")
    first, cache = embed.embed_cached(rows, empty, embed.HashEmbedder)
    got = {r["id"]: r["embedding"] for r in first.collect()}
    assert got[1] == got[2] != got[3] and cache.count() == 3
    cache = spark.createDataFrame(cache.collect(), "key string, value array<float>")

    class Broken:
        def embed_texts(self, texts):
            raise AssertionError("nothing is missing")

    again, _ = embed.embed_cached(rows, cache, Broken)
    assert {r["id"]: r["embedding"] for r in again.collect()} == got


def test_each_text_is_embedded_once(spark, tmp_path):
    log = str(tmp_path)

    class Counting:
        def embed_texts(self, texts):
            import uuid

            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb")], "id long, text string")
    first, cache = embed.embed_cached(rows, spark.createDataFrame([], "key string, value array<float>"), Counting)
    assert {r["id"]: r["embedding"] for r in first.collect()} == {1: [1.0], 2: [2.0], 3: [2.0]} and cache.count() == 2 and first.count() == 3
    assert sorted(t for p in tmp_path.iterdir() for t in p.read_text().split("\n") if t) == ["a", "bb"]


def test_transient_failures_are_repeated_and_others_not():
    class Flaky:
        def __init__(self, fails, error):
            self.fails, self.error, self.calls = fails, error, 0

        def embed_texts(self, texts):
            self.calls += 1
            self.fails -= 1
            if self.fails >= 0:
                raise self.error("quota")
            return [{"embedding": [1]} for _ in texts]

    pace = lambda: embed.Pace(wait=0)
    assert embed.Paced(Flaky(2, embed.Transient), pace=pace()).embed_texts(["a"] * 3) == [[1.0]] * 3
    with pytest.raises(embed.Transient):
        embed.Paced(Flaky(9, embed.Transient), pace=pace()).embed_texts(["a"])
    bad = Flaky(9, ValueError)
    with pytest.raises(ValueError):
        embed.Paced(bad, pace=pace()).embed_texts(["a"])
    assert bad.calls == 1
    now, slept = [0.0], []
    slow = embed.Pace(gap=6.5, clock=lambda: now[0], sleep=slept.append)
    embed.Paced(Flaky(0, ValueError), size=1, pace=slow).embed_texts(["a", "b"])
    assert slept == [0.0, 6.5]


def test_scan_prunes_and_tree_is_bounded(spark, tmp_path):
    for p in ("a/x.py", "a/y.txt", "node_modules/z.js", "b/w.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r["path"] for r in files.scan_tree(spark, str(tmp_path)).collect()) == ["a/x.py", "b/w.go"]
    assert files.scan_tree(spark, str(tmp_path), False).count() == 3
    many = spark.range(9).select(F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("path"))
    lines = [r["line"] for r in files.directory_tree(many, per_dir=3).orderBy("tree_path").collect()]
    assert lines == ["d/", "  f0", "  f1", "  f2", "  ... (6 more)"]


def test_graph_json_round_trip(spark):
    nodes = spark.createDataFrame([("a", "module", 1)], "id string, type string, seq long")
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, type string")
    n, e = files.graph_from_json(files.graph_to_json(nodes, edges), "id string, type string, seq long", "src string, dst string, type string")
    assert n.collect() == nodes.collect() and e.collect() == edges.collect()


def test_git_log(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "README.md").write_text("hi")
    run("add", ".")
    run("commit", "-qm", "first\n\nbody")
    chunks = files.commit_chunks(files.git_log(spark, str(tmp_path))).collect()
    assert len(chunks) == 1 and "Message: first" in chunks[0]["content"]
