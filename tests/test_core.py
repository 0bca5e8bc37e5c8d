import pytest
from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.operators import chunk, graph, incremental, lexical, retrieve, state
from tarn.plans import queries_retrieval
from tarn.sources import parse


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("https://h.org/A/Repo.git", "repo"), ("My-Repo", "my-repo"), ("", "unknown"), ("https://h.org/a/b/", "b")])
def test_repo_slug(spark, given, want):
    assert one(spark, fn.repo_slug("a"), a=given) == want


def test_paths_and_ids(spark):
    assert one(spark, fn.clean_path("a", "/root/x"), a="/root/x/b/c.py") == "b/c.py"
    assert one(spark, fn.clean_path("a"), a=".\\b\\c.py") == "b/c.py"
    assert one(spark, fn.module_name("a"), a="pkg/sub/__init__.py") == "pkg.sub"
    assert one(spark, fn.qualified_name("a", "b", "c"), a="m", b="", c="f") == "m.f"
    assert one(spark, fn.chunk_id("a", "b", "c", "d"), a="a", b="b", c="c", d="1") == "4f5b2fc286a5d623"


def test_tokens(spark):
    assert one(spark, F.array_join(fn.code_tokens("a"), " "), a="getUserName snake_case HTTPServer2x für") == "get user name snake case httpserver 2 x f r"


def test_routing(spark):
    q = "where is `load` used?"
    assert one(spark, fn.intent("a"), a=q) == "function_usage" and one(spark, fn.function_in("a"), a=q) == "load"
    assert one(spark, fn.file_in("a"), a="dependencies of src/a.py, please") == "src/a.py"
    assert one(spark, fn.valid_address("a"), a="https://h/a/b; rm") is False


@pytest.mark.parametrize("n, want", [(300, [0]), (301, [0, 270]), (610, [0, 270, 540])])
def test_windows(spark, n, want):
    assert spark.range(1).select(chunk.windows(F.lit(n), 300, 30).alias("w")).first()["w"] == want


def test_window_must_exceed_overlap():
    with pytest.raises(ValueError):
        chunk.windows(F.lit(5), 30, 30)


def test_bm25_ranks_and_fills(spark):
    docs = spark.createDataFrame([(1, "def load data"), (2, "def save file"), (3, None)], "doc_id long, text string")
    index = lexical.fit(docs)
    got = [(r["doc_id"], r["score"] > 0) for r in lexical.bm25_topk(index, "save", 3).collect()]
    assert got == [(2, True), (1, False), (3, False)]
    assert lexical.bm25_topk(index, "", 2).count() == 2
    assert lexical.bm25_topk(lexical.fit(docs.limit(0)), "save", 2).count() == 0
    twice = {r["key"]: r["score"] for r in lexical.bm25_scores(index, "save save").collect()}
    once = {r["key"]: r["score"] for r in lexical.bm25_scores(index, "save").collect()}
    assert twice.keys() == once.keys() == {2} and abs(twice[2] - 2 * once[2]) < 1e-12


def test_a_question_reads_no_texts(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(100)], "doc_id long, text string")
    plan = lexical.bm25_scores(lexical.fit(docs), "common")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "In(term" in plan or "EqualTo(term" in plan


@pytest.mark.parametrize("name", ["bm25_topk", "graph_aware_retrieve", "graph_expand", "hybrid_candidates", "rerank_funnel", "retrieval_context", "bm25_zero_fill"])
def test_a_fit_takes_the_words_of_a_text_once(spark, monkeypatch, name):
    plans, postings = [], lexical.postings
    monkeypatch.setattr(lexical, "postings", lambda *a: plans.append(x := postings(*a)) or x)
    queries_retrieval.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1
    above, below = plans[0]._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    # a generator's row is a word, so a pattern matched above it or in it is matched once a word
    assert "regexp" not in above + below.split("\n", 1)[0]
    # and no filter below it matches the pattern a second time
    assert not [x for x in below.split("\n") if "Filter" in x and "regexp" in x]


def test_postings_count_runs_of_words(spark):
    docs = spark.createDataFrame([(1, "b a B aB"), (2, ""), (3, None), (4, "x " * 3000 + "y")], "doc_id long, text string")
    got = {tuple(r) for r in lexical.postings(docs).collect()}
    assert got == {("a", 1, 2, 5), ("b", 1, 3, 5), ("x", 4, 3000, 3001), ("y", 4, 1, 3001)}


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, dst string, type string, seq long")


def test_graph(spark):
    e = edges(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "x.y", "imports"), ("x.y", "z", "imports")])
    assert [r["cycle"] for r in graph.simple_cycles(e).collect()] == ["a>b>c>a"]
    assert [r["chain"] for r in graph.import_chains(e, "a").collect()] == ["a>x.y>z"]
    assert sorted(r["path"] for r in graph.call_tree(e.where("type = 'calls'"), "a", 2).collect()) == ["a>b", "a>b>c"]
    nodes = spark.createDataFrame([("x.y", "module", 0)], "id string, type string, seq long")
    assert [r["id"] for r in graph.references(nodes, e, spark.createDataFrame([("y",)], "name string")).collect()] == ["a"]
    twice = edges(spark, [("a", "b", "contains"), ("a", "b", "calls")])
    assert [r["type"] for r in graph.last_write_wins(twice).collect()] == ["calls"]


def test_diagrams(spark):
    e = edges(spark, [("f", "g", "calls")])
    nodes = spark.createDataFrame([("m.f", 0), ("f", 1)], "id string, seq long")
    assert graph.mermaid(e, "inherits").first()["diagram"] == "classDiagram\n  class NoInheritances {\n  }"
    assert graph.sequence_diagram(e, nodes.where("id = 'f'"), "f") == ["sequenceDiagram", "  f ->> g: call"]
    assert graph.sequence_diagram(e, nodes, "none")[-1].endswith("FunctionNotFound")


def test_limiter_blocks_the_61st(spark):
    ev = spark.range(130).select(F.lit("k").alias("user_id"), F.timestamp_micros(F.col("id") * 600_000).alias("ts"), F.col("id").alias("event_id"))
    got = [r["accepted"] for r in state.rate_limit(ev, 60, 60).orderBy("event_id").collect()]
    assert got[:61] == [True] * 60 + [False] and got[99] is False and got[100] is True


def test_cache_keep_first_and_access(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, pos long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, pos long")
    assert {(r["doc_id"], r["source_rank"]) for r in retrieve.keep_first([a, b], "doc_id").collect()} == {(1, 0), (2, 0), (3, 1)}
    old = spark.createDataFrame([("k", "v", 1)], "key string, value string, seq long")
    assert incremental.upsert_latest(old, old.withColumns({"value": F.lit("w"), "seq": F.lit(2).cast("long")}), ["key"]).first()["value"] == "w"
    keys = spark.createDataFrame([("t", "admin"), ("u", "guest")], "token string, role string")
    req = spark.createDataFrame([("t",), ("u",), ("x",), (None,)], "token string").withColumn("allowed", F.array(F.lit("admin")))
    assert {r["token"]: r["status"] for r in state.access(req, keys).collect()} == {"t": 200, "u": 403, "x": 403, None: 401}


def test_js_scanner():
    found = parse.js_symbols("import a from 'b';\n/** D. */\nfunction f() { return '}'; }\nconst g = async (x) => { return `{${x}}`; };\nexport default class C { m(a) { if (a) { g(); } } static n() {} }\nconst k = 3;\n")
    assert [(s[0], s[1], s[6]) for s in found] == [("import a from 'b';", "import", None), ("f", "function", None), ("g", "function", None), ("C", "class", None), ("m", "method", "C"), ("n", "method", "C")]
    assert found[1][5] == "/** D. */"


def test_python_symbols():
    got = parse.python_symbols('import os\nclass A:\n    """Doc."""\n    @property\n    def x(self):\n        def inner():\n            pass\n\nif True:\n    async def f():\n        """F."""\n')
    assert [(s[0], s[1], s[6], s[5]) for s in got] == [("import os", "import", None, None), ("A", "class", None, "Doc."), ("x", "method", "A", None), ("f", "function", None, "F.")]
    assert parse.python_symbols("def broken(:") == []


def test_rest_of_the_library_does_not_need_llm():
    import pathlib

    top = pathlib.Path(__file__).parent.parent / "tarn"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "tarn.llm" not in p.read_text(), p
