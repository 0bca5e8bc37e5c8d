"""The engine over a small tree, file sources, service parts and streams, as queries with known rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.functions import tokens
from tarn.operators import code_graph, embed, graph, state
from tarn.plans.engine import Engine, engine_for
from tarn.plans.queries_code import EDGES, NODES, TREE, values
from tarn.plans.queries_code import tree as code_tree
from tarn.plans.queries_state import ORACLES as STATE
from tarn.session import fresh_path, settings, table
from tarn.sources import files as source
from tarn.sources import parse, versioned
from tarn.streaming import ingest, limiter, metrics

#: Beside the code: what a scan leaves out.
ASIDE = (("node_modules/gone.js", "x"), ("README.md", "# Demo\n\nA tree."), ("dist/gone.py", "x = 1\n"))
_TREES: dict[str, str] = {}


def tree_folder(spark) -> str:
    """The small tree as files in the shared folder, once a session."""
    key = spark.sparkContext.applicationId
    if key not in _TREES:
        root = fresh_path(spark, "tree")
        for path, text in (*TREE, *ASIDE):
            versioned.write_text(spark, f"{root}/{path}", text)
        _TREES[key] = root
    return _TREES[key]


def demo(spark) -> Engine:
    root = tree_folder(spark)
    e = engine_for(spark, f"{root}-home", "Demo", model=lambda prompt: iter(["said ", str(len(prompt) > 0)]))
    if not e.version:
        e.ingest(root)
    return e


def _pairs(spark, rows):
    """(name, value) of results as JSON, keys in order."""
    return spark.createDataFrame([(n, v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for n, v in rows], "name string, value string")


def scan_files(spark, sf_dir):
    return source.scan_tree(spark, tree_folder(spark)).select("path", "size", "language")


def scan_all_files(spark, sf_dir):
    """Every file that isn't pruned, by extension too."""
    root = tree_folder(spark)
    every = source.scan_tree(spark, root, supported_only=False).select("path", F.lit("any").alias("kind"))
    return every.unionByName(source.scan_tree(spark, root, extension=".py", prune=()).select("path", F.lit("py").alias("kind")))


def engine_runs(spark, sf_dir):
    """Counts of a full run, of one with nothing new, and of one with a changed and a new file."""
    root = fresh_path(spark, "runs")
    put = lambda p, t: versioned.write_text(spark, f"{root}/{p}", t)
    put("a.py", "def one():\n    return 1\n")
    put("b.py", "from a import one\n\ndef two():\n    return one()\n")
    e = Engine(spark, f"{root}-home", "Runs")
    rows = [("full", e.ingest(root)), ("same", e.ingest(root, incremental_run=True))]
    put("a.py", "def one():\n    return 2\n\ndef three():\n    return one()\n")
    put("c.py", "class C:\n    pass\n")
    rows.append(("changed", e.ingest(root, incremental_run=True)))
    hashes = {r["file_path"] for r in e.read("snapshot").collect()}
    doc = e.read("document").first()
    return spark.createDataFrame([(n, r.num_files, r.num_symbols, r.num_chunks) for n, r in rows] + [("tracked", len(hashes), len(e.function_usage("one")["callers"]), doc["chunks"])], "run string, files long, symbols long, chunks long")


def engine_document(spark, sf_dir):
    d = demo(spark).read("document")
    return d.select("repo", "files", "symbols", F.size("file_hashes").cast("long").alias("hashes"), F.element_at("file_hashes", "pkg/base.py").alias("base_hash"), F.expr("hubs[0].id").alias("hub"))


def engine_metadata(spark, sf_dir):
    issues = spark.createDataFrame([(7, "Issue", "Slow", "open", None), (8, "Pull Request", "Fast", "closed", "body")], "number long, kind string, title string, state string, body string")
    e = demo(spark)
    return e.metadata(tree_folder(spark), issues).select("id", "file_path", "symbol_name", "symbol_type", "content", "end_line")


def engine_questions(spark, sf_dir):
    e = demo(spark)
    rows = [
        ("usage", e.function_usage("helper")), ("references", e.find_references("Base")), ("implementations", e.find_implementations("Base")), ("inheritance", e.find_inheritance("App")),
        ("dependencies", e.file_dependencies("pkg/app.py")), ("dependents", e.file_dependencies("pkg/base.py")), ("chains", e.find_dependency_chains("pkg/app.py")), ("no file", e.find_dependency_chains("none.py")),
        ("unknown", e.function_usage("nothing")),
    ]
    return _pairs(spark, rows)


def engine_overview(spark, sf_dir):
    e = demo(spark)
    return _pairs(spark, [("overview", e.overview(3)), ("summary", e.hub_summary(2))])


def engine_routes(spark, sf_dir):
    e = demo(spark)
    kind = lambda q: e.route(q)
    rows = [(q, kind(q)) for q in ("Where is helper used?", "dependencies of pkg/app.py", "explain file pkg/base.py")]
    return _pairs(spark, rows)


def engine_answers(spark, sf_dir):
    """The model's words, the first source, and a stream's events."""
    e = demo(spark)
    got = e.answer("who defines helper in base")
    events = list(e.answer_stream("who defines helper in base"))
    kept = e.answer("who defines helper in base") is got
    return _pairs(spark, [("answer", got["answer"]), ("kinds", [x["type"] for x in events]), ("text", "".join(x.get("text", "") for x in events)), ("same sources", events[0]["sources"] == got["sources"]), ("kept", kept), ("fields", sorted(got["sources"][0]))])


def engine_plans(spark, sf_dir):
    e = demo(spark)
    plan = e.plan("x", lambda q: '```json\n[{"tool": "find_implementations", "class_name": "Base"}, {"tool": "find_inheritance"}, {"tool": "odd", "query": "q"}]\n```')
    return _pairs(spark, [(str(i), s["result"]) for i, s in enumerate(e.execute(plan))] + [("none", e.plan("q", lambda q: "no plan"))])


def engine_conversation(spark, sf_dir):
    e = Engine(spark, fresh_path(spark, "talk"), "Talk")
    for role, text in (("user", "hi"), ("assistant", "hello"), ("user", "bye")):
        e.add_message("c1", role, text)
    e.add_message("c2", "user", "other")
    return _pairs(spark, [(c, e.history(c)) for c in ("c1", "c2", "c3")])


def engine_memory(spark, sf_dir):
    e = Engine(spark, fresh_path(spark, "memory"), "Mem")
    rows = [("default", e.memory())]
    e.update_profile({"tech_stack": ["spark", "sql"], "description": "d"})
    e.update_profile({"description": "new"})
    e.add_faq("why?", "so")
    return _pairs(spark, [*rows, ("changed", e.memory())])


def engine_diagrams(spark, sf_dir):
    e = demo(spark)
    empty = graph.mermaid(e.read("edges").where("false"), "imports").first()["diagram"], graph.mermaid(e.read("edges").where("false"), "inherits").first()["diagram"]
    d = e.diagrams("start")
    return _pairs(spark, [("imports", d["imports"]), ("inherits", d["inherits"]), ("sequence", d["sequence"]), ("no imports", empty[0]), ("no inheritance", empty[1]), ("no function", e.diagrams("none")["sequence"])])


def engine_report(spark, sf_dir):
    """Report, reviews and explanations, with a model that repeats the end of its prompt."""
    e = demo(spark)
    r = e.architecture_report()
    return _pairs(spark, [("cycles", r["cycles"]), ("tree", r["tree"]), ("review", e.review("pkg/base.py")), ("no file", e.review("none") or "none"), ("explained", e.explain_symbol("helper", "beginner"))])


def graph_json(spark, sf_dir):
    """Nodes and edges to JSON lines in a file and back."""
    files = code_tree(spark)
    nodes, edges = code_graph.knowledge_graph(files, parse.parse_symbols(files, "Demo"))
    path = fresh_path(spark, "graph")
    source.write_json(source.graph_to_json(nodes.select("id", "type"), edges.select("src", "dst", "type")), path)
    n, e = source.graph_from_json(source.read_json(spark, path, "kind string, json string"), "id string, type string", "src string, dst string, type string")
    return n.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "type").unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type"))


def clean_keys(spark, sf_dir):
    given = [(i, k) for i, k in enumerate(("  abc ", "'abc'", '"a b"', "", "x'y", "''"))]
    return spark.createDataFrame(given, "id long, raw string").select("id", fn.clean_key("raw").alias("key"))


def signed_tokens(spark, sf_dir):
    good = tokens.sign({"sub": "a", "exp": 100}, "secret")
    rows = [("good", good), ("other secret", tokens.sign({"sub": "a", "exp": 100}, "no")), ("late", tokens.sign({"sub": "a", "exp": 10}, "secret")), ("changed", good[:-2] + "xx"), ("no token", "x"), ("null", None)]
    return spark.createDataFrame(rows, "name string, token string").select("name", tokens.verified(F.col("token"), "secret", 50).alias("payload"))


def access_gate(spark, sf_dir):
    """Key, then role, then limit: what a request gets."""
    keys = spark.createDataFrame([("k1", "admin"), ("k2", "viewer")], "token string, role string")
    asked = [(i, k, i) for i, k in enumerate(["k1", "k1", "k1", "k2", None, "bad", "k1"])]
    asked[-1] = (6, "k1", 70)
    requests = spark.createDataFrame(asked, "event_id long, token string, at long").select("event_id", "token", F.timestamp_seconds("at").alias("ts"), F.array(F.lit("admin")).alias("allowed"))
    return state.gate(requests, keys, 2, 60).select("event_id", F.col("status").cast("long").alias("status"))


def embedding_cache(spark, sf_dir):
    """Texts of all documents through a cache that holds some: here the model gives a text's length."""

    class Lengths:
        def embed_texts(self, texts):
            return [[float(len(t))] for t in texts]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    cache = docs.where("doc_id % 3 = 0").select(key.alias("key"), F.array(F.lit(-1.0).cast("float")).alias("value")).distinct()
    return embed.embed_cached(docs, cache, Lengths)[0].select("doc_id", F.col("embedding")[0].cast("double").alias("value"))


def default_settings(spark, sf_dir):
    return spark.createDataFrame(sorted((k, str(v)) for k, v in settings(spark).items()), "name string, value string")


def latency_histogram(spark, sf_dir):
    # quantities as tenths of a second
    e = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("seconds"))
    return metrics.histogram(e, "seconds")


def stream_rate_limit(spark, sf_dir):
    """The limiter on a stream of all events, one batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limiter.STORE)
    out = fresh_path(spark, "limited")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    q = limiter.limited(stream, 2, 86_400).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "limits")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "accepted")


def stream_upsert_latest(spark, sf_dir):
    """The last event of each user and type, kept by a stream."""
    out = fresh_path(spark, "kept")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    q = ingest.stream_upsert(stream.select("user_id", "event_type", "event_id", "value"), out, ["user_id", "event_type"], "event_id", fresh_path(spark, "keeps")).trigger(availableNow=True).start()
    q.awaitTermination()
    return ingest.current(spark, out).select("user_id", "event_type", "event_id", "value")


QUERIES = {
    f.__name__: f
    for f in (
        scan_files, scan_all_files, engine_runs, engine_document, engine_metadata, engine_questions, engine_overview, engine_routes, engine_answers, engine_plans, engine_conversation, engine_memory, engine_diagrams, engine_report,
        graph_json, clean_keys, signed_tokens, access_gate, embedding_cache, default_settings, latency_histogram, stream_rate_limit, stream_upsert_latest,
    )
}

_FAQ = "\n\n## Frequently Asked Questions (FAQ)\n" + "\n".join(f"### Q{i}: {q}\n**A**: {a}" for i, (q, a) in enumerate(state.FAQS, 1))
_PROFILE = "## Repository Stack Profile\n- **Description**: {}\n- **Primary Language**: Unknown\n- **Architecture Style**: Monolith"
_TEXT = dict((*TREE, *ASIDE))
_CODE = {"pkg/app.py": "python", "pkg/base.py": "python", "web/ui.js": "javascript", "src/Main.java": "java", "src/lib.rs": "rust"}
_CHUNK_ID = "left(sha256('demo:' || file_path || ':' || symbol_name || ':1'), 16) AS id"

ORACLES = {
    "scan_files": values("path, size, language", [(p, len(_TEXT[p].encode()), l) for p, l in _CODE.items()], "path, size::BIGINT AS size, language"),
    "scan_all_files": values("path, kind", [*((p, "any") for p in (*_CODE, "notes.txt", "README.md")), *((p, "py") for p in ("pkg/app.py", "pkg/base.py", "dist/gone.py"))]),
    "engine_runs": values("run, files, symbols, chunks", [("full", 2, 3, 3), ("same", 2, 3, 3), ("changed", 3, 5, 5), ("tracked", 3, 2, 5)], "run, files::BIGINT AS files, symbols::BIGINT AS symbols, chunks::BIGINT AS chunks"),
    "engine_document": values("base", [(_TEXT["pkg/base.py"],)], "'Demo' AS repo, 5::BIGINT AS files, 20::BIGINT AS symbols, 5::BIGINT AS hashes, sha256(base) AS base_hash, 'pkg.base.helper' AS hub"),
    "engine_metadata": values(
        "file_path, symbol_name, symbol_type, content, end_line",
        [("README.md", "README", "readme", "# Demo\n\nA tree.", 3), ("issues/7", "Issue #7", "github_issue", "Issue #7: Slow\nState: open\n\n", 3), ("issues/8", "Pull Request #8", "github_issue", "Pull Request #8: Fast\nState: closed\n\nbody", 4)],
        f"{_CHUNK_ID}, *",
    ),
    "engine_questions": values("name, value", [
        ("usage", '{"callees": [], "callers": ["pkg.app.App.start", "pkg.base.Base.run"]}'), ("references", '["pkg.app.App", "pkg.base"]'), ("implementations", '["pkg.app.App"]'), ("inheritance", '["pkg.base.Base"]'),
        ("dependencies", '{"dependencies": ["pkg.base"], "dependents": []}'), ("dependents", '{"dependencies": [], "dependents": ["pkg.app"]}'), ("chains", '["pkg.app>pkg.base"]'), ("no file", "[]"), ("unknown", '{"callees": [], "callers": []}'),
    ]),
    "engine_overview": values("name, value", [
        ("overview", '{"files": 5, "hubs": [["pkg.base.helper", 3], ["pkg.app.App", 2], ["pkg.base.Base", 2]], "most_called": [["pkg.base.helper", 2], ["pkg.app.App.start", 0], ["pkg.app.main", 0]], "symbols": 14}'),
        ("summary", "Top dependency hubs\n- pkg.base.helper (3)\n- pkg.app.App (2)"),
    ]),
    "engine_routes": values("name, value", [
        ("Where is helper used?", '{"category": "function_usage", "result": {"callees": [], "callers": ["pkg.app.App.start", "pkg.base.Base.run"]}}'),
        ("dependencies of pkg/app.py", '{"category": "file_dependencies", "result": {"dependencies": ["pkg.base"], "dependents": []}}'), ("explain file pkg/base.py", '{"category": "file_explanation", "result": "said True"}'),
    ]),
    "engine_answers": values("name, value", [("answer", "said True"), ("kinds", '["metadata", "token", "token"]'), ("text", "said True"), ("same sources", "true"), ("kept", "true"), ("fields", '["file", "lines", "symbol", "type"]')]),
    "engine_plans": values("name, value", [("0", '["pkg.app.App"]'), ("1", "skipped: 'class_name' is missing"), ("2", "said True"), ("none", '[{"query": "q", "tool": "ask_question"}]')]),
    "engine_conversation": values("name, value", [("c1", "User: hi\nAssistant: hello\nUser: bye"), ("c2", "User: other"), ("c3", "")]),
    "engine_memory": values("name, value", [("default", _PROFILE.format("No repository description provided.") + _FAQ), ("changed", _PROFILE.format("new") + "\n- **Tech Stack**: spark, sql" + _FAQ + "\n### Q3: why?\n**A**: so")]),
    "engine_diagrams": values("name, value", [
        ("imports", "flowchart TD\n  pkg.app --> pkg.base"), ("inherits", "classDiagram\n  pkg.base.Base <|-- pkg.app.App"), ("sequence", "sequenceDiagram\n  start ->> helper: call\n  start ->> run: call"),
        ("no imports", "flowchart TD\n  NoDependenciesFound"), ("no inheritance", "classDiagram\n  class NoInheritances {\n  }"), ("no function", "sequenceDiagram\n  User ->> System: FunctionNotFound"),
    ]),
    "engine_report": values("name, value", [("cycles", "[]"), ("tree", "pkg/\n  app.py\n  base.py\nsrc/\n  Main.java\n  lib.rs\nweb/\n  ui.js"), ("review", "said True"), ("no file", "none"), ("explained", "said True")]),
    "graph_json": values("a, b, type", [*((i, None, t) for i, t, _ in NODES), *EDGES]),
    "clean_keys": values("id, key", [(0, "abc"), (1, "abc"), (2, "a b"), (3, ""), (4, "x'y"), (5, "")], "id::BIGINT AS id, key"),
    "signed_tokens": values("name, payload", [("good", '{"exp": 100, "sub": "a"}'), *((n, None) for n in ("other secret", "late", "changed", "no token", "null"))]),
    "access_gate": values("event_id, status", [(0, 200), (1, 200), (2, 429), (3, 403), (4, 401), (5, 403), (6, 200)], "event_id::BIGINT AS event_id, status::BIGINT AS status"),
    "embedding_cache": """WITH c AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE doc_id % 3 = 0)
        SELECT doc_id, CASE WHEN coalesce(text, '') IN (SELECT t FROM c) THEN -1.0 ELSE length(coalesce(text, '')) END::DOUBLE AS value FROM documents""",
    "default_settings": values("name, value", [("top_k", "5"), ("seeds", "20"), ("expanded", "50"), ("rerank", "True"), ("requests", "60"), ("request_seconds", "60"), ("embed_batch", "20"), ("embed_gap", "6.5"), ("chunk_lines", "300"), ("chunk_overlap", "30")]),
    "latency_histogram": """SELECT bound, count(*) FILTER (WHERE bound IS NULL OR l_quantity / 10 <= bound) AS n FROM lineitem, (VALUES (0.1::DOUBLE), (0.25), (0.5), (1.0), (2.5), (5.0), (10.0), (NULL)) AS b(bound) GROUP BY 1""",
    "stream_rate_limit": STATE["rate_limit"],
    "stream_upsert_latest": STATE["upsert_latest"],
}
