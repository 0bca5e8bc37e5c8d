import pytest

from tarn.plans.engine import Engine
from tarn.plans.queries_code import TREE


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "dist").mkdir()
    (root / "dist" / "gone.py").write_text("x = 1\n")
    e = Engine(spark, str(tmp_path_factory.mktemp("home")), "Demo")
    e.root = root
    e.first = e.ingest(str(root))
    return e


def test_ingest_counts(engine):
    assert (engine.first.num_files, engine.first.num_symbols) == (5, 20)


def test_graph_questions(engine):
    assert engine.find_implementations("Base") == ["pkg.app.App"]
    assert engine.find_inheritance("App") == ["pkg.base.Base"]
    assert engine.function_usage("helper")["callers"] == ["pkg.app.App.start", "pkg.base.Base.run"]
    assert engine.file_dependencies("pkg/app.py")["dependencies"] == ["pkg.base"]
    assert engine.find_dependency_chains("pkg/app.py") == ["pkg.app>pkg.base"]


def test_routes_and_answers(engine):
    assert engine.route("Where is helper used?")["result"]["callers"]
    assert engine.route("dependencies of pkg/app.py")["category"] == "file_dependencies"
    got = engine.answer("who defines helper in base")
    assert got["sources"] and engine.answer("who defines helper in base") is got
    kinds = [e["type"] for e in engine.answer_stream("who defines helper in base")]
    assert kinds[0] == "metadata" and kinds[1] == "token"


def test_plan(engine):
    plan = engine.plan("x", lambda q: '```json\n[{"tool": "find_references", "symbol_name": "helper"}, {"tool": "find_inheritance"}]\n```')
    out = engine.execute(plan)
    assert out[0]["result"] and "missing" in out[1]["result"]
    assert engine.plan("x", lambda q: "nonsense") == [{"tool": "ask_question", "query": "x"}]


def test_reports(engine, tmp_path):
    assert "pkg/" in engine.tree() and "app.py" in engine.tree()
    d = engine.diagrams("start")
    assert "  pkg.app --> pkg.base" in d["imports"] and "pkg.base.Base <|-- pkg.app.App" in d["inherits"] and "start ->> helper: call" in d["sequence"]
    assert "Review of" in engine.autonomous_scan(str(tmp_path))


def test_incremental(engine):
    same = engine.ingest(str(engine.root), incremental_run=True)
    assert (same.num_files, same.num_symbols) == (5, 20)
    (engine.root / "pkg" / "base.py").write_text("class Base:\n    def run(self):\n        return 1\n\ndef helper():\n    return 2\n\ndef extra():\n    return helper()\n")
    new = engine.ingest(str(engine.root), incremental_run=True)
    assert new.num_symbols == 21
    assert engine.function_usage("helper")["callers"] == ["pkg.app.App.start", "pkg.base.extra"]
