"""Names, routing, chunks, symbols and code graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.operators import chunk, code_graph, graph, resolve
from tarn.session import table
from tarn.sources import files as source
from tarn.sources import parse

LINKS = "pages"

# A small tree whose results are known
TREE = (
    ("pkg/__init__.py", ""),
    ("pkg/base.py", "class Base:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n"),
    ("pkg/app.py", "import os\nfrom pkg.base import Base, helper as h\n\nclass App(Base):\n    def start(self):\n        n = h()\n        self.run()\n        return n\n\nif True:\n    def main():\n        App().start()\n"),
    ("web/ui.js", "import x from 'y';\n/** Adds. */\nexport function add(a, b) { return a + b; }\nconst twice = (n) => { return n * 2; };\nclass Box {\n  open(k) { if (k) { return '}'; } }\n}\n"),
    ("src/Main.java", "import java.util.List;\nimport java.io.*;\npublic class Main {\n    public static int size(List x) {\n        if (x != null) {\n        return 1; }\n    }\n}\n"),
    ("src/lib.rs", "use std::fmt;\npub struct Point;\nimpl Point {\n    pub fn new() -> Point {\n    }\n}\n"),
    ("notes.txt", "nothing"),
)
QUESTIONS = ("Give me an overview", "What does this repo do?", "Where is `load_data` used?", "who calls pkg.main used", "What depends on src/app.py?", "explain file src/app.py, please", "how does main.py work", "which files import util.py;", "what is this?", "WHERE'S the parser used??", "summarize file docs/readme.md")
ADDRESSES = ("https://github.com/a/b", "https://host.org/a/b/", "git@host.org:a/b.git", "/srv/repos/x", "https://h/a/b; rm -rf /", "a b", "", "HTTP://x/y/z")


def tree(spark):
    return spark.createDataFrame(list(TREE), "path string, text string").withColumn("language", fn.language_of("path")).where("language IS NOT NULL")


def _values(spark, items, name):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"id long, {name} string")


def normalize_repo_id(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return p.unionByName(_values(spark, ("https://h.org/A/Repo.git", "My-Repo", "", "https://h.org/a/b/"), "url").withColumn("id", -1 - F.col("id"))).select("id", fn.repo_slug("url").alias("repo_id"))


def _paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[a-z]+://[^/]*/?(.*)$", 1).alias("path"))
    return p.unionByName(_values(spark, ("./a/b.py", "a\\b\\__init__.py", "/x/y.tar.gz", "", "pkg/__init__.py", ".hidden"), "path").withColumn("id", -1 - F.col("id")))


def normalize_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", fn.clean_path("path").alias("clean"))


def module_name(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", fn.module_name("path").alias("module"))


def fqn(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.qualified_name("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("doc_id").cast("string"))).alias("fqn"))


def symbol_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.symbol_id(F.lit("https://h.org/x/Corpus.git"), F.concat(F.lit("./"), "source", F.lit("/"), "lang"), F.col("source"), F.col("doc_id")).alias("symbol_id"))


def chunk_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.chunk_id(F.lit("corpus"), F.col("source"), F.col("lang"), F.col("doc_id")).alias("chunk_id"))


def embedding_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = fn.embedding_text(F.col("source"), F.lit("document"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("prose")), F.col("text"))
    return d.select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


def language_of_file(spark, sf_dir):
    return _values(spark, [f"dir.d/name{e}" for e in fn.LANGUAGES] + ["x.PY", "Makefile", ".py", "a.b.py", "dir.py/x"], "path").select("path", fn.language_of("path").alias("language"))


def validate_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url").unionByName(_values(spark, ADDRESSES, "url").select("url"))
    return p.select("url", fn.valid_address("url").alias("valid"))


def classify_intent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(" ", F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("conv_id") % len(QUESTIONS) + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("q"))
    return c.unionByName(_values(spark, QUESTIONS, "q").select("q")).select("q", fn.intent("q").alias("intent"))


def extract_function(spark, sf_dir):
    return _values(spark, QUESTIONS, "q").select("q", fn.function_in("q").alias("function"))


def extract_file(spark, sf_dir):
    return _values(spark, QUESTIONS, "q").select("q", fn.file_in("q").alias("file"))


def split_overlapping(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", ".\n").alias("content"))
    y = chunk.split_overlapping(x, "content", 12, 3)
    return y.select("doc_id", "part", "first_line", "n_lines", F.md5("content").alias("content_md5"))


def merge_first_last(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    at = F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")
    x = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min_by("l_partkey", at).alias("first_part"), F.max_by("l_partkey", at).alias("last_part"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"].cast("string")), ",").alias("suppliers"))
    return x


def chunk_with_header(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    top = d.select("source", F.col("doc_id")).groupBy("source").agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 5).alias("ids"))
    x = d.join(top, "source")
    head = chunk.context_header(F.when(F.col("doc_id") % 2 == 0, "class").otherwise("function"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.transform("ids", lambda i: i.cast("string")))
    return x.select("doc_id", F.md5(F.concat(head, F.coalesce("text", F.lit("")))).alias("content_md5"))


def parent_link(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ids = o.select("o_orderkey", fn.chunk_id(F.lit("tpch"), F.lit("orders"), F.lit("order"), F.col("o_orderkey")).alias("parent_id"), "o_orderstatus").where("o_orderstatus != 'P'")
    return l.join(ids, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "parent_id")


def resolve_symbols(spark, sf_dir):
    imports = spark.createDataFrame([("a.py", 1, "import b.c as bc"), ("a.py", 2, "from other import thing, x as y")], "file string, seq long, code string")
    defs = spark.createDataFrame([("a", "local", "a.local", 1), ("b.c", "func", "b.c.func", 2), ("z", "func", "z.func", 3)], "module string, name string, fqn string, seq long")
    files = spark.createDataFrame([("a.py", "a"), ("b/c.py", "b.c")], "file string, module string")
    refs = spark.createDataFrame([("a.py", s) for s in ("local", "bc.func", "thing", "y.z", "func", "unknown", "local.attr")], "file string, symbol string")
    return resolve.resolve(refs, resolve.parse_imports(imports), defs, files)


def parse_python(spark, sf_dir):
    more = spark.createDataFrame([("pkg/doc.py", '"""Module."""\nclass A:\n    """Of A."""\n    async def f(self):\n        """Of f."""\n        def inner(): pass\n', "python"), ("pkg/bad.py", "def broken(:", "python")], "path string, text string, language string")
    files = tree(spark).where("language = 'python'").unionByName(more)
    return parse.parse_symbols(files, "Demo").select("file_path", "name", "type", "start_line", "end_line", "docstring", "parent_class", "fqn", "symbol_id")


def parse_javascript(spark, sf_dir):
    return parse.parse_symbols(tree(spark).where("language = 'javascript'"), "Demo").select("file_path", "name", "type", "start_line", "end_line", "docstring", "parent_class", "fqn")


def parse_line_languages(spark, sf_dir):
    return parse.parse_symbols(tree(spark).where("language IN ('java', 'rust')"), "Demo").select("file_path", "name", "type", F.col("start_line").cast("long").alias("start_line"), "parent_class", "fqn")


MORE = (
    ("m.go", "go", 'import "fmt"\ntype Point struct {\n}\nfunc (p Point) Len() int {\n}\n'),
    ("a.cs", "c_sharp", "using System.Text;\npublic class Größe {\n    public int Get(int x) {\n        if (x > 0) {\n"),
    ("b.cpp", "cpp", "#include <vector>\nint twice(int n) {\nstruct Box {\n  void open() const {\n"),
    ("c.kt", "kotlin", "import a.b\nfun no() {}\ndef yes()\ninterface Shape\nfunc area()\n"),
)


def parse_more_languages(spark, sf_dir):
    """Go, C#, C++ and a language without patterns of its own."""
    files = spark.createDataFrame(list(MORE), "path string, language string, text string")
    return parse.parse_symbols(files, "Demo").select("file_path", "name", "type", F.col("start_line").cast("long").alias("start_line"), "parent_class", "fqn")


def symbol_chunks(spark, sf_dir):
    s = parse.parse_symbols(tree(spark), "Demo")
    return chunk.chunks_from_symbols(s, "Demo").select("id", "symbol_name", "symbol_type", "file_path", "start_line", "end_line", "parent_chunk_id", F.md5("content").alias("content_md5"))


def _kg(spark):
    files = tree(spark)
    return code_graph.knowledge_graph(files, parse.parse_symbols(files, "Demo"))


def knowledge_graph(spark, sf_dir):
    return _kg(spark)[1].select("src", "dst", "type")


def knowledge_nodes(spark, sf_dir):
    return _kg(spark)[0].select("id", "type", "file_path")


def call_graph(spark, sf_dir):
    files = tree(spark)
    return code_graph.call_graph(files, parse.parse_symbols(files, "Demo")).select("src", "dst", "file_path")


def dependency_graph(spark, sf_dir):
    return code_graph.dependency_graph(tree(spark)).select("src", "dst", "type")


def code_callers(spark, sf_dir):
    nodes, edges = _kg(spark)
    return graph.callers(nodes, edges, spark.createDataFrame([("helper",), ("run",), ("start",)], "name string"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_repo_id, normalize_path, module_name, fqn, symbol_id, chunk_id, embedding_text, language_of_file, validate_url, classify_intent, extract_function, extract_file, split_overlapping,
        merge_first_last, chunk_with_header, parent_link, resolve_symbols, parse_python, parse_javascript, parse_line_languages, parse_more_languages, symbol_chunks, knowledge_graph, knowledge_nodes, call_graph, dependency_graph, code_callers,
    )
}


def _sql_values(items, name):
    rows = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(items))
    return f"(SELECT id::BIGINT AS id, {name} FROM (VALUES {rows}) AS given(id, {name}))"


_P = f"""p0 AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1) AS path FROM pages
    UNION ALL SELECT -1 - id, path FROM {_sql_values((chr(46) + "/a/b.py", "a" + chr(92) + "b" + chr(92) + "__init__.py", "/x/y.tar.gz", "", "pkg/__init__.py", ".hidden"), "path")}),
p AS (SELECT id, regexp_replace(trim(replace(path, chr(92), '/'), '/'), '^\\./', '') AS clean FROM p0)"""
_Q = _sql_values(QUESTIONS, "q")
_INTENT = """CASE WHEN regexp_matches(lower(q), 'repo overview|repository overview|give me an overview|summarize this repo') THEN 'repo_overview'
 WHEN regexp_matches(lower(q), 'architecture summary|system overview|what does this repository do|what does this repo do|overall architecture') THEN 'architecture'
 WHEN regexp_matches(lower(q), 'where is|where''s|who calls') AND contains(lower(q), 'used') THEN 'function_usage'
 WHEN regexp_matches(lower(q), 'what depends on|which files import|what files import|who imports|file dependencies|dependencies of') THEN 'file_dependencies'
 WHEN regexp_matches(lower(q), 'explain file|describe file|summarize file|what does file') THEN 'file_explanation' ELSE 'code_question' END"""
_HIT = "CASE WHEN regexp_matches(a, '{0}') THEN trim(trim(regexp_extract(a, '{0}', 1)), '`''\"') END"
_FILES = ", ".join("regexp_replace(split_part({}, ' ', 1), '[,.;]+$', '')".format(_HIT.format(rf"(?i){lead}\s+(.+)")) for lead in fn.FILE_LEADS)

ORACLES = {
    "normalize_repo_id": f"""WITH u AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -1 - id, url FROM {_sql_values(("https://h.org/A/Repo.git", "My-Repo", "", "https://h.org/a/b/"), "url")})
        SELECT id, CASE WHEN coalesce(url, '') = '' THEN 'unknown' ELSE trim(lower(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '\\.git$', ''))) END AS repo_id FROM u""",
    "normalize_path": f"WITH {_P} SELECT id, clean FROM p",
    "module_name": f"""WITH {_P}, s AS (SELECT id, list_filter(string_split(regexp_replace(clean, '([^/.])\\.[^./]*$', '\\1'), '/'), lambda x: x NOT IN ('', '.')) AS a FROM p)
        SELECT id, array_to_string(CASE WHEN a[-1] = '__init__' THEN a[:-2] ELSE a END, '.') AS module FROM s""",
    "fqn": "SELECT doc_id, concat_ws('.', nullif(lang, ''), CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END, CASE WHEN doc_id % 3 <> 0 THEN doc_id::VARCHAR END) AS fqn FROM documents",
    "symbol_id": "SELECT doc_id, 'corpus:' || source || '/' || lang || ':' || source || ':' || doc_id AS symbol_id FROM documents",
    "chunk_id": "SELECT doc_id, substr(sha256(concat_ws(':', 'corpus', source, lang, doc_id::VARCHAR)), 1, 16) AS chunk_id FROM documents",
    "embedding_text": """WITH t AS (SELECT doc_id, concat_ws(chr(10) || chr(10), 'File: ' || source, 'document: ' || doc_id, CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN 'Class: ' || lang END, CASE WHEN doc_id % 3 <> 0 THEN 'Docstring: prose' END, 'Code:' || chr(10) || text) AS t FROM documents)
        SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM t""",
    "language_of_file": "SELECT path, language FROM (VALUES " + ", ".join([f"('dir.d/name{e}', '{l}')" for e, l in fn.LANGUAGES.items()] + ["('x.PY', NULL)", "('Makefile', NULL)", "('.py', NULL)", "('a.b.py', 'python')", "('dir.py/x', NULL)"]) + ") AS v(path, language)",
    "validate_url": f"""WITH u AS (SELECT url FROM pages UNION ALL SELECT url FROM {_sql_values(ADDRESSES, "url")})
        SELECT url, coalesce({" OR ".join(f"regexp_matches(url, '{p}')" for p in fn.REPO_ADDRESSES)}, false) AS valid FROM u""",
    "classify_intent": f"""WITH v AS {_Q}, u AS (SELECT concat_ws(' ', v.q, coalesce(text, '')) AS q FROM conversations JOIN v ON conv_id % {len(QUESTIONS)} = v.id WHERE role = 'user' UNION ALL SELECT q FROM v) SELECT q, {_INTENT} AS intent FROM u""",
    "extract_function": f"""WITH u AS (SELECT q, regexp_replace(trim(q), '\\?+$', '') AS a FROM {_Q})
        SELECT q, coalesce({_HIT.format(r"(?i)where\s+is\s+(.+?)\s+used")}, {_HIT.format(r"(?i)who\s+calls\s+(.+)")}, {_HIT.format(r"(?i)([A-Za-z0-9_.]+)\s+used")}) AS function FROM u""",
    "extract_file": f"WITH u AS (SELECT q, regexp_replace(trim(q), '\\?+$', '') AS a FROM {_Q}) SELECT q, coalesce({_FILES}, {_HIT.format(r'([A-Za-z0-9_/.-]+\.py)')}) AS file FROM u",
    "split_overlapping": """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\. ', '.' || chr(10), 'g') AS c FROM documents),
        l AS (SELECT doc_id, regexp_extract_all(c, '[^\\n]*\\n|[^\\n]+$') AS a FROM t), s AS (SELECT doc_id, a, unnest(CASE WHEN len(a) <= 12 THEN [0] ELSE range(0, len(a), 9) END) AS pos FROM l)
        SELECT doc_id, (pos // 9 + 1)::BIGINT AS part, pos::BIGINT AS first_line, len(a[pos + 1:pos + 12])::BIGINT AS n_lines, md5(array_to_string(a[pos + 1:pos + 12], '')) AS content_md5 FROM s""",
    "merge_first_last": """SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, l_linenumber::BIGINT * 10000000 + l_partkey) AS first_part, arg_max(l_partkey, l_linenumber::BIGINT * 10000000 + l_partkey) AS last_part,
        string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey) AS suppliers FROM lineitem GROUP BY 1""",
    "chunk_with_header": """WITH i AS (SELECT source, string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) AS ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 GROUP BY 1)
        SELECT doc_id, md5('// Dependency imports:' || chr(10) || ids || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN '// Context: Method ''' || doc_id || ''' of class ''' || lang || '''' || chr(10)
          WHEN doc_id % 2 = 0 THEN '// Context: Class ''' || doc_id || '''' || chr(10) ELSE '// Context: Function ''' || doc_id || '''' || chr(10) END || coalesce(text, '')) AS content_md5 FROM documents JOIN i USING (source)""",
    "parent_link": "SELECT l_orderkey, l_linenumber, substr(sha256('tpch:orders:order:' || o_orderkey), 1, 16) AS parent_id FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'",
    "resolve_symbols": """SELECT 'a.py' AS file, symbol, fqn FROM (VALUES ('local', 'a.local'), ('bc.func', 'b.c.func'), ('thing', 'other.thing'), ('y.z', 'other.x.z'), ('func', 'b.c.func'), ('unknown', 'a.unknown'), ('local.attr', 'a.local.attr')) AS v(symbol, fqn)""",
    "parse_line_languages": """SELECT * FROM (VALUES ('src/Main.java', 'import java.util.List;', 'import', 1::BIGINT, NULL, 'src.Main.imports'), ('src/Main.java', 'import java.io.*;', 'import', 2, NULL, 'src.Main.imports'), ('src/Main.java', 'Main', 'class', 3, NULL, 'src.Main.Main'),
        ('src/Main.java', 'size', 'method', 4, 'Main', 'src.Main.Main.size'), ('src/lib.rs', 'use std::fmt;', 'import', 1, NULL, 'src.lib.imports'), ('src/lib.rs', 'Point', 'class', 2, NULL, 'src.lib.Point'), ('src/lib.rs', 'new', 'method', 4, 'Point', 'src.lib.Point.new'))
        AS v(file_path, name, type, start_line, parent_class, fqn)""",
}


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(names: str, rows, select: str = "*") -> str:
    """SQL of a small table of constants."""
    return f"SELECT {select} FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS given({names})"


#: What the fixed tree holds: (file, name, type, first line, last line, docstring, class, module, code)
_PY = (
    ("pkg/app.py", "import os", "import", 1, 1, None, None, "pkg.app", "import os"),
    ("pkg/app.py", "from pkg.base import Base, helper as h", "import", 2, 2, None, None, "pkg.app", "from pkg.base import Base, helper as h"),
    ("pkg/app.py", "App", "class", 4, 8, None, None, "pkg.app", "class App(Base):\n    def start(self):\n        n = h()\n        self.run()\n        return n"),
    ("pkg/app.py", "start", "method", 5, 8, None, "App", "pkg.app", "def start(self):\n        n = h()\n        self.run()\n        return n"),
    ("pkg/app.py", "main", "function", 11, 12, None, None, "pkg.app", "def main():\n        App().start()"),
    ("pkg/base.py", "Base", "class", 1, 3, None, None, "pkg.base", "class Base:\n    def run(self):\n        return helper()"),
    ("pkg/base.py", "run", "method", 2, 3, None, "Base", "pkg.base", "def run(self):\n        return helper()"),
    ("pkg/base.py", "helper", "function", 5, 6, None, None, "pkg.base", "def helper():\n    return 1"),
)
_JS = (
    ("web/ui.js", "import x from 'y';", "import", 1, 1, None, None, "web.ui", "import x from 'y';"),
    ("web/ui.js", "add", "function", 3, 3, "/** Adds. */", None, "web.ui", "export function add(a, b) { return a + b; }"),
    ("web/ui.js", "twice", "function", 4, 4, None, None, "web.ui", "const twice = (n) => { return n * 2; }"),
    ("web/ui.js", "Box", "class", 5, 7, None, None, "web.ui", "class Box {\n  open(k) { if (k) { return '}'; } }\n}"),
    ("web/ui.js", "open", "method", 6, 6, None, "Box", "web.ui", "open(k) { if (k) { return '}'; } }"),
)
_LINES = (
    ("src/Main.java", "import java.util.List;", "import", 1, 1, None, None, "src.Main", "import java.util.List;"),
    ("src/Main.java", "import java.io.*;", "import", 2, 2, None, None, "src.Main", "import java.io.*;"),
    ("src/Main.java", "Main", "class", 3, 3, None, None, "src.Main", "public class Main {"),
    ("src/Main.java", "size", "method", 4, 4, None, "Main", "src.Main", "    public static int size(List x) {"),
    ("src/lib.rs", "use std::fmt;", "import", 1, 1, None, None, "src.lib", "use std::fmt;"),
    ("src/lib.rs", "Point", "class", 2, 2, None, None, "src.lib", "pub struct Point;"),
    ("src/lib.rs", "new", "method", 4, 4, None, "Point", "src.lib", "    pub fn new() -> Point {"),
)
_DOC = (("pkg/doc.py", "A", "class", 2, 6, "Of A.", None, "pkg.doc", ""), ("pkg/doc.py", "f", "method", 4, 6, "Of f.", "A", "pkg.doc", ""))
_FIELDS = "file_path, name, type, start_line, end_line, docstring, parent_class, module, code"
_FQN = "CASE WHEN type = 'import' THEN module || '.imports' ELSE concat_ws('.', module, parent_class, name) END"
_CODE_ID = "left(sha256('demo:' || file_path || ':' || fqn || ':' || start_line), 16)"
_CHUNKS = f"""WITH s AS ({values(_FIELDS, _PY + _JS + _LINES, f"*, {_FQN} AS fqn")}),
    i AS (SELECT file_path, count(*) AS n, string_agg(code, chr(10) ORDER BY start_line) AS codes, min(start_line) AS start_line, max(end_line) AS end_line, any_value(fqn) AS fqn FROM s WHERE type = 'import' GROUP BY 1),
    c AS (SELECT fqn AS class_fqn, {_CODE_ID} AS class_id FROM s WHERE type = 'class'),
    b AS (SELECT s.*, CASE WHEN n > 0 THEN '// Dependency imports:' || chr(10) || codes || chr(10) || chr(10) ELSE '' END
        || CASE type WHEN 'method' THEN '// Context: Method ''' || name || ''' of class ''' || parent_class || '''' WHEN 'class' THEN '// Context: Class ''' || name || '''' ELSE '// Context: Function ''' || name || '''' END || chr(10) || code AS content,
        CASE WHEN type = 'method' THEN class_id END AS parent_chunk_id FROM s LEFT JOIN i USING (file_path) LEFT JOIN c ON class_fqn = concat_ws('.', module, parent_class) AND type = 'method' WHERE type <> 'import')
    SELECT {_CODE_ID} AS id, name AS symbol_name, type AS symbol_type, file_path, start_line, end_line, parent_chunk_id, md5(content) AS content_md5 FROM b
    UNION ALL SELECT {_CODE_ID}, 'imports (' || n || ' statements)', 'import', file_path, start_line, end_line, NULL, md5(codes) FROM i"""
EDGES = (
    ("pkg.app", "pkg.app.App", "contains"), ("pkg.app", "pkg.app.main", "contains"), ("pkg.app.App", "pkg.app.App.start", "contains"), ("pkg.app.App.start", "pkg.app.App.start.n", "contains"),
    ("pkg.base", "pkg.base.Base", "contains"), ("pkg.base", "pkg.base.helper", "contains"), ("pkg.base.Base", "pkg.base.Base.run", "contains"),
    ("src.Main", "src.Main.Main", "contains"), ("src.Main.Main", "src.Main.Main.size", "contains"), ("src.lib", "src.lib.Point", "contains"), ("src.lib.Point", "src.lib.Point.new", "contains"),
    ("web.ui", "web.ui.Box", "contains"), ("web.ui", "web.ui.add", "contains"), ("web.ui", "web.ui.twice", "contains"), ("web.ui.Box", "web.ui.Box.open", "contains"),
    ("pkg.app.App.start", "pkg.base.helper", "calls"), ("pkg.app.App.start", "pkg.app.App.run", "calls"), ("pkg.app.main", "pkg.app.App", "calls"), ("pkg.app.main", "pkg.app.start", "calls"), ("pkg.base.Base.run", "pkg.base.helper", "calls"),
    ("pkg.app.App", "pkg.base.Base", "inherits"), ("pkg.app", "pkg.base", "imports"),
)
NODES = (
    *((m, "module", f) for m, f in (("pkg.app", "pkg/app.py"), ("pkg.base", "pkg/base.py"), ("src.Main", "src/Main.java"), ("src.lib", "src/lib.rs"), ("web.ui", "web/ui.js"))),
    *((".".join(x for x in (r[7], r[6], r[1]) if x), r[2], r[0]) for r in _PY + _JS + _LINES if r[2] != "import"),
    ("pkg.app.App.start.n", "variable", "pkg/app.py"), ("pkg.app.App.run", "external", None), ("pkg.app.start", "external", None),
)
_MORE = (
    ("m.go", 'import "fmt"', "import", 1, None, "m.imports"), ("m.go", "Point", "class", 2, None, "m.Point"), ("m.go", "Len", "method", 4, "Point", "m.Point.Len"),
    ("a.cs", "using System.Text;", "import", 1, None, "a.imports"), ("a.cs", "Größe", "class", 2, None, "a.Größe"), ("a.cs", "Get", "method", 3, "Größe", "a.Größe.Get"),
    ("b.cpp", "#include <vector>", "import", 1, None, "b.imports"), ("b.cpp", "twice", "function", 2, None, "b.twice"), ("b.cpp", "Box", "class", 3, None, "b.Box"), ("b.cpp", "open", "method", 4, "Box", "b.Box.open"),
    ("c.kt", "import a.b", "import", 1, None, "c.imports"), ("c.kt", "yes", "function", 3, None, "c.yes"), ("c.kt", "Shape", "class", 4, None, "c.Shape"), ("c.kt", "area", "method", 5, "Shape", "c.Shape.area"),
)
ORACLES |= {
    "parse_python": values(_FIELDS, _PY + _DOC, f"file_path, name, type, start_line, end_line, docstring, parent_class, {_FQN} AS fqn, 'demo:' || file_path || ':' || {_FQN} || ':' || start_line AS symbol_id"),
    "parse_javascript": values(_FIELDS, _JS, f"file_path, name, type, start_line, end_line, docstring, parent_class, {_FQN} AS fqn"),
    "parse_more_languages": values("file_path, name, type, start_line, parent_class, fqn", _MORE, "* REPLACE (start_line::BIGINT AS start_line)"),
    "symbol_chunks": _CHUNKS,
    "knowledge_graph": values("src, dst, type", EDGES),
    "knowledge_nodes": values("id, type, file_path", NODES),
    "call_graph": values("src, dst, file_path", (("pkg.app.App.start", "h", "pkg/app.py"), ("pkg.app.App.start", "run", "pkg/app.py"), ("pkg.app.main", "App", "pkg/app.py"), ("pkg.app.main", "pkg.app.App.start", "pkg/app.py"), ("pkg.base.Base.run", "pkg.base.helper", "pkg/base.py"))),
    "dependency_graph": values("src, dst, type", (("pkg/app.py", "pkg/base.py", "imports"),)),
    "code_callers": values("name, id", (("helper", "pkg.app.App.start"), ("helper", "pkg.base.Base.run"), ("run", "pkg.app.App.start"), ("start", "pkg.app.main"))),
}
