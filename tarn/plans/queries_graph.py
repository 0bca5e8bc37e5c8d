"""Graph queries: edges from page links, part and supplier keys, and bounded traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import graph
from tarn.session import table
from tarn.sources.files import directory_tree as tree_of

HREF = r'href="([^"]+)"'
#: Traversals run over a ring with shortcuts of this many nodes.
RING = 25


def links(spark, sf_dir):
    """Page links as edges."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst"))
    return p.select("src", "dst", F.lit("imports").alias("type"), F.col("page_id").alias("seq"))


def ring(spark, sf_dir):
    """Nation to the next nation and to twice its key: a small graph with cycles."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    to = F.explode(F.array(F.struct(((F.col("k") + 1) % RING).alias("d"), F.lit("calls").alias("type")), F.struct((F.col("k") * 2 % RING).alias("d"), F.lit("imports").alias("type"))))
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 2, "0"))
    return n.select("k", to.alias("e")).select(name(F.col("k")).alias("src"), name(F.col("e.d")).alias("dst"), "e.type", F.col("k").alias("seq")).where("src != dst")


def degree_topk(spark, sf_dir):
    return graph.in_degree_topk(links(spark, sf_dir), 10)


def _supply(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "calls").otherwise("imports").alias("type"), F.col("l_orderkey").alias("seq"))


def typed_degree(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "function").otherwise("class").alias("type"), F.col("s_suppkey").alias("seq"))
    return graph.in_degree_topk(_supply(spark, sf_dir), 10, nodes, ["calls"], ["function"])


def adjacency(spark, sf_dir):
    return graph.adjacency(links(spark, sf_dir)).select("src", F.md5("targets").alias("targets_md5"))


def neighbors_in(spark, sf_dir):
    return graph.neighbors_in(_supply(spark, sf_dir), F.lit(1)).distinct()


def neighbors_out(spark, sf_dir):
    return graph.neighbors_out(_supply(spark, sf_dir), F.lit(1)).distinct()


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("id")).where("id != ''").distinct()


def suffix_lookup(spark, sf_dir):
    return graph.lookup(_hosts(spark, sf_dir), spark.createDataFrame([("com",), ("org",), ("net",), ("example.com",), ("example.org",)], "name string"))


def edge_last_write_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 7).alias("dst"), F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    return graph.last_write_wins(e).select("src", "dst", "type")


def longest_prefix_resolve(spark, sf_dir):
    h = _hosts(spark, sf_dir).select(F.array_join(F.reverse(F.split("id", r"\.")), ".").alias("target"))
    modules = h.select(F.regexp_extract("target", r"^([^.]+(?:\.[^.]+)?)", 1).alias("module")).distinct().where("length(module) % 2 = 1 OR NOT contains(module, '.')").select("module", F.concat("module", F.lit(".py")).alias("file"))
    return graph.longest_prefix(h, modules)


def call_tree(spark, sf_dir):
    return graph.call_tree(ring(spark, sf_dir), "n03", 3)


def import_chains(spark, sf_dir):
    e = ring(spark, sf_dir).withColumn("type", F.lit("imports")).where("src NOT IN ('n05', 'n08', 'n12')")
    return graph.import_chains(e, "n03", 4)


def simple_cycles(spark, sf_dir):
    return graph.simple_cycles(ring(spark, sf_dir), 6, 10)


def mermaid_edges(spark, sf_dir):
    return graph.mermaid(ring(spark, sf_dir).withColumn("seq", F.struct("seq", "dst")), "imports")


def directory_tree(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]*[^?#/])", 1).alias("path"))
    return tree_of(p, "path", 3, 5)


def remove_nodes(spark, sf_dir):
    e = ring(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id"), F.concat("src", F.lit(".py")).alias("file_path")).distinct()
    return graph.remove_file(nodes, e, spark.createDataFrame([("n01.py",), ("n02.py",)], "file_path string"))[1].select("src", "dst", "type")


QUERIES = {f.__name__: f for f in (degree_topk, typed_degree, adjacency, neighbors_in, neighbors_out, suffix_lookup, edge_last_write_wins, longest_prefix_resolve, call_tree, import_chains, simple_cycles, mermaid_edges, directory_tree, remove_nodes)}

_LINKS = "links AS (SELECT page_id AS seq, url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages)"
_NAME = "'n' || lpad(({})::VARCHAR, 2, '0')"
_RING = f"""ring AS (SELECT * FROM (SELECT n_nationkey AS seq, {_NAME.format("n_nationkey")} AS src, {_NAME.format("(n_nationkey + 1) % 25")} AS dst, 'calls' AS type FROM nation
    UNION ALL SELECT n_nationkey, {_NAME.format("n_nationkey")}, {_NAME.format("n_nationkey * 2 % 25")}, 'imports' FROM nation) WHERE src <> dst)"""
_SUPPLY = "s AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'imports' END AS type FROM lineitem)"
_HOSTS = "h AS (SELECT DISTINCT id FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS id FROM pages) WHERE id <> '')"

ORACLES = {
    "degree_topk": f"WITH {_LINKS} SELECT dst AS id, count(*) AS degree FROM links GROUP BY 1 ORDER BY degree DESC, id LIMIT 10",
    "typed_degree": f"WITH {_SUPPLY}, d AS (SELECT dst, count(*) AS n FROM s WHERE type = 'calls' GROUP BY 1) SELECT s_suppkey AS id, coalesce(n, 0) AS degree FROM supplier LEFT JOIN d ON dst = s_suppkey WHERE s_nationkey % 2 = 0 ORDER BY degree DESC, id LIMIT 10",
    "adjacency": f"WITH {_LINKS} SELECT src, md5(string_agg(DISTINCT dst, ',' ORDER BY dst)) AS targets_md5 FROM links GROUP BY 1",
    "neighbors_in": f"WITH {_SUPPLY} SELECT DISTINCT src AS id, type FROM s WHERE dst = 1",
    "neighbors_out": f"WITH {_SUPPLY} SELECT DISTINCT dst AS id, type FROM s WHERE src = 1",
    "suffix_lookup": f"WITH {_HOSTS}, n(name) AS (VALUES ('com'), ('org'), ('net'), ('example.com'), ('example.org')) SELECT name, id FROM n JOIN h ON id = name OR ends_with(id, '.' || name)",
    "edge_last_write_wins": "SELECT user_id AS src, event_id % 7 AS dst, arg_max(event_type, event_id) AS type FROM events GROUP BY 1, 2",
    "longest_prefix_resolve": f"""WITH {_HOSTS}, t AS (SELECT array_to_string(list_reverse(string_split(id, '.')), '.') AS target FROM h),
        m AS (SELECT DISTINCT module FROM (SELECT regexp_extract(target, '^([^.]+(?:\\.[^.]+)?)', 1) AS module FROM t) WHERE length(module) % 2 = 1 OR NOT contains(module, '.'))
        SELECT target, arg_max(module, length(module)) AS module, arg_max(module, length(module)) || '.py' AS file FROM t JOIN m ON target = module OR starts_with(target, module || '.') GROUP BY 1""",
    "call_tree": f"WITH RECURSIVE {_RING}, e AS (SELECT DISTINCT src, dst FROM ring), t(node, depth, path) AS (SELECT 'n03', 0::BIGINT, 'n03' UNION ALL SELECT e.dst, depth + 1, path || '>' || e.dst FROM t JOIN e ON e.src = node WHERE depth < 3) SELECT depth, path FROM t WHERE depth > 0",
    "import_chains": f"""WITH RECURSIVE {_RING}, e AS (SELECT DISTINCT src, dst FROM ring WHERE src NOT IN ('n05', 'n08', 'n12')),
        t(node, path) AS (SELECT 'n03', ['n03'] UNION ALL SELECT e.dst, list_append(path, e.dst) FROM t JOIN e ON e.src = node WHERE len(path) < 4 AND NOT list_contains(path, e.dst))
        SELECT array_to_string(path, '>') AS chain, len(path)::BIGINT AS n FROM t WHERE len(path) > 1 AND node NOT IN (SELECT src FROM e)""",
    "simple_cycles": f"""WITH RECURSIVE {_RING}, e AS (SELECT DISTINCT src, dst FROM ring), t(start, node, path) AS (SELECT src, dst, [src, dst] FROM e WHERE dst >= src
        UNION ALL SELECT start, e.dst, list_append(path, e.dst) FROM t JOIN e ON e.src = node WHERE node <> start AND len(path) <= 6 AND e.dst >= start AND (e.dst = start OR NOT list_contains(path, e.dst)))
        SELECT array_to_string(path, '>') AS cycle FROM t WHERE node = start ORDER BY cycle LIMIT 10""",
    "mermaid_edges": f"WITH {_RING} SELECT 'flowchart TD' || chr(10) || string_agg('  ' || src || ' --> ' || dst, chr(10) ORDER BY seq, dst) AS diagram FROM ring WHERE type = 'imports'",
    "remove_nodes": f"WITH {_RING} SELECT src, dst, type FROM ring WHERE src NOT IN ('n01', 'n02') AND dst NOT IN ('n01', 'n02')",
    "directory_tree": """WITH p AS (SELECT DISTINCT string_split(path, '/') AS a FROM (SELECT regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1) AS path FROM pages) WHERE path <> ''),
        e AS (SELECT DISTINCT array_to_string(a[1:i - 1], '/') AS dir, a[i] AS name, i < len(a) AS is_dir, i - 1 AS depth FROM p, unnest(range(1, len(a) + 1)) AS t(i)),
        k AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY is_dir DESC, name) AS pos, count(*) OVER (PARTITION BY dir) AS n FROM e WHERE depth <= 3)
        SELECT CASE WHEN dir = '' THEN '' ELSE array_to_string(list_transform(string_split(dir, '/'), lambda p: '0' || p), chr(1)) || chr(1) END || CASE WHEN pos > 5 THEN '2' ELSE CASE WHEN is_dir THEN '0' ELSE '1' END || name END AS tree_path, repeat('  ', depth) || CASE WHEN pos > 5 THEN '... (' || (n - 5) || ' more)' ELSE name || CASE WHEN is_dir THEN '/' ELSE '' END END AS line FROM k WHERE pos <= 6""",
}
