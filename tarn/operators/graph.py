"""Property graphs as node and edge tables, and their traversals.

nodes(id, type, file_path, line, seq), edges(src, dst, type, seq). By default parallel edges of different type are kept;
``last_write_wins`` gives a simple digraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the type of the last in seq."""
    return edges.groupBy("src", "dst").agg(F.max_by("type", "seq").alias("type"), F.min("seq").alias("seq"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id, attributes of the last write, place of the first."""
    rest = [c for c in nodes.columns if c not in ("id", "seq")]
    return nodes.groupBy("id").agg(*[F.max_by(c, "seq").alias(c) for c in rest], F.min("seq").alias("seq"))


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("type") == kind)


def in_degree_topk(edges: DataFrame, k: int, nodes: DataFrame | None = None, types: list[str] | None = None, node_types: list[str] | None = None) -> DataFrame:
    """(id, degree), most first, ties by the nodes' seq then id. Nodes without edges count 0 if nodes are given."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    d = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return d.orderBy(F.desc("degree"), "id").limit(k)
    n = nodes if node_types is None else nodes.where(F.col("type").isin(node_types))
    x = n.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), "seq")
    return x.orderBy(F.desc("degree"), "seq", "id").limit(k).select("id", "degree")


def neighbors_out(edges: DataFrame, ids: Column | str, types: list[str] | None = None) -> DataFrame:
    e = edges if types is None else edges.where(F.col("type").isin(types))
    return e.where(F.col("src") == ids).select(F.col("dst").alias("id"), "type")


def neighbors_in(edges: DataFrame, ids: Column | str, types: list[str] | None = None) -> DataFrame:
    e = edges if types is None else edges.where(F.col("type").isin(types))
    return e.where(F.col("dst") == ids).select(F.col("src").alias("id"), "type")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets): targets in order, joined by commas."""
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), ",").alias("targets"))


def suffix_index(nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """(suffix, id) for every dotted suffix of an id: suffix matches become equi joins."""
    parts = F.split(F.col(id_col), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return nodes.select(F.explode(F.array_distinct(suffixes)).alias("suffix"), F.col(id_col).alias("id"))


def lookup(nodes: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """(name, id): ids that equal a name or end in .name"""
    return names.select(name).distinct().join(suffix_index(nodes), F.col(name) == F.col("suffix")).select(name, "id")


def related(nodes: DataFrame, edges: DataFrame, names: DataFrame, kind: str | None, incoming: bool, distinct: bool = False) -> DataFrame:
    """(name, id) over edges of one type (None: any) into or out of the nodes that match the names."""
    hit = lookup(nodes, names)
    e = edges if kind is None else edges.where(F.col("type") == kind)
    a, b = ("dst", "src") if incoming else ("src", "dst")
    x = hit.join(e.select(F.col(a).alias("_at"), F.col(b).alias("_to")), F.col("id") == F.col("_at")).select("name", F.col("_to").alias("id"))
    return x.distinct() if distinct else x


def callers(nodes, edges, names):
    return related(nodes, edges, names, "calls", True)


def callees(nodes, edges, names):
    return related(nodes, edges, names, "calls", False)


def references(nodes, edges, names):
    return related(nodes, edges, names, None, True, True)


def implementations(nodes, edges, names):
    return related(nodes, edges, names, "inherits", True)


def bases(nodes, edges, names):
    return related(nodes, edges, names, "inherits", False)


def file_modules(nodes: DataFrame) -> DataFrame:
    """(file_path, id): the first module of each file."""
    return nodes.where("type = 'module'").groupBy("file_path").agg(F.min_by("id", "seq").alias("id"))


def dependencies(nodes: DataFrame, edges: DataFrame, file_path: str, incoming: bool = False) -> DataFrame:
    """Modules that a file's module imports, or that import it."""
    at = file_modules(nodes).where(F.col("file_path") == file_path).select(F.col("id").alias("_id"))
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return at.join(edges.where("type = 'imports'"), F.col("_id") == F.col(a)).select(F.col(b).alias("id")).distinct()


def _views(spark, **frames: DataFrame) -> dict[str, str]:
    """Temporary views under names of their own."""
    import uuid

    out = {}
    for name, df in frames.items():
        out[name] = f"{name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(out[name])
    return out


def call_tree(edges: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """(depth, path) rows of the tree of calls below a root; cycles end by depth."""
    v = _views(edges.sparkSession, e=edges.select("src", "dst").distinct())
    q = root.replace("'", "''")
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE t(node, depth, path) AS (
          SELECT CAST('{q}' AS STRING), 0, CAST('{q}' AS STRING)
          UNION ALL SELECT e.dst, t.depth + 1, concat(t.path, '>', e.dst) FROM t JOIN {v["e"]} e ON e.src = t.node WHERE t.depth < {depth})
        SELECT CAST(depth AS BIGINT) AS depth, path FROM t WHERE depth > 0""")


def import_chains(edges: DataFrame, root: str, most: int = 3) -> DataFrame:
    """Simple paths (2 to ``most`` nodes) from a module to modules that import nothing."""
    v = _views(edges.sparkSession, e=edges.where("type = 'imports'").select("src", "dst").distinct())
    q = root.replace("'", "''")
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE t(node, path) AS (
          SELECT CAST('{q}' AS STRING), array(CAST('{q}' AS STRING))
          UNION ALL SELECT e.dst, array_append(t.path, e.dst) FROM t JOIN {v["e"]} e ON e.src = t.node
          WHERE size(t.path) < {most} AND NOT array_contains(t.path, e.dst))
        SELECT array_join(path, '>') AS chain, CAST(size(path) AS BIGINT) AS n FROM t LEFT ANTI JOIN {v["e"]} x ON x.src = t.node WHERE size(path) > 1""")


def core(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """Edges between nodes that have edges in and out, after some rounds of peeling: cycles lie within."""
    e = edges.select("src", "dst").distinct()
    for _ in range(rounds):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return e


def simple_cycles(edges: DataFrame, most: int = 5, limit: int | None = 10, rounds: int = 2) -> DataFrame:
    """Cycles of up to ``most`` nodes, each from its least node on, the first ``limit`` in order."""
    v = _views(edges.sparkSession, e=core(edges, rounds))
    out = edges.sparkSession.sql(f"""
        WITH RECURSIVE t(start, node, path) AS (
          SELECT src, dst, array(src, dst) FROM {v["e"]} WHERE dst >= src
          UNION ALL SELECT t.start, e.dst, array_append(t.path, e.dst) FROM t JOIN {v["e"]} e ON e.src = t.node
          WHERE t.node != t.start AND size(t.path) <= {most} AND e.dst >= t.start AND (e.dst = t.start OR NOT array_contains(t.path, e.dst)))
        SELECT array_join(path, '>') AS cycle FROM t WHERE node = start""")
    return out if limit is None else out.orderBy("cycle").limit(limit)


def remove_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the nodes of some files (file_path) and the edges that meet them."""
    p = paths.select(F.col("file_path").alias("_p")).distinct()
    gone = nodes.join(p, (F.col("file_path") == F.col("_p")) | F.startswith(F.col("id"), F.concat("_p", F.lit(":"))), "left_semi").select(F.col("id").alias("_g"))
    left = nodes.join(gone, F.col("id") == F.col("_g"), "left_anti")
    kept = edges.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti")
    return left, kept


def longest_prefix(targets: DataFrame, modules: DataFrame, target: str = "target") -> DataFrame:
    """(target, module, file): the longest dotted prefix of a target that is a module; targets without one are left out.

    Prefixes are exploded, so the match is an equi join.
    """
    parts = F.split(F.col(target), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), ".").alias("module")))
    x = targets.select(target).distinct().select(target, F.explode(prefixes).alias("p")).select(target, "p.n", "p.module")
    return x.join(modules, "module").groupBy(target).agg(F.max_by("module", "n").alias("module"), F.max_by("file", "n").alias("file"))


def mermaid(edges: DataFrame, kind: str) -> DataFrame:
    """One row with a diagram: 'imports' a flow chart, 'inherits' a class diagram."""
    head, none = ("flowchart TD", "  NoDependenciesFound") if kind == "imports" else ("classDiagram", "  class NoInheritances {\n  }")
    line = F.concat(F.lit("  "), "src", F.lit(" --> "), "dst") if kind == "imports" else F.concat(F.lit("  "), "dst", F.lit(" <|-- "), "src")
    x = edges.where(F.col("type") == kind).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda s: s["line"]), "\n")
    return x.select(F.concat(F.lit(head + "\n"), F.when(F.size("l") > 0, body).otherwise(none)).alias("diagram"))


def sequence_diagram(edges: DataFrame, nodes: DataFrame, function: str, depth: int = 4) -> list[str]:
    """Lines of the calls met by a depth-first walk from a function, each function once.

    The walk follows the order of calls, so it runs on the driver, but only over what ``depth`` steps reach.
    """
    calls = edges.where("type = 'calls'")
    start = nodes.where((F.col("id") == function) | F.col("id").endswith("." + function)).orderBy("seq").limit(1).collect()
    lines = ["sequenceDiagram"]
    if not start:
        return [*lines, "  User ->> System: FunctionNotFound"]
    root = start[0]["id"]
    known: dict[str, list[str]] = {}
    front = [root]
    for _ in range(depth):
        new = [n for n in front if n not in known]
        if not new:
            break
        got = calls.where(F.col("src").isin(new)).orderBy("seq").collect()
        known |= {n: [] for n in new}
        for r in got:
            known[r["src"]].append(r["dst"])
        front = list(dict.fromkeys(r["dst"] for r in got))
    seen: set[str] = set()
    short = lambda n: n.rsplit(".", 1)[-1]
    stack: list[tuple] = [("visit", root, 1)]
    while stack:
        what, node, level = stack.pop()
        if what == "line":
            lines.append(node)
            continue
        if level > depth or node in seen:
            continue
        seen.add(node)
        for to in reversed(known.get(node, [])):
            stack += [("visit", to, level + 1), ("line", f"  {short(node)} ->> {short(to)}: call", level)]
    return lines
