"""Knowledge, call and dependency graphs of a source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import module_name
from tarn.operators.graph import longest_prefix, upsert_nodes
from tarn.operators.resolve import parse_imports, resolve
from tarn.sources.parse import body_facts, import_statements, place


def definitions(symbols: DataFrame) -> DataFrame:
    """(module, name, fqn, seq) of classes and functions at a module's top."""
    x = symbols.where("type IN ('class', 'function')")
    return x.select(module_name("file_path").alias("module"), "name", "fqn", "seq")


def file_modules(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), module_name("path").alias("module"))


def resolver_tables(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(imports, definitions, files) that resolve() needs."""
    imports = parse_imports(symbols.where("type = 'import' AND language = 'python'").select(F.col("file_path").alias("file"), "seq", "code"))
    return imports, definitions(symbols), file_modules(files)


def _within(seq: str = "seq", n: str = "ord") -> Column:
    """The place of a symbol's n-th fact: after the symbol, before the next."""
    return place(F.col(seq)["file_path"], F.col(seq)["at"], F.col(n) + 1)


def knowledge_graph(files: DataFrame, symbols: DataFrame, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(id, type, file_path, line, seq) and edges(src, dst, type, seq): contains, calls, inherits, imports.

    facts: body_facts of the files, if they are at hand. Facts of a body belong to the definition on their own line, so that methods of one name don't share calls.
    """
    facts = body_facts(files) if facts is None else facts
    imports, defs, modules = resolver_tables(files, symbols)
    own = symbols.where("type != 'import'")
    mods = own.select("file_path").distinct().select(module_name("file_path").alias("id"), F.lit("module").alias("type"), "file_path", F.lit(1).alias("line"), place("file_path", 0).alias("seq"))
    nodes = mods.unionByName(own.select(F.col("fqn").alias("id"), "type", "file_path", F.col("start_line").alias("line"), "seq"))
    up = F.when(F.coalesce("parent_class", F.lit("")) != "", F.concat_ws(".", F.nullif(module_name("file_path"), F.lit("")), "parent_class")).otherwise(module_name("file_path"))
    contains = own.select(up.alias("src"), F.col("fqn").alias("dst"), F.lit("contains").alias("type"), "seq")
    at = own.select(F.col("file_path").alias("_p"), F.col("start_line").alias("_l"), "fqn", "seq", F.col("type").alias("_t"))
    f = facts.join(at, (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")))
    # self.x is the class' own method
    cls = F.regexp_extract("owner", r"^(.*)\.[^.]+$", 1)
    symbol = F.when(F.startswith("text", F.lit("self.")) & (cls != ""), F.concat(cls, F.substring("text", F.lit(5), F.length("text")))).otherwise(F.col("text"))
    f = f.withColumn("symbol", symbol)
    wanted = f.where("kind IN ('call', 'base')").select(F.col("path").alias("file"), "symbol").distinct()
    named = resolve(wanted, imports, defs, modules).select(F.col("file").alias("_rf"), F.col("symbol").alias("_rs"), F.col("fqn").alias("target"))
    r = f.join(named, (F.col("path") == F.col("_rf")) & (F.col("symbol") == F.col("_rs")))
    calls = r.where("kind = 'call'").select(F.col("fqn").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("type"), _within().alias("seq"))
    inherits = r.where("kind = 'base'").select(F.col("fqn").alias("src"), F.col("target").alias("dst"), F.lit("inherits").alias("type"), _within().alias("seq"))
    variables = f.where("kind = 'variable'").select(F.concat("fqn", F.lit("."), "text").alias("id"), F.lit("variable").alias("type"), F.col("path").alias("file_path"), "line", _within().alias("seq"))
    holds = variables.select(F.regexp_replace("id", r"\.[^.]+$", "").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), "seq")
    known = modules.join(mods.select(F.col("id").alias("_m")), F.col("module") == F.col("_m"), "left_semi").select("module", "file")
    hit = longest_prefix(imports.select("target"), known)
    into = imports.join(hit.select(F.col("target").alias("_t"), F.col("module").alias("dst")), F.col("target") == F.col("_t")).join(modules.select(F.col("file").alias("_f"), F.col("module").alias("src")), F.col("file") == F.col("_f"))
    brings = into.where("src != dst").select("src", "dst", F.lit("imports").alias("type"), "seq")
    edges = contains.unionByName(calls).unionByName(inherits).unionByName(holds).unionByName(brings)
    edges = edges.groupBy("src", "dst", "type").agg(F.min("seq").alias("seq"))
    loose = edges.select(F.col("dst").alias("id"), F.lit("external").alias("type"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"), F.col("seq"))
    known_ids = nodes.unionByName(variables).select(F.col("id").alias("_k")).distinct()
    loose = loose.join(known_ids, F.col("id") == F.col("_k"), "left_anti")
    return upsert_nodes(nodes.unionByName(variables).unionByName(loose)), edges


def call_graph(files: DataFrame, symbols: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """edges(src, dst, file_path, seq): a callee is the one definition of its short name in the file, if there is just one, else the short name."""
    own = symbols.where("type IN ('function', 'method')")
    at = own.select(F.col("file_path").alias("_p"), F.col("start_line").alias("_l"), "fqn", "seq")
    f = (body_facts(files) if facts is None else facts).where("kind = 'call'").join(at, (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")))
    short = F.regexp_extract("text", r"([^.]+)$", 1)
    one = own.groupBy(F.col("file_path").alias("_f"), F.col("name").alias("_n")).agg(F.count(F.lit(1)).alias("_c"), F.first("fqn").alias("_one")).where("_c = 1")
    x = f.withColumn("short", short).join(one, (F.col("path") == F.col("_f")) & (F.col("short") == F.col("_n")), "left")
    return x.groupBy(F.col("fqn").alias("src"), F.coalesce("_one", "short").alias("dst")).agg(F.min("path").alias("file_path"), F.min(_within()).alias("seq"))


def dependency_graph(files: DataFrame) -> DataFrame:
    """edges(src, dst, type, seq) between files by the longest module prefix; relative imports count from the file's package."""
    py = files.where("language = 'python'")
    modules = file_modules(py)
    said = import_statements(files).withColumnRenamed("module", "asked")
    x = said.join(modules, F.col("path") == F.col("file")).select("path", F.col("module").alias("own"), "asked", "level", "line", "ord")
    is_package = F.endswith("path", F.lit("__init__.py"))
    parts = F.split("own", r"\.")
    up = F.col("level") - F.when(is_package, 1).otherwise(0)
    keep = F.size(parts) - up
    package = F.when(keep > 0, F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), "."))
    target = F.when(F.col("level") == 0, F.col("asked")).when((keep > 0), F.concat_ws(".", package, F.nullif(F.col("asked"), F.lit(""))))
    x = x.withColumn("target", target).where("target IS NOT NULL AND target != ''")
    hit = longest_prefix(x.select("target"), modules).select(F.col("target").alias("_t"), F.col("file").alias("dst"))
    return x.join(hit, F.col("target") == F.col("_t")).where("path != dst").groupBy(F.col("path").alias("src"), "dst").agg(F.lit("imports").alias("type"), F.min(place("path", "line", "ord")).alias("seq"))

