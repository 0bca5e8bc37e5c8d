"""Names to fully qualified names through imports, the local module and all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_imports(statements: DataFrame, code: str = "code") -> DataFrame:
    """(file, alias, target, seq, item) of Python import statements; item counts the names of one.

    ``from m import a as b`` gives b -> m.a, ``import x.y as z`` gives z -> x.y, ``import x.y`` gives x.y -> x.y and, so that
    a use of the first part is found too, x -> x.
    """
    c = F.trim(F.regexp_replace(F.regexp_replace(F.col(code), r"[()\\\n]", " "), r"#.*$", ""))
    x = statements.select("file", "seq", c.alias("c"))
    module = F.regexp_extract("c", r"^from\s+(\S+)\s+import\s+(.*)$", 1)
    names = F.when(module != "", F.regexp_extract("c", r"^from\s+(\S+)\s+import\s+(.*)$", 2)).otherwise(F.regexp_extract("c", r"^import\s+(.*)$", 1))
    x = x.select("file", "seq", module.alias("m"), F.posexplode(F.split(names, ",")).alias("i", "item")).withColumn("item", F.trim("item")).where("item != ''")
    x = x.select("file", "seq", "i", "m", F.regexp_extract("item", r"^(\S+)", 1).alias("name"), F.nullif(F.regexp_extract("item", r"\sas\s+(\S+)$", 1), F.lit("")).alias("renamed"))
    target = F.when(F.col("m") != "", F.concat("m", F.lit("."), "name")).otherwise(F.col("name"))
    own = F.struct(F.coalesce("renamed", "name").alias("alias"), target.alias("target"))
    head = F.regexp_extract("name", r"^([^.]+)", 1)
    first = F.when((F.col("m") == "") & F.col("renamed").isNull() & F.contains("name", F.lit(".")), F.array(own, F.struct(head.alias("alias"), head.alias("target")))).otherwise(F.array(own))
    return x.select("file", "seq", F.col("i").alias("item"), F.explode(first).alias("e")).select("file", "e.alias", "e.target", "seq", "item")


def resolve(refs: DataFrame, imports: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(file, symbol) with fqn: the import of its first part, else the local definition, else the first module's that defines
    it, else module.symbol. Further parts are appended.

    imports(file, alias, target, seq, item), defs(module, name, fqn, seq), files(file, module).
    """
    base = F.split_part("symbol", F.lit("."), F.lit(1))
    tail = F.substring("symbol", F.length(base) + 1, F.length("symbol"))
    last = imports.groupBy(F.col("file").alias("_f"), F.col("alias").alias("_a")).agg(F.max_by("target", F.struct("seq", "item")).alias("_by_import"))
    local = defs.groupBy(F.col("module").alias("_m"), F.col("name").alias("_n")).agg(F.max_by("fqn", "seq").alias("_by_module"))
    modules = defs.groupBy("module").agg(F.min("seq").alias("at"))
    everywhere = local.join(modules, F.col("_m") == F.col("module")).groupBy(F.col("_n").alias("_g")).agg(F.min_by("_by_module", "at").alias("_by_name"))
    x = refs.withColumns({"_base": base, "_tail": tail}).join(files.withColumnRenamed("file", "_file"), F.col("file") == F.col("_file"), "left")
    x = x.join(last, (F.col("file") == F.col("_f")) & (F.col("_base") == F.col("_a")), "left")
    x = x.join(local, (F.col("module") == F.col("_m")) & (F.col("_base") == F.col("_n")), "left")
    x = x.join(everywhere, F.col("_base") == F.col("_g"), "left")
    found = F.coalesce("_by_import", "_by_module", "_by_name")
    rest = F.concat_ws(".", F.nullif(F.col("module"), F.lit("")), "symbol")
    return x.select("file", "symbol", F.when(found.isNotNull(), F.concat(found, "_tail")).otherwise(rest).alias("fqn"))
