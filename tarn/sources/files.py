"""Source trees, JSON documents and reports as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import clean_path, language_of

# Folders that no scan enters
PRUNED = (".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".mypy_cache", ".pytest_cache", "egg-info")
# Names of a tree's readme, in order of precedence
README_NAMES = ("README.md", "README.rst", "README.txt", "README")


def pruned(path, names: tuple[str, ...] = PRUNED) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*names))


def scan_tree(spark: SparkSession, root: str, supported_only: bool = True, extension: str | None = None, prune: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path relative to root, content, size, language) of the files below a folder that aren't empty (the binary source leaves those out). Sizes and paths are read without contents where these aren't asked for."""
    base = root.rstrip("/")
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    x = x.withColumn("path", clean_path(F.when(F.startswith(rel, F.lit(base + "/")), F.substring(rel, F.lit(len(base) + 2), F.length(rel))).otherwise(rel)))
    x = x.where(~pruned(F.col("path"), prune)).withColumn("language", language_of("path"))
    if extension:
        x = x.where(F.endswith("path", F.lit(extension)))
    return (x.where("language IS NOT NULL") if supported_only else x).select("path", "content", F.col("length").alias("size"), "language")


def decoded(files: DataFrame) -> DataFrame:
    """Adds text: UTF-8, where bytes that aren't are left out."""
    @F.pandas_udf("string")
    def utf8(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return files.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(utf8("content")))


def readme(files: DataFrame) -> DataFrame:
    """The first of the usual names at the top of a tree, as a chunk."""
    rank = F.array_position(F.array(*[F.lit(n) for n in README_NAMES]), F.col("path"))
    x = decoded(files.where(F.col("path").isin(*README_NAMES))).withColumn("_rank", rank).orderBy("_rank").limit(1)
    return x.select(F.col("text").alias("content"), F.col("path").alias("file_path"), F.lit("README").alias("symbol_name"), F.lit("readme").alias("symbol_type"))


def commit_text(sha, author, time, message=None) -> Column:
    """A commit as text; time: a timestamp."""
    lines = [F.format_string("Commit: %s\nAuthor: %s\nDate: %s", sha, author, F.date_format(time, "yyyy-MM-dd HH:mm:ss"))]
    return F.concat_ws("\nMessage: ", *lines, *([F.trim(message)] if message is not None else []))


def commit_chunks(commits: DataFrame, n: int = 10) -> DataFrame:
    """The latest commits (sha, author, time in epoch seconds, message) as chunks."""
    x = commits.orderBy(F.desc("time"), "sha").limit(n)
    content = commit_text("sha", "author", F.timestamp_seconds("time"), "message")
    return x.select(content.alias("content"), F.concat(F.lit("commits/"), "sha").alias("file_path"), F.concat(F.lit("commit "), F.left("sha", F.lit(7))).alias("symbol_name"), F.lit("github_commit").alias("symbol_type"))


def issue_chunks(issues: DataFrame) -> DataFrame:
    """Issues and pull requests (number, kind, title, state, body) from any source as chunks."""
    content = F.format_string("%s #%s: %s\nState: %s\n\n%s", "kind", F.col("number").cast("string"), "title", "state", F.coalesce("body", F.lit("")))
    return issues.select(content.alias("content"), F.concat(F.lit("issues/"), F.col("number").cast("string")).alias("file_path"), F.concat("kind", F.lit(" #"), F.col("number").cast("string")).alias("symbol_name"), F.lit("github_issue").alias("symbol_type"))


def git_log(spark: SparkSession, repo: str, n: int = 10) -> DataFrame:
    """Commits of a local clone, by the git program on the driver (a bounded number of rows)."""
    import subprocess

    out = subprocess.run(["git", "-C", repo, "log", f"-{n}", "--format=%H%x1f%an <%ae>%x1f%ct%x1f%B%x1e"], capture_output=True, text=True, check=False).stdout
    rows = [(a.strip(), b, int(c), d) for a, b, c, d in (r.split("\x1f") for r in out.split("\x1e") if r.count("\x1f") == 3)]
    return spark.createDataFrame(rows, "sha string, author string, time long, message string")


def acquire(address: str, target: str) -> str:
    """A local folder as it is; else a clone, or a pull where the clone exists (a failing pull leaves it as it is)."""
    import os
    import subprocess

    if os.path.isdir(address):
        return address
    if os.path.isdir(target):
        subprocess.run(["git", "-C", target, "pull", "--quiet"], check=False)
    else:
        subprocess.run(["git", "clone", "--quiet", "--", address, target], check=True)
    return target


def directory_tree(paths: DataFrame, path: str = "path", depth: int = 5, per_dir: int = 50) -> DataFrame:
    """(tree_path, line): folders and files in order, at most ``per_dir`` entries of a folder, the rest counted."""
    from pyspark.sql import Window

    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("dir"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("is_dir")))
    x = paths.where(F.col(path) != "").select(F.explode(up).alias("e")).select("e.*").distinct()
    x = x.withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))).where(F.col("depth") <= depth)
    w = Window.partitionBy("dir").orderBy(F.desc("is_dir"), "name")
    x = x.withColumns({"pos": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("dir"))}).where(F.col("pos") <= per_dir + 1)
    text = F.when(F.col("pos") > per_dir, F.concat(F.lit("... ("), (F.col("n") - per_dir).cast("string"), F.lit(" more)"))).otherwise(F.concat("name", F.when(F.col("is_dir"), "/").otherwise("")))
    # folders before files before the rest, on each level, so that a folder's entries follow it
    above = F.when(F.col("dir") == "", "").otherwise(F.concat(F.array_join(F.transform(F.split("dir", "/"), lambda p: F.concat(F.lit("0"), p)), "\x01"), F.lit("\x01")))
    order = F.concat(above, F.when(F.col("pos") > per_dir, "2").otherwise(F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), "name")))
    return x.select(order.alias("tree_path"), F.concat(F.repeat(F.lit("  "), F.col("depth")), text).alias("line"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def graph_to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a graph as JSON lines (kind, json)."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def graph_from_json(rows: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    of = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("j")).select("j.*")
    return of("node", node_schema), of("edge", edge_schema)
