"""Chunks of source text: overlapping line windows, merged imports, headers, ids and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import chunk_id, repo_slug

MOST_LINES, OVERLAP, HEADER_IMPORTS = 300, 30, 5


def lines_of(text: Column) -> Column:
    """Lines with their line breaks."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))


def windows(n: Column, most: int, overlap: int) -> Column:
    """Starts of windows of ``most`` lines; those after the first repeat ``overlap`` lines."""
    if most <= overlap:
        raise ValueError("a window must be longer than the overlap")
    stride = most - overlap
    return F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))


def split_overlapping(rows: DataFrame, text: str = "content", most: int = MOST_LINES, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window, with part (from 1), parts, first_line (from 0), n_lines and the window's text."""
    x = rows.withColumn("_lines", lines_of(F.coalesce(F.col(text), F.lit(""))))
    x = x.withColumn("_starts", windows(F.size("_lines"), most, overlap))
    x = x.select("*", F.posexplode("_starts").alias("_i", "_at"))
    piece = F.slice("_lines", F.col("_at") + 1, F.lit(most))
    return x.select(*[c for c in rows.columns if c != text], (F.col("_i") + 1).cast("long").alias("part"), F.size("_starts").cast("long").alias("parts"), F.col("_at").cast("long").alias("first_line"), F.size(piece).cast("long").alias("n_lines"), F.array_join(piece, "").alias(text))


def merged_imports(symbols: DataFrame) -> DataFrame:
    """One chunk for each file's imports."""
    x = symbols.where("type = 'import'").groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("_c"), F.min_by("start_line", "seq").alias("start_line"), F.max_by("end_line", "seq").alias("end_line"),
        F.min_by("language", "seq").alias("language"), F.min_by("fqn", "seq").alias("fqn"), F.min_by("symbol_id", "seq").alias("symbol_id"), F.min("seq").alias("seq"),
    )
    return x.withColumns({"content": F.array_join(F.transform("_c", lambda s: s["code"]), "\n"), "symbol_name": F.concat(F.lit("imports ("), F.col("n").cast("string"), F.lit(" statements)")), "symbol_type": F.lit("import")}).drop("_c")


def context_header(kind: Column, name: Column, parent: Column, imports: Column) -> Column:
    """The file's first imports and a line that says what the code is."""
    head = F.when(F.size(imports) > 0, F.concat(F.lit("// Dependency imports:\n"), F.array_join(F.slice(imports, 1, HEADER_IMPORTS), "\n"), F.lit("\n\n"))).otherwise("")
    scope = (
        F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("// Context: Method '"), name, F.lit("' of class '"), parent, F.lit("'\n")))
        .when(kind == "class", F.concat(F.lit("// Context: Class '"), name, F.lit("'\n")))
        .when(kind == "function", F.concat(F.lit("// Context: Function '"), name, F.lit("'\n")))
        .otherwise("")
    )
    return F.concat(head, scope)


def chunks_from_symbols(symbols: DataFrame, repo: str, most: int = MOST_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of a repository's symbols (seq, name, type, code, file_path, language, fqn, symbol_id, start_line, end_line, docstring, parent_class).

    Imports are one chunk a file; other symbols get a header with context; methods point to their class' chunk;
    long chunks are split into overlapping parts. Ids follow from repo, path, name and line.
    """
    slug = repo_slug(F.lit(repo))
    of_file = Window.partitionBy("file_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = symbols.withColumn("_imports", F.collect_list(F.when(F.col("type") == "import", F.col("code"))).over(of_file)).where("type != 'import'")
    own = lambda path, fqn, name, line: chunk_id(slug, path, F.coalesce(F.nullif(F.col(fqn), F.lit("")), F.col(name)), line)
    classes = symbols.where("type = 'class'").groupBy(F.col("fqn").alias("_class_fqn")).agg(F.max_by(own("file_path", "fqn", "name", "start_line"), "seq").alias("_class_id"))
    x = x.withColumn("_up", F.regexp_replace("fqn", r"\.[^.]*$", "")).join(classes, F.col("_up") == F.col("_class_fqn"), "left")
    body = x.select(
        "seq", F.concat(context_header(F.col("type"), F.col("name"), F.col("parent_class"), F.col("_imports")), "code").alias("content"), "file_path", F.col("name").alias("symbol_name"), F.col("type").alias("symbol_type"), "language", "start_line", "end_line",
        "docstring", F.when(F.col("type") != "class", F.col("parent_class")).alias("parent_class"), "fqn", "symbol_id", F.when((F.col("type") != "class") & (F.coalesce("parent_class", F.lit("")) != ""), F.col("_class_id")).alias("parent_chunk_id"),
    )
    none = F.lit(None).cast("string")
    imports = merged_imports(symbols).select("seq", "content", "file_path", "symbol_name", "symbol_type", "language", "start_line", "end_line", none.alias("docstring"), none.alias("parent_class"), "fqn", "symbol_id", none.alias("parent_chunk_id"))
    y = split_overlapping(body.unionByName(imports), "content", most, overlap)
    many = F.col("parts") > 1
    tag = F.when(many, F.concat(F.lit("__part"), F.col("part").cast("string"))).otherwise("")
    tagged = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(c, tag)).otherwise(F.col(c))
    first = F.col("start_line") + F.col("first_line")
    y = y.withColumns({
        "symbol_name": F.concat("symbol_name", tag), "fqn": tagged("fqn"), "symbol_id": tagged("symbol_id"), "docstring": F.when(F.col("part") == 1, F.col("docstring")),
        "end_line": F.when(many, (first + F.col("n_lines") - 1).cast("int")).otherwise(F.col("end_line")), "start_line": F.when(many, first.cast("int")).otherwise(F.col("start_line")),
        "repo_name": F.lit(repo), "repo_id": slug,
    })
    return y.withColumn("id", own("file_path", "fqn", "symbol_name", "start_line")).orderBy("seq", "part").drop("first_line", "n_lines", "parts")
