"""Scalar functions on names, paths, code text and questions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".cs": "c_sharp",
}

# Phrases of each question category, in order of precedence
INTENTS = (
    ("repo_overview", ("repo overview", "repository overview", "give me an overview", "summarize this repo")),
    ("architecture", ("architecture summary", "system overview", "what does this repository do", "what does this repo do", "overall architecture")),
    ("function_usage", None),
    ("file_dependencies", ("what depends on", "which files import", "what files import", "who imports", "file dependencies", "dependencies of")),
    ("file_explanation", ("explain file", "describe file", "summarize file", "what does file")),
)
# Leads to a file's path, in order of precedence
FILE_LEADS = (
    r"explain\s+file",
    r"describe\s+file",
    r"summarize\s+file",
    r"what\s+does\s+file",
    r"what\s+files\s+import",
    r"which\s+files\s+import",
    r"who\s+imports",
    r"what\s+depends\s+on",
    r"dependencies\s+of",
)
# Accepted forms of a repository's address
REPO_ADDRESSES = (
    r"^https?://[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+/?$",
    r"^git@[a-zA-Z0-9._-]+:[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+\.git$",
    r"^[a-zA-Z0-9._/-]+$",
)
TOKEN = r"[0-9]+|[a-z]+|[A-Z]+[a-z]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def code_tokens(text) -> Column:
    """Lower-case words of camelCase, snake_case and digits; other characters separate."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0)), F.lower)


def language_of(path) -> Column:
    """Language by extension, null if unknown. Leading dots of a file name are no extension."""
    base = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, ext)


def repo_slug(address) -> Column:
    """Last part of an address or name without .git, in lower case; 'unknown' if empty."""
    a = _c(address)
    last = F.regexp_extract(F.regexp_replace(a, "/+$", ""), "([^/]*)$", 1)
    return F.when(a.isNull() | (a == ""), "unknown").otherwise(F.trim(F.lower(F.regexp_replace(last, r"\.git$", ""))))


def clean_path(path, root: str | None = None) -> Column:
    """Path with forward slashes, relative to root, without a leading ./ or outer slashes."""
    p = F.coalesce(_c(path), F.lit(""))
    if root:
        at = root.rstrip("/") + "/"
        p = F.when(p.startswith(at), F.substring(p, F.lit(len(at) + 1), F.length(p))).otherwise(p)
    p = F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.regexp_replace(p, r"^\./", "")


def module_name(path) -> Column:
    """Dotted module of a relative path; a package's __init__ is the package."""
    stem = F.regexp_replace(clean_path(path), r"(?<=[^/.])\.[^./]*$", "")
    parts = F.filter(F.split(stem, "/"), lambda x: (x != "") & (x != "."))
    n = F.size(parts)
    parts = F.when((n > 0) & (F.try_element_at(parts, F.lit(-1)) == "__init__"), F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(parts, ".")


def qualified_name(module, parent, name) -> Column:
    """Non-empty parts joined by dots."""
    return F.concat_ws(".", *[F.nullif(_c(x), F.lit("")) for x in (module, parent, name)])


def symbol_id(repo, path, fqn, line) -> Column:
    return F.concat(repo_slug(repo), F.lit(":"), clean_path(path), F.lit(":"), _c(fqn), F.lit(":"), _c(line).cast("string"))


def chunk_id(repo, path, symbol, line) -> Column:
    """16 hex digits that depend on repo, path, symbol and line."""
    return F.substring(F.sha2(F.concat_ws(":", _c(repo), _c(path), _c(symbol), _c(line).cast("string")), 256), 1, 16)


def embedding_text(path, kind, name, parent, doc, content) -> Column:
    """What is embedded for a chunk: labelled parts with blank lines between; empty class and docstring are left out."""
    part = lambda label, x: F.when(_c(x) != "", F.concat(F.lit(label), _c(x)))
    return F.concat_ws("\n\n", F.concat(F.lit("File: "), _c(path)), F.concat(_c(kind), F.lit(": "), _c(name)), part("Class: ", parent), part("Docstring: ", doc), F.concat(F.lit("Code:\n"), _c(content)))


def intent(question) -> Column:
    """Category of a question."""
    q = F.lower(F.trim(_c(question)))
    out = None
    for name, phrases in INTENTS:
        if phrases is None:
            test = (q.contains("where is") | q.contains("where's") | q.contains("who calls")) & q.contains("used")
        else:
            test = F.lit(False)
            for p in phrases:
                test = test | q.contains(p)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("code_question")


def _found(q: Column, pattern: str) -> Column:
    return F.when(q.rlike(pattern), F.regexp_replace(F.trim(F.regexp_extract(q, pattern, 1)), "^[`'\"]+|[`'\"]+$", ""))


def _asked(question) -> Column:
    return F.regexp_replace(F.trim(_c(question)), r"\?+$", "")


def function_in(question) -> Column:
    """Function that a usage question names, else null."""
    q = _asked(question)
    return F.coalesce(_found(q, r"(?i)where\s+is\s+(.+?)\s+used"), _found(q, r"(?i)who\s+calls\s+(.+)"), _found(q, r"(?i)([A-Za-z0-9_.]+)\s+used"))


def file_in(question) -> Column:
    """Path that a question names, else null: the first word after a lead, or anything that ends in .py."""
    q = _asked(question)
    first = lambda c: F.regexp_replace(F.split(c, r"\s+").getItem(0), "[,.;]+$", "")
    return F.coalesce(*[first(_found(q, rf"(?i){lead}\s+(.+)")) for lead in FILE_LEADS], _found(q, r"([A-Za-z0-9_/.-]+\.py)"))


def valid_address(url) -> Column:
    u = _c(url)
    test = F.lit(False)
    for p in REPO_ADDRESSES:
        test = test | u.rlike(p)
    return F.coalesce(test, F.lit(False))


def unfenced(text) -> Column:
    """Text inside a code fence, else the text."""
    t = F.trim(_c(text))
    inner = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n[^\n]*$", ""))
    inner = F.trim(F.regexp_replace(inner, "^json", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def cut(text, most: int) -> Column:
    return F.left(_c(text), F.lit(most))


def line_count(text) -> Column:
    """Lines of a text; a final line break begins no line."""
    t = F.coalesce(_c(text), F.lit(""))
    ends = F.regexp_count(t, F.lit(r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"))
    return F.when(t == "", 0).otherwise(ends + F.when(t.rlike(r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ])\z"), 0).otherwise(1)).cast("long")


def clean_key(key) -> Column:
    return F.regexp_replace(F.trim(_c(key)), "^[\"']|[\"']$", "")


def memory_markdown(description, language, style, stack, patterns, faqs) -> Column:
    """A repository's profile and questions as markdown. faqs: array of (question, answer)."""
    item = lambda label, value: F.concat(F.lit(f"- **{label}**: "), value)
    listed = lambda label, a: F.when(F.size(_c(a)) > 0, item(label, F.array_join(_c(a), ", ")))
    asked = F.transform(_c(faqs), lambda x, i: F.concat(F.lit("### Q"), (i + 1).cast("string"), F.lit(": "), x["question"], F.lit("\n**A**: "), x["answer"]))
    head = F.concat_ws("\n", F.lit("## Repository Stack Profile"), item("Description", _c(description)), item("Primary Language", _c(language)), item("Architecture Style", _c(style)), listed("Tech Stack", stack), listed("Design Patterns", patterns), F.lit("\n## Frequently Asked Questions (FAQ)"))
    return F.concat_ws("\n", head, F.nullif(F.array_join(asked, "\n"), F.lit("")))


def log_record(time, level, logger, message, trace=None) -> Column:
    """A log line as JSON; an absent trace is left out."""
    return F.to_json(F.struct(_c(time).alias("timestamp"), _c(level).alias("level"), _c(logger).alias("logger"), _c(message).alias("message"), (_c(trace) if trace is not None else F.lit(None).cast("string")).alias("trace_id")))
