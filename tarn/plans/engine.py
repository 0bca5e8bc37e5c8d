"""The engine's face: ingest a tree, ask questions of it, run plans, render reports."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.operators import chunk, code_graph, embed, graph, incremental, lexical, retrieve, state
from tarn.operators.vector_search import vector_topk
from tarn.session import materialize
from tarn.sources import files as source
from tarn.sources import versioned
from tarn.sources.parse import body_facts, parse_symbols

TOOLS = ("find_references", "find_implementations", "find_inheritance", "find_dependency_chains", "ask_question")
PLAN_SCHEMA = "array<struct<tool:string,symbol_name:string,class_name:string,file_path:string,query:string>>"
PROMPTS = {
    "answer": "Answer from the numbered sources only and name the files you use.\n\nSources:\n%s\n\nEarlier turns:\n%s\n\nQuestion: %s",
    "review": "Review this file for faults, risks and unclear parts.\n\nFile: %s\n\n%s",
    "beginner": "Explain this code to someone who is new to programming.\n\n%s",
    "intermediate": "Explain this code to a working programmer.\n\n%s",
    "expert": "Explain this code's design and its trade-offs to an expert.\n\n%s",
    "architecture": "Describe the architecture of a system with this tree and these hubs.\n\n%s\n\n%s",
}


# The summary of a graph's hubs
NO_HUBS, HUBS = "No internal Python dependencies detected.", "Top dependency hubs"


def quoted(prompt: str) -> str:
    """Stand-in for a language model: the end of the prompt."""
    return prompt[-400:]


@dataclass
class IngestResult:
    repo_name: str
    num_files: int
    num_symbols: int
    num_chunks: int
    indexing_time: float


#: Answers that an engine keeps.
MOST_ANSWERS = 256
MESSAGES = "conv_id string, turn long, role string, text string"


class Engine:
    """A repository's tables below one folder, and the questions they answer.

    ``model`` turns a prompt into text, at once or as an iterator of pieces.
    """

    def __init__(self, spark: SparkSession, home: str, repo: str, model: Callable[[str], str | Iterator[str]] = quoted, embedder: Callable[[], object] = embed.HashEmbedder):
        self.spark, self.home, self.repo, self.model, self.embedder = spark, home.rstrip("/"), repo, model, embedder
        self.answers: OrderedDict[tuple, dict] = OrderedDict()
        self.version = 0

    def ask(self, prompt: str) -> str:
        said = self.model(prompt)
        return said if isinstance(said, str) else "".join(said)

    def _path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def read(self, name: str) -> DataFrame:
        found = versioned.read(self.spark, self._path(name))
        if found is None:
            raise LookupError(f"{self.repo} has no {name} yet")
        return found

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        return versioned.save(df, self._path(name))

    def _or_empty(self, name: str, schema: str) -> DataFrame:
        found = versioned.read(self.spark, self._path(name))
        return self.spark.createDataFrame([], schema) if found is None else found

    def metadata(self, root: str, issues: DataFrame | None = None) -> DataFrame:
        """README, latest commits and issues as chunks beside those of the code."""
        found = source.readme(source.scan_tree(self.spark, root, supported_only=False)).unionByName(source.commit_chunks(source.git_log(self.spark, root)))
        if issues is not None:
            found = found.unionByName(source.issue_chunks(issues))
        slug = fn.repo_slug(F.lit(self.repo))
        return found.withColumns({"id": fn.chunk_id(slug, F.col("file_path"), F.col("symbol_name"), F.lit(1)), "repo_name": F.lit(self.repo), "repo_id": slug, "start_line": F.lit(1), "end_line": fn.line_count("content").cast("int")})

    def ingest(self, root: str, incremental_run: bool = False, issues: DataFrame | None = None) -> IngestResult:
        """Scan, parse, chunk, embed and build the graph; an incremental run decodes, parses and embeds only what has changed."""
        began = time.time()
        tree = source.scan_tree(self.spark, root)
        new = incremental.snapshot(tree)
        columns = ("path", "language", "text")
        if incremental_run:
            new = materialize(new, "snapshot")
            changes = materialize(incremental.snapshot_diff(self.read("snapshot"), new), "changes")
            if changes.isEmpty():
                return IngestResult(self.repo, *self.counts(), time.time() - began)
            touched = changes.select("file_path")
            again = source.decoded(tree.join(touched, F.col("path") == F.col("file_path"), "left_semi")).select(*columns)
            again = materialize(again, "changed")
            left = lambda name, path: self.read(name).join(touched.withColumnRenamed("file_path", "_p"), F.col(path) == F.col("_p"), "left_anti")
            files = self._save(left("files", "path").unionByName(again), "files")
            symbols = self._save(left("symbols", "file_path").unionByName(parse_symbols(again, self.repo)), "symbols")
            facts = self._save(left("facts", "path").unionByName(body_facts(again)), "facts")
        else:
            files = self._save(source.decoded(tree).select(*columns), "files")
            symbols = self._save(parse_symbols(files, self.repo), "symbols")
            facts = self._save(body_facts(files), "facts")
        code = chunk.chunks_from_symbols(symbols, self.repo)
        chunks = self._save(code.unionByName(self.metadata(root, issues), allowMissingColumns=True), "chunks")
        text = fn.embedding_text(F.col("file_path"), F.col("symbol_type"), F.col("symbol_name"), F.col("parent_class"), F.col("docstring"), F.col("content"))
        index, cache = embed.embed_cached(chunks.withColumn("text", text), self._or_empty("cache", "key string, value array<float>"), self.embedder)
        index = self._save(index, "index")
        self._save(cache, "cache")
        self._save(lexical.postings(index, "id", "content"), "postings")
        # edges are resolved against all symbols, so unchanged files keep theirs
        nodes, edges = code_graph.knowledge_graph(files, symbols, facts)
        self._save(nodes, "nodes")
        self._save(edges, "edges")
        self._save(new, "snapshot")
        self._save(self.document(), "document")
        self.version += 1
        return IngestResult(self.repo, *self.counts(), time.time() - began)

    def document(self) -> DataFrame:
        """One row about the repository: counts, hubs, and each file's hash."""
        files, symbols, chunks = self.counts()
        hubs = graph.in_degree_topk(self.read("edges"), 10, self.read("nodes")).agg(F.collect_list(F.struct("id", "degree")).alias("hubs"))
        hashes = self.read("snapshot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_path", "hash")))).alias("file_hashes"))
        return hubs.join(hashes, F.lit(True)).select(F.lit(self.repo).alias("repo"), F.lit(files).alias("files"), F.lit(symbols).alias("symbols"), F.lit(chunks).alias("chunks"), "hubs", "file_hashes")

    def counts(self) -> tuple[int, int, int]:
        return self.read("files").count(), self.read("symbols").count(), self.read("chunks").count()

    def _embedding(self, question: str) -> list[float]:
        return self.embedder().embed_texts([question])[0]

    def retrieve(self, question: str, k: int = 5) -> DataFrame:
        """The best chunks: vector and lexical seeds, chunks of neighbouring files and functions, reranked."""
        index = self.read("index")
        docs = index.select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "file_path", "fqn", "symbol_name", "symbol_type", "start_line", "end_line")
        vectors = index.select(F.col("id").alias("vec_id"), "embedding")
        q = self._embedding(question)
        postings = lexical.index_of(self.read("postings"), docs)
        # two short lists, written before three branches read them
        seeds = materialize(retrieve.hybrid_candidates(postings, vectors, question, q, 20), "seeds")
        edges, nodes = self.read("edges"), self.read("nodes")
        # a chunk's function by its full name, else by its short one
        at = docs.join(F.broadcast(seeds.select("doc_id")), "doc_id", "left_semi").select("fqn", "symbol_name").distinct()
        full = at.join(nodes.select("id"), F.col("fqn") == F.col("id"), "left_semi").select(F.col("fqn").alias("id"))
        short = at.join(nodes.select("id"), F.col("fqn") == F.col("id"), "left_anti").where("symbol_name IS NOT NULL").select(F.col("symbol_name").alias("name"))
        at = full.unionByName(graph.lookup(nodes, short).select("id")).distinct().withColumnRenamed("id", "_at")
        near = edges.join(at, F.col("src") == F.col("_at")).select(F.col("dst").alias("id")).union(edges.join(at, F.col("dst") == F.col("_at")).select("src")).distinct()
        modules = graph.file_modules(nodes).withColumnRenamed("id", "_m")
        paths = near.join(modules, F.col("id") == F.col("_m")).select("file_path").distinct()
        ids = docs.join(paths, "file_path", "left_semi").select("doc_id").union(docs.join(near, F.col("fqn") == F.col("id"), "left_semi").select("doc_id")).distinct()
        more = vector_topk(vectors.join(ids, F.col("vec_id") == F.col("doc_id"), "left_semi"), q, 50).select(F.col("vec_id").alias("doc_id"))
        found = seeds.select("doc_id").union(more).distinct()
        return retrieve.rerank(docs.join(found, "doc_id"), question, k)

    def _prompt(self, question: str, history: str, k: int) -> tuple[str, list[dict]]:
        hits = materialize(retrieve.placed(self.retrieve(question, k), F.desc("score"), "doc_id"), "hits")
        context = retrieve.context_block(hits).first()["context"]
        return PROMPTS["answer"] % (context, history, question), [r.asDict() for r in retrieve.citations(hits).collect()]

    def answer(self, question: str, history: str = "", k: int = 5) -> dict:
        """Answer with sources; the latest answers without history are kept until the next ingest."""
        key = (question, self.version, k)
        if not history and key in self.answers:
            return self.answers[key]
        prompt, sources = self._prompt(question, history, k)
        out = {"answer": self.ask(prompt), "sources": sources}
        if not history:
            self.answers[key] = out
            while len(self.answers) > MOST_ANSWERS:
                self.answers.popitem(last=False)
        return out

    def answer_stream(self, question: str, history: str = "", k: int = 5):
        """Events: metadata with the sources first, then the model's pieces as they come."""
        prompt, sources = self._prompt(question, history, k)
        yield {"type": "metadata", "sources": sources}
        said = self.model(prompt)
        for piece in [said] if isinstance(said, str) else said:
            yield {"type": "token", "text": piece}

    def history(self, conversation: str) -> str:
        """The turns of a conversation as text."""
        row = state.conversation_text(self._or_empty("messages", MESSAGES).where(F.col("conv_id") == conversation)).first()
        return row["history"] if row else ""

    def add_message(self, conversation: str, role: str, text: str) -> None:
        self._save(state.append_message(self._or_empty("messages", MESSAGES), conversation, role, text), "messages")

    def memory(self) -> str:
        """The repository's profile and questions as markdown."""
        profile = state.PROFILE | {r["key"]: json.loads(r["value"]) for r in self._or_empty("profile", "key string, value string").collect()}
        faqs = [(r["question"], r["answer"]) for r in self._or_empty("faqs", "seq long, question string, answer string").orderBy("seq").collect()] or list(state.FAQS)
        x = self.spark.createDataFrame([(profile["description"], profile["primary_language"], profile["architecture_style"], profile["tech_stack"], profile["design_patterns"], faqs)], "d string, l string, a string, s array<string>, p array<string>, f array<struct<question:string,answer:string>>")
        return x.select(fn.memory_markdown("d", "l", "a", "s", "p", "f").alias("m")).first()["m"]

    def update_profile(self, updates: dict) -> None:
        new = self.spark.createDataFrame([(k, json.dumps(v)) for k, v in updates.items()], "key string, value string")
        self._save(state.merge_profile(self._or_empty("profile", "key string, value string"), new), "profile")

    def add_faq(self, question: str, answer: str) -> None:
        """One more question with its answer after those stored (the usual ones, at first)."""
        schema = "seq long, question string, answer string"
        stored = versioned.read(self.spark, self._path("faqs"))
        if stored is None:
            stored = self.spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(state.FAQS, 1)], schema)
        new = self.spark.createDataFrame([(None, question, answer)], schema)
        self._save(stored.unionByName(state.append_numbered(stored, new, "question", "seq")), "faqs")

    def _names(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name,)], "name string")

    def _list(self, df: DataFrame) -> list[str]:
        return sorted(r["id"] for r in df.collect())

    def function_usage(self, name: str) -> dict:
        n, e = self.read("nodes"), self.read("edges")
        return {"callers": self._list(graph.callers(n, e, self._names(name))), "callees": self._list(graph.callees(n, e, self._names(name)))}

    def find_references(self, name: str) -> list[str]:
        return self._list(graph.references(self.read("nodes"), self.read("edges"), self._names(name)))

    def find_implementations(self, name: str) -> list[str]:
        return self._list(graph.implementations(self.read("nodes"), self.read("edges"), self._names(name)))

    def find_inheritance(self, name: str) -> list[str]:
        return self._list(graph.bases(self.read("nodes"), self.read("edges"), self._names(name)))

    def file_dependencies(self, path: str) -> dict:
        n, e = self.read("nodes"), self.read("edges")
        return {"dependencies": self._list(graph.dependencies(n, e, path)), "dependents": self._list(graph.dependencies(n, e, path, True))}

    def find_dependency_chains(self, path: str) -> list[str]:
        row = graph.file_modules(self.read("nodes")).where(F.col("file_path") == path).first()
        return [] if row is None else sorted(r["chain"] for r in graph.import_chains(self.read("edges"), row["id"]).collect())

    def explain_file(self, path: str, level: str = "intermediate", most: int = 15_000) -> str | None:
        row = self.read("files").where(F.col("path") == path).select(fn.cut("text", most).alias("t")).first()
        return None if row is None else self.ask(PROMPTS[level] % row["t"])

    def explain_symbol(self, name: str, level: str = "intermediate", most: int = 3) -> str:
        rows = self.read("chunks").where((F.col("symbol_name") == name) | F.endswith("fqn", F.lit("." + name))).orderBy("id").limit(most).collect()
        return self.ask(PROMPTS[level] % "\n\n".join(r["content"] for r in rows))

    def review(self, path: str) -> str | None:
        row = self.read("files").where(F.col("path") == path).first()
        return None if row is None else self.ask(PROMPTS["review"] % (path, row["text"]))

    def tree(self) -> str:
        rows = source.directory_tree(self.read("files")).orderBy("tree_path").collect()
        return "\n".join(r["line"] for r in rows)

    def overview(self, k: int = 10) -> dict:
        n, e = self.read("nodes"), self.read("edges")
        pairs = lambda df: [(r["id"], r["degree"]) for r in df.collect()]
        return {"files": self.read("files").count(), "symbols": n.where("type IN ('class', 'function', 'method')").count(), "hubs": pairs(graph.in_degree_topk(e, k, n)), "most_called": pairs(graph.in_degree_topk(e, k, n, ["calls"], ["function", "method"]))}

    def hub_summary(self, k: int = 10) -> str:
        hubs = self.overview(k)["hubs"]
        if not any(d for _, d in hubs):
            return NO_HUBS
        return "\n".join([HUBS, *(f"- {n} ({d})" for n, d in hubs if d)])

    def architecture_report(self) -> dict:
        cycles = [r["cycle"] for r in graph.simple_cycles(self.read("edges"), 5, 10).collect()]
        tree, hubs = self.tree(), self.overview(5)["hubs"]
        return {"hubs": hubs, "cycles": cycles, "tree": tree[:4000], "summary": self.ask(PROMPTS["architecture"] % (tree[:4000], self.hub_summary()))}

    def autonomous_scan(self, out: str, most: int = 3) -> str:
        """Report and reviews of the files of the top hubs, written as markdown below the given folder."""
        report = self.architecture_report()
        n = self.read("nodes")
        hubs = self.spark.createDataFrame(report["hubs"] or [("", 0)], "id string, degree long")
        paths = [r["file_path"] for r in n.join(hubs, "id").where("file_path IS NOT NULL").orderBy(F.desc("degree"), "seq").select("file_path").distinct().limit(most).collect()]
        text = "\n\n".join(["# Scan of " + self.repo, report["summary"], "## Tree\n\n" + report["tree"], *(f"## Review of {p}\n\n{self.review(p)}" for p in paths)])
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/scan_report")
        return text

    def diagrams(self, function: str | None = None) -> dict:
        n, e = self.read("nodes"), self.read("edges")
        out = {k: graph.mermaid(e, k).first()["diagram"] for k in ("imports", "inherits")}
        if function:
            out["sequence"] = "\n".join(graph.sequence_diagram(e, n, function))
        return out

    def route(self, question: str, conversation: str | None = None) -> dict:
        """What kind of question it is, and its answer; in a conversation both are added to it."""
        r = self.spark.createDataFrame([(question,)], "q string").select(fn.intent("q").alias("i"), fn.function_in("q").alias("f"), fn.file_in("q").alias("p")).first()
        kind, name, path = r["i"], r["f"], r["p"]
        if kind == "repo_overview":
            result = self.overview()
        elif kind == "architecture":
            result = self.architecture_report()
        elif kind == "function_usage" and name:
            result = self.function_usage(name)
        elif kind == "file_dependencies" and path:
            result = self.file_dependencies(path)
        elif kind == "file_explanation" and path:
            result = self.explain_file(path)
        else:
            result = self.answer(question, self.history(conversation) if conversation else "")
        if conversation:
            self.add_message(conversation, "user", question)
            self.add_message(conversation, "assistant", result["answer"] if isinstance(result, dict) and "answer" in result else json.dumps(result, default=str))
        return {"category": kind, "result": result}

    def plan(self, question: str, planner: Callable[[str], str] | None = None) -> list[dict]:
        """Steps from a planner's JSON (fences allowed); without one, or if it makes none, the question itself."""
        if planner:
            row = self.spark.createDataFrame([(planner(question),)], "t string").select(F.from_json(fn.unfenced("t"), PLAN_SCHEMA).alias("p")).first()
            if row["p"]:
                return [{k: v for k, v in s.asDict().items() if v is not None} for s in row["p"]]
        return [{"tool": "ask_question", "query": question}]

    def execute(self, plan: list[dict]) -> list[dict]:
        """Results of the steps; a failing step is noted and skipped, an unknown tool asks."""
        out = []
        for step in plan:
            tool = step.get("tool")
            try:
                if tool == "find_references":
                    got = self.find_references(step["symbol_name"])
                elif tool in ("find_implementations", "find_inheritance"):
                    got = getattr(self, tool)(step["class_name"])
                elif tool == "find_dependency_chains":
                    got = self.find_dependency_chains(step["file_path"])
                else:
                    got = self.answer(step["query"])["answer"]
            except KeyError as e:
                got = f"skipped: {e} is missing"
            out.append(step | {"result": got})
        return out

    def agentic(self, question: str, planner: Callable[[str], str] | None = None) -> dict:
        steps = self.execute(self.plan(question, planner))
        history = "\n".join(f"Step {i}: {json.dumps(s, default=str)}" for i, s in enumerate(steps, 1))
        return self.answer(question, history)

    def benchmark(self, suite: list[tuple[str, list[str]]]) -> dict:
        """Mean precision, recall, citation accuracy and latency over questions with their expected files."""
        from tarn.operators.evaluate import averages

        rows, spent = [], 0.0
        for q, expected in suite:
            began = time.time()
            try:
                cited = [s["file"] for s in self.answer(q)["sources"]]
            except Exception:
                cited = None
            spent += time.time() - began
            rows.append((q, expected, cited))
        return averages(self.spark.createDataFrame(rows, "query string, expected array<string>, cited array<string>")).first().asDict() | {"avg_latency": spent / max(1, len(suite))}


#: Engines that a process keeps open.
MOST_ENGINES = 16
_ENGINES: OrderedDict[tuple, Engine] = OrderedDict()


def engine_for(spark: SparkSession, home: str, repo: str, **options) -> Engine:
    """The engine of a repository, the same one for the same folder; the least used is let go."""
    key = (spark.sparkContext.applicationId, home, repo)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark, home, repo, **options)
    _ENGINES.move_to_end(key)
    while len(_ENGINES) > MOST_ENGINES:
        _ENGINES.popitem(last=False)
    return _ENGINES[key]
