"""Smaller operators, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.functions.vector import cosine_distance
from tarn.operators import graph, incremental, state
from tarn.session import table
from tarn.sources import files as source

PLANS = ('[{"tool": "find_references", "symbol_name": "f"}]', '```json\n[{"tool": "ask_question", "query": "q"}]\n```', "no plan", '```\n[]\n```')


def class_methods(spark, sf_dir):
    """Distinct members of each group, as a set in order."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("members"))


def audit_append(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # the earlier half of all events is stored, the later half appended
    middle = e.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("_m"))
    x = e.join(F.broadcast(middle), F.lit(True))
    stored = state.numbered(x.where("event_id <= _m").select(F.col("event_id").alias("event"), "event_type"), "event", number="id").select("id", "event", "event_type")
    new = x.where("event_id > _m").select(F.col("event_id").alias("event"), "event_type")
    return stored.unionByName(state.append_numbered(stored, new.withColumn("id", F.lit(None).cast("long")), "event"))


def merge_profile(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return state.merge_profile(n, n.where("value = '1'").withColumn("value", F.lit("new")).unionByName(spark.createDataFrame([("added", "x")], "key string, value string")))


def parse_plan(spark, sf_dir):
    x = spark.createDataFrame([(i, p) for i, p in enumerate(PLANS)], "id long, t string")
    plan = F.from_json(fn.unfenced("t"), "array<struct<tool:string,symbol_name:string,query:string>>")
    return x.select("id", F.coalesce(F.get(plan, 0)["tool"], F.lit("ask_question")).alias("tool"))


def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.cut("text", 500)).alias("cut_md5"))


def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.line_count("text").alias("lines"))


def log_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", fn.log_record(F.lit("t"), F.lit("INFO"), F.col("event_type"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))).alias("line"))


def hub_summary(spark, sf_dir):
    from tarn.plans.queries_graph import links

    top = graph.in_degree_topk(links(spark, sf_dir), 5)
    line = F.concat(F.lit("- "), "id", F.lit(" ("), F.col("degree").cast("string"), F.lit(")"))
    x = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id", line.alias("line")))).alias("l"))
    return x.select(F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("summary"))


def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def metadata_chunks(spark, sf_dir):
    """README, commits and issues as one list of chunks."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    commits = o.select(F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").cast("string").alias("author"), (F.col("o_orderkey") * 3600).alias("time"), F.col("o_orderpriority").alias("message"))
    issues = c.select(F.col("c_custkey").alias("number"), F.lit("Issue").alias("kind"), F.col("c_name").alias("title"), F.lit("open").alias("state"), F.col("c_mktsegment").alias("body"))
    read = source.readme(spark.createDataFrame([("README.rst", bytearray(b"b")), ("README.md", bytearray(b"a")), ("x.py", bytearray(b"c"))], "path string, content binary"))
    return read.unionByName(source.commit_chunks(commits)).unionByName(source.issue_chunks(issues))


def content_snapshot(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return incremental.snapshot(d)


def decode_text(spark, sf_dir):
    raw = [(0, bytearray(b"ok \xc3\xa9")), (1, bytearray(b"bad \xff\xfe end")), (2, bytearray(b"")), (3, None)]
    return source.decoded(spark.createDataFrame(raw, "id long, content binary")).select("id", "text")


QUERIES = {f.__name__: f for f in (class_methods, audit_append, merge_profile, parse_plan, truncate_text, line_counts, log_records, hub_summary, cosine_pairs, metadata_chunks, content_snapshot, decode_text)}

ORACLES = {
    "class_methods": "SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS members FROM lineitem GROUP BY 1",
    "audit_append": "SELECT row_number() OVER (ORDER BY event_id) AS id, event_id AS event, event_type FROM events",
    "merge_profile": "SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_regionkey::VARCHAR END AS value FROM nation UNION ALL SELECT 'added', 'x'",
    "parse_plan": "SELECT id::BIGINT AS id, tool FROM (VALUES (0, 'find_references'), (1, 'ask_question'), (2, 'ask_question'), (3, 'ask_question')) AS v(id, tool)",
    "truncate_text": "SELECT doc_id, md5(left(text, 500)) AS cut_md5 FROM documents",
    "line_counts": """SELECT doc_id, (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')) + CASE WHEN regexp_matches(text, '[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]$') THEN 0 ELSE 1 END END)::BIGINT AS lines FROM documents""",
    "log_records": """SELECT event_id, '{"timestamp":"t","level":"INFO","logger":"' || event_type || '","message":"' || user_id || '"' || CASE WHEN event_id % 2 = 0 THEN ',"trace_id":"' || event_id || '"' ELSE '' END || '}' AS line FROM events""",
    "hub_summary": """WITH links AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages), d AS (SELECT dst, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, dst LIMIT 5)
        SELECT string_agg('- ' || dst || ' (' || n || ')', chr(10) ORDER BY n DESC, dst) AS summary FROM d""",
    "cosine_pairs": "SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "metadata_chunks": """SELECT 'a' AS content, 'README.md' AS file_path, 'README' AS symbol_name, 'readme' AS symbol_type UNION ALL
        SELECT 'Commit: ' || o_orderkey || chr(10) || 'Author: ' || o_custkey || chr(10) || 'Date: ' || strftime(make_timestamp(o_orderkey * 3600 * 1000000), '%Y-%m-%d %H:%M:%S') || chr(10) || 'Message: ' || o_orderpriority, 'commits/' || o_orderkey, 'commit ' || left(o_orderkey::VARCHAR, 7), 'github_commit'
          FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10) UNION ALL
        SELECT 'Issue #' || c_custkey || ': ' || c_name || chr(10) || 'State: open' || chr(10) || chr(10) || c_mktsegment, 'issues/' || c_custkey, 'Issue #' || c_custkey, 'github_issue' FROM customer""",
    "content_snapshot": "SELECT doc_id::VARCHAR AS file_path, sha256(coalesce(text, '')) AS hash FROM documents",
    "decode_text": "SELECT id::BIGINT AS id, text FROM (VALUES (0, 'ok é'), (1, 'bad  end'), (2, ''), (3, NULL)) AS v(id, text)",
}
