"""Snapshots, caches, logs, conversations, limits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.operators import incremental, state
from tarn.session import table
from tarn.sources import files as source


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    old = d.where("doc_id % 10 != 0").select("file_path", "hash")
    new = d.where("doc_id % 11 != 0").select("file_path", F.when(F.col("doc_id") % 7 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"))
    return old, new


def snapshot_diff(spark, sf_dir):
    return incremental.snapshot_diff(*_snapshots(spark, sf_dir))


def _cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wanted = d.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).distinct()
    cache = d.where("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).distinct().withColumn("value", F.left("key", F.lit(6)))
    return wanted, cache


def cache_split(spark, sf_dir):
    hits, misses = incremental.cache_split(*_cache(spark, sf_dir), "key")
    return hits.select("key", F.lit("hit").alias("state")).unionByName(misses.select("key", F.lit("miss").alias("state")))


def cached_values(spark, sf_dir):
    return incremental.through_cache(*_cache(spark, sf_dir), "key", lambda misses: misses.withColumn("value", F.upper(F.right("key", F.lit(6)))))


def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return incremental.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def delete_by_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_path"))
    return incremental.delete_by_path(d, d.where("doc_id % 97 = 0").select("file_path"))


def audit_latest(spark, sf_dir):
    return state.audit_latest(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 50, "event_id")


def commit_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return o.select(source.commit_text(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderdate")).alias("content"))


def conversation_history(spark, sf_dir):
    return state.conversation_text(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", F.md5("history").alias("history_md5"))


def rate_limit(spark, sf_dir):
    return state.rate_limit(table(spark, sf_dir, "events"), 2, 86_400)


def memory_markdown(spark, sf_dir):
    x = table(spark, sf_dir, "region").select("r_regionkey", F.array("r_name", F.lit("x")).alias("stack"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("patterns"), F.array(F.struct(F.lit("why?").alias("question"), F.col("r_name").alias("answer"))).alias("faqs"))
    return x.select("r_regionkey", fn.memory_markdown(F.lit("d"), F.lit("sql"), F.lit("flat"), "stack", "patterns", "faqs").alias("markdown"))


def repo_overview(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("lang").alias("languages"), F.sum(F.coalesce(fn.line_count("text"), F.lit(0).cast("long"))).alias("lines"), F.count_if(F.col("n_chars") > 2000).alias("large"))


def access_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("token"), F.array(F.lit("admin"), F.lit("dev")).alias("allowed"))
    keys = spark.createDataFrame([("BUILDING", "admin"), ("MACHINERY", "viewer")], "token string, role string")
    return state.access(c, keys).select("c_custkey", F.col("status").cast("long").alias("status"))


QUERIES = {f.__name__: f for f in (snapshot_diff, cache_split, cached_values, upsert_latest, delete_by_path, audit_latest, commit_latest, conversation_history, rate_limit, memory_markdown, repo_overview, access_status)}

_CACHE = "w AS (SELECT DISTINCT sha256(coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT sha256(coalesce(text, '')) AS key FROM documents WHERE doc_id % 3 = 0)"

ORACLES = {
    "snapshot_diff": """WITH d AS (SELECT doc_id, doc_id::VARCHAR AS file_path FROM documents)
        SELECT file_path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM d
        WHERE (doc_id % 10 = 0 AND doc_id % 11 <> 0) OR (doc_id % 10 <> 0 AND doc_id % 11 = 0) OR (doc_id % 10 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 = 0)""",
    "cache_split": f"WITH {_CACHE} SELECT key, CASE WHEN key IN (SELECT key FROM c) THEN 'hit' ELSE 'miss' END AS state FROM w",
    "cached_values": f"WITH {_CACHE} SELECT key, CASE WHEN key IN (SELECT key FROM c) THEN left(key, 6) ELSE upper(right(key, 6)) END AS value FROM w",
    "upsert_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "delete_by_path": "SELECT doc_id, source AS file_path FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)",
    "audit_latest": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "commit_latest": "SELECT 'Commit: ' || o_orderkey || chr(10) || 'Author: ' || o_custkey || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS content FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)",
    "conversation_history": "SELECT conv_id, count(*) AS n_turns, md5(string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS history_md5 FROM conversations GROUP BY 1",
    "rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r(event_id, user_id, k, kept, accepted) AS (SELECT event_id, user_id, k, [ts], true FROM e WHERE k = 1
        UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN len(i) < 2 THEN list_append(i, e.ts) ELSE i END, len(i) < 2
          FROM (SELECT e.*, list_filter(r.kept, lambda x: e.ts - x < INTERVAL 86400 SECOND) AS i FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) e)
        SELECT event_id, accepted FROM r""",
    "memory_markdown": """SELECT r_regionkey, '## Repository Stack Profile' || chr(10) || '- **Description**: d' || chr(10) || '- **Primary Language**: sql' || chr(10) || '- **Architecture Style**: flat' || chr(10) || '- **Tech Stack**: ' || r_name || ', x'
        || CASE WHEN r_regionkey % 2 = 0 THEN chr(10) || '- **Design Patterns**: p' ELSE '' END || chr(10) || chr(10) || '## Frequently Asked Questions (FAQ)' || chr(10) || '### Q1: why?' || chr(10) || '**A**: ' || r_name AS markdown FROM region""",
    "repo_overview": """SELECT source, count(*) AS files, count(DISTINCT lang) AS languages, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')) + CASE WHEN regexp_matches(text, '[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]$') THEN 0 ELSE 1 END END)::BIGINT AS lines,
        count(*) FILTER (WHERE n_chars > 2000) AS large FROM documents GROUP BY 1""",
    "access_status": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 401 WHEN c_mktsegment = 'BUILDING' THEN 200 ELSE 403 END::BIGINT AS status FROM customer",
}
