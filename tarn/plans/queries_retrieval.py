"""Lexical, vector and hybrid retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions.text import code_tokens
from tarn.operators import evaluate, lexical, retrieve, vector_search
from tarn.session import materialize, spread, table

ASK, RARE = "the nation idiot the version", "copyright zzz apache"
TOK = "regexp_extract_all({0}, '[0-9]+|[a-z]+|[A-Z]+[a-z]*')"


def first_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def tokenize_code(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    extra = spark.createDataFrame([(-1, "HTTPServer2x getUserName snake_case_id def run(self):")], "doc_id long, text string")
    t = code_tokens("text")
    return docs.unionByName(extra).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def term_frequency(spark, sf_dir):
    return lexical.term_frequency(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def document_frequency(spark, sf_dir):
    return lexical.document_frequency(lexical.term_frequency(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")))


def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(table(spark, sf_dir, "documents"))


def bm25_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(spark, sf_dir).join(F.broadcast(n), F.lit(True)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    return lexical.bm25_topk(lexical.fit(table(spark, sf_dir, "documents")), ASK, 5).select("doc_id", F.round("score", 6).alias("score"))


def bm25_zero_fill(spark, sf_dir):
    return lexical.bm25_topk(lexical.fit(table(spark, sf_dir, "documents")), "zzzqqq", 5).select("doc_id", F.round("score", 6).alias("score"))


def vector_topk(spark, sf_dir):
    return vector_search.vector_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 5).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_topk_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector_search.vector_topk(e, first_vector(spark, sf_dir), 5, F.col("label").isin(1, 2, 3)).select("vec_id", F.round("distance", 6).alias("distance"))


def hybrid_candidates(spark, sf_dir):
    return retrieve.hybrid_candidates(lexical.fit(table(spark, sf_dir, "documents")), table(spark, sf_dir, "embeddings"), ASK, first_vector(spark, sf_dir))


def rerank_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieve.rerank(docs, ASK, 20).select("doc_id", F.round("score", 6).alias("score"))


def graph_expand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieve.expand(materialize(lexical.bm25_topk(lexical.fit(docs), RARE, 5), "seeds"), docs)


def graph_aware_retrieve(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = retrieve.graph_aware(docs, lexical.fit(docs), table(spark, sf_dir, "embeddings"), ASK, first_vector(spark, sf_dir))
    return out.select("doc_id", "source", F.round("score", 6).alias("score"))


def retrieval_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = retrieve.placed(lexical.bm25_topk(lexical.fit(docs), ASK, 5), F.round("score", 9).desc(), "doc_id")
    x = docs.select("doc_id", "text", F.col("source").alias("file_path"), F.col("doc_id").cast("string").alias("symbol_name"), F.col("lang").alias("symbol_type"), F.lit(1).alias("start_line"), F.col("n_chars").alias("end_line"))
    return retrieve.context_block(hits.join(x, "doc_id"))


def context_format(spark, sf_dir):
    """A context block for each source: here the fields of every document, whole texts, some fields missing."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    x = d.select(
        "doc_id", F.lit(1).alias("pos"), "text", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("file_path"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).otherwise("").alias("symbol_name"),
        F.lit("document").alias("symbol_type"), F.lit(1).alias("start_line"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("end_line"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") / 7).alias("score"),
    )
    return x.select("doc_id", F.md5(retrieve.context_part()).alias("context_md5"))


def rerank_funnel(spark, sf_dir):
    """20 + 20 candidates, reranked, the best 5."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    found = retrieve.hybrid_candidates(lexical.fit(docs), vectors, ASK, first_vector(spark, sf_dir))
    return retrieve.rerank(docs.join(F.broadcast(found.select("doc_id")), "doc_id"), ASK, 5).select("doc_id", F.round("score", 6).alias("score"))


def citations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    x = d.select(
        F.when(F.col("doc_id") % 7 != 0, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("file_path"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("lang")).alias("symbol_name"),
        F.lit("document").alias("symbol_type"), F.lit(1).alias("start_line"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("end_line"),
    )
    return retrieve.citations(x)


def eval_metrics(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = docs.join(labels, "doc_id").groupBy(F.col("source").alias("query")).agg(
        F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("expected"), F.collect_set(F.when((F.col("toxic") == 0) & (F.col("doc_id") % 3 == 0), F.col("doc_id"))).alias("cited")
    )
    failed = spark.createDataFrame([("failed", [1], None)], "query string, expected array<long>, cited array<long>")
    return evaluate.averages(x.unionByName(failed)).select("queries", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("precision", "recall", "citation_accuracy")])


QUERIES = {f.__name__: f for f in (tokenize_code, term_frequency, document_frequency, corpus_stats, bm25_idf, bm25_topk, bm25_zero_fill, vector_topk, vector_topk_filtered, hybrid_candidates, rerank_overlap, graph_expand, graph_aware_retrieve, retrieval_context, context_format, rerank_funnel, citations, eval_metrics)}

_T = f"tk AS (SELECT doc_id, unnest({TOK.format('text')}) AS raw FROM documents), tf AS (SELECT doc_id, lower(raw) AS term, count(*) AS tf FROM tk GROUP BY 1, 2)"
_LEN = f"l AS (SELECT doc_id, coalesce(len({TOK.format('text')}), 0)::BIGINT AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l)"


def _bm25(query: str, k: int, name: str = "bm") -> str:
    terms = ", ".join(f"('{t}')" for t in query.split())
    return f"""df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q(term) AS (VALUES {terms}),
sc AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), st GROUP BY 1),
{name} AS (SELECT doc_id, coalesce(score, 0) AS score FROM documents LEFT JOIN sc USING (doc_id) ORDER BY round(coalesce(score, 0), 9) DESC, doc_id LIMIT {k})"""


_NEAR = "qv AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0), dist AS (SELECT vec_id, label, round(1 - list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 9) AS distance FROM embeddings, qv)"
_HYBRID = f"""WITH {_T}, {_LEN}, {_bm25(ASK, 20)}, {_NEAR},
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS pos, 0::BIGINT AS source_rank FROM (SELECT * FROM dist ORDER BY distance, vec_id LIMIT 20)),
b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS pos, 1::BIGINT AS source_rank FROM bm),
hy AS (SELECT * FROM v UNION ALL SELECT * FROM b ANTI JOIN v USING (doc_id))"""
_JACCARD = f"""(WITH a AS (SELECT list_distinct(list_transform({TOK.format("coalesce(text, '')")}, lambda x: lower(x))) AS a, list_distinct(string_split('{ASK}', ' ')) AS b)
 SELECT CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) ELSE 0 END FROM a)"""

ORACLES = {
    "tokenize_code": f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'HTTPServer2x getUserName snake_case_id def run(self):')
        SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_transform({TOK.format("text")}, lambda x: lower(x)) AS t FROM d)""",
    "term_frequency": f"WITH {_T} SELECT doc_id, term, tf FROM tf",
    "document_frequency": f"WITH {_T} SELECT term, count(*) AS df FROM tf GROUP BY 1",
    "corpus_stats": f"WITH {_LEN} SELECT n AS n_docs, avgdl AS avg_len FROM st",
    "bm25_idf": f"WITH {_T}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS n FROM documents) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d, c",
    "bm25_topk": f"WITH {_T}, {_LEN}, {_bm25(ASK, 5)} SELECT doc_id, round(score, 6) AS score FROM bm",
    "bm25_zero_fill": f"WITH {_T}, {_LEN}, {_bm25('zzzqqq', 5)} SELECT doc_id, round(score, 6) AS score FROM bm",
    "vector_topk": f"WITH {_NEAR} SELECT vec_id, round(distance, 6) AS distance FROM dist ORDER BY dist.distance, vec_id LIMIT 5",
    "vector_topk_filtered": f"WITH {_NEAR} SELECT vec_id, round(distance, 6) AS distance FROM dist WHERE label IN (1, 2, 3) ORDER BY dist.distance, vec_id LIMIT 5",
    "hybrid_candidates": f"{_HYBRID} SELECT * FROM hy",
    "rerank_overlap": f"WITH s AS (SELECT doc_id, {_JACCARD} AS score FROM documents) SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 20)",
    "graph_expand": f"WITH {_T}, {_LEN}, {_bm25(RARE, 5)} SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN bm USING (doc_id)) AND doc_id NOT IN (SELECT doc_id FROM bm)",
    "graph_aware_retrieve": f"""{_HYBRID}, nb AS (SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN hy USING (doc_id)) AND doc_id NOT IN (SELECT doc_id FROM hy)),
        ex AS (SELECT vec_id AS doc_id FROM dist WHERE vec_id IN (SELECT doc_id FROM nb) ORDER BY distance, vec_id LIMIT 50), cand AS (SELECT doc_id FROM hy UNION SELECT doc_id FROM ex),
        s AS (SELECT doc_id, source, {_JACCARD} AS score FROM documents JOIN cand USING (doc_id)) SELECT doc_id, source, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 5)""",
    "retrieval_context": f"""WITH {_T}, {_LEN}, {_bm25(ASK, 5)}, p AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS pos FROM bm)
        SELECT string_agg('[' || pos || '] File: ' || source || chr(10) || 'Symbol: ' || doc_id || ' (' || lang || ')' || chr(10) || 'Lines: 1-' || n_chars || chr(10) || 'Score: ' || printf('%.4f', score) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) AS context FROM p JOIN documents USING (doc_id)""",
    "context_format": """SELECT doc_id, md5('[1] File: ' || CASE WHEN doc_id % 7 <> 0 THEN source ELSE 'unknown' END || chr(10) || 'Symbol: ' || CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR ELSE 'unknown' END || ' (document)' || chr(10) || 'Lines: 1-'
        || CASE WHEN doc_id % 11 <> 0 THEN coalesce(n_chars::VARCHAR, 'unknown') ELSE 'unknown' END || chr(10) || 'Score: ' || CASE WHEN doc_id % 3 <> 0 THEN printf('%.4f', doc_id / 7) ELSE 'unknown' END || chr(10) || coalesce(text, '')) AS context_md5 FROM documents WHERE source IS NOT NULL""",
    "rerank_funnel": f"""{_HYBRID}, s AS (SELECT doc_id, {_JACCARD} AS score FROM documents JOIN hy USING (doc_id)) SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 5)""",
    "citations": """SELECT source || '/' || doc_id AS file, lang AS symbol, 'document' AS type, '1-' || n_chars AS lines FROM documents
        WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND lang <> '' AND source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL""",
    "eval_metrics": """WITH j AS (SELECT source AS query, quality = 1 AS e, toxic = 0 AND doc_id % 3 = 0 AS c FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT query, count(*) FILTER (WHERE e) AS ne, count(*) FILTER (WHERE c) AS nc, count(*) FILTER (WHERE e AND c) AS tp FROM j GROUP BY 1),
        m AS (SELECT CASE WHEN nc > 0 THEN tp / nc ELSE 0 END AS p, CASE WHEN ne > 0 THEN tp / ne ELSE 0 END AS r, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END AS a FROM g UNION ALL SELECT 0, 0, 0)
        SELECT count(*) AS queries, round(sum(p) / count(*), 6) AS avg_precision, round(sum(r) / count(*), 6) AS avg_recall, round((sum(a) / count(*))::DOUBLE, 6) AS avg_citation_accuracy FROM m""",
}
