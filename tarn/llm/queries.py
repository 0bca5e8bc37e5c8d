"""The training-data queries: thin shells around the operators of this folder."""

from __future__ import annotations

from tarn.llm import chat, embedding_dedup, exact_dedup, mixing, ngram_join, packing, pii, substring_dedup, toxicity, warc
from tarn.session import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.listing(spark, warc.archive(table(spark, sf_dir, "pages")))


def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.summaries(chat.format_chat(rows.unionByName(chat.probe(spark))))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_warc": op5_warc,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat": op9_chat,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op4_ngram_join": ngram_join.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op6_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
