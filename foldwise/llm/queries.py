"""Registered queries of the operators: thin views on their general results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import (collocations, conversations, decontaminate, htmltext, mixing, neardup, neighbours, quality, secrets,
                          substrings, toxicity, urlfilter, warc)
from foldwise.llm.frames import table
from foldwise.llm.oracles import ORACLES as FIRST_ORACLES
from foldwise.llm.oracles_sequences import ORACLES as SEQUENCE_ORACLES

ORACLES = FIRST_ORACLES | SEQUENCE_ORACLES

def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest("items").alias("items_sha256"), "contaminated")

def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, *weights, keep=["doc_id"])
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", "predicted")

def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")

def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = substrings.cut(docs, keep=["doc_id"], with_text=False)
    removed = F.expr("aggregate(removed, 0L, (s, r) -> s + r.end - r.start)")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       "kept_sha256", (F.col("n_bytes") - removed).alias("n_kept"))

def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")

def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"),
                       "n_lines", "fail_bits")

def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])

def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")

def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = "cast(size(filter(base, s -> s.kind = {})) AS bigint) AS n_{}"
    return found.select("doc_id", *[F.expr(count.format(i, k)) for k, i in secrets.ORDER.items() if k != "random"],
                        F.sha2(secrets.to_text("base").cast("binary"), 256).alias("base_sha256"),
                        secrets.to_text("spans").alias("spans"))

def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(conversations.damaged(table(spark, sf_dir, "conversations")), F.col("dropped"))

def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))

def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))

QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_toxicity": op2_toxicity, "op3_warc": op3_warc, "op4_neardup": op4_neardup, "op5_substrings": op5_substrings,
           "op6_mixing": op6_mixing, "op7_quality": op7_quality,
           "op8_html": op8_html, "op9_urls": op9_urls, "op10_secrets": op10_secrets,
           "op11_conversations": op11_conversations, "op12_collocations": op12_collocations, "op13_neighbours": op13_neighbours}

__all__ = ["ORACLES", "QUERIES"]
