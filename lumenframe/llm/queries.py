"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import work_root
from . import decontam, langid, media_avi, mixing, order_minhash, suffix_dedup, token_rollup, toxicity, url_rules, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after two batches over all documents, each sent twice.

    The first inserts every document. The second deletes those whose id ends in 3 and revises
    those whose id ends in 7: they move to another source and their text is doubled.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    digit = F.col("doc_id") % 10
    moved = d.select(
        F.when(digit == 3, "delete").otherwise("revise").alias("op"),
        F.when(digit == 7, F.concat("source", F.lit("/moved"))).otherwise(F.col("source")).alias("source"),
        "lang",
        F.when(digit == 7, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")).alias("text"),
        F.col("source").alias("old_source"),
        F.col("lang").alias("old_lang"),
        F.col("text").alias("old_text"),
        digit.alias("digit"),
    ).filter(F.col("digit").isin(3, 7))
    rollup = token_rollup.Rollup(spark, f"{work_root(spark)}/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}")
    for batch, changes in (("load", d.withColumn("op", F.lit("insert"))), ("changes", moved), ("load", d.withColumn("op", F.lit("insert"))), ("changes", moved)):
        rollup.commit(batch, changes)
    return rollup.totals()


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep_rows=False).select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, kept_as=None)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the capture history that ``warc.captures`` makes of all pages."""
    r = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "|")
    return r.select(F.col("row.record_id").alias("revisit_id"), "uri", "response_id", "outcome", "payload_digest", text.alias("headers"))


def op5_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_avi.store_texts(docs).select("row.doc_id", *[c.split()[0] for c in media_avi.DIGEST.split(", ")])


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_rules.labels_by_page(pages, table(spark, sf_dir, "labels"))
    return url_rules.judge(pages, labelled).select("row.page_id", "host", "path", "rule", "verdict")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.near_duplicates(docs).select("row.doc_id", "class_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, with the evidence of all pages that show it.

    The text model is fitted on a bounded sample of documents' ``lang``; apart from that the
    declared language is the page's markup. A document without a page has its source as host.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = langid.train(docs)
    scored = langid.text_scores(docs.select("doc_id", "source", "text"), model)
    out = langid.identify_by_pages(scored, model, langid.page_evidence(table(spark, sf_dir, "pages")))
    return out.select("row.doc_id", "predicted", "best", F.round("posterior", 6).alias("posterior"), "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select(F.col("row.doc_id").alias("doc_id"), toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_rollup, op2_mixing, op3_suffix_array_dedup, op4_warc_revisits, op5_avi_clips, op6_url_rules, op7_order_minhash, op8_language_id, op9_toxicity, op10_decontamination)}

ORACLE_SQL: dict[str, str] = {"op1_token_rollup": token_rollup.SQL, "op2_mixing": mixing.SQL, "op4_warc_revisits": warc.SQL, "op10_decontamination": decontam.SQL}
