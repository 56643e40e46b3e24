"""The registered queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, decontaminate, filter_audit, html_text, line_dedup, lm_score, mixing, pii, quality, secrets, simhash, token_counts, warc
from .common import table, text_or_empty
from .oracles import SQL  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.judge(docs, text_or_empty(), "q")
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept", "q.n_stop_words")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), text_or_empty(), "q")
    return docs.select("doc_id", "q.n_assign", "q.n_access", "q.n_hex", F.sha2("q.base_spans", 256).alias("base_sha256"), "q.spans", "q.n_entropy")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), whole_texts=True).withColumnRenamed("id", "doc_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.words", F.lit(0)).cast("long").alias("longest_match"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = warc.new_folder(spark)
    warc.archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, path, with_payload=False).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation.damage(table(spark, sf_dir, "conversations"))
    return conversation.repair(damaged, present="present").withColumnRenamed("conv", "conv_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scan, op3_lm_score, op4_html_text, op5_line_dedup, op6_decontaminate, op7_simhash, op8_token_counts, op9_pii, op10_mixing,
        op11_warc, op12_filter_audit, op13_conversation_repair,
    )
}
