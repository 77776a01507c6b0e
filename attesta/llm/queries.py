"""The queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.shared import write_table
    from attesta.llm.warc_bundles import read_bundles, revisits, write_bundles

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    archive = write_table(write_bundles(revisits(pages)), "warc")
    return read_bundles(archive, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.url_filter import filter_urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("label"))
    return filter_urls(pages, pages.join(labels, "page_id"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.quality_rules import quality

    out, _ = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.maxent_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.source_mix import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.chat_format import format_conversations, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more))).drop("n_tokens")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.decontaminate import report, scan

    return report(scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.fill_middle import fill_middle, restored

    made = fill_middle(_table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.best_fit import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_bundles, op2_url_filter, op3_quality_rules, op4_maxent_lm, op5_license_scan, op6_suffix_dedup, op7_source_mix, op8_chat_format, op9_decontaminate, op10_jaccard_join, op11_fill_middle, op12_best_fit, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    from attesta.llm.oracles import SQL

    return dict(SQL)
