"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import clustering, decontaminate, intervals, language, lines, ngram_join, packing, quality, repacking, secrets, substrings, urls, warc
from vellum.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repacking.repack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


def op13_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sale_sessions(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clicks")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: not the tokenizer, language model, forest or URL classifier."""
    return {
        "op1_quality_rules": quality.oracle_sql(),
        "op2_line_dedup": lines.ORACLE_SQL,
        "op3_decontamination": decontaminate.ORACLE_SQL,
        "op4_ngram_jaccard": ngram_join.ORACLE_SQL,
        "op6_suffix_dedup": substrings.ORACLE_SQL,
        "op9_warc_round_trip": warc.ORACLE_SQL,
        "op12_sort_means": clustering.oracle_sql(),
        "op13_interval_overlap": intervals.ORACLE_SQL,
    }
