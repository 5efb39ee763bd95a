"""The operators' queries and oracle SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweft.llm import decontaminate, language_id, ngram_join, packing, secret_scan, suffix_dedup, tiff_media, toxicity, url_filter, warc
from chronoweft.session import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.PRODUCTION_RULES)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.media_digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_language_id, op3_ngram_join, op4_warc, op5_best_fit_packing, op6_suffix_dedup, op7_toxicity, op8_url_filters, op9_media_columns, op10_decontamination)}
ORACLE_SQL = {"op3_ngram_join": ngram_join.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op6_suffix_dedup": suffix_dedup.ORACLE_SQL, "op8_url_filters": url_filter.ORACLE_SQL}
