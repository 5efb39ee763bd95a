"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
for the next one. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweft.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from chronoweft.llm.common import cut
from chronoweft.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter, or without a likely language, go."""
    return language_id.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    return ngram_join.keep_one_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is covered by."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked."""
    return secret_scan.mask_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and places."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scans", scan_secrets),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None
"""SQL can't express the stages; tests hold each against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result for the table ``documents`` in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
