"""From documents to packed training sequences, in five stages.

Each stage takes what the one before kept and returns the columns of ``documents``; the
last returns pieces with their places. ``run`` writes each stage's result as Parquet into
the shared folder and reads it again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm import jaccard, langid, mixing, packing, secrets
from mimicry.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows in a batch between Spark and its Python workers: a row is a whole text.
BATCH_ROWS = "1000"


def _texts(docs: DataFrame) -> DataFrame:
    """``docs``, which the stage's Python workers will get in batches of ``BATCH_ROWS``."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the documents that state one; texts of no certain language go."""
    known = _texts(docs).select("doc_id", "text", "lang").filter(langid.remainder(F.col("doc_id"), 4) != 2)
    return langid.accepted(docs, langid.train(known))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(_texts(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each in its sequence."""
    return packing.pack(_texts(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: A learned model decides in the first stage: SQL cannot state the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
