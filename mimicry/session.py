"""Session settings and the two helpers every job shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS: Mapping[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on (UTC) and the ones plans rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, or one below the warehouse where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def session_key(spark: SparkSession) -> tuple[str, int]:
    """Names a session for tables kept per session, also after another one was stopped."""
    return spark.sparkContext.applicationId, id(spark)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns evaluated once per row, however often they are used later.

    The optimiser copies a projected expression into every filter and projection above
    it. Produced by a generator of exactly one row, the value is computed and kept.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))
