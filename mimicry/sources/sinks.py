"""Writers. Tables are Parquet folders that only grow, or whole snapshots.

Parquet has no unique keys or updates: inserting if absent is an anti-join followed by
an append, replacing is a new snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mimicry.functions.text import clean_text


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    pairs = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(and_, pairs)


def absent(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored; NULL keys compare equal."""
    return new.alias("n").join(
        stored.select(*keys).alias("s"), _same("n", "s", keys), "left_anti"
    )


def absent_batch(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`absent` for a batch much smaller than the table, already computed.

    The table is first narrowed to the batch's keys. Spark knows the size of a computed
    batch, and broadcasts its keys if they are few, so the table is then not shuffled.
    """
    wanted = batch.select(*keys).distinct()
    present = (
        stored.select(*keys).alias("s").join(wanted.alias("w"), _same("s", "w", keys), "left_semi")
    )
    return absent(batch, present.distinct(), keys)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One streaming batch as its own folder: replaying the batch replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(
    spark: SparkSession,
    path: str,
    schema: str,
    before: int | None = None,
    only: int | None = None,
) -> DataFrame:
    """What :func:`write_batch` wrote: all of it, by earlier batches, or by one batch."""
    stored = read_table(spark, path, f"{schema}, batch_id bigint")
    if only is not None:
        stored = stored.where(F.col("batch_id") == only)
    if before is not None:
        stored = stored.where(F.col("batch_id") < before)
    return stored.drop("batch_id")


def insert_if_absent(df: DataFrame, path: str, schema: str, keys: Sequence[str]) -> int:
    """Append the rows whose key is new; returns how many there were."""
    computed = df.persist()
    fresh = absent_batch(computed, read_table(df.sparkSession, path, schema), keys)
    written = Observation()
    append(fresh.observe(written, F.count(F.lit(1)).alias("rows")), path)
    computed.unpersist()
    return written.get["rows"]


def notification_lines(findings: DataFrame) -> DataFrame:
    """The nine bounded, control-free fields of a notification."""
    return findings.select(
        clean_text(F.col("fqdn"), 253).alias("fqdn"),
        clean_text(F.coalesce("brand", F.lit("unknown")), 40).alias("brand"),
        clean_text(F.col("label"), 20).alias("label"),
        "confidence",
        "score",
        clean_text(F.coalesce("evidence", F.lit("")), 500).alias("evidence"),
        clean_text(F.nullif("screenshot_path", F.lit("")), 300).alias("screenshot"),
        clean_text(F.nullif("final_url", F.lit("")), 500).alias("final_url"),
        F.date_format("classified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("detected_at"),
    )


def write_notifications(findings: DataFrame, path: str, batch_id: int | None = None) -> None:
    """JSON lines, one per finding; with a batch id the write can be repeated."""
    lines = notification_lines(findings)
    if batch_id is None:
        lines.write.mode("append").json(path)
    else:
        lines.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def export_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as one Parquet folder below ``folder``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def normalise_paths(captures: DataFrame, vantage: str | None) -> DataFrame:
    """Forward slashes in stored paths, and the vantage point the host states itself."""
    slashed = {
        c: F.replace(F.col(c), F.lit("\\"), F.lit("/")) for c in ("screenshot_path", "html_path")
    }
    return captures.withColumns({**slashed, "vantage": F.lit(vantage).cast("string")})


def with_ids(df: DataFrame, name: str, after: int = 0) -> DataFrame:
    """Unique ids above ``after``; increasing but not consecutive, so nothing is sorted."""
    return df.withColumn(name, F.monotonically_increasing_id() + F.lit(after + 1))
