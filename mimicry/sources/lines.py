"""Text files as rows that remember where they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = ["file_path", "block_start"]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` with ``arrival``, a struct that orders lines by file and position.

    Splitting keeps a block's lines together and in order, so (file, block, running id)
    is a total order without sorting or numbering anything.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return raw.select("value", F.struct(*_BLOCK, "row_id").alias("arrival"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``, ``file_path`` and the 1-based ``line_no`` within the file.

    Each block's first id and length give its offset; only those few rows per file are
    ordered, never the lines.
    """
    lines = read_lines(spark, path).select("value", "arrival.*")
    blocks = lines.groupBy(*_BLOCK).agg(
        F.min("row_id").alias("first_id"), F.count("*").alias("n_lines")
    )
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))
    offsets = blocks.select(*_BLOCK, "first_id", before.alias("before"))
    return lines.join(offsets, _BLOCK).select(
        "value",
        "file_path",
        (F.col("before") + F.col("row_id") - F.col("first_id") + 1).alias("line_no"),
    )
