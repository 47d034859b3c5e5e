"""Labelled sets: JSON lines with one site per line, checked before anything uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.config import LABEL_BASES, LABELS
from mimicry.sources.lines import numbered_lines
from mimicry.sources.tables import LABELLED

REQUIRED = ("fqdn", "expected", "source", "labelled_at")


class DatasetError(ValueError):
    """A labelled set that cannot be trusted to mean what it says."""


def _iso_date(text: Column) -> Column:
    return F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    )


def read_labelled(
    spark: SparkSession, path: str | list[str], allow_unlabelled: bool = False
) -> DataFrame:
    """Every entry with ``file_path``, ``line_no`` and a ``reject_reason``.

    Comments and blank lines are skipped. With ``allow_unlabelled`` an entry without a
    label is kept as ``unknown``; otherwise it is refused.
    """
    return parse_labelled(numbered_lines(spark, path), allow_unlabelled)


def parse_labelled(lines: DataFrame, allow_unlabelled: bool = False) -> DataFrame:
    """As :func:`read_labelled`, over a table of lines (``value`` plus other columns)."""
    keep = [c for c in lines.columns if c != "value"]
    schema = LABELLED.replace("labelled_at date", "labelled_at string")
    text = F.trim("value")
    entries = lines.where((text != "") & ~text.startswith("#")).select(
        *keep,
        F.from_json("value", schema).alias("e"),
        F.try_parse_json("value").isNotNull().alias("is_json"),
        text.startswith("{").alias("is_object"),
        F.json_object_keys("value").alias("keys"),
    )
    e = F.col("e")
    missing = F.array_except(F.array(*[F.lit(f) for f in sorted(REQUIRED)]), F.col("keys"))
    unlabelled = e["expected"].isNull()
    day = _iso_date(e["labelled_at"])
    basis = F.when(
        unlabelled | ~F.array_contains("keys", "label_basis"), F.lit("screenshot")
    ).otherwise(e["label_basis"])
    reason = (
        F.when(~F.col("is_json"), F.lit("not valid JSON"))
        .when(~F.col("is_object"), F.lit("expected a JSON object"))
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("missing field(s) "), F.array_join(missing, ", ")),
        )
        .when(
            unlabelled & F.lit(not allow_unlabelled), F.concat(e["fqdn"], F.lit(" has no label yet"))
        )
        .when(
            ~unlabelled & ~e["expected"].isin(*LABELS),
            F.concat(F.lit("unknown label "), e["expected"]),
        )
        .when(day.isNull(), F.lit("labelled_at must be an ISO date"))
        .when(
            basis.isNull() | ~basis.isin(*LABEL_BASES),
            F.lit("label_basis must be 'screenshot' or 'feed'"),
        )
    )
    return entries.select(
        *keep,
        F.lower(F.trim(e["fqdn"])).alias("fqdn"),
        F.coalesce(e["expected"], F.lit("unknown")).alias("expected"),
        e["source"].alias("source"),
        day.alias("labelled_at"),
        e["brand"].alias("brand"),
        e["note"].alias("note"),
        e["suggestion"].alias("suggestion"),
        basis.alias("label_basis"),
        F.when(~unlabelled, e["labelled_by"]).alias("labelled_by"),
        reason.alias("reject_reason"),
    )


def problems(entries: DataFrame) -> DataFrame:
    """What is wrong with sets: refused lines, and every line of a site after its first one,
    in the same file or another. Empty when sound.

    Only sites listed more than once are joined with their lines, each to one first place.
    """
    refused = entries.where("reject_reason IS NOT NULL").select(
        "file_path", "line_no", F.col("reject_reason").alias("problem")
    )
    usable = entries.where("reject_reason IS NULL").select("fqdn", F.struct("file_path", "line_no").alias("place"))
    counted = usable.groupBy("fqdn").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    later = usable.join(counted.where("n > 1"), "fqdn").where("place > first").select(
        "place.file_path",
        "place.line_no",
        F.concat("fqdn", F.lit(" is also in "), "first.file_path", F.lit(":"), "first.line_no").alias("problem"),
    )
    return refused.unionByName(later)


def sound(entries: DataFrame) -> DataFrame:
    """The labelled sites, or :class:`DatasetError` naming the first problem."""
    worst = problems(entries).orderBy("file_path", "line_no").first()
    if worst is not None:
        raise DatasetError(f"{worst.file_path}:{worst.line_no}: {worst.problem}")
    if entries.isEmpty():
        raise DatasetError("dataset is empty")
    return entries.drop("reject_reason")


def read_all(spark: SparkSession, main: str, others: list[str] | None = None) -> DataFrame:
    """Every entry of the tracked set and any feed sets, as :func:`read_labelled` gives them."""
    sets = [read_labelled(spark, main), *[read_labelled(spark, p) for p in others or []]]
    return reduce(DataFrame.unionByName, sets)


def load_all(spark: SparkSession, main: str, others: list[str] | None = None) -> DataFrame:
    """The tracked set plus any feed sets, no site in two of them."""
    return sound(read_all(spark, main, others))
