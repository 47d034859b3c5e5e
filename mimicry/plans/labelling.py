"""Collecting candidate sites to label, and keeping the labels analysts give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.config import REVIEWABLE_LABELS, Brand
from mimicry.functions.hostnames import is_valid_hostname
from mimicry.functions.rounding import round_binary
from mimicry.operators.queues import best_per_host
from mimicry.sources.feeds import entries_naming_brands

# Harmless sites that resemble a brand, and why.
HARD_NEGATIVES = (
    ("hummelcloud.net", "word ending in l before cloud, read as icloud"),
    ("bigbullcloud.com", "same pattern"),
    ("vercelcloud.com", "same pattern"),
    ("vesselcloud.dev", "same pattern"),
    ("voxelclouddao.xyz", "same pattern"),
    ("ateliergamelle.com", "rn/m folding brushed against ameli"),
    ("thedarnells.org", "same pattern"),
    ("amell.family", "surname colliding with a short brand token"),
    ("hicloud.net", "Huawei: a genuine dnstwist variant of icloud"),
    ("livee.com", "a genuine dnstwist variant of live.com"),
    ("microsoft-falcon.net", "Microsoft's own infrastructure, shaped like a combosquat"),
)

# Where a label's site came from.
OWN_SOURCE, FEED_SOURCE, SEEDED_SOURCE = "alerts", "openphish", "calibration"


def _candidates(
    rows: DataFrame, source: Column, suggestion: str | None, brand: Column, note: Column
) -> DataFrame:
    return rows.select(
        "fqdn",
        source.alias("source"),
        F.lit(suggestion).cast("string").alias("suggestion"),
        brand.alias("brand"),
        note.alias("note"),
    )


def candidates_from_feed(entries: DataFrame, brands: Sequence[Brand]) -> DataFrame:
    """Feed hosts whose first URL mentions a brand; the feed's word is provenance only."""
    note = F.concat(F.lit("listed by "), "source", F.lit("; confirm from the capture"))
    named = entries_naming_brands(entries, brands)
    return _candidates(named, F.col("source"), "phishing", F.col("brand"), note)


def candidates_from_alerts(captures: DataFrame, matches: DataFrame, limit: int) -> DataFrame:
    """The most recently captured alerting hosts whose page loaded."""
    loaded = (
        captures.where("status = 'ok'")
        .groupBy("fqdn")
        .agg(F.max("captured_at").alias("last_captured"))
    )
    newest = (
        loaded.join(best_per_host(matches.where("is_alert")), "fqdn")
        .orderBy(F.desc("last_captured"), "fqdn")
        .limit(limit)
    )
    score = F.format_string("%.2f", round_binary(F.col("score"), 2))
    note = F.concat(F.lit("alerted at score "), score, F.lit("; label from the screenshot"))
    return _candidates(newest, F.lit(OWN_SOURCE), None, F.col("brand"), note)


def hard_negatives(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(HARD_NEGATIVES), "fqdn string, note string")
    none = F.lit(None).cast("string")
    return _candidates(rows, F.lit(SEEDED_SOURCE), "legitimate", none, F.col("note"))


def new_candidates(candidates: DataFrame, present: DataFrame, today: Column) -> DataFrame:
    """Unlabelled lines for hosts not in the set yet; the first source naming a host wins.

    ``candidates`` carries ``place``, the order of its sources; ``present`` the hosts known.
    """
    fields = ("source", "suggestion", "brand", "note")
    first = candidates.groupBy("fqdn").agg(F.min_by(F.struct(*fields), "place").alias("__first"))
    return first.join(present.select("fqdn"), "fqdn", "left_anti").select(
        "fqdn",
        F.lit(None).cast("string").alias("expected"),
        "__first.suggestion",
        "__first.brand",
        "__first.source",
        F.date_format(today, "yyyy-MM-dd").alias("labelled_at"),
        "__first.note",
        F.lit("screenshot").alias("label_basis"),
    )


def candidate_counts(candidates: DataFrame, added: DataFrame) -> DataFrame:
    """(added, skipped) of one run."""
    total = candidates.agg(F.count("*").alias("total"))
    fresh = added.agg(F.count("*").alias("added"))  # one row, as the other
    return total.crossJoin(F.broadcast(fresh)).select("added", (F.col("total") - F.col("added")).alias("skipped"))


def refused_labels(labels: DataFrame) -> DataFrame:
    """Labels an analyst may not give, with the reason; the rest passes."""
    fqdn = F.lower(F.trim("fqdn"))
    reason = F.when(
        ~F.col("label").isin(*REVIEWABLE_LABELS),
        F.concat("label", F.lit(" describes a visit, not a site, and cannot be a label")),
    ).when(
        ~is_valid_hostname(fqdn), F.concat(F.lit("not a hostname: '"), F.substring(fqdn, 1, 80), F.lit("'"))
    )
    return labels.withColumn("fqdn", fqdn).withColumn("reject_reason", reason)


def route_labels(labels: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """Add ``dest`` and ``label_source``: where a label belongs and what a new line records.

    ``current`` holds (fqdn, dest) of every labelled set, ``tracked`` or a feed set's
    name. A labelled site stays where it is, the tracked set first; a new one goes to the
    tracked set only if our own scoring found it. The rule fails safe: feed sites never
    reach the tracked set.
    """
    tracked = F.col("dest") == "tracked"
    placed = current.groupBy("fqdn").agg(
        F.when(F.bool_or(tracked), F.lit("tracked")).otherwise(F.min("dest")).alias("placed")
    )
    found = matches.select("fqdn").distinct().withColumn("found", F.lit(True))
    dest = F.coalesce(
        "placed", F.when(F.col("found"), F.lit("tracked")), F.lit("feed")
    )
    return (
        labels.join(placed, "fqdn", "left")
        .join(found, "fqdn", "left")
        .withColumn("dest", dest)
        .withColumn(
            "label_source",
            F.when(F.col("dest") == "tracked", F.lit(OWN_SOURCE)).otherwise(F.lit(FEED_SOURCE)),
        )
        .drop("placed", "found")
    )


def upsert_labels(current: DataFrame, labels: DataFrame, today: Column) -> DataFrame:
    """The labelled set after the analysts' labels: a whole new snapshot.

    ``labels`` holds one (fqdn, label, brand, suggestion, label_source) per site. A site's
    row is replaced and others stay; a different label someone else gave is kept in the
    note.
    """
    new = labels.select(
        F.col("fqdn"),
        F.col("label").alias("new_label"),
        F.col("brand").alias("new_brand"),
        F.col("suggestion").alias("new_suggestion"),
        F.col("label_source").alias("new_source"),
    )
    old = current.withColumn("is_old", F.lit(True))
    relabelled = F.col("new_label").isNotNull()
    added = F.col("is_old").isNull()
    by_other = ~F.coalesce(F.col("labelled_by") == "human", F.lit(False))
    overruled = (
        ~added
        & relabelled
        & by_other
        & F.col("expected").isNotNull()
        & (F.col("expected") != F.col("new_label"))
    )
    was = F.concat(
        F.lit("relabelled by a human; was "), "expected", F.lit(" ("),
        F.coalesce(F.nullif("labelled_by", F.lit("")), F.lit("?")), F.lit(")"),
    )
    note = F.when(overruled, F.concat_ws("; ", F.nullif("note", F.lit("")), was)).otherwise(
        F.col("note")
    )

    def changed(value: Column, name: str) -> Column:
        return F.when(relabelled, value).otherwise(F.col(name)).alias(name)

    def filled(value: str, name: str) -> Column:
        return F.when(added, F.col(value)).otherwise(F.col(name)).alias(name)

    return old.join(new, "fqdn", "full_outer").select(
        "fqdn",
        changed(F.col("new_label"), "expected"),
        filled("new_source", "source"),
        changed(today, "labelled_at"),
        filled("new_brand", "brand"),
        note.alias("note"),
        filled("new_suggestion", "suggestion"),
        changed(F.lit("screenshot"), "label_basis"),
        changed(F.lit("human"), "labelled_by"),
    )


def current_labels(sets: DataFrame) -> DataFrame:
    """The label in force per site over all sets (column ``dest``); the tracked set wins."""
    rank = F.struct((F.col("dest") == "tracked").cast("int").alias("tracked"), F.col("dest"))
    fields = F.struct("expected", "labelled_by", "labelled_at", "dest")
    return sets.groupBy("fqdn").agg(F.max_by(fields, rank).alias("__label")).select("fqdn", "__label.*")
