"""Classification metrics from counts of (expected, predicted).

Predictions are reduced once to one row per group, expected and predicted label; every
figure is computed from those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimicry.functions.rounding import ratio, round_binary


def confusion_counts(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(group..., expected, predicted, n) for the cells that occur."""
    return predictions.groupBy(*groups, "expected", "predicted").agg(F.count("*").alias("n"))


def _per_label(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Support, predictions and hits of every label that occurs on either side."""
    both = F.explode(
        F.array(
            F.struct(F.col("expected").alias("label"), F.lit(1).alias("is_expected")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_expected")),
        )
    ).alias("side")
    n = F.col("n")
    sides = counts.select(
        *groups, both, "n", (F.col("expected") == F.col("predicted")).alias("right")
    )
    expected = F.col("side.is_expected") == 1
    return sides.groupBy(*groups, F.col("side.label").alias("label")).agg(
        F.sum(F.when(expected, n).otherwise(0)).alias("support"),
        F.sum(F.when(~expected, n).otherwise(0)).alias("predicted"),
        F.sum(F.when(expected & F.col("right"), n).otherwise(0)).alias("true_positives"),
    )


def confusion_matrix(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Every expected and predicted label of the group, absent cells as zero.

    Labels are a handful per group; the set of them is one array, exploded twice.
    """
    labels = counts.groupBy(*groups).agg(
        F.array_union(F.collect_set("expected"), F.collect_set("predicted")).alias("labels")
    )
    cells = labels.select(*groups, "labels", F.explode("labels").alias("expected")).select(
        *groups, "expected", F.explode("labels").alias("predicted")
    )
    filled = cells.join(counts, [*groups, "expected", "predicted"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0)))


def f1_score(precision: Column, recall: Column) -> Column:
    """From the rounded precision and recall, as they are reported."""
    total = precision + recall
    return F.when(total > 0, round_binary(2 * precision * recall / total, 4)).otherwise(
        F.lit(0.0)
    )


def class_metrics(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    hits = F.col("true_positives")
    per_label = _per_label(counts, groups).withColumns(
        {
            "false_positives": F.col("predicted") - hits,
            "false_negatives": F.col("support") - hits,
            "precision": ratio(hits, F.col("predicted")),
            "recall": ratio(hits, F.col("support")),
        }
    )
    return per_label.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def macro_metrics(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro averages over the labels that occur."""
    per_label = class_metrics(counts, groups)
    labels = F.count("*")

    def mean(name: str) -> Column:
        # Summed in label order, so the result does not depend on the partitioning.
        ordered = F.array_sort(F.collect_list(F.struct("label", F.col(name).alias("x"))))
        total = F.aggregate(ordered, F.lit(0.0), lambda acc, item: acc + item["x"])
        return round_binary(total / labels, 4)

    return per_label.groupBy(*groups).agg(
        F.sum("support").alias("total"),
        F.sum("true_positives").alias("correct"),
        ratio(F.sum("true_positives"), F.sum("support")).alias("accuracy"),
        mean("precision").alias("macro_precision"),
        mean("recall").alias("macro_recall"),
        mean("f1").alias("macro_f1"),
    )


def split_metrics(predictions: DataFrame, column: str, missing: str) -> DataFrame:
    """Macro metrics per value of a column, in one aggregation over all groups."""
    named = predictions.withColumn(
        "split", F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    )
    return macro_metrics(confusion_counts(named, ["split"]), ["split"])


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float], configured: float
) -> DataFrame:
    """Alerts and phishing precision, recall, F1 at each threshold.

    Scores fall into the bucket of the highest threshold they reach; reverse running sums
    over those few buckets give every threshold from one pass over the data.
    """
    phishing = (F.col("expected") == "phishing").cast("bigint")
    buckets = scored.groupBy(score_bucket(thresholds).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(phishing).alias("hits")
    )
    return sweep_of(buckets, thresholds, configured)


def score_bucket(thresholds: Sequence[float]) -> Column:
    """The place of the highest threshold that ``score`` reaches, -1 for none."""
    reached = F.lit(-1)
    for position, step in enumerate(sorted(set(thresholds))):
        reached = F.when(F.col("score") >= step, F.lit(position)).otherwise(reached)
    return reached


def sweep_of(buckets: DataFrame, thresholds: Sequence[float], configured: float) -> DataFrame:
    """As :func:`threshold_sweep`, from sites and phishing sites (n, hits) per score bucket."""
    steps = sorted(set(thresholds))
    packed = buckets.agg(F.collect_list(F.struct("bucket", "n", "hits")).alias("buckets"))
    points = F.array(
        *[
            F.struct(F.lit(p).alias("position"), F.lit(float(s)).alias("threshold"))
            for p, s in enumerate(steps)
        ]
    )
    zero = F.lit(0).cast("bigint")

    def above(name: str, floor: Column) -> Column:
        kept = F.filter("buckets", lambda b: b["bucket"] >= floor)
        return F.aggregate(kept, zero, lambda acc, b: acc + b[name])

    at = F.col("point.position")
    counted = packed.select("buckets", F.explode(points).alias("point")).select(
        F.col("point.threshold").alias("threshold"),
        above("n", at).alias("alerts"),
        above("hits", at).alias("true_positives"),
        above("hits", F.lit(-1)).alias("phishing"),
    )
    hits = F.col("true_positives")
    rated = counted.withColumns(
        {
            "false_positives": F.col("alerts") - hits,
            "false_negatives": F.col("phishing") - hits,
            "precision": ratio(hits, F.col("alerts")),
            "recall": ratio(hits, F.col("phishing")),
            "is_configured": F.abs(F.col("threshold") - configured) < 1e-9,
        }
    )
    return rated.withColumn("f1", f1_score(F.col("precision"), F.col("recall"))).drop("phishing")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep point of the best F1; the lowest threshold on ties."""
    best = F.max_by(F.struct(*sweep.columns), F.struct(F.col("f1"), -F.col("threshold")))
    return sweep.agg(best.alias("__best")).select("__best.*")


def mistakes(predictions: DataFrame) -> DataFrame:
    """Wrong predictions; ``is_costly`` where phishing was judged harmless."""
    return predictions.where(F.col("expected") != F.col("predicted")).withColumn(
        "is_costly", F.col("expected") == "phishing"
    )


def contradictory(predictions: DataFrame) -> DataFrame:
    """Verdicts that name an impersonated brand but do not say phishing."""
    return predictions.where((F.col("verdict_brand") != "") & (F.col("predicted") != "phishing"))


def cost_of(predictions: DataFrame, captures: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """What the judged sites cost to capture and classify."""
    spent = predictions.join(captures, ["fqdn", *groups], "left").groupBy(*groups).agg(
        F.count("*").alias("sites"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("capture_ms", "classify_ms", "tokens")
        ],
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )
    return with_unit_costs(spent)


def with_unit_costs(spent: DataFrame) -> DataFrame:
    sites = F.col("sites")
    total = round_binary(F.col("cost_usd"), 6)
    busy = F.col("capture_ms") + F.col("classify_ms")
    return spent.withColumns(
        {
            "cost_usd": total,
            "ms_per_site": ratio(busy, sites, 1),
            "usd_per_1000_sites": F.when(
                sites > 0, round_binary(total / sites * 1000, 4)
            ).otherwise(F.lit(0.0)),
        }
    )
