"""Measuring the detection arms on labelled sites."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mimicry.config import SWEEP_THRESHOLDS
from mimicry.functions.rounding import ratio, round_binary
from mimicry.operators.metrics import (
    class_metrics,
    confusion_counts,
    confusion_matrix,
    contradictory,
    cost_of,
    macro_metrics,
    mistakes,
    score_bucket,
    split_metrics,
    sweep_of,
    threshold_sweep,
    with_unit_costs,
)
from mimicry.operators.queues import captures_with_verdict, if_set, latest_captures
from mimicry.operators.scoring import Scorer, best_match
from mimicry.operators.statistics import RESAMPLES, bootstrap_intervals
from mimicry.sources.files import create, read_small, remove, subfolders

def judgeable(sites: DataFrame) -> DataFrame:
    """Sites with ground truth: ``unknown`` is no class and is only counted."""
    return sites.where("expected <> 'unknown'")


def labeller_counts(sites: DataFrame) -> DataFrame:
    by = F.coalesce(F.nullif("labelled_by", F.lit("")), F.lit("unrecorded"))
    return sites.groupBy(by.alias("labelled_by")).agg(F.count("*").alias("sites"))


def score_sites(sites: DataFrame, scorer: Scorer) -> DataFrame:
    """Sites with their best score; no issuer is known, so no free-DV bonus.

    The brand falls back to the label's own where nothing scored.
    """
    distinct = sites.select("fqdn").distinct()
    named = scorer.score_names(distinct.withColumnRenamed("fqdn", "site"), "site")
    best = best_match(named, "site").select(
        F.col("site").alias("fqdn"), "score", F.col("brand").alias("scored_brand")
    )
    scored = sites.join(best, "fqdn", "left")
    return scored.withColumns(
        {
            "score": F.coalesce("score", F.lit(0.0)),
            "brand": F.coalesce("scored_brand", "brand"),
        }
    ).drop("scored_brand")


def scoring_only_arm(
    scored: DataFrame, alert_threshold: float, captures: DataFrame | None = None
) -> DataFrame:
    """Predictions on names alone: phishing from the threshold up, else legitimate."""
    screenshot = F.lit(None).cast("string")
    if captures is not None:
        scored = scored.join(captures.select("fqdn", "screenshot_path"), "fqdn", "left")
        screenshot = F.col("screenshot_path")
    alerted = F.col("score") >= alert_threshold
    return scored.select(
        "fqdn",
        "expected",
        F.when(alerted, F.lit("phishing")).otherwise(F.lit("legitimate")).alias("predicted"),
        "score",
        "brand",
        "note",
        "source",
        screenshot.alias("screenshot"),
        F.lit(None).cast("string").alias("verdict_brand"),
    )


def full_arm(scored: DataFrame, alert_threshold: float, captures: DataFrame) -> DataFrame:
    """Predictions of the whole pipeline, with ``excluded_reason`` where there is none.

    Measured only where the page loaded. Below the threshold no verdict is asked for and
    the site counts as legitimate; an alerted site nobody classified is left out.
    """
    alerted = F.col("score") >= alert_threshold
    reason = (
        F.when(F.col("status").isNull(), F.lit("not captured"))
        .when(F.col("status") != "ok", F.lit("unreachable"))
        .when(alerted & F.col("verdict_label").isNull(), F.lit("not classified"))
    )
    predicted = F.when(alerted, F.col("verdict_label")).otherwise(F.lit("legitimate"))
    return scored.join(captures, "fqdn", "left").select(
        "fqdn",
        "expected",
        F.when(reason.isNull(), predicted).alias("predicted"),
        "score",
        "brand",
        "note",
        "source",
        F.col("screenshot_path").alias("screenshot"),
        "verdict_brand",
        reason.alias("excluded_reason"),
    )


def judged(arm: DataFrame) -> DataFrame:
    return arm.where("excluded_reason IS NULL").drop("excluded_reason")


def arm_report(
    predictions: DataFrame,
    captures: DataFrame | None = None,
    alert_threshold: float | None = None,
    resamples: int = RESAMPLES,
) -> dict[str, DataFrame]:
    """The result tables of one arm, each small and ready to be written."""
    counts = confusion_counts(predictions)
    tables = {
        "metrics": macro_metrics(counts),
        "classes": class_metrics(counts),
        "confusion": confusion_matrix(counts),
        "by_brand": split_metrics(predictions, "brand", "(none)"),
        "by_source": split_metrics(predictions, "source", "(unknown)"),
        "intervals": bootstrap_intervals(counts, resamples),
        "mistakes": mistakes(predictions),
        "contradictory": contradictory(predictions),
    }
    if captures is not None:
        tables["cost"] = cost_of(predictions.select("fqdn"), captures)
    if alert_threshold is not None:
        tables["sweep"] = threshold_sweep(predictions, SWEEP_THRESHOLDS, alert_threshold)
    return tables


def evaluate(
    sites: DataFrame,
    scorer: Scorer,
    stored_captures: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    backend: str | None = None,
    model: str | None = None,
    resamples: int = RESAMPLES,
) -> dict[str, dict[str, DataFrame]]:
    """Report tables per arm. The full arm needs stored captures and verdicts."""
    threshold = scorer.cfg.alert_threshold
    known = judgeable(sites)
    scored = score_sites(known, scorer).persist()
    captures = None
    if stored_captures is not None and verdicts is not None:
        captures = captures_with_verdict(known, stored_captures, verdicts, backend, model)
    names_only = scoring_only_arm(scored, threshold, captures)
    arms = {"scoring_only": arm_report(names_only, None, threshold, resamples)}
    if captures is not None:
        arm = full_arm(scored, threshold, captures)
        tables = arm_report(judged(arm), captures, None, resamples)
        tables["excluded"] = arm.where("excluded_reason IS NOT NULL").select(
            "fqdn", "excluded_reason"
        )
        arms["scoring_plus_verdicts"] = tables
    return arms


def export_report(arms: dict[str, dict[str, DataFrame]], folder: str, **conditions: object) -> None:
    """Every table as JSON lines with the conditions of the run in each row."""
    stamp = {name: F.lit(value) for name, value in conditions.items()}
    for arm, tables in arms.items():
        for name, df in tables.items():
            stamped = df.withColumns({"arm": F.lit(arm), **stamp})
            stamped.write.mode("overwrite").json(f"{folder}/{arm}/{name}")


ARMS = ("scoring_only", "scoring_plus_verdicts")
COSTS = ("capture_ms", "classify_ms", "tokens", "cost_usd")


def arm_predictions(
    scored: DataFrame, alert_threshold: float, captures: DataFrame | None = None
) -> DataFrame:
    """A row for each site and arm: prediction, what it was made from, what it cost.

    The sites are scored and meet their captures once; each row fans out to its arms.
    Without ``captures`` there is only the first arm. A site without a prediction in an arm
    has the reason in ``excluded_reason``.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    alerted = F.col("score") >= alert_threshold
    by_name = F.when(alerted, F.lit("phishing")).otherwise(F.lit("legitimate"))
    shot = text if captures is None else F.col("screenshot_path")
    free = [number.alias(c) for c in COSTS[:-1]] + [F.lit(None).cast("double").alias(COSTS[-1])]
    arms = [F.struct(
        F.lit(ARMS[0]).alias("arm"), by_name.alias("predicted"), shot.alias("screenshot"), text.alias("verdict_brand"),
        text.alias("excluded_reason"), *free,
    )]
    if captures is not None:
        scored = scored.join(captures, "fqdn", "left")
        reason = (
            F.when(F.col("status").isNull(), F.lit("not captured"))
            .when(F.col("status") != "ok", F.lit("unreachable"))
            .when(alerted & F.col("verdict_label").isNull(), F.lit("not classified"))
        )
        judged_as = F.when(alerted, F.col("verdict_label")).otherwise(F.lit("legitimate"))
        spent = [F.col(c).cast("double" if c == "cost_usd" else "bigint").alias(c) for c in COSTS]
        arms.append(F.struct(
            F.lit(ARMS[1]).alias("arm"), F.when(reason.isNull(), judged_as).alias("predicted"), F.col("screenshot_path").alias("screenshot"),
            F.col("verdict_brand").alias("verdict_brand"), reason.alias("excluded_reason"), *spent,
        ))
    return scored.select(
        "fqdn", "expected", "score", "brand", "note", "source", F.inline(F.array(*arms))
    )


def report_tables(
    predictions: DataFrame, alert_threshold: float, resamples: int = RESAMPLES
) -> dict[str, DataFrame]:
    """The result tables of all arms from one table of predictions.

    One aggregate counts the cells of (arm, source, brand, score bucket, expected, predicted);
    metrics, splits, sweep and intervals are derived from those few rows. Lists of single sites
    and costs read the predictions themselves.
    """
    made = predictions.where("excluded_reason IS NULL")
    names = {"source": "(unknown)", "brand": "(none)"}
    keys = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(missing)).alias(c) for c, missing in names.items()]
    cells = made.groupBy("arm", *keys, score_bucket(SWEEP_THRESHOLDS).alias("bucket"), "expected", "predicted").agg(
        F.count("*").alias("n")
    ).persist()

    def merged(*groups: str) -> DataFrame:
        return cells.groupBy(*groups, "expected", "predicted").agg(F.sum("n").alias("n"))

    by_arm = merged("arm")
    intervals = [
        bootstrap_intervals(by_arm.where(F.col("arm") == arm).drop("arm"), resamples).withColumn("arm", F.lit(arm))
        for arm in ARMS
    ]
    sites = made.where(F.col("arm") == ARMS[1]).groupBy("arm")
    costs = sites.agg(F.count("*").alias("sites"), *[F.coalesce(F.sum(c), F.lit(0).cast("double" if c == "cost_usd" else "bigint")).alias(c) for c in COSTS])
    hits = F.sum(F.when(F.col("expected") == "phishing", F.col("n")).otherwise(0)).alias("hits")
    buckets = cells.where(F.col("arm") == ARMS[0]).groupBy("bucket").agg(F.sum("n").alias("n"), hits)
    return {
        "metrics": macro_metrics(by_arm, ["arm"]),
        "classes": class_metrics(by_arm, ["arm"]),
        "confusion": confusion_matrix(by_arm, ["arm"]),
        "by_source": macro_metrics(merged("arm", "source"), ["arm", "source"]),
        "by_brand": macro_metrics(merged("arm", "brand"), ["arm", "brand"]),
        "intervals": intervals[0].unionByName(intervals[1]),
        "sweep": sweep_of(buckets, SWEEP_THRESHOLDS, alert_threshold).withColumn("arm", F.lit(ARMS[0])),
        "mistakes": mistakes(made).select("arm", "fqdn", "expected", "predicted", "score", "brand", "note", "screenshot", "is_costly"),
        "contradictory": contradictory(made).select("arm", "fqdn", "verdict_brand", "predicted"),
        "excluded": predictions.where("excluded_reason IS NOT NULL").select("arm", "fqdn", "excluded_reason"),
        "cost": with_unit_costs(costs),
    }


class Reports:
    """Evaluation reports below a folder, each visible as a whole or not at all.

    A run writes its tables as JSON lines into a folder of its own; a small numbered file, which
    is created last and exclusively, names that folder, the tables with their schemas and the
    conditions of the run. Readers follow the newest such file.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def publish(self, tables: dict[str, DataFrame], **conditions: object) -> int:
        run = uuid4().hex
        schemas = {}
        for name, df in tables.items():
            df.write.json(f"{self.folder}/runs/{run}/{name}")
            schemas[name] = df.schema.toDDL()
        told = json.dumps({"run": run, "tables": schemas, "conditions": conditions}, default=str, sort_keys=True)
        while True:
            number = max(self._numbers(), default=-1) + 1
            if create(self.spark, f"{self.folder}/{number:06d}.json", told):
                return number

    def _numbers(self) -> list[int]:
        names = subfolders(self.spark, self.folder)
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]

    def read(self, number: int | None = None) -> tuple[dict[str, DataFrame], dict[str, object]]:
        """Tables and conditions of a report, by default the newest."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no report below {self.folder}")
        told = json.loads(read_small(self.spark, f"{self.folder}/{max(numbers) if number is None else number:06d}.json"))
        run = f"{self.folder}/runs/{told['run']}"
        tables = {n: self.spark.read.schema(ddl).json(f"{run}/{n}") for n, ddl in told["tables"].items()}
        return tables, told["conditions"]


def run_evaluation(
    sites: DataFrame,
    scorer: Scorer,
    folder: str,
    stored_captures: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    backend: str | None = None,
    model: str | None = None,
    resamples: int = RESAMPLES,
    **conditions: object,
) -> int:
    """Evaluate labelled sites and publish the report below ``folder``; returns its number.

    Predictions are made once and written; the counts of sites are observed while that runs.
    """
    spark = sites.sparkSession
    threshold = scorer.cfg.alert_threshold
    known = judgeable(sites)
    captures = None
    if stored_captures is not None and verdicts is not None:
        captures = captures_with_verdict(known, stored_captures, verdicts, backend, model)
    seen = Observation("evaluated")
    first = F.col("arm") == ARMS[0]
    rows = arm_predictions(score_sites(known, scorer), threshold, captures).observe(
        seen,
        F.count_if(first).alias("sites"),
        F.count_if(F.col("excluded_reason").isNotNull()).alias("excluded"),
    )
    path = f"{folder}/predictions/{uuid4().hex}"
    rows.write.parquet(path)
    predictions = spark.read.schema(rows.schema).parquet(path)
    tables = report_tables(predictions, threshold, resamples) | {"labellers": labeller_counts(sites)}
    counts = {name: seen.get[name] for name in ("sites", "excluded")}
    number = Reports(spark, folder).publish(tables, alert_threshold=threshold, **counts, **conditions)
    remove(spark, path)
    return number


def model_predictions(
    scored: DataFrame,
    alert_threshold: float,
    captures: DataFrame,
    verdicts: DataFrame,
    models: list[str],
    backend: str | None = None,
) -> DataFrame:
    """The full arm once per model over the same sites and captures.

    Captures are reduced to the latest per site once; verdicts to the latest per capture
    and model in one aggregate, instead of one pass per model.
    """
    latest = latest_captures(scored.select("fqdn"), captures)
    usable = verdicts.where(
        (F.col("label") != "error") & F.col("model").isin(*models) & if_set("backend", backend)
    )
    newest = usable.groupBy("capture_id", "model").agg(
        F.max(
            F.struct(
                "verdict_id", "label", "latency_ms", "prompt_tokens", "completion_tokens", "cost_usd"
            )
        ).alias("__verdict")
    )
    loaded = (
        scored.select("fqdn", "expected", "score")
        .join(latest.where("status = 'ok'"), "fqdn")
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        .join(newest, ["capture_id", "model"], "left")
    )
    alerted = F.col("score") >= alert_threshold
    zero = F.lit(0)
    return loaded.where(~alerted | F.col("__verdict.label").isNotNull()).select(
        "model",
        "fqdn",
        "expected",
        F.when(alerted, F.col("__verdict.label")).otherwise(F.lit("legitimate")).alias("predicted"),
        F.coalesce("__verdict.latency_ms", zero).alias("classify_ms"),
        (F.coalesce("__verdict.prompt_tokens", zero) + F.coalesce("__verdict.completion_tokens", zero)).alias(
            "tokens"
        ),
        F.coalesce("__verdict.cost_usd", F.lit(0.0)).alias("cost_usd"),
    )


def model_table(predictions: DataFrame) -> DataFrame:
    """Per model: sites judged, accuracy, macro F1, time per site, tokens and cost.

    One aggregate to a few cells per model, from which both sides are derived: what was
    spent travels along as a key of the metrics, so the predictions are made once.
    """
    cells = predictions.groupBy("model", "expected", "predicted").agg(
        F.count("*").alias("n"),
        F.sum("classify_ms").alias("ms"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    models = cells.groupBy("model").agg(
        F.sum("n").alias("judged"),
        ratio(F.sum("ms"), F.sum("n"), 1).alias("ms_per_site"),
        F.sum("tokens").alias("tokens"),
        round_binary(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.collect_list(F.struct("expected", "predicted", "n")).alias("cells"),
    )
    spent = ["model", "judged", "ms_per_site", "tokens", "cost_usd"]
    metrics = macro_metrics(models.select(*spent, F.inline("cells")), spent)
    return metrics.select(*spent, "accuracy", "macro_f1")


def model_answers(predictions: DataFrame) -> DataFrame:
    """(fqdn, model, is_right), the input of the paired tests."""
    right = F.col("expected") == F.col("predicted")
    return predictions.select("fqdn", "model", right.alias("is_right"))
