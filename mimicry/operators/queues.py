"""Work queues and listings over matches, captures and verdicts.

"Best", "first" and "latest" per host are aggregates (``max_by``, ``min_by``), combined
before the shuffle, never ranking windows: a host holding a third of all rows costs each
task one row. Instants are passed in as ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _instant(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def since(column: str, as_of: datetime | Column, hours: float) -> Column:
    """Strictly later than ``hours`` before ``as_of``."""
    seconds = F.lit(float(hours) * 3600.0)
    return F.col(column) > _instant(as_of) - F.make_dt_interval(secs=seconds)


def if_set(column: str, value: str | None) -> Column:
    """An equality that holds for every row when no value is given."""
    return F.lit(True) if value is None else F.col(column) == value


def in_set(column: str, values: Sequence[str]) -> Column:
    """Membership that holds for every row when no values are given."""
    return F.col(column).isin(*values) if values else F.lit(True)


def best_brand() -> Column:
    """Brand of the highest score; equal scores go to the first name."""
    top = F.min(F.struct((-F.col("score")).alias("minus"), F.col("brand").alias("brand")))
    return top["brand"]


def best_per_host(matches: DataFrame) -> DataFrame:
    return matches.groupBy("fqdn").agg(F.max("score").alias("score"), best_brand().alias("brand"))


def capture_queue(
    matches: DataFrame,
    captures: DataFrame,
    as_of: datetime | Column,
    recapture_after_h: float,
    limit: int,
) -> DataFrame:
    """Alerting hosts without a recent capture: highest score first, then newest."""
    recent = captures.where(since("captured_at", as_of, recapture_after_h)).select("fqdn")
    waiting = (
        matches.where("is_alert")
        .groupBy("fqdn")
        .agg(
            F.min("registered_domain").alias("registered_domain"),
            best_brand().alias("brand"),
            F.max("score").alias("score"),
            F.min("first_seen_at").alias("first_seen_at"),
        )
        .join(recent, "fqdn", "left_anti")
    )
    return waiting.orderBy(F.desc("score"), F.desc("first_seen_at"), "fqdn").limit(limit)


def uncaptured(
    wanted: DataFrame, captures: DataFrame, as_of: datetime | Column, recapture_after_h: float
) -> DataFrame:
    """Rows of ``wanted`` whose host has no recent capture; its columns are kept."""
    recent = captures.where(since("captured_at", as_of, recapture_after_h)).select("fqdn")
    return wanted.join(recent, "fqdn", "left_anti")


def recent_sites(
    captures: DataFrame, as_of: datetime | Column, since_h: float, vantage: str | None = None
) -> DataFrame:
    """(fqdn, last_captured) of hosts captured lately, from one vantage point if given."""
    return (
        captures.where(since("captured_at", as_of, since_h) & if_set("vantage", vantage))
        .groupBy("fqdn")
        .agg(F.max("captured_at").alias("last_captured"))
    )


def same_site_targets(
    theirs: DataFrame,
    ours: DataFrame,
    as_of: datetime | Column,
    since_h: float,
    their_vantage: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Hosts the other side captured lately and we did not, newest first."""
    todo = uncaptured(recent_sites(theirs, as_of, since_h, their_vantage), ours, as_of, since_h)
    todo = todo.orderBy(F.desc("last_captured"), "fqdn")
    return todo if limit is None else todo.limit(limit)


def fresh_feed_targets(
    entries: DataFrame,
    captures: DataFrame,
    today: Column,
    max_age_days: int,
    limit: int,
) -> DataFrame:
    """Recently listed feed hosts never captured before, newest listing first.

    ``entries`` holds (fqdn, brand, labelled_at, line_no). A host listed twice counts at
    its last line, with the brand of its first one.
    """
    newest = (
        entries.where(F.col("labelled_at") >= F.date_sub(today, max_age_days))
        .groupBy("fqdn")
        .agg(
            F.max("line_no").alias("line_no"),
            F.min_by("brand", "line_no").alias("brand"),
        )
        .join(captures.select("fqdn"), "fqdn", "left_anti")
    )
    return newest.orderBy(F.desc("line_no"), "fqdn").limit(limit)


def classification_queue(
    captures: DataFrame,
    verdicts: DataFrame,
    matches: DataFrame,
    backend: str,
    limit: int | None = None,
    model: str | None = None,
) -> DataFrame:
    """Captures this backend (and model, if given) has not judged, newest first.

    With a limit the queue is cut to it before the brands are looked up, so the matches
    are read for the queued hosts only.
    """
    judged = verdicts.where(F.col("backend") == backend)
    if model is not None:
        judged = judged.where(F.col("model") == model)
    queued = (
        captures.join(judged.select("capture_id"), "capture_id", "left_anti")
        .orderBy(F.desc("captured_at"), F.desc("capture_id"))
    )
    queued = queued if limit is None else queued.limit(limit)
    named = matches.join(queued.select("fqdn").distinct(), "fqdn", "left_semi")
    brands = best_per_host(named).select("fqdn", F.col("brand").alias("suspected_brand"))
    return (
        queued.join(brands, "fqdn", "left")
        .withColumn("suspected_brand", F.coalesce("suspected_brand", F.lit("unknown")))
        .orderBy(F.desc("captured_at"), F.desc("capture_id"))
    )


def pending_alerts(
    verdicts: DataFrame,
    captures: DataFrame,
    matches: DataFrame,
    labels: Sequence[str],
    min_confidence: float,
    limit: int | None,
    announced: DataFrame | None = None,
) -> DataFrame:
    """Verdicts the policy announces, most confident first.

    Only hosts our own scoring found are announced, each verdict once: neither stamped as
    alerted nor in the ``announced`` ledger (column ``verdict_id``).
    """
    due = verdicts.where(
        F.col("alerted_at").isNull()
        & F.col("label").isin(*labels)
        & (F.col("confidence") >= min_confidence)
    )
    if announced is not None:
        due = due.join(announced.select("verdict_id"), "verdict_id", "left_anti")
    scores = matches.groupBy("fqdn").agg(F.max("score").alias("score"))
    pages = captures.select("capture_id", "screenshot_path", "final_url")
    found = (
        due.join(scores, "fqdn")
        .join(pages, "capture_id")
        .select(
            "verdict_id", "fqdn", "label", "confidence", "score",
            F.col("brand_impersonated").alias("brand"), "evidence", "screenshot_path",
            "final_url", "classified_at",
        )
        .orderBy(F.desc("confidence"), F.desc("verdict_id"))
    )
    return found if limit is None else found.limit(limit)


_VERDICT_FIELDS = (
    "capture_id", "brand_impersonated", "label", "confidence", "evidence", "model",
    "classified_at", "alerted_at",
)


def latest_verdicts(verdicts: DataFrame, model: str | None = None) -> DataFrame:
    """The newest verdict (highest id) of each host that is not an error."""
    usable = verdicts.where((F.col("label") != "error") & if_set("model", model))
    newest = F.max(F.struct("verdict_id", *_VERDICT_FIELDS))
    return usable.groupBy("fqdn").agg(newest.alias("__latest")).select("fqdn", "__latest.*")


def findings(
    verdicts: DataFrame,
    captures: DataFrame,
    matches: DataFrame,
    labels: Sequence[str] = (),
    min_confidence: float = 0.0,
    limit: int | None = None,
    model: str | None = None,
) -> DataFrame:
    """Latest verdict per host, then filtered, newest first."""
    latest = latest_verdicts(verdicts, model).where(
        in_set("label", labels) & (F.col("confidence") >= min_confidence)
    )
    pages = captures.select("capture_id", "final_url", "screenshot_path")
    scores = matches.groupBy("fqdn").agg(F.max("score").alias("score"))
    found = (
        latest.join(pages, "capture_id")
        .join(scores, "fqdn", "left")
        .select(
            "verdict_id", "fqdn", F.col("brand_impersonated").alias("brand"), "label",
            "confidence", F.coalesce("score", F.lit(0.0)).alias("score"), "evidence",
            "final_url", "screenshot_path", "model", "classified_at", "alerted_at",
        )
        .orderBy(F.desc("classified_at"), F.desc("verdict_id"))
    )
    return found if limit is None else found.limit(limit)


def unreviewed(found: DataFrame, current: DataFrame) -> DataFrame:
    """Findings whose current label (``labelled_by``) is not a human's."""
    done = current.where("labelled_by = 'human'").select("fqdn")
    return found.join(done, "fqdn", "left_anti")


def label_counts(verdicts: DataFrame) -> DataFrame:
    """Hosts per label of their latest verdict, most frequent first."""
    counts = latest_verdicts(verdicts).groupBy("label").agg(F.count("*").alias("hosts"))
    return counts.orderBy(F.desc("hosts"), "label")


def verdict_listing(
    verdicts: DataFrame, captures: DataFrame, limit: int, label: str | None = None
) -> DataFrame:
    """Verdicts with the capture behind them, newest first."""
    pages = captures.select("capture_id", "screenshot_path")
    return (
        verdicts.where(if_set("label", label))
        .join(pages, "capture_id")
        .select(
            "verdict_id", "classified_at", "label", "confidence", "fqdn", "brand_impersonated",
            "evidence", "screenshot_path", "backend",
        )
        .orderBy(F.desc("classified_at"), F.desc("verdict_id"))
        .limit(limit)
    )


def alert_summary(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts per registered domain and brand, newest first, with their best host."""
    top = F.min(F.struct((-F.col("score")).alias("minus"), F.col("fqdn").alias("fqdn")))
    summary = (
        matches.where("is_alert")
        .groupBy("registered_domain", "brand")
        .agg(
            F.max("score").alias("score"),
            F.count("*").alias("hostnames"),
            F.min("first_seen_at").alias("first_seen"),
            top["fqdn"].alias("example"),
        )
        .orderBy(F.desc("first_seen"), "registered_domain", "brand")
    )
    return summary if limit is None else summary.limit(limit)


def latest_captures(sites: DataFrame, captures: DataFrame) -> DataFrame:
    """The last capture (highest id) of each of the ``sites`` that has one."""
    fields = ("capture_id", "status", "screenshot_path", "duration_ms")
    newest = F.max(F.struct(*fields))
    return (
        captures.join(sites.select("fqdn").distinct(), "fqdn", "left_semi")
        .groupBy("fqdn")
        .agg(newest.alias("__capture"))
        .select("fqdn", "__capture.*")
    )


def captures_with_verdict(
    sites: DataFrame,
    captures: DataFrame,
    verdicts: DataFrame,
    backend: str | None = None,
    model: str | None = None,
) -> DataFrame:
    """Latest capture of each site with its latest verdict that is not an error.

    The five verdict columns come from one aggregate and one join.
    """
    latest = latest_captures(sites, captures)
    wanted = latest.select("capture_id")
    usable = verdicts.where(
        (F.col("label") != "error") & if_set("backend", backend) & if_set("model", model)
    )
    newest = (
        usable.join(wanted, "capture_id", "left_semi")
        .groupBy("capture_id")
        .agg(
            F.max(
                F.struct(
                    "verdict_id", "label", "brand_impersonated", "latency_ms", "prompt_tokens",
                    "completion_tokens", "cost_usd",
                )
            ).alias("__verdict")
        )
    )
    zero = F.lit(0)
    return latest.join(newest, "capture_id", "left").select(
        "fqdn",
        "status",
        "screenshot_path",
        F.coalesce("duration_ms", zero).alias("capture_ms"),
        F.col("__verdict.label").alias("verdict_label"),
        F.col("__verdict.brand_impersonated").alias("verdict_brand"),
        F.coalesce("__verdict.latency_ms", zero).alias("classify_ms"),
        (F.coalesce("__verdict.prompt_tokens", zero) + F.coalesce("__verdict.completion_tokens", zero)).alias(
            "tokens"
        ),
        F.coalesce("__verdict.cost_usd", F.lit(0.0)).alias("cost_usd"),
    )


def without_newest(
    verdicts: DataFrame, backend: str, model: str | None = None, limit: int | None = None
) -> DataFrame:
    """The snapshot left after dropping a backend's newest verdicts, to judge them again.

    Without a limit all of them go, by a filter.
    """
    own = F.coalesce((F.col("backend") == backend) & if_set("model", model), F.lit(False))
    if limit is None:
        return verdicts.where(~own)
    chosen = verdicts.where(own).select("verdict_id").orderBy(F.desc("verdict_id")).limit(limit)
    return verdicts.join(chosen, "verdict_id", "left_anti")


def without_failed(verdicts: DataFrame, backend: str) -> DataFrame:
    """The snapshot left after dropping a backend's error rows."""
    return verdicts.where(~((F.col("backend") == backend) & (F.col("label") == "error")))
