"""Queued captures to verdicts, verdicts to notifications, untrusted results to captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimicry.functions.hostnames import candidate_urls
from mimicry.functions.rounding import round_binary
from mimicry.functions.text import chat_safe
from mimicry.operators.verdicts import offline_verdict, parse_replies, rule_verdict, token_cost
from mimicry.sources.results import (
    accepted_results,
    inside_folder,
    judge_results,
    rejected_lines,
)
from mimicry.sources.sinks import absent, normalise_paths

VERDICT_KEY = ("capture_id", "backend", "model")


def _verdict_rows(
    judged: DataFrame, backend: str, model: str | None, classified_at: Column, **extra: Column
) -> DataFrame:
    v = F.col("verdict")
    fields = {
        "latency_ms": F.lit(None).cast("bigint"),
        "prompt_tokens": F.lit(None).cast("bigint"),
        "completion_tokens": F.lit(None).cast("bigint"),
        "cost_usd": F.lit(None).cast("double"),
        "error": F.lit(None).cast("string"),
        **extra,
    }
    return judged.select(
        "capture_id",
        "fqdn",
        F.lit(backend).alias("backend"),
        F.lit(model).cast("string").alias("model"),
        F.coalesce(v["label"], F.lit("error")).alias("label"),
        F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"),
        v["brand_impersonated"].alias("brand_impersonated"),
        v["evidence"].alias("evidence"),
        classified_at.alias("classified_at"),
        *[value.alias(name) for name, value in fields.items()],
        F.lit(None).cast("timestamp").alias("alerted_at"),
    )


def _offline() -> Column:
    return offline_verdict(F.col("status"), inside_folder(F.col("screenshot_path")))


def classify_by_rules(
    queue: DataFrame, classified_at: Column, backend: str = "stub"
) -> DataFrame:
    """A verdict row for each queued capture, from its status and page signals."""
    by_rule = rule_verdict(F.col("fqdn"), F.col("suspected_brand"), F.col("signals"))
    judged = queue.withColumn("verdict", F.coalesce(_offline(), by_rule))
    return _verdict_rows(judged, backend, None, classified_at)


def classify_by_replies(
    queue: DataFrame,
    replies: DataFrame,
    backend: str,
    model: str,
    classified_at: Column,
    prompt_price: float = 0.0,
    completion_price: float = 0.0,
) -> DataFrame:
    """Verdict rows from a table of model replies.

    ``replies`` holds (capture_id, reply, latency_ms, prompt_tokens, completion_tokens).
    Captures that need no model get their offline verdict; a reply that does not parse
    becomes an error row, so the capture is not tried for ever.
    """
    queue = queue.drop("error")
    offline = queue.withColumn("verdict", _offline()).where("verdict IS NOT NULL")
    rows = _verdict_rows(offline, backend, model, classified_at)
    asked = queue.where(_offline().isNull()).join(parse_replies(replies), "capture_id")
    cost = token_cost(
        F.col("prompt_tokens"), F.col("completion_tokens"), prompt_price, completion_price
    )
    fine = F.col("error").isNull()
    extra = {
        "latency_ms": F.col("latency_ms"),
        "prompt_tokens": F.when(fine, F.col("prompt_tokens")),
        "completion_tokens": F.when(fine, F.col("completion_tokens")),
        "cost_usd": F.when(fine, cost),
        "error": F.substring("error", 1, 500),
    }
    return rows.unionByName(_verdict_rows(asked, backend, model, classified_at, **extra))


def new_verdicts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose capture, backend and model have no verdict yet; no model equals no model."""
    return absent(rows, stored, VERDICT_KEY)


def notification_text(findings: DataFrame) -> Column:
    """A one-screen summary per finding that a chat client will show but not act on."""

    def safe(name: str, limit: int) -> Column:
        return chat_safe(F.col(name), limit)

    def two_places(name: str) -> Column:
        return F.format_string("%.2f", round_binary(F.col(name), 2))

    head = F.concat(
        F.lit("["), safe("label", 20), F.lit("] "), safe("fqdn", 253), F.lit(" (brand: "),
        chat_safe(F.coalesce("brand", F.lit("unknown")), 40), F.lit(", confidence "),
        two_places("confidence"), F.lit(", score "), two_places("score"), F.lit(")"),
    )
    evidence = chat_safe(F.coalesce("evidence", F.lit("")), 500)
    url, shot = F.nullif("final_url", F.lit("")), F.nullif("screenshot_path", F.lit(""))
    return F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("evidence: "), evidence),
        F.concat(F.lit("final URL: "), chat_safe(url, 500)),
        F.concat(F.lit("screenshot: "), chat_safe(shot, 300)),
    )


@dataclass(frozen=True)
class ImportedResults:
    captures: DataFrame
    rejected: DataFrame


def import_results(
    lines: DataFrame,
    targets: DataFrame,
    now: Column,
    vantage: str | None = None,
    schemes: tuple[str, ...] = ("https", "http"),
    run_failed: bool = False,
) -> ImportedResults:
    """Accepted results as captures, and the refused lines with their reasons.

    A target without an accepted result gets an error capture, unless the run itself
    failed: those targets were never tried and stay queued.
    """
    judged = judge_results(lines, targets, schemes)
    captures = accepted_results(judged)
    if not run_failed:
        # Accepted hosts are among the targets: one join gives both kinds of rows.
        silent = F.col("status").isNull()
        without_result = {
            "url": candidate_urls(F.col("fqdn"), schemes)[0],
            "captured_at": now,
            "duration_ms": F.lit(0).cast("bigint"),
            "error": F.lit("no valid result from the capture container"),
            "status": F.lit("error"),
        }
        captures = targets.select("fqdn").distinct().join(captures, "fqdn", "left")
        captures = captures.withColumns(
            {
                name: F.when(silent, value).otherwise(F.col(name))
                for name, value in without_result.items()
            }
        )
    return ImportedResults(normalise_paths(captures, vantage), rejected_lines(judged))


def status_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy("status").agg(F.count("*").alias("captures"))


def mark_announced(findings: DataFrame, when: Column) -> DataFrame:
    """Ledger rows for findings a sink has accepted."""
    return findings.select("verdict_id", when.alias("alerted_at"))
