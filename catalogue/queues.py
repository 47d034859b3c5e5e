"""Queues, listings and resets."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import check, moment, moment_sql, query
from mimicry.config import AlertPolicy
from mimicry.operators import queues as q
from mimicry.plans import labelling
from mimicry.session import shared_folder
from mimicry.sources.sinks import absent, export_snapshot
from mimicry.staging import Tables

AS_OF = datetime(2001, 7, 25)
AS_OF_SQL = "TIMESTAMP '2001-07-25 00:00:00'"
POLICY = AlertPolicy()

BEST = """best AS (
    SELECT fqdn, score, brand FROM (
        SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY score DESC, brand) AS rn FROM matches)
    WHERE rn = 1)"""
LATEST = """latest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY verdict_id DESC) AS rn
                   FROM verdicts WHERE label <> 'error') WHERE rn = 1)"""


@query(check(("matches",), f"""
    SELECT registered_domain, brand, max(score) AS score, count(*) AS hostnames,
           {moment_sql("min(first_seen_at)")} AS first_seen,
           first(fqdn ORDER BY score DESC, fqdn) AS example
    FROM matches WHERE is_alert GROUP BY registered_domain, brand"""))
def alert_summary(t: Tables) -> DataFrame:
    return q.alert_summary(t.matches).withColumn("first_seen", moment("first_seen"))


@query(check(("matches", "captures"), f"""
    SELECT fqdn, any_value(registered_domain) AS registered_domain, any_value(b.brand) AS brand,
           max(m.score) AS score, {moment_sql("min(first_seen_at)")} AS first_seen_at
    FROM matches m JOIN alert_best b USING (fqdn)
    WHERE is_alert AND fqdn NOT IN (SELECT fqdn FROM captures WHERE captured_at > {AS_OF_SQL} - INTERVAL 2000 HOUR)
    GROUP BY fqdn ORDER BY max(m.score) DESC, min(first_seen_at) DESC, fqdn LIMIT 40""",
    BEST.replace("best AS", "alert_best AS").replace("FROM matches", "FROM matches WHERE is_alert")))
def capture_queue(t: Tables) -> DataFrame:
    queue = q.capture_queue(t.matches, t.captures, AS_OF, 2000, 40)
    return queue.withColumn("first_seen_at", moment("first_seen_at"))


@query(check(("matches", "captures", "verdicts"), f"""
    SELECT capture_id, c.fqdn, status, coalesce(b.brand, 'unknown') AS suspected_brand, {moment_sql("captured_at")} AS captured_at
    FROM captures c LEFT JOIN best b ON b.fqdn = c.fqdn
    WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.capture_id = c.capture_id
                      AND v.backend = 'vision' AND v.model = 'medium')
    ORDER BY c.captured_at DESC, capture_id DESC LIMIT 500""", BEST))
def classification_queue(t: Tables) -> DataFrame:
    queue = q.classification_queue(t.captures, t.verdicts, t.matches, "vision", 500, "medium")
    return queue.select(
        "capture_id", "fqdn", "status", "suspected_brand", moment("captured_at").alias("captured_at")
    )


_DUE = f"""
    SELECT verdict_id, v.fqdn, label, confidence, b.score, brand_impersonated AS brand, final_url,
           screenshot_path, {moment_sql("classified_at")} AS classified_at
    FROM verdicts v JOIN captures USING (capture_id) JOIN best b ON b.fqdn = v.fqdn
    WHERE NOT already_alerted AND label = 'phishing' AND confidence >= 0.6"""


def _due(t: Tables, announced: DataFrame | None = None, limit: int | None = 50) -> DataFrame:
    due = q.pending_alerts(
        t.verdicts, t.captures, t.matches, POLICY.labels, POLICY.min_confidence, limit, announced
    )
    return due.withColumn("classified_at", moment("classified_at")).drop("evidence")


@query(check(("matches", "captures", "verdicts"),
             _DUE + " ORDER BY confidence DESC, verdict_id DESC LIMIT 50", BEST))
def alert_policy(t: Tables) -> DataFrame:
    return _due(t)


@query(check(("matches", "captures", "verdicts"),
             _DUE + " AND model IS DISTINCT FROM 'large' ORDER BY confidence DESC, verdict_id DESC LIMIT 30", BEST))
def alerts_not_announced(t: Tables) -> DataFrame:
    ledger = t.verdicts.where("model = 'large'").select("verdict_id")
    return _due(t, ledger, 30)


_FINDINGS = f"""
    SELECT verdict_id, l.fqdn, brand_impersonated AS brand, label, confidence,
           coalesce(b.score, 0.0::DOUBLE) AS score, final_url, screenshot_path, model,
           {moment_sql("classified_at")} AS classified_at, already_alerted AS was_alerted
    FROM latest l JOIN captures USING (capture_id) LEFT JOIN best b ON b.fqdn = l.fqdn
    WHERE label IN ('phishing', 'parked') AND confidence >= 0.5"""


def _findings(t: Tables, limit: int | None) -> DataFrame:
    return q.findings(t.verdicts, t.captures, t.matches, ("phishing", "parked"), 0.5, limit)


@query(check(("matches", "captures", "verdicts"),
             _FINDINGS + " ORDER BY l.classified_at DESC, verdict_id DESC LIMIT 200", BEST, LATEST))
def findings(t: Tables) -> DataFrame:
    found = _findings(t, 200).withColumn("was_alerted", F.col("alerted_at").isNotNull())
    return found.withColumn("classified_at", moment("classified_at")).drop("evidence", "alerted_at")


@query(check(("matches", "captures", "verdicts", "labelled"), f"""
    SELECT verdict_id, fqdn, label FROM ({_FINDINGS}) f
    WHERE fqdn NOT IN (SELECT fqdn FROM labelled WHERE labelled_by = 'human')""", BEST, LATEST))
def unreviewed_findings(t: Tables) -> DataFrame:
    found = _findings(t, None)
    return q.unreviewed(found, t.labelled).select("verdict_id", "fqdn", "label")


@query(check(("verdicts",), "SELECT label, count(*) AS hosts FROM latest GROUP BY label", LATEST))
def label_counts(t: Tables) -> DataFrame:
    return q.label_counts(t.verdicts)


@query(check(("captures", "verdicts"), f"""
    SELECT verdict_id, {moment_sql("classified_at")} AS classified_at, label, confidence, v.fqdn,
           brand_impersonated, evidence, screenshot_path, backend
    FROM verdicts v JOIN captures c ON c.capture_id = v.capture_id WHERE label = 'parked'
    ORDER BY v.classified_at DESC, verdict_id DESC LIMIT 300"""))
def verdict_listing(t: Tables) -> DataFrame:
    listed = q.verdict_listing(t.verdicts, t.captures, 300, "parked")
    return listed.withColumn("classified_at", moment("classified_at"))


@query(check(("captures", "verdicts", "labelled"), """
    SELECT c.fqdn, c.status, c.screenshot_path, c.duration_ms AS capture_ms, v.label AS verdict_label,
           v.brand_impersonated AS verdict_brand, coalesce(v.latency_ms, 0) AS classify_ms,
           coalesce(v.prompt_tokens, 0) + coalesce(v.completion_tokens, 0) AS tokens,
           coalesce(v.cost_usd, 0.0::DOUBLE) AS cost_usd
    FROM (SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY capture_id DESC) AS rn FROM captures
          WHERE fqdn IN (SELECT fqdn FROM labelled)) c
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY verdict_id DESC) AS rv
               FROM verdicts WHERE label <> 'error' AND backend = 'vision') v
    ON v.capture_id = c.capture_id AND rv = 1 WHERE rn = 1"""))
def latest_capture_verdict(t: Tables) -> DataFrame:
    return q.captures_with_verdict(t.labelled, t.captures, t.verdicts, "vision")


@query(check(("captures", "labelled"), f"""
    SELECT fqdn, c_custkey FROM labelled l WHERE NOT EXISTS (
        SELECT 1 FROM captures c WHERE c.fqdn = l.fqdn AND c.captured_at > {AS_OF_SQL} - INTERVAL 8000 HOUR)"""))
def uncaptured(t: Tables) -> DataFrame:
    wanted = t.labelled.select("fqdn", "c_custkey")
    return q.uncaptured(wanted, t.captures, AS_OF, 8000)


@query(check(("captures",), f"""
    SELECT fqdn, {moment_sql("max(captured_at)")} AS last_captured FROM captures
    WHERE vantage = 'home' AND captured_at > {AS_OF_SQL} - INTERVAL 4000 HOUR
      AND fqdn NOT IN (SELECT fqdn FROM captures WHERE vantage = 'cloud-north'
                       AND captured_at > {AS_OF_SQL} - INTERVAL 4000 HOUR)
    GROUP BY fqdn ORDER BY max(captured_at) DESC, fqdn LIMIT 100"""))
def same_site_targets(t: Tables) -> DataFrame:
    ours = t.captures.where("vantage = 'cloud-north'")
    targets = q.same_site_targets(t.captures, ours, AS_OF, 4000, "home", 100)
    return targets.withColumn("last_captured", moment("last_captured"))


@query(check(("captures", "labelled"), """
    SELECT fqdn, arg_min_null(brand, line_no) AS brand, max(line_no) AS line_no FROM (
        SELECT fqdn, brand, c_custkey AS line_no, DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) AS labelled_at FROM labelled
        UNION ALL SELECT fqdn, 'again', c_custkey + 3, DATE '2024-01-30' FROM labelled WHERE c_custkey % 6 = 0) e
    WHERE labelled_at >= DATE '2024-01-21'
      AND fqdn NOT IN (SELECT fqdn FROM captures WHERE vantage = 'home')
    GROUP BY fqdn ORDER BY max(line_no) DESC, fqdn LIMIT 50"""))
def fresh_feed_targets(t: Tables) -> DataFrame:
    listed = F.expr("date_add(DATE '2024-01-01', CAST(c_custkey % 40 AS INT))")
    entries = t.labelled.select(
        "fqdn", "brand", listed.alias("labelled_at"), F.col("c_custkey").alias("line_no")
    )
    again = t.labelled.where("c_custkey % 6 = 0").select(
        "fqdn", F.lit("again"), F.lit("2024-01-30").cast("date"), F.col("c_custkey") + 3
    )
    entries = entries.union(again)
    today = F.lit("2024-01-31").cast("date")
    done = t.captures.where("vantage = 'home'")
    return q.fresh_feed_targets(entries, done, today, 10, 50).select("fqdn", "brand", "line_no")


_LEFT = "SELECT backend, model, count(*) AS verdicts, CAST(sum(verdict_id) AS BIGINT) AS ids FROM ({}) GROUP BY backend, model"


def _left(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("backend", "model").agg(
        F.count("*").alias("verdicts"), F.sum("verdict_id").alias("ids")
    )


@query(check(("verdicts",), _LEFT.format("""
    SELECT * FROM verdicts WHERE verdict_id NOT IN (
        SELECT verdict_id FROM verdicts WHERE backend = 'vision' AND model = 'small'
        ORDER BY verdict_id DESC LIMIT 700)""")))
def verdict_reset(t: Tables) -> DataFrame:
    return _left(q.without_newest(t.verdicts, "vision", "small", 700))


@query(check(("verdicts",), _LEFT.format(
    "SELECT * FROM verdicts WHERE NOT coalesce(backend = 'vision' AND model = 'small', false)")))
def verdict_reset_all(t: Tables) -> DataFrame:
    return _left(q.without_newest(t.verdicts, "vision", "small"))


@query(check(("verdicts",), _LEFT.format(
    "SELECT * FROM verdicts WHERE NOT (backend = 'replay' AND label = 'error')")))
def failed_reset(t: Tables) -> DataFrame:
    return _left(q.without_failed(t.verdicts, "replay"))


@query(check(("verdicts",), """
    SELECT n.verdict_id, n.capture_id, n.backend, n.model FROM verdicts n
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM verdicts WHERE label = 'parked') s
                      WHERE s.capture_id = n.capture_id AND s.backend = n.backend
                        AND s.model IS NOT DISTINCT FROM n.model)"""))
def verdict_insert(t: Tables) -> DataFrame:
    stored = t.verdicts.where("label = 'parked'")
    fresh = absent(t.verdicts, stored, ("capture_id", "backend", "model"))
    return fresh.select("verdict_id", "capture_id", "backend", "model")


@query(check(("matches", "captures"), """
    SELECT fqdn, 'alerts' AS source, b.brand, 'alerted at score ' || printf('%.2f', b.score)
           || '; label from the screenshot' AS note
    FROM (SELECT fqdn, max(captured_at) AS last_at FROM captures WHERE status = 'ok' GROUP BY fqdn) c
    JOIN best b USING (fqdn) ORDER BY last_at DESC, fqdn LIMIT 25""",
    BEST.replace("FROM matches", "FROM matches WHERE is_alert")))
def candidates_from_alerts(t: Tables) -> DataFrame:
    candidates = labelling.candidates_from_alerts(t.captures, t.matches, 25)
    return candidates.select("fqdn", "source", "brand", "note")


_SNAPSHOT = ("matches", "captures", "verdicts")


@query(check(_SNAPSHOT, " UNION ALL ".join(f"""
    SELECT '{name}' AS tbl, count(*) AS rows, count(DISTINCT {key}) AS keys, CAST(min({key}) AS VARCHAR) AS first, CAST(max({key}) AS VARCHAR) AS last
    FROM {name}""" for name, key in zip(_SNAPSHOT, ("fqdn", "capture_id", "verdict_id"), strict=True))))
def snapshot_export(t: Tables) -> DataFrame:
    """The stored tables exported as one snapshot and read back with their schemas."""
    folder = f"{shared_folder(t.spark)}/run-{uuid4().hex}"
    tables = {"matches": t.matches, "captures": t.captures, "verdicts": t.verdicts}
    export_snapshot(tables, folder)
    parts = []
    for (name, df), key in zip(tables.items(), ("fqdn", "capture_id", "verdict_id"), strict=True):
        back = t.spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        parts.append(back.agg(
            F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"),
            F.min(key).cast("string").alias("first"), F.max(key).cast("string").alias("last"),
        ))
    return parts[0].union(parts[1]).union(parts[2])
