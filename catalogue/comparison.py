"""Two vantage points, feed detection, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import check, moment, moment_sql, query
from catalogue.scoring_sql import ratio
from mimicry.operators.pairing import closest_pairs
from mimicry.plans import comparison as c
from mimicry.staging import Tables
from mimicry.streaming import monitors as mon

_GAP = 240.0  # hours; the staged captures are days apart

_SIDES = [
    """side_verdicts AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY classified_at DESC, verdict_id DESC) AS rn
                       FROM verdicts WHERE label <> 'error') v WHERE rn = 1)""",
    """sides AS (
        SELECT c.*, v.label AS verdict,
               lower(regexp_extract(final_url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS final_host,
               coalesce(has_signals AND (has_password_input OR has_credential_field) AND form_count > 0, false) AS login,
               CASE WHEN has_signals THEN lower(trim(regexp_replace(title, '[ ]+', ' ', 'g'))) ELSE '' END AS norm_title
        FROM captures c LEFT JOIN side_verdicts v USING (capture_id))""",
    """closest AS (
        SELECT * FROM (
            SELECT a.fqdn, a.capture_id AS first_id, b.capture_id AS second_id,
                   abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) AS gap_us,
                   row_number() OVER (PARTITION BY a.fqdn ORDER BY abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)),
                                      a.capture_id, b.capture_id) AS rn
            FROM sides a JOIN sides b ON a.fqdn = b.fqdn AND a.vantage = 'home' AND b.vantage = 'cloud-north') p
        WHERE rn = 1)""",
    f"""states AS (
        SELECT fqdn, first_id, second_id, gap_us,
               CASE WHEN NOT bool_or_first THEN 'only second' WHEN NOT bool_or_second THEN 'only first'
                    WHEN gap_us > {int(_GAP * 3600)}::BIGINT * 1000000 THEN 'too far apart' ELSE 'pair' END AS state
        FROM (SELECT fqdn, bool_or(vantage = 'home') AS bool_or_first, bool_or(vantage = 'cloud-north') AS bool_or_second
              FROM sides WHERE vantage IS NOT NULL GROUP BY fqdn) s LEFT JOIN closest USING (fqdn))""",
    """diffs AS (
        SELECT s.fqdn, state, first_id, second_id, s.gap_us,
               coalesce((a.status = 'ok') <> (b.status = 'ok'), false) AS one_down,
               concat_ws(',', CASE WHEN a.status = 'ok' AND b.status = 'ok' AND a.http_status <> b.http_status THEN 'http status' END,
                              CASE WHEN a.status = 'ok' AND b.status = 'ok' AND a.final_host <> b.final_host THEN 'final site' END,
                              CASE WHEN a.status = 'ok' AND b.status = 'ok' AND a.login <> b.login THEN 'login form' END,
                              CASE WHEN a.status = 'ok' AND b.status = 'ok' AND a.norm_title <> b.norm_title THEN 'title' END) AS content,
               coalesce(a.verdict <> b.verdict, false) AS other_verdict
        FROM states s LEFT JOIN sides a ON state = 'pair' AND a.capture_id = first_id
                      LEFT JOIN sides b ON state = 'pair' AND b.capture_id = second_id)""",
]


def _compared(t: Tables) -> DataFrame:
    sides = c.load_sides(t.captures, t.verdicts, "home", "cloud-north")
    return c.compare_captures(sides, _GAP)


@query(check(("captures", "verdicts"), "SELECT fqdn, first_id, second_id, gap_us FROM closest", *_SIDES))
def nearest_pair(t: Tables) -> DataFrame:
    keys = ("fqdn", "capture_id", "captured_at")
    return closest_pairs(
        t.captures.where("vantage = 'home'").select(*keys),
        t.captures.where("vantage = 'cloud-north'").select(*keys),
    )


@query(check(("captures", "verdicts"), """
    SELECT fqdn, state, first_id, second_id, gap_us, one_down AS unreachable_on_one_side,
           content AS content_differences, other_verdict AS different_verdict,
           one_down OR content <> '' OR other_verdict AS differs FROM diffs""", *_SIDES))
def vantage_comparison(t: Tables) -> DataFrame:
    down, other = F.col("unreachable_on_one_side"), F.col("different_verdict")
    return _compared(t).select(
        "fqdn", "state", "first_id", "second_id", "gap_us",
        F.coalesce(down, F.lit(False)).alias("unreachable_on_one_side"),
        F.coalesce(F.array_join("content_differences", ","), F.lit("")).alias("content_differences"),
        F.coalesce(other, F.lit(False)).alias("different_verdict"), "differs",
    )


@query(check(("captures", "verdicts"), """
    SELECT count(*) FILTER (WHERE state = 'pair') AS pairs,
           count(*) FILTER (WHERE state = 'too far apart') AS too_far_apart,
           count(*) FILTER (WHERE state = 'only first') AS only_first,
           count(*) FILTER (WHERE state = 'only second') AS only_second,
           count(*) FILTER (WHERE one_down) AS unreachable_on_one_side,
           count(*) FILTER (WHERE content <> '') AS different_content,
           count(*) FILTER (WHERE other_verdict) AS different_verdict,
           count(*) FILTER (WHERE one_down OR content <> '' OR other_verdict) AS differing FROM diffs""", *_SIDES))
def cloaking_rollup(t: Tables) -> DataFrame:
    return c.comparison_summary(_compared(t))


_ENTRIES = """entries AS (
    SELECT fqdn, DATE '2023-12-28' + CAST(c_custkey % 40 AS INTEGER) AS labelled_at FROM labelled
    UNION ALL SELECT 'other.' || fqdn, DATE '2024-01-02' + CAST(c_custkey % 30 AS INTEGER) FROM labelled)"""
_DETECTED = [
    _ENTRIES,
    """listed AS (SELECT fqdn, min(labelled_at) AS listed_on, ends_with(fqdn, '.github.io') AS shared,
                  coalesce(nullif(regexp_extract(fqdn, '([^.]+[.](co[.]uk|[a-z]+))$', 1), ''), fqdn) AS registered
           FROM entries GROUP BY fqdn)""",
    """detected AS (
        SELECT l.fqdn, listed_on, shared, bool_or(is_alert) AS alerted,
               coalesce(min(first_seen_at) FILTER (WHERE is_alert), min(first_seen_at)) AS flagged,
               coalesce(listed_on >= (SELECT CAST(min(first_seen_at) AS DATE) FROM matches), false) AS monitored
        FROM listed l LEFT JOIN matches m ON m.fqdn = l.fqdn OR (NOT shared AND m.registered_domain = registered)
        GROUP BY l.fqdn, listed_on, shared)""",
    """outcomes AS (
        SELECT fqdn, listed_on, shared,
               CASE WHEN NOT monitored THEN NULL WHEN alerted THEN 'alerted' WHEN NOT alerted THEN 'matched'
                    WHEN shared THEN 'out of reach' ELSE 'not seen' END AS outcome,
               CASE WHEN monitored THEN flagged END AS flagged,
               CASE WHEN NOT monitored OR flagged IS NULL THEN NULL
                    WHEN CAST(flagged AS DATE) < listed_on THEN 'before the listing day'
                    WHEN CAST(flagged AS DATE) = listed_on THEN 'on the listing day'
                    ELSE 'after the listing day' END AS timing FROM detected)""",
]


def _detected(t: Tables) -> DataFrame:
    own = t.labelled.select(
        "fqdn", F.expr("date_add(DATE '2023-12-28', CAST(c_custkey % 40 AS INT))").alias("labelled_at")
    )
    other = t.labelled.select(
        F.concat(F.lit("other."), "fqdn").alias("fqdn"),
        F.expr("date_add(DATE '2024-01-02', CAST(c_custkey % 30 AS INT))").alias("labelled_at"),
    )
    return c.feed_detection(own.unionByName(other), t.matches)


@query(check(("labelled", "matches"), f"""
    SELECT fqdn, CAST(listed_on AS STRING) AS listed_on, shared AS shared_platform, outcome,
           {moment_sql("flagged")} AS first_flagged, timing FROM outcomes""", *_DETECTED))
def feed_detection(t: Tables) -> DataFrame:
    return _detected(t).withColumns(
        {"listed_on": F.col("listed_on").cast("string"), "first_flagged": moment("first_flagged")}
    )


_COUNTS = """counts AS (
    SELECT count(*) FILTER (WHERE outcome IS NULL) AS listed_before_monitoring, count(outcome) AS sites,
           count(*) FILTER (WHERE outcome = 'out of reach') AS out_of_reach,
           count(*) FILTER (WHERE outcome <> 'out of reach') AS in_reach,
           count(*) FILTER (WHERE outcome = 'alerted') AS alerted,
           count(*) FILTER (WHERE outcome = 'matched') AS matched,
           count(*) FILTER (WHERE outcome = 'not seen') AS not_seen,
           count(*) FILTER (WHERE outcome = 'alerted' AND timing = 'before the listing day') AS alerted_before,
           count(*) FILTER (WHERE outcome = 'alerted' AND timing = 'on the listing day') AS alerted_same_day,
           count(*) FILTER (WHERE outcome = 'alerted' AND timing = 'after the listing day') AS alerted_after
    FROM outcomes)"""


@query(check(("labelled", "matches"), f"""
    SELECT *, {ratio("alerted", "in_reach", 3)} AS alerted_share, {ratio("matched", "in_reach", 3)} AS matched_share,
           {ratio("not_seen", "in_reach", 3)} AS not_seen_share FROM counts""", *_DETECTED, _COUNTS))
def detection_summary(t: Tables) -> DataFrame:
    return c.detection_summary(_detected(t))


# -------------------------------------------------------------------- monitors


def _events(t: Tables) -> DataFrame:
    return t.base("events").withColumn("at", F.col("ts").cast("timestamp"))


def _bucket(minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2000-01-01')"


@query(f"""
    WITH seen AS (SELECT DISTINCT {_bucket(10)} AS w FROM events WHERE event_type = 'error'),
         bounds AS (SELECT min({_bucket(10)}) AS a, max({_bucket(10)}) AS b FROM events)
    SELECT {moment_sql("w")} AS window_start
    FROM (SELECT unnest(generate_series(a, b, INTERVAL 10 MINUTE)) AS w FROM bounds) g
    WHERE w NOT IN (SELECT w FROM seen)""")
def silence_windows(t: Tables) -> DataFrame:
    counts = mon.event_counts(_events(t).where("event_type = 'error'"))
    every = mon.event_counts(_events(t))
    silent = mon.silent_windows(counts, F.min("window_start"), F.max("window_start"), period=every)
    return silent.select(moment("window_start").alias("window_start"))


@query(f"""
    SELECT {moment_sql(_bucket(30))} AS window_start, count(*) FILTER (WHERE event_type = 'error') AS failures
    FROM events GROUP BY {_bucket(30)} HAVING count(*) FILTER (WHERE event_type = 'error') >= 3""")
def failure_windows(t: Tables) -> DataFrame:
    cycles = _events(t).withColumn("failed", F.col("event_type") == "error")
    return mon.failure_windows(cycles).withColumn("window_start", moment("window_start"))


@query(f"""
    WITH means AS (SELECT {_bucket(30)} AS w, avg(value) AS mean FROM events GROUP BY 1)
    SELECT {moment_sql("w")} AS window_start FROM (
        SELECT w, mean, lag(w, 1) OVER o AS w1, lag(mean, 1) OVER o AS m1,
               lag(w, 2) OVER o AS w2, lag(mean, 2) OVER o AS m2 FROM means WINDOW o AS (ORDER BY w)) x
    WHERE mean > 40 AND m1 > 40 AND m2 > 40 AND w1 = w - INTERVAL 30 MINUTE AND w2 = w - INTERVAL 60 MINUTE""")
def level_windows(t: Tables) -> DataFrame:
    """Three half-hour means in a row above 40 (the staged events are too sparse for 5 minutes)."""
    means = mon.level_means(_events(t), level="value", width="30 minutes")
    high = mon.sustained_levels(means, 40.0, 3, "30 minutes")
    return high.select(moment("window_start").alias("window_start"))
