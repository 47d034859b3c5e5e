"""Pages, verdicts, imports, notifications and text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogue.queues import BEST
from catalogue.registry import check, moment, moment_sql, query
from catalogue.scoring_sql import rounded
from mimicry.functions import hostnames as h
from mimicry.functions.text import chat_safe, clean_text, defang
from mimicry.operators import queues as q
from mimicry.operators import verdicts as v
from mimicry.operators.signals import has_login_form, page_signals
from mimicry.plans import triage as tr
from mimicry.sources.results import bound_results
from mimicry.sources.sinks import normalise_paths, notification_lines
from mimicry.session import computed_once
from mimicry.staging import Tables


def _now() -> Column:
    return F.lit(datetime(2024, 2, 1))

_HOST = "regexp_extract(url, 'https://([^/]+)/', 1)"
_OWN = f"""own AS (
    SELECT *, {_HOST} AS host, coalesce(nullif(regexp_extract({_HOST}, '([^.]+[.](co[.]uk|[a-z]+))$', 1), ''), '') AS page_domain,
           page_id % 6 AS kind FROM archive)"""
_SIGNALS = [
    _OWN,
    """targets AS (
        SELECT *, CASE kind WHEN 0 THEN ['evil.co.uk']
                            WHEN 2 THEN list_filter([coalesce(nullif(page_domain, ''), 'login.' || host), 'example.org'],
                                                    lambda d: d <> page_domain)
                            ELSE [] END AS targets FROM own)""",
    """signals AS (
        SELECT page_id, url, host, targets, page_domain, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS form_count,
               CASE kind WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS password_input_count,
               kind IN (1, 2) AS has_credential_field, CASE kind WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS iframe_count,
               nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') AS title
        FROM targets)""",
]


@query(check(("archive",), """
    SELECT page_id, title, form_count, password_input_count, has_credential_field, iframe_count,
           array_to_string(targets, ',') AS targets,
           (password_input_count > 0 OR has_credential_field) AND form_count > 0 AS has_login_form
    FROM signals""", *_SIGNALS))
def page_signals_archive(t: Tables) -> DataFrame:
    s = F.col("signals")
    return page_signals(t.archive).select(
        "page_id", s["title"].alias("title"), s["form_count"].alias("form_count"),
        s["password_input_count"].alias("password_input_count"),
        s["has_credential_field"].alias("has_credential_field"),
        s["iframe_count"].alias("iframe_count"),
        F.array_join(s["cross_domain_form_targets"], ",").alias("targets"), "has_login_form",
    )


_RULES = """ruled AS (
    SELECT capture_id, fqdn, CASE
        WHEN status <> 'ok' THEN ['unreachable', '1.0', '', 'Capture failed with status ' || status || '.']
        WHEN screenshot_path IS NULL THEN ['unknown', '0.0', '', 'Screenshot file is missing; cannot classify.']
        WHEN NOT has_signals THEN ['unknown', '0.3', '', 'No DOM signals available.']
        WHEN (has_password_input OR has_credential_field) AND form_count > 0 THEN
            ['phishing', CASE WHEN posts_away THEN '0.8' ELSE '0.6' END, coalesce(b.brand, 'unknown'),
             'Login form on ' || fqdn || CASE WHEN posts_away THEN ', posting to evil.example.net' ELSE '' END || '.']
        WHEN form_count = 0 AND title = '' THEN ['parked', '0.5', '', 'No forms and no page title.']
        ELSE ['unknown', '0.4', '', 'No login form detected; a screenshot is needed to decide.'] END AS r
    FROM captures c LEFT JOIN best b USING (fqdn))"""


@query(check(("captures", "matches"), """
    SELECT capture_id, fqdn, 'stub' AS backend, NULL::VARCHAR AS model, r[1] AS label, CAST(r[2] AS DOUBLE) AS confidence,
           nullif(r[3], '') AS brand_impersonated, r[4] AS evidence FROM ruled""", BEST, _RULES))
def rule_verdicts(t: Tables) -> DataFrame:
    best = q.best_per_host(t.matches).select("fqdn", F.col("brand").alias("suspected_brand"))
    queue = t.captures.join(best, "fqdn", "left").withColumn(
        "suspected_brand", F.coalesce("suspected_brand", F.lit("unknown"))
    )
    rows = tr.classify_by_rules(queue, _now())
    return rows.select(
        "capture_id", "fqdn", "backend", "model", "label", "confidence", "brand_impersonated", "evidence"
    )


_PAYLOAD = """'{"label": "' || CASE WHEN label = 'error' THEN 'malware' ELSE label END || '", "confidence": '
    || CASE WHEN verdict_id % 50 = 9 THEN '1.7' ELSE CAST(CAST(round(confidence * 100) AS BIGINT) AS STRING) || 'e-2' END
    || ', "brand_impersonated": ' || coalesce('"' || brand_impersonated || '"', 'null')
    || ', "evidence": ' || CASE WHEN evidence IS NULL THEN '7' ELSE '"' || evidence || '"' END || '}'"""
_REPLY = """CASE verdict_id % 7
    WHEN 0 THEN payload
    WHEN 1 THEN repeat(chr(96), 3) || 'json' || chr(10) || payload || chr(10) || repeat(chr(96), 3)
    WHEN 2 THEN 'Sure, here it is: ' || payload || ' Anything else?'
    WHEN 3 THEN 'I cannot judge this page.'
    WHEN 4 THEN substr(payload, 1, length(payload) - 3) || '}'
    ELSE '  ' || payload || chr(10) END"""
_REPLIES = f"replies AS (SELECT *, {_REPLY} AS reply FROM (SELECT *, {_PAYLOAD} AS payload FROM verdicts) p)"
_JUDGED = """judged AS (
    SELECT *, CASE WHEN verdict_id % 7 = 3 THEN 'no JSON object in model output: ' || left(reply, 200)
                   WHEN verdict_id % 7 = 4 AND evidence IS NOT NULL THEN 'invalid JSON in model output: ' || left(reply, 200)
                   WHEN verdict_id % 7 = 4 THEN 'invalid JSON in model output: ' || left(reply, 200)
                   WHEN label = 'error' THEN 'model output does not match the verdict schema: label'
                   WHEN verdict_id % 50 = 9 THEN 'model output does not match the verdict schema: confidence'
                   WHEN evidence IS NULL THEN 'model output does not match the verdict schema: evidence' END AS error
    FROM replies)"""


def _replies(t: Tables) -> DataFrame:
    told = t.verdicts.selectExpr("*", f"{_PAYLOAD} AS payload")
    return computed_once(told.selectExpr("*", f"{_REPLY} AS reply"), reply=F.col("reply"))


@query(check(("verdicts",), f"""
    SELECT verdict_id, error, CASE WHEN error IS NULL THEN label END AS label,
           CASE WHEN error IS NULL THEN {rounded("confidence", 2)} END AS confidence,
           CASE WHEN error IS NULL THEN nullif(brand_impersonated, '') END AS brand_impersonated,
           CASE WHEN error IS NULL THEN evidence END AS evidence FROM judged""", _REPLIES, _JUDGED))
def reply_parse(t: Tables) -> DataFrame:
    replies = _replies(t).select("verdict_id", "reply")
    return v.parse_replies(replies).select("verdict_id", "error", "verdict.*")


@query(check(("verdicts", "captures"), f"""
    SELECT c.capture_id, CASE WHEN status <> 'ok' THEN 'unreachable' WHEN screenshot_path IS NULL THEN 'unknown'
                              WHEN j.error IS NOT NULL THEN 'error' ELSE j.label END AS label,
           CASE WHEN status = 'ok' AND screenshot_path IS NOT NULL AND j.error IS NULL
                THEN {rounded("prompt_tokens / 1000 * 0.02 + coalesce(completion_tokens, 0) / 1000 * 0.06", 6)} END AS cost_usd
    FROM captures c LEFT JOIN (SELECT * FROM judged WHERE backend = 'vision' AND model = 'medium') j USING (capture_id)
    WHERE status <> 'ok' OR screenshot_path IS NULL OR j.verdict_id IS NOT NULL""", _REPLIES, _JUDGED))
def reply_verdicts(t: Tables) -> DataFrame:
    replies = _replies(t).where("backend = 'vision' AND model = 'medium'").select(
        "capture_id", "reply", "latency_ms", "prompt_tokens", "completion_tokens"
    )
    queue = t.captures.withColumn("suspected_brand", F.lit("unknown"))
    rows = tr.classify_by_replies(queue, replies, "vision", "medium", _now(), 0.02, 0.06)
    return rows.select("capture_id", "label", "cost_usd")


@query(check(("captures",), """
    SELECT capture_id, f || chr(10) || 'Domain visited: ' || fqdn || chr(10) || 'Brand the domain resembles: paypal' || chr(10)
           || 'Final URL after redirects: ' || coalesce(final_url, 'unknown') || chr(10)
           || CASE WHEN has_signals THEN 'Page title: ' || coalesce(nullif(title, ''), '(none)') || chr(10) || 'Forms: ' || form_count || chr(10)
              || 'Password inputs: ' || CASE WHEN has_password_input THEN 1 ELSE 0 END || chr(10)
              || 'Credential-like field present: ' || CASE WHEN has_credential_field THEN 'True' ELSE 'False' END || chr(10)
              || 'Forms posting to another domain: ' || CASE WHEN posts_away THEN '[''evil.example.net'']' ELSE 'none' END || chr(10)
              || 'Iframes: 0' || chr(10) ELSE '' END || f AS prompt
    FROM captures, (SELECT '-----PAGE CONTEXT (untrusted data)-----' AS f)"""))
def prompt_text(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in ("fqdn", "final_url", "signals")]
    built = v.prompt(columns[0], F.lit("paypal"), columns[1], columns[2])
    return t.captures.select("capture_id", built.alias("prompt"))


# ------------------------------------------------------------------- imports

_LINE = """
    SELECT capture_id AS line_no, fqdn, status, CASE capture_id % 12
        WHEN 0 THEN 'garbage ' || fqdn
        WHEN 1 THEN '{{"fqdn": "' || fqdn || '", "url": "' || url || '", "status": "' || status || '"}}'
        WHEN 2 THEN '{{"fqdn": "' || fqdn || '", "url": "' || url || '", "status": "gone", "captured_at": "2024-01-01T00:00:00Z", "duration_ms": -5, "extra": 1}}'
        WHEN 3 THEN '{{"fqdn": "' || fqdn || '", "url": "https://elsewhere.example.org/", "status": "' || status || '", "captured_at": "2024-01-01T00:00:00Z", "duration_ms": 5}}'
        ELSE '{{"fqdn": "' || fqdn || '", "url": "' || url || '", "status": "' || status || '", "captured_at": "2024-01-01T10:00:00+02:00", "duration_ms": '
             || CAST(duration_ms AS STRING) || ', "http_status": ' || coalesce(CAST(http_status AS STRING), 'null')
             || coalesce(', "screenshot_path": "' || screenshot_path || '"', '') || '}}' END AS value
    FROM {captures}"""
_LINES = "lines AS (" + _LINE.format(captures="captures") + ")"
_IMPORT = [
    _LINES,
    "jobs AS (SELECT fqdn FROM labelled WHERE source <> 'feed')",
    """valid AS (
        SELECT l.*, c.screenshot_path, c.duration_ms, CASE l.line_no % 12
                   WHEN 0 THEN '1 invalid field(s)' WHEN 1 THEN '2 invalid field(s)' WHEN 2 THEN '3 invalid field(s)' END AS bad
        FROM lines l JOIN captures c ON c.capture_id = l.line_no)""",
    """refused AS (
        SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN fqdn NOT IN (SELECT fqdn FROM jobs) THEN 'hostname the job did not ask for'
                       WHEN line_no % 12 = 3 THEN 'URL is not one this hostname would be visited at'
                       WHEN status = 'ok' AND screenshot_path IS NULL THEN 'screenshot missing or outside the capture directory' END AS own_reason
        FROM valid)""",
    "accepted AS (SELECT fqdn, min(line_no) AS first_line FROM refused WHERE own_reason IS NULL GROUP BY fqdn)",
    """reasons AS (
        SELECT line_no, r.fqdn, status, duration_ms, CASE WHEN bad IS NULL AND line_no > first_line THEN 'second result for the same hostname'
                             ELSE own_reason END AS reject_reason
        FROM refused r LEFT JOIN accepted a USING (fqdn))""",
]


def _import(t: Tables) -> tr.ImportedResults:
    lines = t.spark.sql(_LINE, captures=t.captures).select("line_no", "value")
    lines = computed_once(lines, value=F.col("value"))
    jobs = t.labelled.where("source <> 'feed'").select("fqdn")
    return tr.import_results(lines, jobs, _now(), "home")


@query(check(("captures", "labelled"), "SELECT line_no, reject_reason FROM reasons WHERE reject_reason IS NOT NULL", *_IMPORT))
def import_rejected(t: Tables) -> DataFrame:
    return _import(t).rejected


@query(check(("captures", "labelled"), """
    SELECT fqdn, status, duration_ms, '2024-01-01 08:00:00' AS captured_at, NULL::VARCHAR AS error, 'home' AS vantage
    FROM reasons WHERE reject_reason IS NULL
    UNION ALL
    SELECT fqdn, 'error', 0, '2024-02-01 00:00:00', 'no valid result from the capture container', 'home'
    FROM jobs WHERE fqdn NOT IN (SELECT fqdn FROM accepted)""", *_IMPORT))
def import_captures(t: Tables) -> DataFrame:
    return _import(t).captures.select(
        "fqdn", "status", "duration_ms", moment("captured_at").alias("captured_at"), "error", "vantage"
    )


@query(check(("captures", "labelled"), """
    SELECT status, count(*) AS captures FROM (
        SELECT status FROM reasons WHERE reject_reason IS NULL
        UNION ALL SELECT 'error' FROM jobs WHERE fqdn NOT IN (SELECT fqdn FROM accepted)) s GROUP BY status""", *_IMPORT))
def import_statuses(t: Tables) -> DataFrame:
    return tr.status_counts(_import(t).captures)


@query(check(("captures",), """
    SELECT capture_id, CASE WHEN code BETWEEN 100 AND 599 THEN code END AS http_status,
           CASE WHEN code NOT BETWEEN 100 AND 599 THEN 'non-standard HTTP status ' || code || '; slow' ELSE 'slow' END AS error,
           left(url || repeat('x', 3000), 2100) AS final_url, CASE WHEN has_signals THEN least(form_count * 9000, 10000) END AS form_count,
           'a/' || capture_id || '/b.png' AS screenshot_path
    FROM (SELECT *, CAST(capture_id % 700 AS INTEGER) AS code FROM captures) c"""))
def result_bounds(t: Tables) -> DataFrame:
    wide = t.captures.withColumns({
        "http_status": (F.col("capture_id") % 700).cast("int"),
        "error": F.lit("slow"),
        "final_url": F.concat("url", F.repeat(F.lit("x"), 3000)),
        "screenshot_path": F.concat(F.lit("a\\"), "capture_id", F.lit("\\b.png")),
        "signals": F.col("signals").withField("form_count", F.col("signals.form_count") * 9000),
    })
    bounded = bound_results(normalise_paths(wide, None))
    return bounded.select("capture_id", "http_status", "error", "final_url",
                          F.col("signals.form_count").alias("form_count"), "screenshot_path")


_ATTEMPTS = """
    SELECT capture_id AS visit, fqdn, a AS attempt, CASE a WHEN 0 THEN 'https://' ELSE 'http://' END || fqdn || '/' AS url,
           CASE WHEN a = 0 AND (status = 'dns_error' OR capture_id % 3 = 0) THEN CASE WHEN status = 'ok' THEN 'timeout' ELSE status END
                ELSE status END AS status,
           CASE WHEN status <> 'ok' AND capture_id % 2 = 0 THEN 'net failure ' || CAST(a AS STRING) END AS error
    FROM {captures} CROSS JOIN (SELECT 0 AS a UNION ALL SELECT 1) two"""


@query(check(("captures",), """
    SELECT visit, fqdn, CASE WHEN ok_at IS NOT NULL THEN ok_url ELSE last_url END AS url,
           CASE WHEN ok_at IS NOT NULL THEN 'ok' ELSE last_status END AS status,
           CASE WHEN ok_at IS NOT NULL THEN NULL WHEN n > 1 THEN left(told, 500) ELSE last_error END AS error
    FROM (SELECT visit, fqdn, min(attempt) FILTER (WHERE status = 'ok') AS ok_at, count(*) AS n,
                 arg_min(url, attempt) FILTER (WHERE status = 'ok') AS ok_url, arg_max(url, attempt) AS last_url,
                 arg_max(status, attempt) AS last_status, arg_max_null(error, attempt) AS last_error,
                 string_agg(url || ': ' || coalesce(error, status), ' | ' ORDER BY attempt) AS told
          FROM (SELECT * FROM attempts a WHERE NOT EXISTS (SELECT 1 FROM attempts d WHERE d.visit = a.visit
                    AND d.status = 'dns_error' AND d.attempt < a.attempt)) k GROUP BY visit, fqdn) v""",
    "attempts AS (" + _ATTEMPTS.format(captures="captures") + ")"))
def attempt_folding(t: Tables) -> DataFrame:
    attempts = t.spark.sql(_ATTEMPTS.replace("CROSS JOIN (SELECT 0 AS a UNION ALL SELECT 1) two",
                                             "LATERAL VIEW explode(array(0, 1)) two AS a"),
                           captures=t.captures)
    return v.fold_attempts(attempts).select("visit", "fqdn", "url", "status", "error")


@query(check(("captures",), """
    SELECT capture_id, CASE WHEN status = 'dns_error' THEN 'dns_error' WHEN status IN ('connection_error', 'timeout') THEN 'connection_error'
                            ELSE 'error' END AS mapped FROM captures WHERE status <> 'ok'"""))
def error_status(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("status") == "dns_error", "Page.goto: net::ERR_NAME_NOT_RESOLVED at https://x/")
        .when(F.col("status") == "connection_error", "net::ERR_CERT_DATE_INVALID")
        .when(F.col("status") == "timeout", "net::ERR_CONNECTION_TIMED_OUT")
        .otherwise("something else")
    )
    failed = t.captures.where("status <> 'ok'")
    return failed.select("capture_id", v.error_status(text).alias("mapped"))


# ---------------------------------------------------------------- notifications


def _safe(value: str, limit: int | None = 500) -> str:
    plain = f"regexp_replace({value}, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g')"
    plain = plain if limit is None else f"left({plain}, {limit})"
    text = f"replace(replace({plain}, 'http://', 'hxxp://'), 'https://', 'hxxps://')"
    # No look-around in this engine: the dot is guarded by its captured neighbours, twice
    # because neighbouring matches may share one.
    for _ in range(2):
        text = f"regexp_replace({text}, '([A-Za-z0-9-])[.]([A-Za-z])', '\\1[.]\\2', 'g')"
    return f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '@', '@' || chr(8203))"


_DUE = f"""due AS (
    SELECT verdict_id, v.fqdn, label, confidence, b.score, brand_impersonated AS brand, evidence, final_url, screenshot_path, classified_at
    FROM verdicts v JOIN captures USING (capture_id) JOIN best b ON b.fqdn = v.fqdn
    WHERE NOT already_alerted AND label IN ('phishing', 'parked') AND confidence >= 0.3)"""


DUE = _DUE


def _due(t: Tables) -> DataFrame:
    return q.pending_alerts(
        t.verdicts, t.captures, t.matches, ("phishing", "parked"), 0.3, None
    )


@query(check(("matches", "captures", "verdicts"), f"""
    SELECT verdict_id, '[' || label || '] ' || {_safe("fqdn", 253)} || ' (brand: ' || coalesce(brand, 'unknown') || ', confidence '
           || printf('%.2f', confidence) || ', score ' || printf('%.2f', score) || ')' || chr(10) || 'evidence: ' || {_safe("coalesce(evidence, '')")}
           || coalesce(chr(10) || 'final URL: ' || {_safe("final_url")}, '')
           || coalesce(chr(10) || 'screenshot: ' || {_safe("screenshot_path", 300)}, '') AS message FROM due""", BEST, _DUE))
def notification_text(t: Tables) -> DataFrame:
    due = _due(t)
    return due.select("verdict_id", tr.notification_text(due).alias("message"))


@query(check(("matches", "captures", "verdicts"), f"""
    SELECT fqdn, coalesce(brand, 'unknown') AS brand, label, confidence, score, coalesce(evidence, '') AS evidence,
           screenshot_path AS screenshot, final_url, strftime(classified_at, '%Y-%m-%dT%H:%M:%S.000000Z') AS detected_at
    FROM due""", BEST, _DUE))
def notification_fields(t: Tables) -> DataFrame:
    return notification_lines(_due(t))


@query("""
    SELECT doc_id, left(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), 300) AS cleaned FROM documents""")
def clean_texts(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(f"""
    SELECT doc_id, {_safe("text", None)} AS safe FROM documents""")
def chat_safe_texts(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", chat_safe(F.col("text"), None).alias("safe"))


@query("""
    SELECT page_id, replace(replace(replace(left(url, 500), 'http://', 'hxxp://'), 'https://', 'hxxps://'), '.', '[.]') AS defanged
    FROM pages""")
def defang_urls(t: Tables) -> DataFrame:
    return t.base("pages").select("page_id", defang(F.col("url")).alias("defanged"))


# ---------------------------------------------------------------- URL policy

_URLS = """
    SELECT page_id, CASE page_id % 10
        WHEN 0 THEN 'http://10.' || CAST(page_id % 256 AS STRING) || '.0.1/x'
        WHEN 1 THEN 'https://172.' || CAST(page_id % 40 AS STRING) || '.5.5/'
        WHEN 2 THEN 'javascript:alert(1)'
        WHEN 3 THEN 'file:///etc/passwd'
        WHEN 4 THEN 'wss://169.254.169.254:80/meta'
        WHEN 5 THEN 'https:///path'
        WHEN 6 THEN 'http://[::1]:8080/'
        WHEN 7 THEN 'http://' || CAST(192 + page_id % 60 AS STRING) || '.168.1.1/'
        ELSE url END AS url
    FROM {pages}"""
_PRIVATE = """(starts_with(host, '10.') OR (starts_with(host, '172.') AND TRY_CAST(split_part(host, '.', 2) AS INTEGER) BETWEEN 16 AND 31)
    OR starts_with(host, '169.254.') OR host = '::1' OR starts_with(host, '192.168.')
    OR (regexp_matches(host, '^[0-9.]+$') AND TRY_CAST(split_part(host, '.', 1) AS INTEGER) >= 224))"""


@query(f"""
    WITH u AS ({_URLS.format(pages="pages")}),
         p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme,
                      nullif(coalesce(nullif(regexp_extract(url, '://[[]([^]]*)', 1), ''),
                             lower(regexp_extract(url, '://([^/:]*)', 1))), '') AS host FROM u)
    SELECT page_id, host, CASE WHEN scheme = 'javascript' THEN NULL WHEN scheme = 'file' THEN 'scheme file not allowed'
                               WHEN host IS NULL THEN 'no host' WHEN {_PRIVATE} THEN 'private address ' || host END AS refusal,
           coalesce({_PRIVATE}, false) AS is_private FROM p""")
def url_policy(t: Tables) -> DataFrame:
    urls = t.spark.sql(_URLS, pages=t.base("pages"))
    url, host = F.col("url"), h.url_host(F.col("url"))
    return urls.select(
        "page_id", host.alias("host"), h.url_refusal(url).alias("refusal"),
        h.is_private_address(F.coalesce(host, F.lit(""))).alias("is_private"),
    )


_NAMES = """
    SELECT c_custkey, CASE c_custkey % 9
        WHEN 0 THEN 'Host-' || CAST(c_custkey AS STRING) || '.example.org'
        WHEN 1 THEN 'evil.com@router' || CAST(c_custkey AS STRING) || '.local'
        WHEN 2 THEN 'a.example:' || CAST(c_custkey * 131 AS STRING)
        WHEN 3 THEN '[2001:db8::' || CAST(c_custkey % 10 AS STRING) || ']:443'
        WHEN 4 THEN '-bad.' || CAST(c_custkey AS STRING)
        WHEN 5 THEN 'under_score' || CAST(c_custkey AS STRING) || '.example.'
        WHEN 6 THEN c_name
        WHEN 7 THEN 'a..' || CAST(c_custkey AS STRING)
        ELSE '192.0.2.' || CAST(c_custkey % 300 AS STRING) END AS host
    FROM {customer}"""


@query(f"""
    WITH n AS ({_NAMES.format(customer="customer")})
    SELECT c_custkey, host, CASE c_custkey % 9 WHEN 0 THEN true WHEN 1 THEN false
        WHEN 2 THEN c_custkey * 131 BETWEEN 1 AND 99999 WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true
        WHEN 6 THEN false WHEN 7 THEN false ELSE true END AS valid,
        'https://' || host || '/ http://' || host || '/' AS urls FROM n""")
def valid_hostnames(t: Tables) -> DataFrame:
    names = t.spark.sql(_NAMES, customer=t.base("customer"))
    host = F.col("host")
    return names.select(
        "c_custkey", "host", h.is_valid_hostname(host).alias("valid"),
        F.array_join(h.candidate_urls(host), " ").alias("urls"),
    )


@query(check(("captures",), f"""
    SELECT capture_id, coalesce(has_signals AND (has_password_input OR has_credential_field) AND form_count > 0, false) AS login,
           nullif(lower(regexp_extract(final_url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS final_host,
           {moment_sql("captured_at")} AS captured_at FROM captures"""))
def login_forms(t: Tables) -> DataFrame:
    return t.captures.select(
        "capture_id", has_login_form(F.col("signals")).alias("login"),
        h.url_host(F.col("final_url")).alias("final_host"), moment("captured_at").alias("captured_at"),
    )
