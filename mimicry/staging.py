"""The logical tables, derived from the given Parquet tables.

The same SQL text serves Spark (``{orders}`` bound to a DataFrame) and a SQL engine that
has the tables as views, so a query and its check start from the same rows. The dialect
is the part both share.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.config import DEFAULT_BRANDS
from mimicry.session import computed_once

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

TOKENS = tuple(token for brand in DEFAULT_BRANDS for token in brand.tokens)
OFFICIAL = (
    "paypal.com", "microsoft.com", "office365.com", "outlook.com", "apple.com", "icloud.com",
    "netflix.com", "amazon.com", "ameli.fr",
)
# Latin letters and the Cyrillic ones drawn alike, used to stage IDN hosts.
_TWINS = {"a": "а", "o": "о", "e": "е", "i": "і"}


def idn_labels() -> list[tuple[str, str]]:
    """(punycode label, decoded label) staged for each token: its first twin swapped."""
    labels = []
    for token in TOKENS:
        at = min(token.index(c) for c in _TWINS if c in token)
        decoded = token[:at] + _TWINS[token[at]] + token[at + 1 :]
        labels.append(("xn--" + decoded.encode("punycode").decode("ascii"), decoded))
    return labels


def _pick(place: str, values: Sequence[str]) -> str:
    """The value at a 0-based place."""
    return f"split_part('{','.join(values)}', ',', CAST({place} AS INT) + 1)"


def _div(value: str, by: int) -> str:
    return f"CAST(floor(({value}) / {by}) AS BIGINT)"


def host_sql(key: str) -> str:
    """A host for an integer key: twenty shapes, from official to unparsable."""
    k = f"({key})"
    n = f"CAST({k} AS STRING)"
    which = f"({_div(k, 20)} % {len(TOKENS)})"
    tok, own = _pick(which, TOKENS), _pick(which, OFFICIAL)
    idn = _pick(which, [label for label, _ in idn_labels()])
    octets = " || '.' || ".join(
        f"CAST({_div(k, by)} % 250 AS STRING)" for by in (62500, 250, 1)
    )
    shapes = [
        f"'n' || {n} || '.' || {own}",
        f"'n' || {n} || '.' || {tok} || '-secure-login.xyz'",
        f"'n' || {n} || '.' || replace(replace({tok}, 'o', '0'), 'l', '1') || '.com'",
        f"'n' || {n} || '.' || substr({tok}, 1, 1) || substr({tok}, 3) || '.com'",
        f"'n' || {n} || '.' || substr({tok}, 2, 1) || substr({tok}, 1, 1) || substr({tok}, 3) || '.com'",
        f"{tok} || '.com.account-verify' || {n} || '.top'",
        f"'shop' || {n} || '.example.org'",
        f"replace({tok}, 'm', 'rn') || '-' || {n} || '-support.net'",
        f"'n' || {n} || '.' || {tok} || '.shop'",
        f"{tok} || 's' || {n} || '.co.uk'",
        f"'n' || {n} || '.' || {idn} || '.com'",
        f"replace({tok}, 'i', 'l') || '-' || {n} || '.info'",
        f"'n' || {n} || '.' || substr({tok}, 1, 3) || 'z' || substr({tok}, 4) || '.org'",
        f"'pineapple' || {n} || '.com'",
        f"'cloud' || {n} || '.vercelcloud.com'",
        f"'10.' || {octets}",
        f"'localhost' || {n}",
        f"'mail.' || {tok} || {n} || '.github.io'",
        f"'billing-' || replace({tok}, 'a', 'ä') || '-' || {n} || '.fr'",
        f"{tok} || '-wallet' || {n} || '.online'",
    ]
    whens = " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(shapes))
    return f"CASE {k} % 20 {whens} END"


_ISSUER = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Let''s Encrypt' WHEN '2-HIGH' THEN "
    "'DigiCert Inc' WHEN '3-MEDIUM' THEN 'ZeroSSL GmbH' WHEN '5-LOW' THEN 'Sectigo Limited' END"
)
_REGISTERED = "regexp_extract(fqdn, '([^.]+[.](co[.]uk|[a-z]+))$', 1)"

# Base tables with the hosts of a key, named ``<table>_hosts`` in the SQL below. A third of
# the certificates name one and the same host.
HOSTS = {
    "orders_hosts": ("orders", {
        "host": host_sql("o_custkey"),
        "cert_host": host_sql("CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE o_custkey END"),
    }),
    "events_hosts": ("events", {"host": host_sql("user_id")}),
    "customer_hosts": ("customer", {"host": host_sql("c_custkey")}),
    "pages_hosts": (
        "pages", {"host": host_sql("page_id"), "shared_host": host_sql("page_id % 50")}
    ),
}

# A verdict's columns, told from a line of an order.
_VERDICT = f"""\
        SELECT capture_id * 10 + ln AS verdict_id, capture_id, fqdn,
               CASE WHEN ln = 1 THEN 'stub' WHEN ln <= 4 THEN 'vision' ELSE 'replay' END AS backend,
               CASE WHEN ln = 1 THEN NULL WHEN ln % 3 = 2 THEN 'small' WHEN ln % 3 = 0 THEN 'medium'
                    ELSE 'large' END AS model,
               CASE WHEN q % 10 = 0 THEN 'error' WHEN q % 10 = 7 THEN 'unknown'
                    WHEN flag = 'A' THEN 'phishing' WHEN flag = 'R' THEN 'parked'
                    ELSE 'legitimate' END AS label,
               (30 + 7 * d) / 100.0E0 AS confidence,
               CASE WHEN q % 4 = 0 THEN NULL WHEN q % 4 = 1 THEN '' ELSE {_pick("q % 9", TOKENS)} END AS brand_impersonated,
               CASE WHEN q % 6 = 0 THEN NULL
                    ELSE 'Logo on http://' || fqdn || '/a.b <b>&' || CAST(q AS STRING) || '@all' END AS evidence,
               classified_at, 100 * q + d AS latency_ms, 10 * q AS prompt_tokens,
               CASE WHEN q % 5 = 0 THEN NULL ELSE q END AS completion_tokens,
               q / 1000.0E0 AS cost_usd, d = 10 OR d = 9 AS already_alerted
"""

SQL = {
    "certificates": f"""
        SELECT o_orderkey AS arrival, md5(CAST(o_orderkey AS STRING)) AS cert_sha256,
               CAST(o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS TIMESTAMP) AS seen_at,
               {_ISSUER} AS issuer_org, cert_host AS host, o_orderkey % 5 = 0 AS with_www
        FROM {{orders_hosts}}
    """,
    "messages": f"""
        SELECT o_orderkey AS line_no, CASE
            WHEN o_orderkey % 23 = 0 THEN '{{{{"message_type": "certificate_update", "data": '
            WHEN o_orderkey % 19 = 0 THEN '{{{{"message_type": "heartbeat", "timestamp": 1.5}}}}'
            WHEN o_orderkey % 31 = 0 THEN ''
            ELSE CASE WHEN o_orderkey % 43 = 2 THEN chr(9) ELSE '' END
                || '{{{{"message_type": "certificate_update", "data": {{{{"seen": '
                || CASE WHEN o_orderkey % 41 = 3 THEN '"NaN"' WHEN o_orderkey % 41 = 4 THEN '"1e18"'
                        ELSE CAST(1700000000 + o_orderkey AS STRING) || '.25' END || ', "source": {{{{"name": "log'
                || CAST(o_custkey % 4 AS STRING) || '"}}}}, "leaf_cert": {{{{'
                || CASE WHEN o_orderkey % 13 = 0 THEN '"sha256": "",'
                        WHEN o_orderkey % 13 = 1 THEN '"sha256": "E3:B0:C4:42:98:FC:1C:14:9A:FB:F4:C8:99:6F:B9:24:27:AE:41:E4:64:9B:93:4C:A4:95:99:1B:78:52:B8:55",'
                        ELSE '"sha256": "AB:' || upper(md5(CAST(o_orderkey AS STRING))) || '",' END
                || '"issuer": {{{{"CN": "R' || CAST(o_custkey % 9 AS STRING) || '", "O": '
                || CASE WHEN o_orderkey % 37 = 5 THEN '"Národní ' || chr(92) || '"CA' || chr(92) || '"' || chr(92) || 't1"'
                        WHEN o_orderkey % 37 = 6 THEN '7'
                        ELSE coalesce('"' || {_ISSUER} || '"', 'null') END || '}}}}, "serial_number": "'
                || CASE WHEN o_orderkey % 26 = 0 THEN '' ELSE CAST(o_orderkey * 7 AS STRING) END
                || '", "not_before": 1690000000'
                || CASE WHEN o_orderkey % 17 = 0 THEN ''
                        WHEN o_orderkey % 17 = 1 THEN ', "not_after": "soon"'
                        ELSE ', "not_after": 1800000000' END
                || ', "all_domains": '
                || CASE WHEN o_orderkey % 11 = 0 THEN 'null'
                        ELSE '["z.example.com", "' || host || '"]' END
                || '}}}}}}}}}}}}'
            END AS value
        FROM {{orders_hosts}}
    """,
    "matches": f"""
        SELECT fqdn, brand, {_REGISTERED} AS registered_domain, score, score >= 0.7 AS is_alert,
               first_seen_at, user_id, first_value
        FROM (SELECT *, (40 + least(60, CAST(floor(first_value) AS BIGINT))) / 100.0E0 AS score
              FROM (SELECT user_id, min(host) AS fqdn,
                           CASE event_type WHEN 'click' THEN 'paypal' WHEN 'view' THEN 'microsoft'
                                WHEN 'purchase' THEN 'apple' WHEN 'signup' THEN 'netflix'
                                ELSE 'amazon' END AS brand,
                           min_by(value, event_id) AS first_value,
                           CAST(min_by(ts, event_id) AS TIMESTAMP) AS first_seen_at
                    FROM {{events_hosts}} GROUP BY user_id, event_type) firsts) m
    """,
    "captures": f"""
        SELECT capture_id, fqdn, 'https://' || fqdn || '/' AS url, status, captured_at, duration_ms,
               CASE WHEN status <> 'ok' THEN NULL
                    WHEN capture_id % 7 = 0 THEN 'https://Landing' || CAST(k % 5 AS STRING) || '.example.net:8443/in?u=1'
                    ELSE 'https://user@' || fqdn || '/home' END AS final_url,
               CASE WHEN status <> 'ok' THEN NULL WHEN capture_id % 9 = 0 THEN 404 ELSE 200 END AS http_status,
               CASE WHEN status = 'ok' AND capture_id % 11 <> 0
                    THEN 'shots/' || CAST(capture_id AS STRING) || '.png' END AS screenshot_path,
               CASE WHEN capture_id % 6 = 0 THEN '' WHEN capture_id % 6 = 1 THEN ' Sign  in to Shop '
                    WHEN capture_id % 6 = 2 THEN 'sign in TO shop' ELSE 'Welcome ' || CAST(k % 4 AS STRING) END AS title,
               CAST(capture_id % 3 AS INT) AS form_count, capture_id % 4 = 0 AS has_password_input,
               capture_id % 10 = 3 AS has_credential_field, capture_id % 8 = 0 AS posts_away,
               status = 'ok' AND capture_id % 25 <> 1 AS has_signals,
               CASE WHEN capture_id % 10 = 9 THEN NULL WHEN capture_id % 2 = 0 THEN 'home'
                    ELSE 'cloud-north' END AS vantage
        FROM (SELECT o_orderkey AS capture_id, o_custkey AS k, host AS fqdn,
                     CASE WHEN o_orderstatus <> 'P' THEN 'ok'
                          ELSE {_pick("o_orderkey % 5", ("timeout", "dns_error", "connection_error", "blocked", "error"))} END AS status,
                     CAST(o_orderdate + (o_orderkey * 37 % 86400) * INTERVAL 1 SECOND AS TIMESTAMP) AS captured_at,
                     o_orderkey * 13 % 20000 AS duration_ms
              FROM {{orders_hosts}}) visits
    """,
    "verdicts": f"""
{_VERDICT}        FROM (SELECT l_orderkey AS capture_id, CAST(l_linenumber AS BIGINT) AS ln, max(host) AS fqdn,
                     CAST(max(l_quantity) AS BIGINT) AS q, CAST(round(max(l_discount) * 100) AS BIGINT) AS d,
                     max(l_returnflag) AS flag,
                     CAST(max(l_shipdate) + max(l_linenumber) * INTERVAL 1 HOUR AS TIMESTAMP) AS classified_at
              FROM {{lineitem}} JOIN {{orders_hosts}} ON l_orderkey = o_orderkey
              GROUP BY l_orderkey, l_linenumber) staged
    """,
    "labelled": f"""
        SELECT host AS fqdn,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'phishing' WHEN 'AUTOMOBILE' THEN 'parked'
                    WHEN 'MACHINERY' THEN 'legitimate' WHEN 'HOUSEHOLD' THEN 'unknown'
                    ELSE 'phishing' END AS expected,
               CASE c_nationkey % 4 WHEN 0 THEN 'alerts' WHEN 1 THEN 'calibration'
                    WHEN 2 THEN 'feed' ELSE '' END AS source,
               CASE WHEN c_custkey % 3 = 0 THEN 'paypal' END AS brand,
               CASE WHEN c_custkey % 7 = 0 THEN 'seen twice' END AS note,
               CASE c_nationkey % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'agent' END AS labelled_by,
               c_custkey
        FROM {{customer_hosts}}
    """,
    "label_pairs": """
        SELECT CAST(l.doc_id AS STRING) AS fqdn, d.lang AS brand, d.source AS source,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'legitimate'
                    WHEN l.toxic = 1 THEN 'phishing' ELSE 'parked' END AS expected,
               CASE WHEN d.n_chars % 100 >= 70 THEN 'phishing'
                    WHEN d.n_chars % 7 = 0 THEN 'parked' ELSE 'legitimate' END AS predicted,
               (d.n_chars % 101) / 100.0E0 AS score, d.n_chars AS n_chars,
               CASE WHEN d.n_chars % 3 = 0 THEN 'paypal' ELSE '' END AS verdict_brand
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
    """,
    "feed": f"""
        SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://' || host || '/signin?b=PayPal'
                             WHEN page_id % 4 = 1 THEN 'HTTP://user@' || shared_host || ':8080/outlook/x'
                             WHEN page_id % 40 = 2 THEN 'ftp://files.example.org/a'
                             WHEN page_id % 40 = 6 THEN '# comment'
                             WHEN page_id % 40 = 10 THEN 'not a url'
                             WHEN page_id % 40 = 14 THEN 'http:///nohost'
                             WHEN page_id % 40 = 18 THEN 'https://bad_host-.example.org/'
                             ELSE '  ' || url || ' ' END AS url,
               CAST(CAST(TIMESTAMP '2023-12-28 00:00:00' + (page_id % 30) * INTERVAL 24 HOUR AS DATE) AS DATE) AS labelled_at
        FROM {{pages_hosts}}
    """,
    "archive": f"""
        SELECT page_id, 'https://' || host || '/login' AS url,
               html || CASE page_id % 6
                 WHEN 0 THEN '<form action="https://collect' || CAST(page_id % 9 AS STRING) || '.evil.co.uk/a"><input type="PASSWORD" name="x"></form><iframe src="a"></iframe>'
                 WHEN 1 THEN '<form action="/same"><input name="user_passwd_1"></form>'
                 WHEN 2 THEN '<form action="//login.' || host || '/x"><input id="OTP"></form><form action="http://b.example.org/"></form><form action="http://a.b.example.org/"></form>'
                 WHEN 3 THEN '<iframe></iframe><IFRAME></IFRAME><input type=password>'
                 ELSE '' END AS html
        FROM {{pages_hosts}}
    """,
}
SOURCES = {
    "certificates": ("orders_hosts",), "messages": ("orders_hosts",),
    "matches": ("events_hosts",), "captures": ("orders_hosts",),
    "verdicts": ("lineitem", "orders_hosts"), "labelled": ("customer_hosts",),
    "label_pairs": ("labels", "documents"), "feed": ("pages_hosts",), "archive": ("pages_hosts",),
}


def sql_for(name: str) -> str:
    """The SQL of a logical table over the base tables as views."""
    names = {t: t for t in SOURCES[name]}
    for hosted in HOSTS.keys() & names.keys():
        table, hosts = HOSTS[hosted]
        columns = ", ".join(f"{expression} AS {column}" for column, expression in hosts.items())
        names[hosted] = f"(SELECT *, {columns} FROM {table}) {hosted}"
    return SQL[name].format(**names)


class Tables:
    """The logical tables of one scale factor as DataFrames with their full schemas."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, rows: DataFrame) -> DataFrame:
        """One small file is one task: its rows are dealt out before staging works on them."""
        wanted = self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)

    def source(self, name: str, given: DataFrame | None = None) -> DataFrame:
        """A base table, or one with its staged hosts (each computed once per row)."""
        if name not in HOSTS:
            return self.spread(self.base(name))
        table, hosts = HOSTS[name]
        rows = self.spread(self.base(table)) if given is None else given
        return computed_once(rows, **{c: F.expr(text) for c, text in hosts.items()})

    def staged(self, name: str, **given: DataFrame) -> DataFrame:
        """A logical table; ``given`` replaces base tables, by a stream for example."""
        bound = {}
        for source in SOURCES[name]:
            table = HOSTS[source][0] if source in HOSTS else source
            bound[source] = self.source(source, given.get(table))
        return self.spark.sql(SQL[name], **bound)

    @cached_property
    def certificates(self) -> DataFrame:
        return as_certificates(self.staged("certificates"))

    @cached_property
    def messages(self) -> DataFrame:
        return computed_once(self.staged("messages"), value=F.col("value"))

    @cached_property
    def matches(self) -> DataFrame:
        return as_matches(self.staged("matches"))

    @cached_property
    def captures(self) -> DataFrame:
        return as_captures(self.staged("captures"))

    @cached_property
    def verdicts(self) -> DataFrame:
        return as_verdicts(self.spark.sql(_VERDICT + "FROM {staged}", staged=self._judged_lines()))

    def _judged_lines(self) -> DataFrame:
        """What the SQL of verdicts groups after its join, grouped before: each line is dealt out
        and sorted once, without its order's host."""
        lines = self.source("lineitem").repartition("l_orderkey").groupBy(
            F.col("l_orderkey").alias("capture_id"), "l_linenumber"
        ).agg(
            F.max("l_quantity").cast("bigint").alias("q"), F.expr("CAST(round(max(l_discount) * 100) AS BIGINT) AS d"),
            F.max("l_returnflag").alias("flag"), F.max("l_shipdate").alias("shipped"),
        )
        hosts = self.source("orders_hosts").groupBy(F.col("o_orderkey").alias("capture_id")).agg(F.max("host").alias("fqdn"))
        at = "CAST(shipped + l_linenumber * INTERVAL 1 HOUR AS TIMESTAMP) AS classified_at"
        return lines.join(hosts, "capture_id").selectExpr("*", "CAST(l_linenumber AS BIGINT) AS ln", at)

    @cached_property
    def labelled(self) -> DataFrame:
        return self.staged("labelled")

    @cached_property
    def label_pairs(self) -> DataFrame:
        return self.staged("label_pairs")

    @cached_property
    def feed(self) -> DataFrame:
        return self.staged("feed")

    @cached_property
    def archive(self) -> DataFrame:
        return self.staged("archive")


def as_certificates(staged: DataFrame) -> DataFrame:
    host = F.col("host")
    names = F.array(host, F.concat(F.lit("*."), host))
    with_www = F.array_append(names, F.concat(F.lit("www."), host))
    return staged.select(
        "arrival",
        "cert_sha256",
        "seen_at",
        "issuer_org",
        F.col("seen_at").alias("not_before"),
        (F.col("seen_at") + F.expr("INTERVAL 90 DAY")).alias("not_after"),
        F.lit("log").alias("ct_log"),
        F.when(F.col("with_www"), with_www).otherwise(names).alias("all_domains"),
    )


def as_matches(staged: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    features = F.struct(
        none.alias("known_variant_fuzzers"),
        F.lit(0.0).alias("typo_similarity"),
        (F.col("first_value") >= 20).alias("token_in_registered_label"),
        F.lit(False).alias("token_in_subdomain"),
        F.lit(False).alias("homoglyph"),
        none.alias("keyword_hits"),
        (F.col("user_id") % 2 == 0).alias("free_dv_issuer"),
    )
    # The certificate on file: every third one belongs to another site.
    key = F.when(F.col("user_id") % 3 == 0, F.col("user_id") * 3).otherwise(F.col("user_id"))
    return staged.select(
        "fqdn",
        "brand",
        "registered_domain",
        "score",
        "is_alert",
        features.alias("features"),
        F.md5(key.cast("string")).alias("cert_sha256"),
        "first_seen_at",
    )


def as_captures(staged: DataFrame) -> DataFrame:
    targets = F.when(F.col("posts_away"), F.array(F.lit("evil.example.net"))).otherwise(
        F.array().cast("array<string>")
    )
    signals = F.struct(
        F.col("title"),
        F.col("form_count"),
        F.col("has_password_input"),
        F.col("has_credential_field"),
        targets.alias("cross_domain_form_targets"),
        F.lit(0).alias("iframe_count"),
        F.col("has_password_input").cast("int").alias("password_input_count"),
    )
    return staged.select(
        "capture_id", "fqdn", "url", "status", "captured_at", "duration_ms", "final_url",
        "http_status", "screenshot_path", F.lit(None).cast("string").alias("html_path"),
        F.when(F.col("has_signals"), signals).alias("signals"),
        F.lit(None).cast("string").alias("error"), "vantage",
    )


def as_verdicts(staged: DataFrame) -> DataFrame:
    return staged.select(
        "verdict_id", "capture_id", "fqdn", "backend", "model", "label", "confidence",
        "brand_impersonated", "evidence", "classified_at", "latency_ms", "prompt_tokens",
        "completion_tokens", "cost_usd", F.lit(None).cast("string").alias("error"),
        F.when(F.col("already_alerted"), F.col("classified_at")).alias("alerted_at"),
    )
