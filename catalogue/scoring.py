"""Hosts, tokens, variants, matches and rescoring."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import check, moment, moment_sql, query, scorer
from catalogue.scoring_sql import host_ctes, rounded, scored_ctes
from mimicry.config import DEFAULT_BRANDS
from mimicry.functions.hostnames import normalize_hostname
from mimicry.functions.rounding import round_binary
from mimicry.functions.similarity import typo_similarity
from mimicry.operators import scoring as sc
from mimicry.operators.domains import split_hosts
from mimicry.plans import ingest as ing
from mimicry.session import shared_folder
from mimicry.sources import ct
from mimicry.staging import Tables

_NAMES = """names AS (
    SELECT arrival, cert_sha256, seen_at, issuer_org, unnest(list_concat([host, '*.' || host],
           CASE WHEN with_www THEN ['www.' || host] ELSE [] END)) AS name FROM certificates)"""
_HOSTS = "SELECT DISTINCT host FROM certificates"
_FREE = ("coalesce(contains(lower(issuer_org), 'let''s encrypt') OR contains(lower(issuer_org), 'zerossl') "
         "OR contains(lower(issuer_org), 'google trust services') OR contains(lower(issuer_org), 'cpanel'), false)")  # fmt: skip


def _hosts(t: Tables) -> DataFrame:
    """Distinct names of all certificates, normalised."""
    names = t.certificates.select(F.explode("all_domains").alias("name"))
    return names.select(normalize_hostname(F.col("name")).alias("fqdn")).distinct()


@query(check(("certificates",), """
    SELECT rtrim(CASE WHEN starts_with(lower(name), '*.') THEN substr(lower(name), 3) ELSE lower(name) END, '.') AS fqdn,
           count(*) AS names FROM names GROUP BY 1""", _NAMES))
def hostname_normalise(t: Tables) -> DataFrame:
    names = t.certificates.select(F.explode("all_domains").alias("name"))
    return names.groupBy(normalize_hostname(F.col("name")).alias("fqdn")).agg(
        F.count("*").alias("names")
    )


@query(check(("certificates",), """
    SELECT fqdn, registered_domain, label_raw, label_sk, subdomain_sk, label_loose, subdomain_loose
    FROM forms""", _NAMES, *host_ctes("SELECT name AS host FROM names")))
def skeleton(t: Tables) -> DataFrame:
    forms = sc.host_forms(_hosts(t))
    return forms.select("fqdn", "registered_domain", "label_raw", "label_sk", "subdomain_sk",
                        "label_loose", "subdomain_loose")


@query(check(("certificates",), """
    SELECT n.fqdn, s.suffix, s.domain, s.registered_domain, s.subdomain
    FROM (SELECT DISTINCT fqdn FROM named) n LEFT JOIN split s USING (fqdn)""",
    _NAMES, *host_ctes("SELECT name AS host FROM names")))
def registered_domain(t: Tables) -> DataFrame:
    split = split_hosts(_hosts(t))
    return split.select("fqdn", "suffix", "domain", "registered_domain", "subdomain")


@query(check(("certificates",), """
    SELECT DISTINCT host AS fqdn, ends_with(host, '.github.io') AS shared_platform,
           CASE WHEN ends_with(host, '.github.io') THEN regexp_extract(host, '([^.]+[.]github[.]io)$', 1)
                ELSE nullif(regexp_extract(host, '([^.]+[.](co[.]uk|[a-z]+))$', 1), '') END AS registered_domain
    FROM certificates"""))
def shared_platform(t: Tables) -> DataFrame:
    hosts = t.staged("certificates").select(F.col("host").alias("fqdn")).distinct()
    split = split_hosts(hosts, include_private=True)
    return split.select(
        "fqdn", F.col("on_private_suffix").alias("shared_platform"), "registered_domain"
    )


_SCORED = scored_ctes("SELECT DISTINCT host, false AS free_dv FROM certificates")


@query(check(("certificates",), """
    SELECT host, k.brand, array_to_string(k.fuzzers, ',') AS fuzzers
    FROM named JOIN split s USING (fqdn) LEFT JOIN idn ON s.domain = ascii_label
    JOIN known k ON k.label = coalesce(decoded, s.domain) AND k.suffix = s.suffix
    WHERE NOT EXISTS (SELECT 1 FROM brands b WHERE b.brand = k.brand AND list_contains(b.official, s.registered_domain))""",
    *scored_ctes(_HOSTS)))
def known_variants(t: Tables) -> DataFrame:
    """Equality lookup of registered domains in the variant index."""
    index = scorer(t.spark)._index
    hosts = t.staged("certificates").select("host").distinct()
    split = split_hosts(hosts, "host").where("registered_domain IS NOT NULL")
    hits = split.join(index, F.col("registered_domain") == F.col("variant_domain"))
    official = F.create_map(
        *[c for b in DEFAULT_BRANDS for c in (F.lit(b.name), F.array(*map(F.lit, b.official_domains)))]
    )
    found = hits.select("host", "registered_domain", F.explode("variant_fuzzers").alias("brand", "f"))
    own = F.array_contains(official[F.col("brand")], F.col("registered_domain"))
    return found.where(~own).select("host", "brand", F.array_join("f", ",").alias("fuzzers"))


@query(check(("certificates",), """
    SELECT host, brand, in_label, in_sub, NOT spelt_out AS homoglyph
    FROM named JOIN flags USING (fqdn) WHERE in_label OR in_sub""", *scored_ctes(_HOSTS)))
def token_match(t: Tables) -> DataFrame:
    hosts = t.staged("certificates").select(F.col("host").alias("name")).distinct()
    hosts = hosts.withColumn("fqdn", F.col("name")).withColumn("free_dv", F.lit(False))
    scored = scorer(t.spark).score(hosts, floor=0.0)
    f = F.col("features")
    return scored.where(f["token_in_registered_label"] | f["token_in_subdomain"]).select(
        F.col("name").alias("host"),
        "brand",
        f["token_in_registered_label"].alias("in_label"),
        f["token_in_subdomain"].alias("in_sub"),
        f["homoglyph"].alias("homoglyph"),
    )


@query(check(("certificates",), f"""
    SELECT label, token, {rounded("max(sim)")} AS similarity
    FROM (SELECT label, token, 1.0::DOUBLE - damerau_levenshtein(word, token)::DOUBLE / greatest(length(word), length(token)) AS sim, length(word) >= length(token) AS fits
          FROM (SELECT label, unnest(list_distinct(list_append(string_split_regex(label, '[^a-z]+'), label))) AS word
                FROM (SELECT DISTINCT label_loose AS label FROM forms) l) w,
               (VALUES ('mlcrosoft'), ('outlook'), ('netfllx')) v(token)) s
    WHERE fits GROUP BY label, token""", *host_ctes(_HOSTS)))
def typo_distance(t: Tables) -> DataFrame:
    """Exact similarity of every label to three tokens, unpruned."""
    hosts = t.staged("certificates").select(normalize_hostname(F.col("host")).alias("fqdn"))
    labels = sc.host_forms(hosts.distinct()).select(F.col("label_loose").alias("label")).distinct()
    tokens = F.explode(F.array(F.lit("mlcrosoft"), F.lit("outlook"), F.lit("netfllx")))
    pairs = labels.select("label", tokens.alias("token"))
    long_enough = F.exists(
        F.array_append(F.split("label", "[^a-z]+"), F.col("label")),
        lambda w: F.length(w) >= F.length("token"),
    )
    return pairs.where(long_enough).withColumn(
        "similarity", typo_similarity(F.col("label"), F.array("token"))
    )


_FEATURES_SQL = """array_to_string(fuzzers, ',') AS fuzzers, typo, in_label, in_sub, homoglyph,
           array_to_string(keywords, ',') AS keywords"""


def _features(matches: DataFrame, *columns: object) -> DataFrame:
    f = F.col("features")
    return matches.select(
        *columns,
        F.array_join(f["known_variant_fuzzers"], ",").alias("fuzzers"),
        f["typo_similarity"].alias("typo"),
        f["token_in_registered_label"].alias("in_label"),
        f["token_in_subdomain"].alias("in_sub"),
        f["homoglyph"].alias("homoglyph"),
        F.array_join(f["keyword_hits"], ",").alias("keywords"),
    )


@query(check(("certificates",), f"""
    SELECT host, fqdn, registered_domain, brand, score, {_FEATURES_SQL} FROM scored WHERE score >= 0.4""",
    *_SCORED))
def score_hosts(t: Tables) -> DataFrame:
    hosts = t.staged("certificates").select("host").distinct()
    scored = scorer(t.spark).score_names(hosts, "host")
    return _features(scored, "host", "fqdn", "registered_domain", "brand", "score")


@query(check(("certificates",), """
    SELECT host, score, brand FROM (
        SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, pos) AS rn
        FROM scored WHERE score >= 0.4) r WHERE rn = 1""", *_SCORED))
def best_match(t: Tables) -> DataFrame:
    hosts = t.staged("certificates").select("host").distinct()
    return sc.best_match(scorer(t.spark).score_names(hosts, "host"), "host")


_SIGHTINGS = f"""sightings AS (
    SELECT * FROM (SELECT *, {_FREE} AS free_dv, row_number() OVER (PARTITION BY name ORDER BY arrival) AS rn
                   FROM names) r WHERE rn = 1)"""
_FIRST = """first_matches AS (
    SELECT * FROM (SELECT s.*, g.cert_sha256, g.seen_at, g.arrival,
                          row_number() OVER (PARTITION BY s.fqdn, s.brand ORDER BY g.arrival, s.free_dv) AS rn
                   FROM scored s JOIN sightings g ON g.name = s.host AND g.free_dv = s.free_dv
                   WHERE s.score >= 0.4) r WHERE rn = 1)"""
FREE_DV, FIRST_MATCHES = _FREE, _FIRST
INGEST = [_NAMES, _SIGHTINGS, *scored_ctes("SELECT name AS host, free_dv FROM sightings"), _FIRST]


@query(check(("certificates",), f"""
    SELECT name, cert_sha256, {moment_sql("seen_at")} AS seen_at, issuer_org FROM sightings""",
    _NAMES, _SIGHTINGS))
def first_sighting(t: Tables) -> DataFrame:
    first = ing.first_sightings(t.certificates).drop("arrival")
    return first.withColumn("seen_at", moment("seen_at"))


@query(check(("certificates",), f"""
    SELECT fqdn, brand, registered_domain, score, score >= 0.7 AS is_alert, {_FEATURES_SQL},
           free_dv, cert_sha256, {moment_sql("seen_at")} AS first_seen_at FROM first_matches""", *INGEST))
def ingest_matches(t: Tables) -> DataFrame:
    matches = ing.score_certificates(t.certificates, scorer(t.spark))
    return _features(
        matches, "fqdn", "brand", "registered_domain", "score", "is_alert",
        F.col("features.free_dv_issuer").alias("free_dv"), "cert_sha256",
        moment("first_seen_at").alias("first_seen_at"),
    )


@query(check(("certificates", "matches"), f"""
    SELECT 'match' AS kind, f.fqdn AS id, f.brand AS detail FROM first_matches f
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.fqdn = f.fqdn AND m.brand = f.brand)
    UNION ALL
    SELECT 'certificate', cert_sha256, {moment_sql("seen_at")} FROM certificates
    WHERE cert_sha256 IN (SELECT f.cert_sha256 FROM first_matches f
        WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.fqdn = f.fqdn AND m.brand = f.brand))
      AND cert_sha256 NOT IN (SELECT cert_sha256 FROM certificates WHERE issuer_org IS NULL)""", *INGEST))
def ingest_new_rows(t: Tables) -> DataFrame:
    """What an ingest adds to tables that already hold some matches and certificates."""
    stored = t.certificates.where("issuer_org IS NULL").drop("arrival")
    new = ing.ingest(t.certificates, scorer(t.spark), t.matches, stored)
    matches = new.matches.select(
        F.lit("match").alias("kind"), F.col("fqdn").alias("id"), F.col("brand").alias("detail")
    )
    certs = new.certificates.select(
        F.lit("certificate").alias("kind"), F.col("cert_sha256").alias("id"),
        moment("seen_at").alias("detail"),
    )
    return matches.unionByName(certs)


_TRUST = [
    "trusted AS (SELECT cert_sha256, issuer_org, host FROM certificates)",
    """links AS (
        SELECT m.*, md5(CAST(CASE WHEN user_id % 3 = 0 THEN user_id * 3 ELSE user_id END AS STRING)) AS linked
        FROM matches m)""",
    f"""flagged AS (
        SELECT l.*, CASE WHEN coalesce(c.host = l.fqdn OR '*.' || l.fqdn = c.host, false) THEN {_FREE}
                         ELSE user_id % 2 = 0 END AS free_dv
        FROM links l LEFT JOIN trusted c ON c.cert_sha256 = l.linked)""",
]
_RESCORED = [
    *_TRUST,
    *scored_ctes("SELECT fqdn AS host, free_dv FROM flagged"),
    """rescored AS (
        SELECT f.fqdn, f.brand, f.score AS old_score, coalesce(s.score, 0.0::DOUBLE) AS new_score,
               f.is_alert AS was_alert, coalesce(s.score, 0.0) >= 0.7 AS now_alert,
               s.host IS NOT NULL AND (len(s.fuzzers) > 0 OR s.typo <> 0 OR s.in_label <> (f.first_value >= 20)
                   OR s.in_sub OR s.homoglyph OR len(s.keywords) > 0 OR f.free_dv <> (f.user_id % 2 = 0)) AS other_features
        FROM flagged f LEFT JOIN scored s ON s.host = f.fqdn AND s.brand = f.brand AND s.free_dv = f.free_dv)""",
    """changes AS (SELECT * FROM rescored WHERE abs(old_score - new_score) > 1e-9
                   OR was_alert <> now_alert OR other_features)""",
]


def _rescored(t: Tables) -> DataFrame:
    return ing.rescore(t.matches, t.certificates, scorer(t.spark))


@query(check(("certificates", "matches"), """
    SELECT fqdn, brand, old_score, new_score, was_alert, now_alert AS is_alert FROM changes""", *_RESCORED))
def rescore_changes(t: Tables) -> DataFrame:
    return ing.score_changes(_rescored(t)).drop("features")


@query(check(("certificates", "matches"), """
    SELECT (SELECT count(*) FROM rescored) AS checked, count(*) AS changed,
           count(*) FILTER (WHERE now_alert AND NOT was_alert) AS now_alerting,
           count(*) FILTER (WHERE was_alert AND NOT now_alert) AS no_longer_alerting FROM changes""",
    *_RESCORED))
def rescore_summary(t: Tables) -> DataFrame:
    return ing.rescore_summary(_rescored(t))


@query(check(("certificates", "matches"), f"""
    SELECT fqdn, brand, registered_domain, r.new_score AS score, now_alert AS is_alert,
           {moment_sql("m.first_seen_at")} AS first_seen_at
    FROM matches m JOIN rescored r USING (fqdn, brand)""", *_RESCORED))
def rescore_snapshot(t: Tables) -> DataFrame:
    after = ing.rescored_matches(_rescored(t)).drop("features", "cert_sha256")
    return after.withColumn("first_seen_at", moment("first_seen_at"))


# ------------------------------------------------------------------ CT messages

_LEAF = [
    """updates AS (
        SELECT line_no, value::JSON AS j FROM messages
        WHERE json_valid(value) AND value::JSON->>'$.message_type' = 'certificate_update')""",
    """leaves AS (
        SELECT line_no, j->>'$.data.seen' AS seen, j->>'$.data.source.name' AS ct_log,
               j->>'$.data.leaf_cert.issuer.O' AS issuer_org,
               replace(replace(CAST(j->'$.data.leaf_cert.issuer.O' AS VARCHAR), 'á', '\\u00e1'), 'í', '\\u00ed') AS issuer_json, j->>'$.data.leaf_cert.issuer.CN' AS issuer_cn,
               j->>'$.data.leaf_cert.serial_number' AS serial, j->>'$.data.leaf_cert.not_after' AS not_after,
               j->>'$.data.leaf_cert.not_before' AS not_before,
               lower(replace(j->>'$.data.leaf_cert.sha256', ':', '')) AS sha,
               coalesce(from_json(nullif(j->>'$.data.leaf_cert.all_domains', 'null'), '["VARCHAR"]'), []) AS names
        FROM updates)""",
    """checked AS (
        SELECT *, CASE WHEN seen IN ('NaN', '1e18') THEN 'seen is out of range'
                       WHEN not_after IS NULL THEN 'missing not_after'
                       WHEN TRY_CAST(not_after AS DOUBLE) IS NULL THEN 'not_after is not a number' END AS reject_reason
        FROM leaves)""",
    """keyed AS (
        SELECT *, CASE WHEN sha IN ('', 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855')
                  THEN 'issuer-serial:' || sha256('{"CN": "' || issuer_cn || '", "O": '
                       || coalesce(issuer_json, 'null') || '}|'
                       || coalesce(nullif(serial, ''), not_before || '|' || not_after || '|' || array_to_string(list_sort(names), ',')))
                  ELSE sha END AS cert_sha256 FROM checked WHERE reject_reason IS NULL)""",
]


LEAVES = _LEAF


def _parsed(t: Tables) -> DataFrame:
    return ct.parse_messages(t.messages)


@query(check(("messages",), f"""
    SELECT line_no, cert_sha256, {moment_sql("to_timestamp(CAST(seen AS DOUBLE))")} AS seen_at,
           issuer_org, ct_log, {moment_sql("to_timestamp(CAST(not_after AS DOUBLE))")} AS not_after,
           array_to_string(names, ' ') AS names FROM keyed""", *_LEAF))
def certificate_parse(t: Tables) -> DataFrame:
    certs = ct.certificates(_parsed(t))
    return certs.select(
        "line_no", "cert_sha256", moment("seen_at").alias("seen_at"), "issuer_org", "ct_log",
        moment("not_after").alias("not_after"), F.array_join("all_domains", " ").alias("names"),
    )


@query(check(("messages",), """
    SELECT line_no, reject_reason FROM checked WHERE reject_reason IS NOT NULL""", *_LEAF))
def malformed_messages(t: Tables) -> DataFrame:
    return ct.malformed(_parsed(t)).drop("rejected_message")


@query(check(("messages",), """
    SELECT count(*) AS certificate_messages, count(*) FILTER (WHERE reject_reason IS NULL) AS certificates,
           count(*) FILTER (WHERE reject_reason IS NOT NULL) AS malformed,
           CAST(sum(CASE WHEN reject_reason IS NULL THEN len(names) ELSE 0 END) AS BIGINT) AS hostnames,
           (SELECT count(*) FROM (SELECT DISTINCT s.fqdn, s.brand FROM scored s WHERE score >= 0.4) d) AS matches_new
    FROM checked""", *_LEAF,
    *scored_ctes(f"SELECT DISTINCT unnest(names) AS host, {_FREE} AS free_dv FROM keyed")))
def ingest_counters(t: Tables) -> DataFrame:
    """Messages to matches, with the run's counters."""
    parsed = _parsed(t).withColumn("arrival", F.col("line_no"))
    matches = ing.score_certificates(ct.certificates(parsed), scorer(t.spark))
    return ing.run_counters(parsed, matches)


@query(check(("certificates",), f"""
    SELECT brand, is_alert, count(*) AS matches, {rounded("avg(score)", 6)} AS mean_score
    FROM (SELECT *, score >= 0.7 AS is_alert FROM first_matches) f GROUP BY ALL""", *INGEST))
def alert_rates(t: Tables) -> DataFrame:
    """Flagship: certificates to matches to alerts per brand."""
    matches = ing.score_certificates(t.certificates, scorer(t.spark))
    # Scores have four places: summed as whole ten-thousandths, in any order.
    units = F.sum(F.round(F.col("score") * 10_000).cast("bigint"))
    return matches.groupBy("brand", "is_alert").agg(
        F.count("*").alias("matches"),
        round_binary(units / F.count("*") / 10_000, 6).alias("mean_score"),
    )


@query(check(("messages",), f"""
    SELECT cert_sha256, {moment_sql("to_timestamp(CAST(seen AS DOUBLE))")} AS seen_at,
           issuer_org, ct_log, array_to_string(names, ' ') AS names FROM keyed""", *_LEAF))
def message_files(t: Tables) -> DataFrame:
    """Recorded messages read from files of lines, some blank or broken, in one batch."""
    folder = f"{shared_folder(t.spark)}/run-{uuid4().hex}"
    t.messages.select("value").write.text(folder)
    certs = ct.certificates(ct.parse_messages(ct.read_ct_messages(t.spark, folder)))
    return certs.select("cert_sha256", moment("seen_at").alias("seen_at"), "issuer_org", "ct_log",
                        F.array_join("all_domains", " ").alias("names"))
