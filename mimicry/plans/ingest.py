"""Certificates to matches, and stored matches scored again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mimicry.functions.hostnames import normalize_hostname
from mimicry.operators.scoring import Scorer, is_free_dv
from mimicry.sources.ct import CERTIFICATE_COLUMNS
from mimicry.sources.sinks import absent

MATCH_KEY = ("fqdn", "brand")


@dataclass(frozen=True)
class Ingested:
    matches: DataFrame
    certificates: DataFrame


def first_sightings(certificates: DataFrame) -> DataFrame:
    """(name, cert_sha256, seen_at, issuer_org, arrival) of each name's first certificate.

    ``arrival`` orders certificates. An aggregate: the names of a busy site are reduced to
    one row per task before they are shuffled.
    """
    names = certificates.select(
        F.explode("all_domains").alias("name"),
        F.struct("arrival", "cert_sha256", "seen_at", "issuer_org").alias("sighting"),
    )
    return names.groupBy("name").agg(F.min("sighting").alias("__first")).select("name", "__first.*")


def score_certificates(certificates: DataFrame, scorer: Scorer) -> DataFrame:
    """Matches of all certificates: each (fqdn, brand) with its first sighting.

    Wildcard twins and repeated names are reduced before scoring, which is the expensive
    step: a host is scored once per value of its free-DV flag.
    """
    cfg = scorer.cfg
    hosts = (
        first_sightings(certificates)
        .select(
            normalize_hostname(F.col("name")).alias("fqdn"),
            is_free_dv(F.col("issuer_org"), cfg).alias("free_dv"),
            F.struct("arrival", "cert_sha256", "seen_at").alias("sighting"),
        )
        .where("fqdn IS NOT NULL")
        .groupBy("fqdn", "free_dv")
        .agg(F.min("sighting").alias("sighting"))
    )
    scored = scorer.score(hosts)
    row = F.struct("registered_domain", "score", "features", "sighting")
    first = scored.groupBy(*MATCH_KEY).agg(F.min_by(row, "sighting").alias("__match"))
    return first.select(
        "fqdn",
        "brand",
        "__match.registered_domain",
        "__match.score",
        (F.col("__match.score") >= cfg.alert_threshold).alias("is_alert"),
        "__match.features",
        "__match.sighting.cert_sha256",
        F.col("__match.sighting.seen_at").alias("first_seen_at"),
    )


def ingest(
    certificates: DataFrame,
    scorer: Scorer,
    stored_matches: DataFrame | None = None,
    stored_certificates: DataFrame | None = None,
) -> Ingested:
    """New matches, and the certificates they refer to that are not stored yet."""
    matches = score_certificates(certificates, scorer)
    if stored_matches is not None:
        matches = absent(matches, stored_matches, MATCH_KEY)
    used = referenced_certificates(certificates, matches)
    if stored_certificates is not None:
        used = absent(used, stored_certificates, ("cert_sha256",))
    return Ingested(matches, used)


def referenced_certificates(certificates: DataFrame, matches: DataFrame) -> DataFrame:
    """The certificates some match points to, each once (its first message)."""
    fields = [c for c in CERTIFICATE_COLUMNS if c != "cert_sha256"]
    return (
        certificates.join(matches.select("cert_sha256").distinct(), "cert_sha256", "left_semi")
        .groupBy("cert_sha256")
        .agg(F.min_by(F.struct(*fields), "arrival").alias("__cert"))
        .select("cert_sha256", "__cert.*")
    )


def run_counters(parsed: DataFrame, matches: DataFrame) -> DataFrame:
    """Messages, certificates, malformed messages, names and new matches of a run."""
    read = parsed.agg(
        F.count("*").alias("certificate_messages"),
        F.count_if(F.col("reject_reason").isNull()).alias("certificates"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("malformed"),
        F.coalesce(
            F.sum(F.when(F.col("reject_reason").isNull(), F.size("all_domains"))), F.lit(0)
        ).alias("hostnames"),
    )
    new = matches.agg(F.count("*").alias("matches_new"))  # one row, as the other
    return read.crossJoin(F.broadcast(new))


def rescore(matches: DataFrame, certificates: DataFrame, scorer: Scorer) -> DataFrame:
    """Every stored match with its score under the current settings.

    The certificate's issuer counts only if the certificate names the host; otherwise the
    stored free-DV flag stands. A brand that is gone, or now owns the host, scores zero
    and keeps its features. Rows are scored once per distinct (fqdn, brand, flag).
    """
    cfg = scorer.cfg
    names = F.transform("all_domains", F.lower)
    named = F.array_contains(names, F.col("fqdn")) | F.array_contains(
        names, F.concat(F.lit("*."), "fqdn")
    )
    certs = certificates.select("cert_sha256", "issuer_org", "all_domains")
    joined = matches.join(certs, "cert_sha256", "left").select(
        *matches.columns,
        F.when(F.coalesce(named, F.lit(False)), is_free_dv(F.col("issuer_org"), cfg))
        .otherwise(F.coalesce("features.free_dv_issuer", F.lit(False)))
        .alias("free_dv"),
    )
    keys = joined.select("fqdn", F.col("brand").alias("wanted"), "free_dv").distinct()
    current = scorer.score(keys, floor=0.0, only_brand="wanted").select(
        "fqdn",
        "brand",
        "free_dv",
        F.col("score").alias("current_score"),
        F.col("features").alias("current_features"),
    )
    new_score = F.coalesce("current_score", F.lit(0.0))
    flag = new_score >= cfg.alert_threshold
    features = F.coalesce("current_features", "features")
    changed = (
        (F.abs(new_score - F.col("score")) > 1e-9)
        | (flag != F.col("is_alert"))
        | ~features.eqNullSafe(F.col("features"))
    )
    return joined.join(current, ["fqdn", "brand", "free_dv"], "left").select(
        *matches.columns,
        new_score.alias("new_score"),
        flag.alias("new_is_alert"),
        features.alias("new_features"),
        changed.alias("changed"),
    )


def score_changes(rescored: DataFrame) -> DataFrame:
    """What a rescore would change."""
    return rescored.where("changed").select(
        "fqdn",
        "brand",
        F.col("score").alias("old_score"),
        "new_score",
        F.col("is_alert").alias("was_alert"),
        F.col("new_is_alert").alias("is_alert"),
        F.col("new_features").alias("features"),
    )


def rescore_summary(rescored: DataFrame) -> DataFrame:
    was, now = F.col("is_alert"), F.col("new_is_alert")
    return rescored.agg(
        F.count("*").alias("checked"),
        F.count_if("changed").alias("changed"),
        F.count_if(now & ~was).alias("now_alerting"),
        F.count_if(was & ~now).alias("no_longer_alerting"),
    )


def rescored_matches(rescored: DataFrame) -> DataFrame:
    """The matches as a rescore leaves them, to be written as a new snapshot."""
    new = {"score": "new_score", "is_alert": "new_is_alert", "features": "new_features"}
    stored = [c for c in rescored.columns if c not in (*new.values(), "changed")]
    return rescored.select(*[F.col(new.get(c, c)).alias(c) for c in stored])
