"""Splitting hosts at their public suffix.

One broadcast hash join per rule depth (at most five or six small lookups) instead of
exploding each host into its suffixes: the host rows are never shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.functions.hostnames import is_ipv4
from mimicry.session import session_key
from mimicry.sources.suffixes import rules_by_depth

# Full stops other than the ASCII one that end a hostname.
_TRAILING_DOTS = ".。．｡"


def _netloc(host: Column) -> Column:
    """The host part of text that may carry userinfo, a port or a path."""
    text = F.regexp_replace(host, r"[/?#].*$", "")
    text = F.substring_index(F.substring_index(text, "@", -1), ":", 1)
    return F.rtrim(F.btrim(text, F.lit(" \t\n")), F.lit(_TRAILING_DOTS))


def _last_labels(name: Column, count: Column) -> Column:
    return F.call_function("substring_index", name, F.lit("."), -count)


_LOOKUPS: dict[tuple[str, int, bool], dict[int, DataFrame]] = {}


def _lookups(spark: SparkSession, include_private: bool) -> dict[int, DataFrame]:
    """Per rule depth, one row per rule text with its exact and its wildcard reading.

    Built once per session as local relations: planning a split reads nothing.
    """
    key = (*session_key(spark), include_private)
    if key not in _LOOKUPS:
        _LOOKUPS[key] = {
            depth: _lookup(spark, rules, f"__d{depth}")
            for depth, rules in rules_by_depth(spark, include_private).items()
        }
    return _LOOKUPS[key]


def _lookup(spark: SparkSession, rules: list[tuple[str, int, int, bool]], tag: str) -> DataFrame:
    table: dict[str, dict[str, int | bool | str]] = {}
    for rule, labels, rank, private in rules:
        form = "wide" if labels > rule.count(".") + 1 else "tight"
        row = table.setdefault(rule, {"rule": rule})
        row |= {f"{form}_labels": labels, f"{form}_rank": rank, f"{form}_private": private}
    fields = {"rule": "string"}
    for form in ("tight", "wide"):
        fields |= {f"{form}_labels": "int", f"{form}_rank": "int", f"{form}_private": "boolean"}
    frame = pd.DataFrame([{f: row.get(f) for f in fields} for row in table.values()], dtype=object)
    flat = spark.createDataFrame(frame, ", ".join(f"{f} {t}" for f, t in fields.items()))
    options = [
        F.when(
            F.col(f"{form}_labels").isNotNull(),
            F.struct(
                F.col(f"{form}_rank").alias("rank"),
                F.col(f"{form}_labels").alias("labels"),
                F.col(f"{form}_private").alias("is_private"),
            ),
        ).alias(f"{tag}_{form}")
        for form in ("tight", "wide")
    ]
    return flat.select(F.col("rule").alias(f"{tag}_rule"), *options)


def split_hosts(df: DataFrame, host: str = "fqdn", include_private: bool = False) -> DataFrame:
    """Add ``subdomain``, ``domain``, ``suffix``, ``registered_domain``, ``on_private_suffix``.

    All are NULL for hosts without a known public suffix (IP addresses, single labels);
    ``registered_domain`` is also NULL where the host is nothing but a suffix. Unless
    ``include_private`` is set, only ICANN rules count, so a site on a shared platform
    belongs to the platform's domain.
    """
    spark = df.sparkSession
    name = F.col("__name")
    size = F.col("__size")
    out = df.withColumn(
        "__name",
        F.when(F.col(host).rlike(r"[/?#@:\s。．｡]"), _netloc(F.col(host))).otherwise(F.col(host)),
    ).withColumn(
        "__size",
        F.when(is_ipv4(name), F.lit(0)).otherwise(
            F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1
        ),
    )
    options = []
    helper: list[str] = ["__name", "__size", "__best", "__labels"]
    for depth, lookup in _lookups(spark, include_private).items():
        tag = f"__d{depth}"
        key = F.when(size >= depth, F.substring_index(name, ".", -depth))
        out = out.join(F.broadcast(lookup), key == F.col(f"{tag}_rule"), "left")
        options += [F.col(f"{tag}_tight"), F.when(size > depth, F.col(f"{tag}_wide"))]
        helper += [f"{tag}_rule", f"{tag}_tight", f"{tag}_wide"]
    out = out.withColumn("__best", F.greatest(*options)).withColumn(
        "__labels", F.col("__best.labels")
    )
    labels = F.col("__labels")
    has_domain = size > labels
    registered = _last_labels(name, labels + 1)
    domain = F.when(has_domain, F.nullif(F.substring_index(registered, ".", 1), F.lit("")))
    rest = F.length(name) - F.length(registered) - 1
    return (
        out.withColumn("suffix", F.when(labels.isNotNull(), _last_labels(name, labels)))
        .withColumn("domain", domain)
        .withColumn("registered_domain", F.when(F.col("domain").isNotNull(), registered))
        .withColumn(
            "subdomain",
            F.when(
                F.col("domain").isNotNull(),
                F.when(rest > 0, F.substr(name, F.lit(1), rest)).otherwise(F.lit("")),
            ),
        )
        .withColumn("on_private_suffix", F.coalesce(F.col("__best.is_private"), F.lit(False)))
        .drop(*helper)
    )
