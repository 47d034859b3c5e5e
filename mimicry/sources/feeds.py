"""URL feeds: one URL per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.config import Brand
from mimicry.functions.hostnames import is_valid_hostname, url_host, url_scheme
from mimicry.session import computed_once
from mimicry.sources.lines import read_lines


def read_url_feed(spark: SparkSession, path: str | list[str], source: str) -> DataFrame:
    lines = read_lines(spark, path).withColumnRenamed("value", "url")
    return feed_entries(lines, source)


def feed_entries(lines: DataFrame, source: str) -> DataFrame:
    """(fqdn, url, source): the first usable http(s) URL of each host.

    ``lines`` holds ``url`` text and an ordering column ``arrival``. The first URL is an
    aggregate, so a host listed millions of times is reduced before the shuffle.
    """
    url = F.btrim(F.col("url"), F.lit(" \t\r\n"))
    usable = (
        lines.select(url.alias("url"), "arrival")
        .where((F.col("url") != "") & ~F.col("url").startswith("#"))
        .where(url_scheme(F.col("url")).isin("http", "https"))
    )
    hosts = computed_once(usable, fqdn=url_host(F.col("url")))
    valid = hosts.where(F.col("fqdn").isNotNull() & is_valid_hostname(F.col("fqdn")))
    return valid.groupBy("fqdn").agg(F.min_by("url", "arrival").alias("url")).withColumn(
        "source", F.lit(source)
    )


def brand_for_url(url: Column, brands: Sequence[Brand]) -> Column:
    """The first brand whose token occurs anywhere in the URL, or NULL.

    Deliberately plain: it selects what the scorer is measured on, so it must not use it.
    """
    text = F.lower(url)
    mentions = []
    for brand in brands:
        hit = F.lit(False)
        for token in brand.tokens:
            hit = hit | text.contains(token)
        mentions.append(F.when(hit, F.lit(brand.name)))
    return F.coalesce(*mentions, F.lit(None).cast("string"))


def entries_naming_brands(entries: DataFrame, brands: Sequence[Brand]) -> DataFrame:
    """Entries that mention a brand. Hosts are already unique: their first URL decides."""
    return entries.withColumn("brand", brand_for_url(F.col("url"), brands)).where(
        "brand IS NOT NULL"
    )
