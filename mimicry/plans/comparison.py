"""Captures of the same sites from two vantage points, and feed listings against matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimicry.functions.hostnames import url_host
from mimicry.functions.rounding import ratio
from mimicry.functions.text import normalised_title
from mimicry.operators.domains import split_hosts
from mimicry.operators.pairing import nearest
from mimicry.operators.queues import if_set
from mimicry.operators.signals import has_login_form

MAX_GAP_HOURS = 6.0


_DETAILS = (
    "captured_at", "status", "http_status", "final_host", "title", "has_login_form", "verdict"
)


def load_sides(
    captures: DataFrame, verdicts: DataFrame, first: str, second: str, backend: str | None = None
) -> DataFrame:
    """Captures of two vantage points with their newest verdict (by time) that is no error.

    One scan serves both; ``in_first`` and ``in_second`` tell the sides.
    """
    both = captures.where(F.col("vantage").isin(first, second))
    usable = verdicts.where((F.col("label") != "error") & if_set("backend", backend))
    newest = usable.groupBy("capture_id").agg(
        F.max_by("label", F.struct("classified_at", "verdict_id")).alias("verdict")
    )
    return both.join(newest, "capture_id", "left").select(
        (F.col("vantage") == first).alias("in_first"),
        (F.col("vantage") == second).alias("in_second"),
        "fqdn",
        "capture_id",
        "captured_at",
        "status",
        "http_status",
        url_host(F.col("final_url")).alias("final_host"),
        F.col("signals.title").alias("title"),
        has_login_form(F.col("signals")).alias("has_login_form"),
        "verdict",
    )


def _differences() -> dict[str, Column]:
    def differs(name: str) -> Column:
        return ~F.col(f"first.{name}").eqNullSafe(F.col(f"second.{name}"))

    titles = normalised_title(F.col("first.title")) != normalised_title(F.col("second.title"))
    return {
        "http status": differs("http_status"),
        "final site": differs("final_host"),
        "login form": differs("has_login_form"),
        "title": titles,
    }


def compare_sides(
    first: DataFrame, second: DataFrame, max_gap_hours: float = MAX_GAP_HOURS
) -> DataFrame:
    """``compare_captures`` of two frames, each holding one side's captures."""
    flagged = [
        side.withColumn("in_first", F.lit(mine)).withColumn("in_second", F.lit(not mine))
        for side, mine in ((first, True), (second, False))
    ]
    return compare_captures(flagged[0].unionByName(flagged[1]), max_gap_hours)


def compare_captures(sides: DataFrame, max_gap_hours: float = MAX_GAP_HOURS) -> DataFrame:
    """One row per site either side captured, with how its two closest captures differ.

    ``state`` is ``pair``, ``too far apart``, ``only first`` or ``only second``. The details
    travel with the captures through the search for the closest two, which also tells who
    captured a site at all, so the captures are read once. Captures without a time pair
    with none.
    """
    details = F.struct("capture_id", *_DETAILS)
    found = nearest(
        sides.select(
            "fqdn",
            F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at"),
            F.when(F.col("in_first"), details).alias("a"),
            F.when(F.col("in_second"), details).alias("b"),
        )
    )
    gap = F.col("best.gap_us")
    state = (
        F.when(~F.col("has_b"), F.lit("only first"))
        .when(~F.col("has_a"), F.lit("only second"))
        .when(gap <= int(max_gap_hours * 3_600_000_000), F.lit("pair"))
        .otherwise(F.lit("too far apart"))
    )
    out = found.select(
        "fqdn",
        state.alias("state"),
        F.col("best.first.capture_id").alias("first_id"),
        F.col("best.second.capture_id").alias("second_id"),
        gap.alias("gap_us"),
        *[
            F.when(state == "pair", F.struct(*[F.col(f"best.{name}.{d}") for d in _DETAILS])).alias(name)
            for name in ("first", "second")
        ],
    )
    up = {name: F.col(f"{name}.status") == "ok" for name in ("first", "second")}
    both_up = up["first"] & up["second"]
    content = F.array_compact(
        F.array(*[F.when(both_up & test, F.lit(name)) for name, test in _differences().items()])
    )
    verdicts = F.col("first.verdict") != F.col("second.verdict")
    compared = out.select(
        "fqdn",
        "state",
        "first_id",
        "second_id",
        "gap_us",
        "first",
        "second",
        F.coalesce(up["first"] != up["second"], F.lit(False)).alias("unreachable_on_one_side"),
        content.alias("content_differences"),
        F.coalesce(verdicts, F.lit(False)).alias("different_verdict"),
    )
    differs = (
        F.col("unreachable_on_one_side")
        | (F.size("content_differences") > 0)
        | F.col("different_verdict")
    )
    return compared.withColumn("differs", differs)


def comparison_summary(compared: DataFrame) -> DataFrame:
    state = F.col("state")
    return compared.agg(
        F.count_if(state == "pair").alias("pairs"),
        F.count_if(state == "too far apart").alias("too_far_apart"),
        F.count_if(state == "only first").alias("only_first"),
        F.count_if(state == "only second").alias("only_second"),
        F.count_if("unreachable_on_one_side").alias("unreachable_on_one_side"),
        F.count_if(F.size("content_differences") > 0).alias("different_content"),
        F.count_if("different_verdict").alias("different_verdict"),
        F.count_if("differs").alias("differing"),
    )


def first_listings(entries: DataFrame) -> DataFrame:
    """(fqdn, listed_on): the earliest listing of each host."""
    return entries.groupBy("fqdn").agg(F.min("labelled_at").alias("listed_on"))


def feed_detection(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """What our scoring did with every feed listing, and when.

    A listing is found by its own host, or by its registered domain unless it sits on a
    shared platform. The two ways are two equality joins over pre-aggregated matches, not
    one join with an OR. Listings from before the first match have ``outcome`` NULL.
    """
    split = split_hosts(first_listings(entries), "fqdn", include_private=True)
    listed = split.select(
        "fqdn",
        "listed_on",
        F.col("on_private_suffix").alias("shared_platform"),
        F.when(
            ~F.col("on_private_suffix"),
            F.when(
                F.col("suffix").isNotNull(), F.coalesce("registered_domain", F.col("fqdn"))
            ).otherwise(F.col("fqdn")),
        ).alias("registered"),
    )

    def seen_by(key: str, name: str) -> DataFrame:
        return matches.groupBy(F.col(key).alias(f"{name}_key")).agg(
            F.bool_or("is_alert").alias(f"{name}_alert"),
            F.min("first_seen_at").alias(f"{name}_seen"),
            F.min(F.when(F.col("is_alert"), F.col("first_seen_at"))).alias(f"{name}_alerted"),
        )

    started = matches.agg(F.min("first_seen_at").cast("date").alias("since"))
    alerted = F.coalesce(F.greatest("host_alert", "domain_alert"), F.lit(None).cast("boolean"))
    first_alert = F.least("host_alerted", "domain_alerted")
    flagged = F.coalesce(first_alert, F.least("host_seen", "domain_seen"))
    found = (
        listed.join(seen_by("fqdn", "host"), F.col("fqdn") == F.col("host_key"), "left")
        .join(
            seen_by("registered_domain", "domain"),
            F.col("registered") == F.col("domain_key"),
            "left",
        )
        .crossJoin(F.broadcast(started))  # one row
    )
    monitored = F.coalesce(F.col("listed_on") >= F.col("since"), F.lit(False))
    outcome = (
        F.when(~monitored, F.lit(None).cast("string"))
        .when(alerted, F.lit("alerted"))
        .when(~alerted, F.lit("matched"))
        .when(F.col("shared_platform"), F.lit("out of reach"))
        .otherwise(F.lit("not seen"))
    )
    flagged_on = flagged.cast("date")
    timing = (
        F.when(~monitored | flagged_on.isNull(), F.lit(None).cast("string"))
        .when(flagged_on < F.col("listed_on"), F.lit("before the listing day"))
        .when(flagged_on == F.col("listed_on"), F.lit("on the listing day"))
        .otherwise(F.lit("after the listing day"))
    )
    return found.select(
        "fqdn",
        "listed_on",
        "shared_platform",
        outcome.alias("outcome"),
        F.when(monitored, flagged).alias("first_flagged"),
        timing.alias("timing"),
    )


def detection_summary(detected: DataFrame) -> DataFrame:
    """Counts by outcome and timing, and the shares of what was within reach."""
    outcome, timing = F.col("outcome"), F.col("timing")

    def alerted_when(text: str) -> Column:
        return F.count_if((outcome == "alerted") & (timing == text))

    counts = detected.agg(
        F.count_if(outcome.isNull()).alias("listed_before_monitoring"),
        F.count_if(outcome.isNotNull()).alias("sites"),
        F.count_if(outcome == "out of reach").alias("out_of_reach"),
        F.count_if(outcome.isNotNull() & (outcome != "out of reach")).alias("in_reach"),
        F.count_if(outcome == "alerted").alias("alerted"),
        F.count_if(outcome == "matched").alias("matched"),
        F.count_if(outcome == "not seen").alias("not_seen"),
        alerted_when("before the listing day").alias("alerted_before"),
        alerted_when("on the listing day").alias("alerted_same_day"),
        alerted_when("after the listing day").alias("alerted_after"),
    )
    reach = F.col("in_reach")
    return counts.withColumns(
        {f"{name}_share": ratio(F.col(name), reach, 3) for name in ("alerted", "matched", "not_seen")}
    )
