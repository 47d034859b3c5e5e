"""The closest pair of captures of a site, one from each of two sides.

Captures of a site are points of two colours on a line, and the closest pair of points of
different colour is always adjacent. Points are merged per instant, adjacent ones are
compared inside one-minute chunks, and chunk ends are compared with the next chunk's
start. No pairs are enumerated, and a site holding a third of all captures is spread over
its minutes: a task never sees more than one minute of a site, or one row per minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK_US = 60_000_000


def _pair(left: Column, right: Column) -> list[Column]:
    """Both ways of pairing two points, NULL where a side or a time is missing."""
    gap = F.abs(right["at"] - left["at"])
    options = []
    for a, b in ((left["a"], right["b"]), (right["a"], left["b"])):
        pair = F.struct(gap.alias("gap_us"), a.alias("first"), b.alias("second"))
        options.append(F.when(a.isNotNull() & b.isNotNull() & gap.isNotNull(), pair))
    return options


def closest_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(fqdn, first_id, second_id, gap_us) for each host both sides captured.

    Both inputs hold (fqdn, capture_id, captured_at). Equal gaps go to the lowest ids.
    """
    sides = [
        side.select(
            "fqdn",
            F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at"),
            *[
                (F.col("capture_id") if name == mine else F.lit(None).cast("bigint")).alias(name)
                for name in ("a", "b")
            ],
        )
        for side, mine in ((first, "a"), (second, "b"))
    ]
    best = nearest(sides[0].unionByName(sides[1])).where("best IS NOT NULL")
    return best.select(
        "fqdn",
        F.col("best.first").alias("first_id"),
        F.col("best.second").alias("second_id"),
        "best.gap_us",
    )


def nearest(captures: DataFrame) -> DataFrame:
    """(fqdn, best, has_a, has_b) for each host of ``captures`` (fqdn, at, a, b).

    ``at`` is in microseconds; ``a`` and ``b`` are what a capture is to either side, NULL
    if it is not of that side: any type that starts with an id, whose order breaks ties.
    ``best`` is (gap_us, first, second), NULL where no two captures with a time meet.
    """
    points = (
        captures.groupBy("fqdn", "at")
        .agg(F.min("a").alias("a"), F.min("b").alias("b"))
        .select(
            "fqdn",
            F.floor(F.col("at") / _CHUNK_US).alias("chunk"),
            F.struct("at", "a", "b").alias("point"),
        )
    )
    point = F.col("point")
    inside = Window.partitionBy("fqdn", "chunk").orderBy("point.at")
    compared = points.withColumn("before", F.lag("point").over(inside)).withColumn(
        "best", F.least(*_pair(F.col("before"), point), _pair(point, point)[0])
    )
    chunks = compared.groupBy("fqdn", "chunk").agg(
        F.min_by("point", "point.at").alias("head"),
        F.max_by("point", "point.at").alias("tail"),
        F.min("best").alias("best"),
        F.bool_or(F.col("point.a").isNotNull()).alias("has_a"),
        F.bool_or(F.col("point.b").isNotNull()).alias("has_b"),
    )
    along = Window.partitionBy("fqdn").orderBy("chunk")
    joined = chunks.withColumn("before", F.lag("tail").over(along)).withColumn(
        "best", F.least("best", *_pair(F.col("before"), F.col("head")))
    )
    return joined.groupBy("fqdn").agg(
        F.min("best").alias("best"),
        F.bool_or("has_a").alias("has_a"),
        F.bool_or("has_b").alias("has_b"),
    )
