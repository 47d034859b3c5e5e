"""Alarms over health events: silence, repeated failures, a level held too long.

Windows are tumbling and aligned, evaluated over event time. The aggregations work on
streams as well as tables. Silence has no events to aggregate: over a table it is a step
over the calendar, over a stream a timer of each source that fires as the watermark passes
a window's end, whether or not anything arrived.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The alarms' periods and limits.
SILENCE_WINDOW = "10 minutes"
FAILURE_WINDOW, FAILURE_LIMIT = "30 minutes", 3
LEVEL_WINDOW, LEVEL_LIMIT, LEVEL_PERIODS = "5 minutes", 80.0, 3
WATERMARK = "1 hour"


def windowed(
    df: DataFrame, at: str, width: str, watermark: str | None = WATERMARK, /, **figures: Column
) -> DataFrame:
    """(window_start, figures...) per tumbling window of event time."""
    timed = df.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming and watermark:
        timed = timed.withWatermark(at, watermark)
    grouped = timed.groupBy(F.window(at, width).alias("w"))
    named = [value.alias(name) for name, value in figures.items()]
    return grouped.agg(*named).select(F.col("w.start").alias("window_start"), *figures)


def event_counts(events: DataFrame, at: str = "at", width: str = SILENCE_WINDOW) -> DataFrame:
    return windowed(events, at, width, events=F.count("*"))


def silent_windows(
    counts: DataFrame,
    start: Column,
    end: Column,
    width: str = SILENCE_WINDOW,
    period: DataFrame | None = None,
) -> DataFrame:
    """Windows from ``start`` up to ``end`` without any event. Missing data is a breach.

    ``start`` and ``end`` may be aggregates over ``period``, by default ``counts`` itself; a
    source that is silent throughout needs a period that does not come from its events. The
    calendar is numbered in parallel, however long it is.
    """
    step = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    first, last, seconds = (counts if period is None else period).agg(
        F.unix_seconds(start), F.unix_seconds(end), step
    ).first()
    if first is None:  # no events to take a period from
        first, last = 0, -1
    numbers = counts.sparkSession.range(first, last + 1, seconds)
    calendar = numbers.select(F.timestamp_seconds("id").alias("window_start"))
    return calendar.join(counts.where("events >= 1"), "window_start", "left_anti")


def failure_windows(
    cycles: DataFrame,
    at: str = "at",
    failed: str = "failed",
    width: str = FAILURE_WINDOW,
    limit: int = FAILURE_LIMIT,
) -> DataFrame:
    """Windows with at least ``limit`` failed cycles."""
    failures = F.sum(F.col(failed).cast("int"))
    return windowed(cycles, at, width, failures=failures).where(F.col("failures") >= limit)


def level_means(
    samples: DataFrame, at: str = "at", level: str = "level", width: str = LEVEL_WINDOW
) -> DataFrame:
    return windowed(samples, at, width, mean=F.avg(level))


def sustained_levels(
    means: DataFrame,
    limit: float = LEVEL_LIMIT,
    periods: int = LEVEL_PERIODS,
    width: str = LEVEL_WINDOW,
) -> DataFrame:
    """Last windows of ``periods`` consecutive ones whose means all exceed ``limit``.

    Each high window votes for the periods that could end after it; a period with all
    votes alarms. One aggregation, no ordering of the whole series.
    """
    high = means.where(F.col("mean") > limit)
    votes = high.select(
        F.explode(
            F.array(
                *[
                    F.col("window_start") + F.expr(f"INTERVAL {width}") * step
                    for step in range(periods)
                ]
            )
        ).alias("window_start")
    )
    return votes.groupBy("window_start").agg(F.count("*").alias("votes")).where(
        F.col("votes") == periods
    ).select("window_start")


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds_of(width: str) -> int:
    """The seconds of an interval such as ``10 minutes``."""
    number, unit = width.split()
    return int(number) * _UNITS[unit.lower().removesuffix("s")]


def sustained_level_alarms(
    samples: DataFrame,
    at: str = "at",
    level: str = "level",
    limit: float = LEVEL_LIMIT,
    periods: int = LEVEL_PERIODS,
    width: str = LEVEL_WINDOW,
    watermark: str = WATERMARK,
) -> DataFrame:
    """As :func:`sustained_levels` over :func:`level_means`, over a table or a stream.

    Two aggregations, one behind the other: the windows with a high mean are counted in
    sliding windows of ``periods`` widths. On a stream a row appears once the watermark has
    passed its window's end; samples that come later are left out.
    """
    means = windowed_spans(samples, at, width, watermark, mean=F.avg(level))
    step = seconds_of(width)
    high = means.where(F.col("mean") > limit)
    spans = high.groupBy(
        F.window(F.window_time("span"), f"{step * periods} seconds", f"{step} seconds").alias("whole")
    ).agg(F.count(F.lit(1)).alias("high"))
    last = F.col("whole.end") - F.make_dt_interval(secs=F.lit(step))
    return spans.where(F.col("high") == periods).select(last.alias("window_start"))


def windowed_spans(df: DataFrame, at: str, width: str, watermark: str, /, **figures: Column) -> DataFrame:
    """(span, figures...) per tumbling window, its span still usable as event time."""
    timed = df.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark(at, watermark)
    return timed.groupBy(F.window(at, width).alias("span")).agg(*[v.alias(n) for n, v in figures.items()])


class _Silence(StatefulProcessor):
    """Windows of one source: those with events that are not judged yet, and the next to judge."""

    def __init__(self, width_ms: int) -> None:
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "number bigint")
        self.busy = handle.getMapState("busy", "number bigint", "events bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events: dict[int, int] = {}
        first = None
        for row in rows:
            number = row.at_ms // self.width
            first = number if first is None else min(first, number)
            if row.is_event:
                events[number] = events.get(number, 0) + 1
        if not self.next.exists():
            self.next.update((first,))
            self.handle.registerTimer((first + 1) * self.width)
        due = self.next.get()[0]
        for number, n in events.items():
            if number >= due:
                before = self.busy.getValue((number,))[0] if self.busy.containsKey((number,)) else 0
                self.busy.updateValue((number,), (before + n,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due, passed = self.next.get()[0], timerValues.getCurrentWatermarkInMs() // self.width
        busy = {k[0] for k in self.busy.keys()}
        for number in range(due, passed):
            if number not in busy:
                yield Row(source=key[0], window_ms=number * self.width)
        for number in busy:
            if number < passed:
                self.busy.removeKey((number,))
        self.next.update((max(due, passed),))
        self.handle.registerTimer((max(due, passed) + 1) * self.width)

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as timers need; others as configured."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def silence_alarms(
    beats: DataFrame,
    source: str = "source",
    at: str = "at",
    is_event: Column | None = None,
    width: str = SILENCE_WINDOW,
    watermark: str = WATERMARK,
) -> DataFrame:
    """(source, window_start) of the windows in which a source of the stream was silent.

    A source is on duty from the window of its first row on. Rows that are not ``is_event``
    only register it, so that one that never sends anything is heard of. A window is judged
    once the watermark, which all sources drive, has passed its end; events older than the
    watermark do not count. The state of a source is its windows beyond the watermark. Needs
    the RocksDB state store (:func:`rocksdb`).
    """
    event = F.lit(True) if is_event is None else is_event
    timed = beats.select(F.col(source).cast("string").alias("source"), F.col(at).cast("timestamp").alias("at"), event.alias("is_event"))
    timed = timed.withWatermark("at", watermark).withColumn("at_ms", F.unix_millis("at"))
    silent = timed.groupBy("source").transformWithState(
        statefulProcessor=_Silence(seconds_of(width) * 1000),
        outputStructType="source string, window_ms bigint",
        outputMode="append",
        timeMode="EventTime",
    )
    return silent.select("source", F.timestamp_millis("window_ms").alias("window_start"))
