"""Uncertainty of the evaluation: bootstrap intervals and the exact McNemar test."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from mimicry.operators.metrics import macro_metrics

# Resamples, seed and confidence of the reported intervals.
RESAMPLES = 10_000
SEED = 20261019
CONFIDENCE = 0.95


def bootstrap_metrics(
    counts: DataFrame, resamples: int = RESAMPLES, seed: int = SEED
) -> DataFrame:
    """Accuracy and macro F1 of each resample.

    Drawing n sites with replacement and counting them by cell is one multinomial draw
    over the confusion cells, so a resample costs a few cells however many sites there
    are. A draw follows from the seed and the numbers of its resample and cell alone, so the
    result does not depend on how the resamples are spread over tasks.
    """
    spark = counts.sparkSession
    packed = counts.agg(
        F.array_sort(F.collect_list(F.struct("expected", "predicted", "n"))).alias("cells")
    )
    tasks = max(1, min(resamples, spark.sparkContext.defaultParallelism * 4))
    numbered = spark.range(0, resamples, 1, tasks).withColumnRenamed("id", "resample")
    sampled = (
        numbered.crossJoin(F.broadcast(packed))  # one row
        .where(F.size("cells") > 0)
        .withColumn("drawn", _drawn(seed, F.col("resample"), F.col("cells")))
        .select("resample", F.explode(F.arrays_zip("cells", "drawn")).alias("cell"))
        .select(
            "resample",
            F.col("cell.cells.expected").alias("expected"),
            F.col("cell.cells.predicted").alias("predicted"),
            F.col("cell.drawn").alias("n"),
        )
        .where("n > 0")
    )
    return macro_metrics(sampled, ["resample"]).select("resample", "accuracy", "macro_f1")


def _uniform(seed: int, resample: Column, cell: Column) -> Column:
    """A number between 0 and 1, both excluded, that only the resample and the cell decide."""
    told = F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), cell.cast("string"))
    return (F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _log_factorial(k: Column) -> Column:
    """Stirling's series from k + 9 on, less the eight factors in between."""
    k = k.cast("double")
    z = k + 9
    between = reduce(lambda a, b: a * b, [k + i for i in range(1, 9)])
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(between)


def binomial_quantile(u: Column, n: Column, p: Column) -> Column:
    """The smallest number of hits in ``n`` draws whose cumulated chance reaches ``u``.

    Chances are added up from nine deviations below the mean to nine above; what lies outside
    is less than a double resolves. Each follows from the one before.
    """
    mean, spread = n * p, 9 * F.sqrt(n * p * (1 - p)) + 9
    low = F.greatest(F.lit(0).cast("bigint"), F.floor(mean - spread))
    high = F.least(n, F.ceil(mean + spread))
    first = F.exp(
        _log_factorial(n) - _log_factorial(low) - _log_factorial(n - low) + low * F.log(p) + (n - low) * F.log(1 - p)
    )
    start = F.struct(
        F.lit(0.0).alias("sum"), first.alias("chance"), p.alias("p"), n.alias("n"), u.alias("u"), F.lit(-1).cast("bigint").alias("at")
    )

    def step(acc: Column, x: Column) -> Column:
        reached = acc["sum"] + acc["chance"]
        return F.struct(
            reached.alias("sum"),
            (acc["chance"] * (acc["n"] - x) / (x + 1) * acc["p"] / (1 - acc["p"])).alias("chance"),
            acc["p"].alias("p"), acc["n"].alias("n"), acc["u"].alias("u"),
            F.when((acc["at"] < 0) & (reached >= acc["u"]), x).otherwise(acc["at"]).alias("at"),
        )

    found = F.aggregate(F.sequence(low, high), start, step, lambda acc: acc["at"])
    return F.when(p >= 1, n).when(found < 0, high).otherwise(found)


def _drawn(seed: int, resample: Column, cells: Column) -> Column:
    """How often each cell is drawn, in the cells' order: a binomial draw out of what is left."""
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(cells, zero, lambda acc, c: acc + c["n"])
    start = F.struct(
        total.alias("draws"), total.alias("sites"), F.lit(0).alias("place"), F.array().cast("array<bigint>").alias("drawn")
    )

    def step(acc: Column, cell: Column) -> Column:
        part = cell["n"].cast("double") / acc["sites"]
        hits = binomial_quantile(_uniform(seed, resample, acc["place"]), acc["draws"], part)
        return F.transform(F.array(hits), lambda h: F.struct(
            (acc["draws"] - h).alias("draws"), (acc["sites"] - cell["n"]).alias("sites"), (acc["place"] + 1).alias("place"),
            F.concat(acc["drawn"], F.array(h)).alias("drawn"),
        ))[0]

    return F.aggregate(cells, start, step, lambda acc: acc["drawn"])


def percentile_bounds(resamples: int, confidence: float = CONFIDENCE) -> tuple[int, int]:
    """0-based order statistics of the middle part of the resampled values."""
    tail = (1 - confidence) / 2
    return int(resamples * tail), min(resamples - 1, int(resamples * (1 - tail)))


def bootstrap_intervals(
    counts: DataFrame, resamples: int = RESAMPLES, seed: int = SEED
) -> DataFrame:
    """(metric, low, high) of accuracy and macro F1.

    The order statistics are read off the running count per distinct value. Values are
    rounded to four places, so there are at most 10,001 of them whatever the resamples.
    """
    low, high = percentile_bounds(resamples)
    values = bootstrap_metrics(counts, resamples, seed).select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")),
            )
        ).alias("v")
    )
    frequency = values.groupBy("v.metric", "v.value").agg(F.count("*").alias("n"))
    ordered = frequency.groupBy("metric").agg(
        F.array_sort(F.collect_list(F.struct("value", "n"))).alias("steps")
    )
    return ordered.select(
        "metric", _order_statistic(low).alias("low"), _order_statistic(high).alias("high")
    )


def _order_statistic(index: int) -> Column:
    """The value at a 0-based position of the sorted values."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("at"))
    walked = F.aggregate(
        "steps",
        start,
        lambda acc, step: F.struct(
            (acc["seen"] + step["n"]).alias("seen"),
            F.when(acc["at"].isNull() & (acc["seen"] + step["n"] > index), step["value"])
            .otherwise(acc["at"])
            .alias("at"),
        ),
    )
    return walked["at"]


def discordant_counts(answers: DataFrame, models: list[str]) -> DataFrame:
    """Per pair of models, the shared sites and those only one of them got right.

    ``answers`` holds (fqdn, model, is_right). Each site's answers become one row by
    aggregation; the pairs are the configured models' only, not the data's.
    """
    answer = [
        F.max(F.when(F.col("model") == m, F.col("is_right"))).alias(f"m{i}")
        for i, m in enumerate(models)
    ]
    sites = answers.where(F.col("model").isin(*models)).groupBy("fqdn").agg(*answer)
    pairs = list(combinations(range(len(models)), 2))
    sums = []
    for i, j in pairs:
        first, second = F.col(f"m{i}"), F.col(f"m{j}")
        sums.append(
            F.struct(
                F.lit(models[i]).alias("model_a"),
                F.lit(models[j]).alias("model_b"),
                F.count_if(first & ~second).alias("only_a"),
                F.count_if(second & ~first).alias("only_b"),
                F.count_if(first.isNotNull() & second.isNotNull()).alias("shared"),
            )
        )
    return sites.agg(F.array(*sums).alias("pairs")).select(F.inline("pairs"))


def mcnemar_exact(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact p-value of a split at least this lopsided under a fair coin.

    The tail is summed in units of its largest term, whose logarithm comes from
    log-gamma sums, so no count is too large. The sum runs from the largest term down;
    terms below a double's resolution of it change nothing.
    """
    return _mcnemar(only_a.cast("bigint"), only_b.cast("bigint"))


@pandas_udf(T.DoubleType())
def _mcnemar(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    return pd.Series([_tail(int(a), int(b)) for a, b in zip(only_a, only_b, strict=True)])


def _tail(only_a: int, only_b: int) -> float:
    from math import exp, lgamma, log

    total, smaller = only_a + only_b, min(only_a, only_b)
    if total == 0:
        return 1.0
    largest = lgamma(total + 1) - lgamma(smaller + 1) - lgamma(total - smaller + 1)
    term = relative = 1.0
    for k in range(smaller, 0, -1):
        term *= k / (total - k + 1)
        relative += term
        if term < relative * 1e-18:
            break
    return min(1.0, 2 * relative * exp(largest - total * log(2)))


def paired_tests(answers: DataFrame, models: list[str]) -> DataFrame:
    """Every pair of models with its discordant counts and p-value."""
    counts = discordant_counts(answers, models)
    return counts.withColumn("p_value", mcnemar_exact(F.col("only_a"), F.col("only_b")))
