"""Mixing sources to target weights by capped water-filling, and the seeded sample it takes.

DataFrame and SQL functions only. A source's target is its share of the budget by weight;
no target passes ``max_epochs`` times the source's size, and what a clamped source leaves
goes to the others by weight. Ordered by size over weight the clamped sources come first,
so running sums over the sources give the level at which all others stand.

A source takes each document as often as whole epochs fit its target. The rest goes to its
documents in the order of a seeded hash until the words are used up; the one on the border
gives the words still missing. The order is cut into ``BUCKETS`` ranges of the hash: sums
of the ranges are added up per source, documents only inside their range, so a source that
holds most rows is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mimicry.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
BUCKET_DIGITS = 3  # hexadecimal digits of the hash: 4,096 ranges a source


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("order")


def cyclic_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Give the sources the weights in turn, by code point, null last.

    One window over the sources, a dimension: one row a source, not a document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight).

    Weights must be positive. A source of size 0 gets 0. If all caps together stay below
    the budget, every source stands at its cap.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_epochs
    return (
        sources.withColumn("_budget", F.sum("source_size").over(everything) * share)
        .withColumn("_used", F.coalesce(F.sum(cap).over(earlier), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_left"))
        .withColumn("_level", F.max(F.when(cap > F.col("_level") * F.col("weight"), F.col("_level"))).over(everything))
        .withColumn(
            "target",
            F.least(cap.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), cap).cast("double")),
        )
        .drop("_budget", "_used", "_left", "_level")
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``row``, the document's own columns.

    ``taken`` counts the words the mix takes of a document, repeats included; per source
    they add up to the target, rounded. A null source is a source; a null text has size 0
    and gives nothing; repeated rows are documents of their own. Any other columns only
    travel inside ``row``. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"),
        seeded(F.col(doc_id), seed),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return _take(rows, weights, share, max_epochs)


def _take(rows: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    sized = rows.withColumn("_bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = stored(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    sources = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = water_fill(cyclic_weights(sources, weights), share, max_epochs).drop("weight")
    ranges = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)))
    plan = _same_source(starts.drop("_sum"), targets, [])
    inside = Window.partitionBy("source", "_bucket").orderBy("order", "size", F.xxhash64("row"))
    before = F.col("_start") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - F.col("_epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("_rest") - F.col("_before")))
    return (
        _same_source(sized, plan, ["_bucket"])
        .withColumn("_before", before)
        .withColumn("_epochs", epochs.cast("long"))
        .withColumn("_rest", rest)
        .withColumn("taken", F.col("_epochs") * F.col("size") + part)
        .select("doc_id", "size", "source_size", "target", "taken", "row")
    )


def _same_source(left: DataFrame, right: DataFrame, others: list[str]) -> DataFrame:
    """Join on the source, null equal to null, and on the other columns."""
    keys = ["source", *others]
    right = right.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.col("source").eqNullSafe(F.col("source__r"))
    for k in others:
        on = on & (F.col(k) == F.col(f"{k}__r"))
    return left.join(right, on).drop(*[f"{k}__r" for k in keys])


def repeated(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` as a mix takes them: each row as often as its source's whole epochs, and once
    more up to the place in the seeded order where the source's words are used up.

    The document on the border is taken if at least half of it is. Only ids and sizes are
    ordered; texts stay where they are and look up their source's epochs and border.
    Documents without a word, of which a mix takes nothing, stay once.
    """
    small = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), seeded(F.col(doc_id), seed)
    )
    small = stored(small.withColumn("row", F.struct("source", "order")), "mix-sizes")
    taken = _take(small, weights, share, max_epochs).withColumn(
        "_rest", F.col("taken") - F.floor(F.col("target") / F.col("source_size")) * F.col("size")
    )
    plan = taken.filter("size > 0").groupBy(F.col("row.source").alias("source")).agg(
        F.max(F.floor(F.col("target") / F.col("source_size"))).cast("int").alias("_epochs"),
        F.max(F.when((F.col("_rest") > 0) & (2 * F.col("_rest") >= F.col("size")), F.col("row.order"))).alias("_border"),
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        seeded(F.col(doc_id), seed),
        (words_in(F.col(text)) > 0).alias("_any"),
    )
    plan = plan.withColumnRenamed("source", "source__r")
    copies = F.coalesce("_epochs", F.lit(0)) + F.coalesce(F.col("order") <= F.col("_border"), F.lit(False)).cast("int")
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("source__r")), "left")
        .withColumn("_copies", F.when(F.col("_any"), copies).otherwise(1))
        .filter("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("row.*")
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = docs.select("doc_id", words_in(F.col("text")).alias("size"), "source", seeded(F.col("doc_id"), SEED))
    sizes = stored(sizes.withColumn("row", F.struct("doc_id")), "mix-sizes")
    return _take(sizes, WEIGHTS, SHARE, MAX_EPOCHS).drop("row")


# The same result for an independent engine.
OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (
           ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM s),
t AS (
  SELECT source, source_size,
         least((source_size * 2)::DOUBLE,
               coalesce(max(CASE WHEN source_size * 2 > lvl * weight THEN lvl END) OVER () * weight,
                        source_size * 2)::DOUBLE) AS target
  FROM l),
w AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM w
"""
