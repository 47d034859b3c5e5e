"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mimicry.llm.common import stored

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it reaches.

    Each round points a node's larger neighbours, then its smaller ones, to the smallest
    neighbour. A node with many neighbours costs one partial minimum a task, and one side
    of a join that Spark can split. Rounds are written to the shared folder, so none is run
    twice; their number grows with the logarithm of the nodes. Should they not settle within
    ``ROUNDS``, the job fails; unsettled components are never returned.
    """
    now = stored(_larger_first(edges), "components")
    done = 0
    while not _is_forest_of_stars(now):
        if done == ROUNDS:
            raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
        now = stored(_small_star(_large_star(now)), "components")
        done += 1
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node points to one other, and none that points is pointed to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.filter("out > 1 or (out > 0 and in > 0)").isEmpty()


def _larger_first(edges: DataFrame) -> DataFrame:
    kept = edges.filter("a <> b")
    return kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
