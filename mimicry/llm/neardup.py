"""Near duplicates of embeddings by randomised-rotation binary codes.

A unit vector is turned by a random rotation (into more dimensions than it has) and kept as
the signs of its coordinates, together with its inner product with those signs. Signs and
factor give an unbiased estimate of the vector's inner product with any other, with a
confidence bound; only pairs whose upper bound reaches the threshold are computed exactly.

Which pairs are looked at: centres picked from a bounded sample cut the sphere into cells.
A vector is indexed in its nearest cell and looks into its ``PROBES`` nearest ones. Cells
are cut into blocks on both sides, so no task holds more than two blocks of one cell, however
many vectors it has. A pair that finds itself from both sides is counted in one place only.
Equal vectors are one class throughout, with a number of its own, as an id may stand on
several vectors. Tasks return sums of links and a spanning forest of their links, never all
pairs. Without probes there is one cell and no bound is trusted: every pair is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import stored, table
from mimicry.llm.graph import components

THRESHOLD = 0.9
CODE_BITS = 256  # at least; vectors of more dimensions get as many bits
CONFIDENCE = 3.0  # in units of the estimate's spread: the bound fails about once in 400
PROBES = 8
PER_CELL = 64  # vectors a centre stands for, while there are fewer than MAX_CENTRES
MAX_CENTRES = 16_384
SAMPLE = 32_768  # vectors the centres are picked from, at most about this many
APART = 0.8  # centres are less similar than this
BLOCK = 2_048


def usable(embedding: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """Rows take a vector to max(CODE_BITS, dims) coordinates and keep inner products."""
    bits = max(CODE_BITS, -(-dims // 8) * 8)
    turned, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((bits, dims)))
    return turned.T


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, inner product of each vector with its scaled signs)."""
    turned = units @ rotation(units.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(
    codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, confidence: float = CONFIDENCE
) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products (index, query), and half the width of each row's interval."""
    turned = (queries @ rotation(queries.shape[1])).astype(np.float32)
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    products = signs @ turned.T / np.float32(math.sqrt(bits))
    spread = np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors / math.sqrt(bits - 1)
    width = confidence * spread if math.isfinite(confidence) else np.full(len(factors), math.inf)
    return products / factors[:, None].astype(np.float32), width


def _units(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def centres(classes: DataFrame, dims: int, total: int) -> np.ndarray:
    """Directions picked from a seeded sample, no two of them close to each other."""
    wanted = max(1, min(MAX_CENTRES, total // PER_CELL))
    draw = F.pmod(F.xxhash64("vec_id", F.lit("centres")), F.lit(1_000_000))
    share = min(1.0, SAMPLE / total, 4.0 * wanted / total + 64 / total)
    rows = classes.filter(draw < math.ceil(1_000_000 * share)).orderBy("vec_id", "embedding").limit(2 * SAMPLE).select("embedding").collect()
    picked = np.zeros((0, dims))
    sample = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, dims)
    sample /= np.abs(sample).max(axis=1, keepdims=True) if len(sample) else 1
    sample /= np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else 1
    for start in range(0, len(sample), 256):
        for vector in sample[start : start + 256]:
            if len(picked) < wanted and not (len(picked) and (picked @ vector).max() >= APART):
                picked = np.vstack((picked, vector))
    return picked if len(picked) else np.eye(1, dims)


def assign(classes: DataFrame, dims: int, centre: np.ndarray, probes: int) -> DataFrame:
    """Each class with its cells, nearest first, its code and its factor."""
    shared = classes.sparkSession.sparkContext.broadcast(centre)
    probes = min(probes, len(centre))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                units = _units(batch.column("embedding"), dims)
                near = units @ shared.value.T
                cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                cells = np.take_along_axis(cells, np.argsort(-np.take_along_axis(near, cells, 1), axis=1), 1)
                codes, factors = encode(units)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node"),
                        batch.column("vec_id"),
                        batch.column("weight"),
                        pa.array(list(units), pa.list_(pa.float64())),
                        pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(factors),
                    ],
                    names=["node", "vec_id", "weight", "unit", "cells", "code", "factor"],
                )

    schema = "node long, vec_id long, weight long, unit array<double>, cells array<int>, code binary, factor double"
    return classes.mapInArrow(run, schema)


def _blocks(counts: DataFrame) -> Column:
    """Blocks of a cell by its number of rows; there are at most as many cells as centres."""
    rows = [(r["cell"], -(-r["n"] // BLOCK)) for r in counts.collect() if r["n"] > BLOCK]
    entries = [F.lit(x) for row in rows for x in row]
    looked_up = F.element_at(F.create_map(*entries), F.col("cell")) if entries else F.lit(None)
    return F.coalesce(looked_up, F.lit(1)).cast("int")


def compare(placed: DataFrame, threshold: float, confidence: float) -> DataFrame:
    """(node, vec_id, links, root, root_vec_id): sums of links found, and edges that span them."""
    keyed = placed.withColumn("draw", F.xxhash64("node", F.lit("block")))
    members = keyed.withColumn("cell", F.element_at("cells", 1)).withColumn("asks", F.lit(False))
    askers = keyed.withColumn("cell", F.explode("cells")).withColumn("asks", F.lit(True))
    of_members = _blocks(members.groupBy("cell").agg(F.count("*").alias("n")))
    of_askers = _blocks(askers.groupBy("cell").agg(F.count("*").alias("n")))

    def dealt(rows: DataFrame, own: Column, other: Column, mine: str, theirs: str) -> DataFrame:
        return rows.withColumn(mine, F.pmod("draw", own).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), other - 1))
        )

    kept = ["cell", "member_block", "asker_block", "asks", "node", "vec_id", "weight", "unit", "cells", "code", "factor"]
    both = dealt(members, of_members, of_askers, "member_block", "asker_block").select(kept)
    both = both.union(dealt(askers, of_askers, of_members, "asker_block", "member_block").select(kept))

    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        cell = rows.column("cell")[0].as_py()
        member, asker = (_Side(rows.take(pa.array(np.flatnonzero(asks == side)))) for side in (False, True))
        a, b = _pairs(member, asker, cell, threshold, confidence)
        nodes, places = np.unique(np.concatenate((member.nodes[a], asker.nodes[b])), return_index=True)
        ids = np.concatenate((member.ids[a], asker.ids[b]))[places]
        x, y = np.searchsorted(nodes, member.nodes[a]), np.searchsorted(nodes, asker.nodes[b])
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, x, asker.weights[b])
        np.add.at(links, y, member.weights[a])
        root = _roots(len(nodes), x, y)
        return pa.table({"node": nodes, "vec_id": ids, "links": links, "root": nodes[root], "root_vec_id": ids[root]})

    schema = "node long, vec_id long, links long, root long, root_vec_id long"
    return both.groupBy("cell", "member_block", "asker_block").applyInArrow(run, schema)


class _Side:
    def __init__(self, rows: pa.Table):
        self.nodes = rows.column("node").to_numpy()
        self.ids = rows.column("vec_id").to_numpy()
        self.weights = rows.column("weight").to_numpy()
        n = len(self.ids)
        self.units = rows.column("unit").combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))
        self.cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))
        self.codes = np.array([np.frombuffer(c, np.uint8) for c in rows.column("code").to_pylist()]) if n else np.zeros((0, 0))
        self.factors = rows.column("factor").to_numpy()


def _pairs(
    member: _Side, asker: _Side, cell: int, threshold: float, confidence: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of linked pairs, each pair in this one place of all that see it."""
    if not len(member.ids) or not len(asker.ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    guess, width = estimates(member.codes, member.factors, asker.units, confidence)
    a, b = np.nonzero(guess + width[:, None] >= threshold)
    near = np.zeros(len(a), bool)
    for start in range(0, len(a), 1 << 16):
        part = slice(start, start + (1 << 16))
        near[part] = np.einsum("ij,ij->i", member.units[a[part]], asker.units[b[part]]) >= threshold
    a, b = a[near], b[near]
    home = asker.cells[b, 0]
    mirrored = (member.cells[a] == home[:, None]).any(axis=1)
    ids, others = member.ids[a], asker.ids[b]
    before = (ids < others) | ((ids == others) & (member.nodes[a] < asker.nodes[b]))
    here = np.where(home == cell, before, ~mirrored | (cell < home))
    return a[here], b[here]


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place each place reaches by the pairs (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    probes: int | None = PROBES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows without an id, and vectors that are null, empty, zero or hold a null or a value
    that is not finite, link with nothing; vectors of different lengths do not link. Rows
    with equal vectors link with each other. Rows with one id and different vectors are
    vectors of their own, with links of their own. No other column is read. ``probes`` is
    the number of cells a vector looks into; None compares every pair exactly, in blocks,
    which costs the square of the vectors.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    fine = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    equal = fine.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    classes = stored(equal.withColumn("node", F.monotonically_increasing_id()), "embedding-classes")
    found = None
    sizes = classes.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy("dims").collect()
    for size in sizes:
        own = classes.filter(F.size("embedding") == size["dims"])
        centre = np.eye(1, size["dims"]) if probes is None else centres(own, size["dims"], size["n"])
        placed = stored(assign(own, size["dims"], centre, probes or 1), "embedding-cells")
        part = stored(compare(placed, threshold, math.inf if probes is None else CONFIDENCE), "embedding-links")
        found = part if found is None else found.union(part)
    if found is None:
        alone = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
        return alone.select("vec_id", "n_links", "component_id", F.col("vec_id").isNotNull().alias("kept"))
    # Nodes are ordered by id first, so that the smallest node of a component has its smallest id.
    joined = components(
        found.select(
            F.struct("vec_id", "node").alias("a"),
            F.struct(F.col("root_vec_id").alias("vec_id"), F.col("root").alias("node")).alias("b"),
        )
    ).select("node.node", F.col("component.vec_id").alias("component"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.join(links.hint("merge"), "node", "left")
        .join(joined.hint("merge"), "node", "left")
        .select(
            F.col("embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    keyed = rows.withColumn("fine", F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    placed = keyed.filter("fine").join(known.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    alone = keyed.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = placed.union(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
