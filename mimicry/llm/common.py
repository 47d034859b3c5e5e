"""What the operators of this package share: tables, shared storage, vectorised text helpers.

Text helpers work on the bytes of a whole Arrow batch at once and hash with 64-bit
polynomials over random byte values, so no Python object is made per word. Batches are cut
to about ``CHUNK_BYTES`` of text at row borders; a longer text is a chunk of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one in the warehouse where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files: what they wrote is in ``stored`` tables."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


FILTER_BITS = 1 << 25


def likely_among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` that may have a partner in ``wanted`` (one column of that name).

    A bitmap of hashes, at most ``FILTER_BITS`` bits in rows of 4 KB whatever the input, is
    sent to the rows, so that few of the others are shuffled. It only ever lets too many pass.
    """
    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(FILTER_BITS)) + 1

    bitmaps = wanted.select(place(F.col(column)).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket"))
    bitmaps = bitmaps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bitmap"))
    position = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_position div 8 as int) + 1, 1)")), 16, 10).cast("int")
    placed = df.withColumn("_bucket", F.bitmap_bucket_number(place(F.col(column)))).withColumn("_position", position)
    joined = placed.join(F.broadcast(bitmaps), "_bucket")
    kept = joined.filter(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(_position % 8 as int)) as int)")) != 0)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 borders between them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def trim_memory() -> None:
    """Give back what earlier tasks of this worker process left in its allocators and caches."""
    Powers.up = Powers.down = np.ones(1, dtype=np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """From now on workers get rows in batches of so many at most: a row may be a whole text."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > rows:
        spark.conf.set(setting, str(rows))


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, so that its worker, which waits for its next task beside
    others, holds little before and after."""

    def task(batches: Batches) -> Batches:
        trim_memory()
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return task


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the multiplier and of its inverse, grown to the longest chunk seen."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = np.full(size, _MULTIPLIER), np.full(size, _INVERSE)
            cls.up[0] = cls.down[0] = 1
            cls.up, cls.down = np.cumprod(cls.up), np.cumprod(cls.down)
        return cls.up[:n], cls.down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; equal bytes, equal hash, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = Powers.of(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a chunk in order: byte spans, and ``first[i]:first[i + 1]`` those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, borders: np.ndarray) -> Words:
    """Maximal runs of bytes other than the six ASCII white-space bytes, text by text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(borders), np.int64))
    filled = ~SPACE[data]
    opens = filled.copy()
    opens[1:] &= ~filled[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    opens[inner] = filled[inner]
    closes = filled.copy()
    closes[:-1] &= ~filled[1:]
    closes[inner - 1] = filled[inner - 1]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, borders))
