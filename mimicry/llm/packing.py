"""Best-fit packing of tokenised documents into sequences of bounded length.

The instance is small whatever the corpus: pieces are told apart by length alone, so the
solver sees a histogram of at most ``capacity`` counts. It first fixes small sets that
dominate every other way to fill a bin (Martello and Toth), then packs what is left by
best fit, longest first. The result is a plan of *runs*: ``bins`` sequences filled alike,
of which each slot takes the next pieces of one length. Pieces find their slot by their
rank within the length.
"""

from __future__ import annotations

import contextlib
import os
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mimicry.llm.common import LOWER, chunks, partitions, span_hashes, stored, table, text_bytes, trimmed

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Rows of one (shard, length) group are numbered in one task; shards grow with the input.
PIECES_PER_SHARD = 20_000


# --- the solver ------------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """``bins`` sequences, each holding pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    bins: int


def solve(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs that hold every piece of the histogram, by reduction and best fit."""
    left = {length: n for length, n in histogram.items() if n > 0}
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def reduce_dominated(left: dict[int, int], capacity: int) -> list[Run]:
    """Fix sets that dominate all others with their longest piece; takes them off ``left``.

    With ``room`` beside the longest piece and the other pieces at hand:
    nothing fits: the piece stands alone. One piece fills the room, or no two fit: the
    largest that fits joins it. At most two fit: the largest that fits joins it if it is
    as long as any two that fit; or the best pair, if its longer one is the largest that
    fits and no fitting pair has a longer shorter one. Fixing a set only takes choices
    from the rest, so it is repeated until one of its lengths runs out.
    """
    runs: list[Run] = []
    changed = True
    while changed:
        changed = False
        for longest in sorted(left, reverse=True):
            while left.get(longest) and (others := _dominating(left, longest, capacity - longest)) is not None:
                chosen = (longest, *others)
                need = {x: chosen.count(x) for x in chosen}
                bins = min(left[x] // n for x, n in need.items())
                for x, n in need.items():
                    left[x] -= bins * n
                    if not left[x]:
                        del left[x]
                runs.append(Run(chosen, bins))
                changed = True
    return runs


def _dominating(left: dict[int, int], longest: int, room: int) -> tuple[int, ...] | None:
    """What joins one piece of ``longest``, or None where nothing is known to dominate."""

    def count(x: int) -> int:
        return left.get(x, 0) - (x == longest)

    lengths = sorted(x for x in left if x <= room and count(x) > 0)
    if not lengths:
        return ()
    largest = lengths[-1]
    smallest: list[int] = []
    for x in lengths[:3]:
        smallest += [x] * min(3, count(x))
    if largest == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (largest,)
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        return None
    pairs = [(x, y) for x in lengths if (y := _partner(lengths, count, x, room)) is not None]
    if not pairs:
        return (largest,)
    best = max(pairs, key=lambda p: (sum(p), max(p)))
    if largest >= sum(best):
        return (largest,)
    shorter = max(min(p) for p in pairs)
    fitting = [y for y in lengths if largest + y <= room and (y != largest or count(y) > 1)]
    if fitting and fitting[-1] >= shorter:
        return (largest, fitting[-1])
    return None


def _partner(lengths: Sequence[int], count, x: int, room: int) -> int | None:
    """The longest piece that fits beside ``x``."""
    at = bisect_right(lengths, room - x) - 1
    if at >= 0 and lengths[at] == x and count(x) < 2:
        at -= 1
    return lengths[at] if at >= 0 else None


def best_fit(left: dict[int, int], capacity: int) -> list[Run]:
    """Longest first into the fullest bin with room; bins filled alike move together."""
    open_bins: dict[int, list[Run]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, run: Run) -> None:
        if room not in open_bins or not open_bins[room]:
            at = bisect_left(rooms, room)
            if at == len(rooms) or rooms[at] != room:
                rooms.insert(at, room)
        open_bins[room].append(run)

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(todo, each)
                for n, bins in ((each, full), (rest, 1)):
                    if n and bins:
                        put(capacity - n * length, Run((length,) * n, bins))
                break
            room = rooms[at]
            run = open_bins[room].pop()
            if not open_bins[room]:
                del rooms[at]
            each = room // length
            full, rest = min(run.bins, todo // each), 0
            if full < run.bins:
                rest = todo - full * each if todo - full * each < each else 0
            untouched = run.bins - full - (rest > 0)
            if full:
                put(room - each * length, Run(run.lengths + (length,) * each, full))
            if rest:
                put(room - rest * length, Run(run.lengths + (length,) * rest, 1))
            if untouched:
                put(room, Run(run.lengths, untouched))
            todo -= full * each + rest
    return [run for runs in open_bins.values() for run in runs]


def plan_rows(runs: Sequence[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first sequence, offset) of every slot of every run."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            rows.append((length, ranks[length], ranks[length] + run.bins, sequence, offset))
            ranks[length] += run.bins
            offset += length
        sequence += run.bins
    return rows


# --- tokens ----------------------------------------------------------------------------

LEARNT = 4_096  # words that the tokenizer sees at once
TEXT_BYTES = 1 << 20  # of text encoded at once
_SPACE, _LETTER, _DIGIT, _MARK, _JOINED = range(5)
_CLASS = np.full(256, _JOINED, dtype=np.uint8)
_CLASS[:128] = _MARK
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[11, 12, 28, 29, 30, 31, ord("'")]] = _JOINED
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER


class WordTokens:
    """Token ids of texts, looked up by word; the tokenizer sees each new word once.

    A text is cut only where this tokenizer cuts as well: at white space, between an ASCII
    letter, digit and mark, and between two digits. Not beside an apostrophe (contractions)
    or a byte beyond ASCII. Texts with a special token's opening are encoded whole. Words
    are known by a 64-bit hash: sorted arrays of hashes and slots, some 30 bytes a word with
    its ids. Beyond ``max_bytes`` the store is emptied.
    """

    def __init__(self, path: str, max_bytes: int = 20 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_bytes = max_bytes
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _bytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.slots, self.flat, self.ends))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 where it is not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slots[at], -1).astype(np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        parts, sizes = [self.flat], []
        for start in range(0, len(words), LEARNT):  # what the tokenizer returns is large
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[start : start + LEARNT], add_special_tokens=False)]
            sizes += map(len, found)
            parts.append(np.fromiter((x for ids in found for x in ids), self.flat.dtype, sum(map(len, found))))
        n = len(self.slots)
        self.flat = np.concatenate(parts)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)))
        known = np.concatenate((self.hashes, hashes))
        order = np.argsort(known, kind="stable")
        self.hashes = known[order]
        self.slots = np.concatenate((self.slots, np.arange(n, n + len(words), dtype=np.int32)))[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the borders between texts."""
        raw, borders = text_bytes(column)
        data, kinds = LOWER[raw], _CLASS[raw]
        filled = kinds != _SPACE
        cut = np.ones(len(data), dtype=bool)
        apart = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        cut[1:] = ~filled[:-1] | (apart & (kinds[1:] != _JOINED) & (kinds[:-1] != _JOINED))
        cut[borders[:-1][borders[:-1] < len(data)]] = True
        starts = np.flatnonzero(filled & cut)
        stops = np.append(cut[1:] | ~filled[1:], True) if len(data) else cut
        ends = np.flatnonzero(filled & stops) + 1
        codes, unique = pd.factorize(span_hashes(data, starts, ends))
        if self._bytes() > self.max_bytes:
            self._clear()
        slots = self._find(unique)
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.full(len(unique), -1, dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            text = data.tobytes()
            self._learn(unique[new], [text[starts[j] : ends[j]].decode() for j in where[new].tolist()])
            slots = self._find(unique)
        slot = slots[codes] if len(codes) else np.zeros(0, np.int64)
        sizes = self.ends[slot + 1] - self.ends[slot]
        after = np.cumsum(sizes)
        at = np.repeat(self.ends[slot] - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)
        ids = self.flat[at].astype(np.uint32)
        counts = np.concatenate(([0], after))[np.searchsorted(starts, borders)]
        return self._special(raw, borders, ids, counts)

    def _special(self, raw, borders, ids, counts):
        text = raw.tobytes()
        if b"<|" not in text:
            return ids, counts
        parts = []
        for i in range(len(borders) - 1):
            part = text[borders[i] : borders[i + 1]]
            if b"<|" in part:
                parts.append(np.asarray(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(ids[counts[i] : counts[i + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Texts that are read inside reach the workers in batches of so many rows at most."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


_STORES: dict[str, WordTokens] = {}


def _word_tokens(path: str | None) -> WordTokens:
    """One store per worker process, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _STORES:
        _STORES[path] = WordTokens(path)
    return _STORES[path]


def pieces(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator: int = 0,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: documents as ids plus the separator, cut only beyond ``capacity``.

    A null or empty text is the separator alone. ``tokenizer_path`` names the vocabulary
    on every machine; without it the installed public one is used.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _word_tokens(tokenizer_path)
        for chunk in chunks(batches, "text", TEXT_BYTES):
            ids, borders = store.encode(chunk.column(1))
            owner, number, starts, sizes, sums = [], [], [], [], []
            for i in range(chunk.num_rows):
                own = np.append(ids[borders[i] : borders[i + 1]], np.uint32(separator)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    owner.append(i)
                    number.append(k)
                    starts.append(start)
                    sizes.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        trimmed(cut), PIECES
    )


# --- the job ---------------------------------------------------------------------------


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (``doc_id, piece, start, length, ids_crc32``) a sequence and an offset.

    Pieces of one length are numbered shard by shard: a count per (shard, length), running
    sums of those over the shards, and a row number inside each (shard, length). Shards are
    dealt by a hash of the piece, so one length held by a third of all pieces is spread over
    all shards. Equal rows may swap numbers, which changes nothing.
    """
    spark = cut.sparkSession
    total = cut.count()
    shards = max(partitions(spark), -(-total // PIECES_PER_SHARD))
    sharded = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = stored(sharded.groupBy("_shard", "length").agg(F.count("*").alias("_n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan_rows(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_shard", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        sharded.join(bases.hint("merge"), ["_shard", "length"])  # grows with the input: never broadcast
        .withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1)
        .select(*cut.columns, "_rank")
    )
    return _seat(spark, ranked, rows)


def _seat(spark: SparkSession, ranked: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Look up each piece's slot in the plan, whose size depends on the capacity alone."""
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for row in rows:
        by_length[row[0]].append(row)
    slots = {
        length: tuple(np.asarray(column, dtype=np.int64) for column in zip(*own, strict=True))
        for length, own in by_length.items()
    }
    shared = spark.sparkContext.broadcast(slots)
    names = [c for c in ranked.columns if c != "_rank"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                _, lows, _, firsts, offsets = shared.value[int(length)]
                at = np.searchsorted(lows, ranks[own], side="right") - 1
                sequence[own] = firsts[at] + ranks[own] - lows[at]
                offset[own] = offsets[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator: int = 0,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null ids are
    kept, null texts count as empty, repeated rows are packed once each, other columns are
    ignored, an empty table gives an empty result.
    """
    cut = pieces(
        docs, doc_id=doc_id, text=text, capacity=capacity, separator=separator, tokenizer_path=tokenizer_path
    )
    with small_batches(docs.sparkSession):
        cut = stored(cut, "packing-pieces")
    return place(cut, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
