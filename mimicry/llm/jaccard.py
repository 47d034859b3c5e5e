"""Exact n-gram Jaccard join by partitions of the token universe.

Documents with the same set of word n-grams are one class, joined once. Classes fall into
size bands such that a partner lies in the same band or the next. A band cuts the universe
of n-grams into segments by hash; two sets that are similar enough differ in so few n-grams
that some segment must hold the same subset of both, or subsets that differ in one n-gram
where the segment is also indexed with every one-deletion neighbour. A document is indexed
by a hash of each subset, in its own band and as a probe into the band below.

Costs decide the allocation. A band is given more units (a segment is worth one, with
deletions two) than the largest difference needs; each document may then leave out the
segments most likely to be shared by chance: those with the fewest n-grams that are not
common, which n-grams are common being estimated on a bounded sample. How many segments
have deletions follows from the number of sets in the band. Any allocation gives the same
result; a better one compares fewer sets.

Documents with equal index entries are compared exactly, unless sketches of their sets, some
bits to an n-gram, already differ too much: first each with one of the entry, then with another one of it,
then, in blocks, all pairs that are left across components. So near copies in their thousands
cost a few comparisons each, and no link that joins components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mimicry.llm.common import (
    LOWER,
    chunks,
    likely_among,
    mixed,
    partitions,
    span_hashes,
    stored,
    table,
    text_bytes,
    trimmed,
    words_of,
)
from mimicry.llm.graph import components

NGRAM = 5
PERCENT = 80
# To estimate costs: documents sampled, the share of them from which an n-gram counts as
# common, and the most common ones kept.
SAMPLE = 4_000
COMMON_SHARE = 0.003
COMMON = 65_536
MEETING = 0.2  # what a meeting by chance costs, in index entries
SPARE_BITS, LEAST_BITS = 2, 256  # of a sketch: to each item, and at least
BLOCK = 1_024  # sets of one entry compared at once, on either side
ROUNDS = 1  # more sets of each entry that all others of it are compared with first
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
# Roles of index entries, in the two low bits of a key: the band's own sets come first.
_DELETED, _PROBE = 1, 2


# --- sets ------------------------------------------------------------------------------


@dataclass
class Sets:
    """Distinct hashed n-grams of the texts in a row, sorted within each text."""

    items: np.ndarray
    borders: np.ndarray
    first: np.ndarray  # two sums of hashes that name a set
    second: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.borders)


def sets_of(column: pa.Array, n: int = NGRAM) -> Sets:
    """Words are runs of bytes other than ASCII white space, with A-Z in lower case.

    A text with fewer than n words has all of them as its one item; without words none.
    """
    raw, borders = text_bytes(column)
    data = LOWER[raw]
    words = words_of(data, borders)
    counts = np.diff(words.first)
    rows = len(counts)
    hashes = span_hashes(data, words.starts, words.ends)
    owner = np.repeat(np.arange(rows), counts)
    many = max(0, len(hashes) - n + 1)
    value = np.zeros(many, np.uint64)
    for k in range(n):
        value = mixed(value + hashes[k : k + many] * _ODD[k % len(_ODD)])
    inside = owner[:many] == owner[n - 1 :] if many else np.zeros(0, bool)
    value, value_owner = value[inside], owner[:many][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            at = words.first[:-1][short[has]] + k
            extra[has] = mixed(extra[has] + hashes[at] * _ODD[k % len(_ODD)])
        value = np.concatenate((value, mixed(extra + counts[short].astype(np.uint64))))
        value_owner = np.concatenate((value_owner, short))
    order = np.lexsort((value, value_owner))
    value, value_owner = value[order], value_owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (value_owner[1:] != value_owner[:-1])
    value, value_owner = value[new], value_owner[new]
    at = np.searchsorted(value_owner, np.arange(rows + 1))
    return Sets(value, at, _sum_by(mixed(value), at), _sum_by(mixed(value ^ _ODD[1]), at))


def _sum_by(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return (run[borders[1:]] - run[borders[:-1]]).view(np.int64)


# --- allocation ------------------------------------------------------------------------


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    deletions: int  # segments from the first on that are also indexed with deletions
    units: int


def largest_difference(a: int, b: int, percent: int) -> int:
    """How many items two sets of these sizes can differ in and still be similar."""
    return (100 - percent) * (a + b) // (100 + percent)


def skipped(units: int, size: np.ndarray, percent: int) -> np.ndarray:
    """Units a set of this size may leave out: two sets' shares never take one too many."""
    return np.maximum(0, np.floor((units - 1) / 2 - (100 - percent) * size / (100 + percent)).astype(np.int64))


def bands_of(counts: dict[int, int], loads: np.ndarray, percent: int = PERCENT) -> list[Band]:
    """Bands up to the largest size, with the cheapest allocation found for the sets they hold.

    ``counts`` are numbers of sets by the band's place, ``loads`` rows (items, rare items) of
    sampled sets.
    """
    edges = band_edges(max(counts, default=-1) + 1, percent)
    starts = np.array([low for low, _ in edges], dtype=np.int64)
    place = np.searchsorted(starts, loads[:, 0], side="right") - 1
    out = []
    for i, (low, high) in enumerate(edges):
        own, probes = (
            (counts.get(j, 0), loads[place == j] if (place == j).any() else np.array([[low, low]])) for j in (i, i + 1)
        )
        out.append(min(_allocations(low, high, percent), key=lambda band: _cost(band, own, probes, percent)))
    return out


def _allocations(low: int, high: int, percent: int) -> Iterator[Band]:
    """Allocations that find every similar pair; they differ in spare units and in deletions."""
    partner = high * 100 // percent
    needed = largest_difference(high, partner, percent) + 1
    # The larger partner must have something to leave out as well.
    lean = max(0, math.ceil(2 * (100 - percent) * partner / (100 + percent)) + 1 - needed)
    for spare in (1, 2, 4, 8):
        units = needed + lean + 2 * (1 + needed * spare // 32)
        for deletions in sorted({units // 2 * k // 8 for k in range(9)}):
            yield Band(low, high, units - deletions, deletions, units)


def _cost(band: Band, own: tuple[int, np.ndarray], probes: tuple[int, np.ndarray], percent: int) -> float:
    """Entries of all sets, and the meetings by chance, each worth ``MEETING`` entries.

    By chance meet segments without a rare item that were not left out, and deletions that
    take a segment's only one.
    """
    worth = 1 + band.deletions / band.segments
    entries, bare, single = [], [], []
    for number, loads in (own, probes):
        size, rare = loads[:, 0], loads[:, 1] / band.segments
        left_out = skipped(band.units, size, percent) / worth
        entries.append(number * float((band.segments - left_out + band.deletions * size / band.segments).mean()))
        none = np.exp(-rare)
        bare.append(number * float(np.maximum(0.0, none - left_out / band.segments).mean()))
        single.append(number * float((none * rare).mean()) * band.deletions / band.segments)
    meetings = bare[0] * (bare[0] / 2 + bare[1]) + single[0] * (bare[0] + bare[1]) + bare[0] * single[1]
    return sum(entries) + MEETING * band.segments * meetings


def band_edges(n: int, percent: int) -> list[tuple[int, int]]:
    edges, low = [], 1
    for _ in range(n):
        high = max(low, (low - 1) * 100 // percent)
        edges.append((low, high))
        low = high + 1
    return edges


def band_starts(largest: int, percent: int) -> np.ndarray:
    starts, low = [], 1
    while low <= largest:
        starts.append(low)
        low = max(low, (low - 1) * 100 // percent) + 1
    return np.array(starts, dtype=np.int64)


# --- index -----------------------------------------------------------------------------


def sample_of(docs: DataFrame, total: int) -> DataFrame:
    draw = F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(1_000_000))
    return docs.filter(draw < math.ceil(1_000_000 * min(1.0, SAMPLE / max(1, total))))


def common_items(docs: DataFrame, total: int) -> np.ndarray:
    """The n-grams that many documents hold, sorted, by a seeded sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(sets_of(chunk.column("text")).items.view(np.int64))], names=["item"])

    counted = sample_of(docs, total).mapInArrow(trimmed(run), "item long").groupBy("item").agg(F.count("*").alias("n"))
    least = max(3, math.ceil(COMMON_SHARE * min(SAMPLE, total)))
    rows = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "item").limit(COMMON).collect()
    return np.sort(np.array([r["item"] for r in rows], dtype=np.int64).view(np.uint64))


def loads_of(docs: DataFrame, total: int, common: np.ndarray) -> np.ndarray:
    """(items, rare items) of the sampled documents."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = sets_of(chunk.column("text"))
            rare = np.concatenate(([0], np.cumsum(~_among(sets.items, shared.value))))[sets.borders]
            yield pa.RecordBatch.from_arrays([pa.array(sets.sizes), pa.array(np.diff(rare))], names=["n", "rare"])

    rows = sample_of(docs, total).mapInArrow(trimmed(run), "n long, rare long").collect()
    return np.array([(r["n"], r["rare"]) for r in rows], dtype=np.int64).reshape(-1, 2)


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def entries_of(
    sets: Sets, bands: list[Band], percent: int = PERCENT, common: np.ndarray = np.zeros(0, np.uint64)
) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each): the index entries of every set, role in the two low bits."""
    rare = ~_among(sets.items, common)
    lows = np.array([b.low for b in bands])
    own = np.searchsorted(lows, sets.sizes, side="right") - 1
    keys, rows = [], []
    for role, place in ((0, own), (_PROBE, own - 1)):
        chosen = np.flatnonzero((sets.sizes > 0) & (place >= 0))
        if not len(chosen):
            continue
        plan = [bands[p] for p in place[chosen]]
        if role:  # sets too large for any partner in the band below are left out
            chosen = chosen[[sets.sizes[r] * percent <= b.high * 100 for r, b in zip(chosen, plan, strict=True)]]
            plan = [bands[p] for p in place[chosen]]
        segments = np.array([b.segments for b in plan], dtype=np.int64)
        deletions = np.array([b.deletions for b in plan], dtype=np.int64)
        units = np.array([b.units for b in plan], dtype=np.int64)
        sizes = sets.sizes[chosen]
        base = np.concatenate(([0], np.cumsum(segments)))
        at = np.repeat(np.arange(len(chosen)), sizes)
        place_of = np.repeat(sets.borders[chosen], sizes) + _within(sizes)
        item = sets.items[place_of]
        spread = mixed(item ^ _ODD[2])
        segment = (spread % segments[at].astype(np.uint64)).astype(np.int64)
        cell = base[at] + segment
        count = np.bincount(cell, rare[place_of], minlength=base[-1])
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, cell, spread)
        holder = np.repeat(np.arange(len(chosen)), segments)
        number = _within(segments)
        deep = number < deletions[holder]
        salt = mixed((place[chosen][holder].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
        # Leave out the segments with the fewest rare items, as many units as the size allows.
        order = np.lexsort((number, count, holder))
        worth = 1 + deep[order]
        spent = np.cumsum(worth)
        spent -= np.concatenate(([0], spent))[base[:-1]][holder]
        kept = np.ones(len(order), bool)
        kept[order] = spent > skipped(units, sizes, percent)[holder]
        keys.append(_keyed(total[kept], salt[kept], role))
        rows.append(chosen[holder[kept]])
        deleted = (deep & kept)[cell]
        keys.append(_keyed(total[cell[deleted]] - spread[deleted], salt[cell[deleted]], role + _DELETED))
        rows.append(chosen[at[deleted]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _within(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _keyed(total: np.ndarray, salt: np.ndarray, role: int) -> np.ndarray:
    return ((mixed(total ^ salt) & ~np.uint64(3)) | np.uint64(role)).view(np.int64)


# --- the join --------------------------------------------------------------------------


def sketches(sets: Sets) -> list[bytes]:
    """Whether the items of each set with a hash are odd in number, a bit for each hash: two
    sets differ in as many items at least as their bits do.

    There are ``SPARE_BITS`` to four times as many bits as items, so that what differs rarely
    cancels out; a sketch is cut down to a shorter one by laying its halves over each other.
    """
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(SPARE_BITS * sets.sizes, LEAST_BITS))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(bits)), sets.sizes)
    cell = base[owner] + (mixed(sets.items ^ _ODD[3]) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=base[-1]) & 1).astype(np.uint8)
    packed, at = np.packbits(odd, bitorder="little").tobytes(), base // 8
    return [packed[start:stop] for start, stop in zip(at[:-1], at[1:], strict=True)]


def _laid(rows: list[bytes], size: int) -> np.ndarray:
    """Sketches of ``size`` bytes or some power of two times that, all cut down to ``size``."""
    out = np.empty((len(rows), size // 8), np.uint64)
    lengths = np.array([len(r) for r in rows])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        whole = np.frombuffer(b"".join([rows[i] for i in at]), np.uint64).reshape(len(at), length // size, size // 8)
        out[at] = np.bitwise_xor.reduce(whole, axis=1)
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, first, second, sketch) of rows (doc_id, text): the size and the name of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = sets_of(chunk.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array(sets.sizes),
                    pa.array(sets.first),
                    pa.array(sets.second),
                    pa.array(sketches(sets), pa.binary()),
                ],
                names=["doc_id", "n", "first", "second", "sketch"],
            )

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, first long, second long, sketch binary")


def index(docs: DataFrame, bands: list[Band], percent: int, common: np.ndarray) -> DataFrame:
    """(key, node): the entries of all sets, a set being named by the first of its sums.

    Copies make equal entries. Two sets of one name would only be compared once more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = sets_of(chunk.column("text"))
            keys, rows = entries_of(sets, bands, percent, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets.first[rows])], names=["key", "node"])

    return docs.mapInArrow(trimmed(run), "key long, node long")


def meetings(entries: DataFrame) -> DataFrame:
    """(key, head, node, head_role, role) of entries that stand under one key with others.

    Entries arrive sorted, so a group is a run; only its first entry is remembered.
    """
    spread = entries.repartition(partitions(entries.sparkSession), F.shiftright("key", 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node = 0, 0
        started = False
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            if started:  # the head of the run that may go on
                keys, nodes = np.append(last_key, keys), np.append(last_node, nodes)
            groups = keys >> 2
            opens = np.ones(len(keys), bool)
            opens[1:] = groups[1:] != groups[:-1]
            heads = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), 0))
            met = ~opens & (nodes != nodes[heads])
            started, last_key, last_node = True, keys[heads[-1]], nodes[heads[-1]]
            at = np.flatnonzero(met)
            head = heads[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(groups[at]),
                    pa.array(nodes[head]),
                    pa.array(nodes[at]),
                    pa.array((keys[head] & 3).astype(np.int8)),
                    pa.array((keys[at] & 3).astype(np.int8)),
                ],
                names=["key", "head", "node", "head_role", "role"],
            )

    ordered = spread.sortWithinPartitions("key", "node")
    return ordered.mapInArrow(trimmed(run), "key long, head long, node long, head_role byte, role byte")


def _may_meet(a: str, b: str) -> str:
    """Not both probes, not both deletions."""
    return f"({a} & {b}) = 0"


def verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """(a, b), documents, of the pairs of names whose sets are similar.

    Only the texts of these sets are moved, and from then on only the sets.
    """
    wanted = pairs.select(F.col("a").alias("first")).union(pairs.select(F.col("b").alias("first"))).distinct()
    needed = stored(names.join(wanted.hint("merge"), "first").select("doc_id", "first", "second"), "jaccard-wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = sets_of(chunk.column("text"))
            # An id may stand on several texts.
            same = (chunk.column("first").to_numpy() == found.first) & (chunk.column("second").to_numpy() == found.second)
            own = np.flatnonzero(same)
            items = [found.items[found.borders[i] : found.borders[i + 1]].tobytes() for i in own]
            taken = [chunk.column(c).take(pa.array(own)) for c in ("doc_id", "first")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(items, pa.binary())], names=["node", "first", "items"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                same = int((both[1:] == both[:-1]).sum())
                similar.append(100 * same >= percent * (len(x) + len(y) - same))
            kept = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(kept), batch.column("y").filter(kept)], names=["a", "b"])

    texts = likely_among(docs, "doc_id", needed.select("doc_id")).join(needed.hint("merge"), "doc_id")
    found = texts.mapInArrow(trimmed(sets), "node long, first long, items binary").dropDuplicates(["node", "first"])
    items = stored(found, "jaccard-sets")
    left = items.select(F.col("first").alias("a"), F.col("node").alias("x"), F.col("items").alias("left"))
    right = items.select(F.col("first").alias("b"), F.col("node").alias("y"), F.col("items").alias("right"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("x", "y", "left", "right").mapInArrow(trimmed(compare), "a long, b long")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def links(docs: DataFrame, names: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes that have a partner; ``names`` has one row a class."""
    largest = names.agg(F.max("n")).first()[0] or 0
    place = F.lit(-1)
    for start in band_starts(largest, percent):  # some five bands for each threefold size
        place = place + (F.col("n") >= int(start)).cast("int")
    counts = {r["band"]: r["k"] for r in names.groupBy(place.alias("band")).agg(F.count("*").alias("k")).collect()}
    total = sum(counts.values())
    common = common_items(docs, total)
    bands = bands_of(counts, loads_of(docs, total, common), percent)
    entries = index(docs, bands, percent, common)
    met = stored(meetings(entries), "jaccard-meetings")
    stars = _pairs(met.filter(_may_meet("head_role", "role")), "head", "node")
    stars = stored(plausible(stars, names, percent), "jaccard-stars")
    edges = stored(verified(stars, docs, names, percent), "jaccard-edges")
    found = stored(components(edges), "jaccard-components")

    heads = met.select("key", F.col("head").alias("first"), F.col("head_role").alias("role"))
    members = met.select("key", F.col("node").alias("first"), "role").union(heads).distinct()
    sizes = names.select("first", F.col("doc_id").alias("node"), "n")
    members = stored(members.join(sizes.hint("merge"), "first"), "jaccard-members")
    done = stars
    for turn in range(ROUNDS + 1):
        members = _open(members, found)
        if members.isEmpty():
            return found
        last = turn == ROUNDS
        if last:
            more = across(members, names, percent)
        else:
            more = plausible(_pairs(_one_more(members, turn), "first", "other"), names, percent)
        more = stored(more.distinct().join(done.hint("merge"), ["a", "b"], "left_anti"), "jaccard-more")
        if not more.isEmpty():
            edges = stored(edges.union(verified(more, docs, names, percent)), "jaccard-edges")
            found = stored(components(edges), "jaccard-components")
            done = done.union(more)
        if last:
            return found
    return found


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the entries that hold several components.

    Entries whose members are one component stay so, and need not be looked at again.
    """
    members = members.select("key", "first", "role", "node", "n")
    labelled = members.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("k"))
    keys = parts.groupBy("key").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"))
    keys = keys.filter("k > 2 and k * k > same")
    return stored(labelled.join(keys.select("key", "k").hint("merge"), "key"), "jaccard-rest")


def _one_more(rest: DataFrame, turn: int) -> DataFrame:
    """(first, other): each member with one of its entry, the same one for many entries."""
    draw = F.xxhash64("first", F.lit(turn))
    chosen = rest.groupBy("key").agg(F.min_by(F.struct("first", "role", "component", "n"), draw).alias("o"))
    return (
        rest.join(chosen.hint("merge"), "key")
        .filter(f"component <> o.component and {_may_meet('role', 'o.role')}")
        .select("first", F.col("o.first").alias("other"))
    )


def plausible(pairs: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            shorter = np.array([min(len(i), len(j)) for i, j in zip(x, y, strict=True)], dtype=np.int64)
            apart = np.zeros(len(n), np.int64)
            for size in np.unique(shorter):
                at = np.flatnonzero(shorter == size)
                apart[at] = _apart(*(_laid([rows[i] for i in at], int(size)) for rows in (x, y)))
            kept = pa.array(apart <= (100 - percent) * (n + m) // (100 + percent))
            yield pa.RecordBatch.from_arrays([batch.column("p").filter(kept), batch.column("q").filter(kept)], names=["a", "b"])

    left = names.select(F.col("first").alias("p"), "n", F.col("sketch").alias("x"))
    right = names.select(F.col("first").alias("q"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    named = pairs.select(F.col("a").alias("p"), F.col("b").alias("q"))
    both = named.join(left.hint("merge"), "p").join(right.hint("merge"), "q")
    return both.filter(f"100 * least(n, m) >= {percent} * greatest(n, m)").mapInArrow(trimmed(run), "a long, b long").distinct()


def across(rest: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one entry and different components that sizes and sketches do not rule out.

    An entry's members are cut into blocks, and each two blocks are compared in one place.
    """
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("first", F.lit("block")), blocks).cast("int")
    marked = rest.select("key", "first", "component", "role", "n", blocks.alias("blocks"), own.alias("block"))
    marked = marked.join(names.select("first", "sketch").hint("merge"), "first")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = marked.withColumn("other", other).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("place"),
        (F.col("block") > F.col("other")).alias("right"),
        "first",
        "component",
        "role",
        "n",
        "sketch",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            places = batch.column("place").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(places[1:] != places[:-1]) + 1, [len(places)])) if len(places) else [0]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, stop - start)
                if held and held[0].column("place")[0] != part.column("place")[0]:
                    yield _ruled_in(pa.Table.from_batches(held), percent)
                    held = []
                held.append(part)
        if held:
            yield _ruled_in(pa.Table.from_batches(held), percent)

    spread = dealt.repartition(partitions(rest.sparkSession), "place").sortWithinPartitions("place", "first")
    return spread.mapInArrow(trimmed(run), "a long, b long").distinct()


def _ruled_in(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of the rows that may be similar: left with right, or all if there is no right."""
    first, component, n, role = (rows.column(c).to_numpy() for c in ("first", "component", "n", "role"))
    sketch = rows.column("sketch").to_pylist()
    laid = _laid(sketch, min(map(len, sketch)))
    right = rows.column("right").to_numpy(zero_copy_only=False)
    left, right = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(first)),) * 2
    found = []
    for i in left:
        j = right if left is not right else right[right > i]
        fits = (component[j] != component[i]) & ((role[j] & role[i]) == 0)
        fits &= 100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])
        j = j[fits]
        j = j[_apart(laid[j], laid[i]) <= (100 - percent) * (n[j] + n[i]) // (100 + percent)]
        found.append(np.stack((np.minimum(first[i], first[j]), np.maximum(first[i], first[j]))))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when their sets of word 5-grams have a Jaccard similarity of at least
    ``percent`` hundredths; a component's id is its smallest document's. Null, empty and
    blank texts have an empty set and link with nothing. Rows that repeat an id are linked
    by it. Rows without an id are returned without a component, and no other column is
    read. N-grams are 64-bit hashes, so the chance that a compared pair of sets of 20,000
    is misjudged is below one in ten billion.
    """
    spark_docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    every = stored(classes(spark_docs), "jaccard-classes")
    filled = every.filter("n > 0 and doc_id is not null")
    names = stored(filled.groupBy("n", "first", "second").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")), "jaccard-names")
    # A row without an id has no name here: as the head of an entry it would hide the others' links.
    joined = links(spark_docs.filter("doc_id is not null"), names, percent)
    smallest = (
        names.withColumnRenamed("doc_id", "node")
        .join(joined.hint("merge"), "node", "left")
        .select("n", "first", "second", F.coalesce("component", "node").alias("component"))
    )
    placed = every.join(smallest.hint("merge"), ["n", "first", "second"], "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller id.

    Of rows that repeat an id one stays. Rows without an id stay, as nothing names them.
    """
    found = join(docs, doc_id=doc_id, text=text, percent=percent).filter("doc_id is not null")
    kept = found.groupBy("doc_id").agg(F.min("component_id").alias("component")).filter("doc_id = component")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("row"))
    staying = rows.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first))
    return staying.filter("_nth = 1").select("row.*").union(rows.filter("doc_id is null").select("row.*"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
