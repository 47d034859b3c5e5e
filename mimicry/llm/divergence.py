"""How the sources of a language differ in the terms they use, counted exactly.

The first pass counts for each language in how many documents a term stands; terms in enough
of them are kept. They are dealt by hash into shards, each a minimal perfect hash that stores
its keys, built by Spark tasks. The second pass has the shards as broadcasts of at most
``ROUND_BYTES`` each (more shards, more rounds over the text) and adds up a term's occurrences
in the slot of its group, an array over the slots of a shard for each (language, source). A
task hands its slots on when they pass ``DENSE_BYTES``; arrays of a group meet in streams of
one array's size, first by salt, so that a source that holds most rows is spread.

A group gives each kept term p = 1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V)),
in integers. Sources of a language are compared in tiles of terms and sources: the output has
all pairs, a task one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mimicry.llm.common import LOWER, chunks, stored, table, text_bytes
from mimicry.llm.perfecthash import PerfectHash, key_hashes

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
SHARD_KEYS = 1 << 14  # kept terms in a perfect hash, about
ROUND_BYTES = 96 << 20  # of perfect hashes broadcast at once
DENSE_BYTES = 96 << 20  # of slots a task holds
SALTS = 8
BLOCK_TERMS = 1 << 12  # terms in a tile, about
TILE_SOURCES = 256  # sources in a tile, about
TEXT_BYTES = 4 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[97:123] = _TERM[128:] = True

SHARDS = "lang string, shard int, size int, widths binary, bits binary, borders binary, keys binary"
SLOTS = "lang string, source string, shard int, salt int, size int, slots binary, counts binary"


def _terms(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of a chunk's texts: the number of each among the distinct ones, these, and its text's number."""
    data, borders = text_bytes(column)
    low = LOWER[data]
    inside = _TERM[low]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    ends = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[inside]))]
    ).dictionary_encode()
    text = np.searchsorted(borders, starts, side="right") - 1
    return words.indices.to_numpy().astype(np.int64), words.dictionary, text


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a chunk in which a term stands."""
    for chunk in chunks(batches, "text", TEXT_BYTES):
        codes, terms, text = _terms(chunk.column("text"))
        if not len(codes):
            continue
        lang, langs = _coded(chunk.column("lang"))
        once = np.unique(text * len(terms) + codes)
        pair, n = np.unique(lang[once // len(terms)] * len(terms) + once % len(terms), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(pair // len(terms))), terms.take(pa.array(pair % len(terms))).cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64))],
            ["lang", "term", "n"],
        )


def _keys(langs: pa.Array, terms: pa.Array) -> pa.Array:
    """A language and a term as one key: no term holds a zero byte."""
    return pc.binary_join_element_wise(langs.cast(pa.large_binary()), terms.cast(pa.large_binary()), pa.scalar(b"\0", pa.large_binary()))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _dealt(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("lang"), batch.column("term"))
            shard = _shard_of(key_hashes(keys), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(shard), keys.cast(pa.binary())], ["lang", "shard", "key"])

    return run


def _built(group: pa.Table) -> pa.Table:
    """One shard's keys as a perfect hash."""
    hashed = PerfectHash.build(group.column("key").combine_chunks())
    row = [group.column("lang")[0].as_py(), group.column("shard")[0].as_py(), len(hashed), *hashed.packed()]
    names = ["lang", "shard", "size", "widths", "bits", "borders", "keys"]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def perfect_hashes(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A row for each (language, shard) of the kept (lang, term), and the number of shards of a language."""
    shards = max(1, -(-kept.count() // shard_keys))
    dealt = kept.select("lang", "term").mapInArrow(_dealt(shards), "lang string, shard int, key binary")
    return stored(dealt.groupBy("lang", "shard").applyInArrow(_built, SHARDS), "divergence-hashes"), shards


Shards = dict[tuple[str, int], PerfectHash]


def _loaded(rows: list[tuple]) -> Shards:
    return {(lang, shard): PerfectHash.unpacked(*packed) for lang, shard, *packed in rows}


class _Dense:
    """Slots of the groups a task has met, as arrays over a shard's slots."""

    def __init__(self, shards: Shards, salt: int, limit: int) -> None:
        self.shards, self.salt, self.limit = shards, salt, limit
        self.held: dict[tuple[str, str, int], np.ndarray] = {}
        self.bytes = 0

    def add(self, lang: str, source: str, shard: int, slots: np.ndarray, counts: np.ndarray) -> None:
        key = (lang, source, shard)
        if key not in self.held:
            self.held[key] = np.zeros(len(self.shards[lang, shard]), dtype=np.int64)
            self.bytes += self.held[key].nbytes
        self.held[key][slots] += counts

    def full(self) -> bool:
        return self.bytes > self.limit

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        items = list(self.held.items())
        self.held, self.bytes = {}, 0
        for start in range(0, len(items), 64):
            rows = [(*key, self.salt, *_sparse(dense)) for key, dense in items[start : start + 64]]
            yield _slot_rows(rows)


def _sparse(dense: np.ndarray) -> tuple[int, bytes, bytes]:
    """Size, places and counts of an array, in the narrowest integers."""
    at = np.flatnonzero(dense)
    counts = dense[at]
    return len(dense), at.astype(np.uint32).tobytes() if len(dense) > 1 << 16 else at.astype(np.uint16).tobytes(), (
        counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()
    )


def _add_sparse(dense: np.ndarray, slots: bytes, counts: bytes) -> None:
    at = np.frombuffer(slots, dtype=np.uint32 if len(dense) > 1 << 16 else np.uint16)
    if len(at):
        dense[at] += np.frombuffer(counts, dtype=f"u{len(counts) // len(at)}").astype(np.int64)


def _slot_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["lang", "source", "shard", "salt", "size", "slots", "counts"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _counted(sent: Broadcast, shards: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The second pass: occurrences of kept terms, added up in the slots of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = _loaded(sent.value)
        known = {lang for lang, _ in hashes}
        dense = _Dense(hashes, TaskContext.get().partitionId() % SALTS, limit)
        for chunk in chunks(batches, "text", TEXT_BYTES):
            codes, terms, text = _terms(chunk.column("text"))
            lang, langs = _coded(chunk.column("lang"))
            source, sources = _coded(chunk.column("source"))
            for number, name in enumerate(langs.to_pylist()):
                mine = lang[text] == number
                if name not in known or not mine.any():
                    continue
                pair, n = np.unique(source[text[mine]] * len(terms) + codes[mine], return_counts=True)
                _into_slots(dense, name, sources, terms, shards, pair, n)
                if dense.full():
                    yield from dense.handed_on()
        yield from dense.handed_on()

    return run


def _into_slots(
    dense: _Dense, lang: str, sources: pa.Array, terms: pa.Array, shards: int, pair: np.ndarray, n: np.ndarray
) -> None:
    """Add ``n`` to the slots of the (source, term) numbers in ``pair``, all of one language."""
    used, which = np.unique(pair % len(terms), return_inverse=True)
    asked = terms.take(pa.array(used))
    keys = _keys(pa.array([lang] * len(asked)), asked)
    hashes = key_hashes(keys)
    shard = _shard_of(hashes, shards)
    slot = np.full(len(used), -1, dtype=np.int64)
    for number in np.unique(shard):
        if (lang, number) in dense.shards:
            at = np.flatnonzero(shard == number)
            slot[at] = dense.shards[lang, number].slots(keys.take(pa.array(at)), hashes[at])
    here = np.flatnonzero(slot[which] >= 0)
    if not len(here):
        return
    group = (pair[here] // len(terms)) * shards + shard[which[here]]
    order = np.argsort(group, kind="stable")
    here, group = here[order], group[order]
    for part in np.split(np.arange(len(here)), np.flatnonzero(np.diff(group)) + 1):
        source, number = divmod(int(group[part[0]]), shards)
        rows = here[part]
        dense.add(lang, sources[source].as_py(), number, slot[which[rows]], n[rows])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, int], int, np.ndarray]]:
    """Sums of the arrays of each group and shard, from rows sorted by them."""
    current, salt, dense = None, 0, np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["lang"], row["source"], row["shard"])
            if (key, row["salt"]) != (current, salt):
                if current is not None:
                    yield current, salt, dense
                current, salt, dense = key, row["salt"], np.zeros(row["size"], dtype=np.int64)
            _add_sparse(dense, row["slots"], row["counts"])
    if current is not None:
        yield current, salt, dense


def _met_by_salt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, _, dense in _met(batches):
        yield _slot_rows([(*key, 0, *_sparse(dense))])


def _named(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, term, n) of the slots that counted something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _loaded(sent.value)
        for (lang, source, shard), _, dense in _met(batches):
            at = np.flatnonzero(dense)
            keys = hashes[lang, shard].keys.take(pa.array(at)).cast(pa.large_string())
            terms = pc.utf8_slice_codeunits(keys, len(lang) + 1).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), terms, pa.array(dense[at])],
                ["lang", "source", "term", "n"],
            )

    return run


def _rounds(hashes: DataFrame, limit: int) -> list[list[tuple[str, int]]]:
    """Shards in groups of at most ``limit`` bytes, one shard at least; only names and sizes come here."""
    sizes = hashes.select("lang", "shard", F.expr("length(widths) + length(bits) + length(borders) + length(keys) AS size"))
    rounds: list[list[tuple[str, int]]] = []
    room = 0
    for lang, shard, size in sizes.orderBy("lang", "shard").toLocalIterator():
        if size > room or not rounds:
            rounds.append([])
            room = limit
        rounds[-1].append((lang, shard))
        room -= size
    return rounds


def occurrences(
    docs: DataFrame, kept: DataFrame, shard_keys: int = SHARD_KEYS, round_bytes: int = ROUND_BYTES, dense_bytes: int = DENSE_BYTES
) -> DataFrame:
    """(lang, source, term, n) for each group and kept (lang, term) that occurs in it."""
    spark = docs.sparkSession
    hashes, shards = perfect_hashes(kept, shard_keys)
    parts = []
    for chosen in _rounds(hashes, round_bytes):
        bounds = F.struct("lang", "shard").between(*[F.struct(F.lit(lang), F.lit(shard)) for lang, shard in (chosen[0], chosen[-1])])
        rows = hashes.filter(bounds).select("lang", "shard", "widths", "bits", "borders", "keys").collect()
        sent = spark.sparkContext.broadcast([(r.lang, r.shard, *map(bytes, r[2:])) for r in rows])
        slots = docs.select("lang", "source", "text").mapInArrow(_counted(sent, shards, dense_bytes), SLOTS)
        group = ["lang", "source", "shard"]
        salted = slots.repartition(*group, "salt").sortWithinPartitions(*group, "salt").mapInArrow(_met_by_salt, SLOTS)
        met = salted.repartition(*group).sortWithinPartitions(*group)
        parts.append(stored(met.mapInArrow(_named(sent), "lang string, source string, term string, n long"), "divergence-counts"))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def share(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)) in exact integers."""
    wide = "decimal(27,0)"
    upper = (count + smoothing).cast(wide) * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", upper, (total + terms * smoothing).cast(wide))


def _pair_sums(group: pa.Table) -> pa.Table:
    """What one tile of terms adds to the distances of its sources, in either direction.

    Where neither of two sources has a term, both stand at their bases: the tile of number 0
    counts that for all terms, every tile corrects it for the terms that one of them has.
    """
    told = group.filter(pc.is_null(group.column("term")))
    names = told.column("source").combine_chunks()
    base, tile = told.column("p").to_numpy(), told.column("tile").to_numpy()
    seen = group.filter(pc.is_valid(group.column("term")))
    first, low, high = (group.column(c)[0].as_py() for c in ("block", "low", "high"))
    every = told.column("terms")[0].as_py() if first == 0 else 0
    at = pc.index_in(seen.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    term = seen.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(base[:, None], len(term.dictionary), axis=1)
    shares[at, term.indices.to_numpy()] = seen.column("p").to_numpy()
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    a, b, value = [], [], []
    for i in left:
        others = right[right > i] if low == high else right
        apart = np.abs(shares[others] - shares[i]).sum(axis=1) + (every - shares.shape[1]) * np.abs(base[others] - base[i])
        a.append(np.full(len(others), i))
        b.append(others)
        value.append(apart)
    ends = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b, value)]
    source, other, sums = np.concatenate(ends[:2]), np.concatenate(ends[1::-1]), np.concatenate([ends[2]] * 2)
    lang = pa.array([group.column("lang")[0].as_py()] * len(sums), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(source)), names.take(pa.array(other)), pa.array(sums)], ["lang", "source", "item", "value"])


def _pairs(counts: DataFrame, info: DataFrame, block_terms: int, tile_sources: int) -> DataFrame:
    """(lang, source, item, value): distances of all ordered pairs of sources of a language."""
    tiles = info.groupBy("lang").agg(F.ceil(F.count("*") / tile_sources).cast("int").alias("tiles"))
    placed = info.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    told = placed.select("lang", "source", "tile", "terms", "tiles", F.col("base").alias("p"), F.lit(None).cast("string").alias("term"),
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    seen = counts.join(placed, ["lang", "source"]).select(
        "lang", "source", "tile", "terms", "tiles", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "term",
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"),
    )
    both = told.union(seen).select("lang", "source", "tile", "terms", "p", "term", "block", other)
    both = both.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    sums = both.groupBy("lang", "block", "low", "high").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    *,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    shard_keys: int = SHARD_KEYS,
    round_bytes: int = ROUND_BYTES,
    dense_bytes: int = DENSE_BYTES,
    block_terms: int = BLOCK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each (language, source) that occurs.

    Part ``pair``: every other source of the language by the distance of the two. Part
    ``term``: the ``top`` kept terms that the source uses most beyond its language. Rank 1 is
    the largest value, ties by item in code-point order. Null text, language and source are
    empty strings; an empty text still makes its group occur; every row is a document of its
    own, repeated ones too. A language without kept terms has distances of 0 and no terms. An
    empty table gives an empty result. Columns besides the three play no part.
    """
    rows = docs.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    kept = rows.select("lang", "text").mapInArrow(_documents_with, "lang string, term string, n long")
    kept = stored(kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs), "divergence-kept")
    counts = occurrences(rows, kept, shard_keys, round_bytes, dense_bytes)
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    info = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(size, "lang", "left")
    info = info.fillna(0, ["total", "terms"])
    zero = F.lit(0).cast("long")
    info = stored(info.withColumn("base", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)), "divergence-groups")

    pairs = _pairs(counts, info, block_terms, tile_sources).withColumn("part", F.lit("pair"))
    whole = info.groupBy("lang").agg(F.sum("total").alias("everything"))
    used = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "term")))
    used = used.join(info, ["lang", "source"]).join(whole, "lang")
    excess = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all"), F.col("everything"), F.col("terms"))
    terms = used.select("lang", "source", F.col("term").alias("item"), excess.alias("value"), F.lit("term").alias("part")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns).union(ranked.select(columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


# The same result for an independent engine.
OP13_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
w AS MATERIALIZED (SELECT doc, lang, source, unnest(words) AS term FROM d),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (
  SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (n.total + 5 * v.terms) AS p
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t.total) + 5 * any_value(v.terms)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total FROM n GROUP BY lang) t USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
       LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
