"""Removal of repeated byte strings by suffix arrays of shards.

Equal strings meet in one shard because of what they contain: of the ``ANCHOR`` bytes that
start at each place of a window of ``length`` bytes, the one with the smallest hash is the
window's anchor, and equal windows have equal anchors at equal places. Windows that follow
each other with the same anchor are one run; a run's bytes are its passage. Passages whose
anchor stands nowhere else hold no repeated window. Equal passages are one, and every window
of a passage that stands twice is repeated. What remains, different passages around one
anchor, is put into shards, and the shard's suffix array, by external induced sorting, tells
which windows of one passage also stand in another.

All passages of an anchor go to the shard of its owner, the smallest document it stands in.
So near copies share their owner, and passages of a text that follow each other under one
owner are one, which spares most of their overlap. An owner with more than a shard's bytes
is split by its anchors. An anchor with more different passages than a shard may hold goes
to no shard: each of its windows is a row with its hash, and equal ones meet in a join.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mimicry.llm.common import (
    _BYTE_VALUES,
    Powers,
    chunks,
    likely_among,
    mixed,
    partitions,
    span_hashes,
    stored,
    table,
    text_batches,
    text_bytes,
    trim_memory,
    trimmed,
)
from mimicry.llm.induced import repeated

LENGTH = 200
ANCHOR = 24
SHARD_BYTES = 2 << 20
DEALT_BYTES = 1 << 19  # of passages that are compared together, about; one owner's or anchor's stay together
TEXT_BYTES = 1 << 19  # of text at a time: hashes of its windows take some fifty times as much
CHAIN = 16  # passages joined into one at most
_PLACE_BITS = np.uint64(28)


# --- runs ------------------------------------------------------------------------------


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each place on."""
    up, down = Powers.of(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    n = len(data) - width + 1
    return mixed((sums[width:] - sums[:n]) * down[:n])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values, from running minima of blocks both ways."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, borders: np.ndarray, length: int, anchor: int = ANCHOR):
    """(row, first window, windows, anchor hash, passage hash) of the runs of all texts."""
    nothing = np.zeros(0, np.int64)
    rows, starts, counts, anchors = [nothing], [nothing], [nothing], [np.zeros(0, np.uint64)]
    for row in np.flatnonzero(np.diff(borders) >= length):
        own = data[borders[row] : borders[row + 1]]
        hashes = _rolling(own, anchor)
        ranked = ((hashes >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_least(ranked, length - anchor + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        rows.append(np.full(len(first), row))
        starts.append(first)
        counts.append(np.diff(np.append(first, len(place))))
        anchors.append(hashes[place[first]])
    row, start, count = map(np.concatenate, (rows, starts, counts))
    at = borders[row] + start
    return row, start, count, np.concatenate(anchors), span_hashes(data, at, at + count + length - 1)


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, passage, doc_id, version, start, windows) of rows (doc_id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", TEXT_BYTES):
            data, borders = text_bytes(chunk.column("text"))
            row, start, count, anchor, passage = runs_of(data, borders, length)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(passage.view(np.int64)),
                    chunk.column("doc_id").take(taken),
                    chunk.column("version").take(taken),
                    pa.array(start),
                    pa.array(count),
                ],
                names=["anchor", "passage", "doc_id", "version", "start", "windows"],
            )

    return docs.mapInArrow(trimmed(run), "anchor long, passage long, doc_id long, version long, start long, windows long")


# --- shards ----------------------------------------------------------------------------


def shard_spans(passages: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of different passages, the spans of its bytes that also stand elsewhere here.

    The text is the passages with a mark after each; a window holds no mark.
    """
    sizes = np.array([len(p) for p in passages], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\x00".join([*passages, b""]), dtype=np.uint8).astype(np.int32) + 2
    text[ends - 1] = 1
    with tempfile.TemporaryDirectory() as folder:
        found = repeated(text, length, folder)
    out = []
    for start, size in zip(ends - sizes - 1, sizes, strict=True):
        windows = np.flatnonzero(found[start : start + size - length + 1])
        cut = np.flatnonzero(np.diff(windows) > length) + 1
        out.append([(int(w[0]), int(w[-1]) + length) for w in np.split(windows, cut) if len(w)])
    return out


def chained(texts: DataFrame, length: int) -> DataFrame:
    """(shard, doc_id, version, start, body): passages to compare, joined where they may be.

    Rows are (doc_id, version, text, runs). Joining reaches over a gap shorter than the
    overlap it saves; the windows in the gap stand in other shards as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", TEXT_BYTES):
            data, borders = text_bytes(chunk.column("text"))
            runs = chunk.column("runs")
            flat = runs.flatten()
            shard, start, windows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("shard", "start", "windows"))
            goes = flat.field("goes").to_numpy(zero_copy_only=False).astype(bool)
            owner = np.repeat(np.arange(chunk.num_rows), np.diff(runs.offsets.to_numpy()))
            order = np.flatnonzero(goes)
            order = order[np.lexsort((start[order], owner[order]))]
            shard, start, owner = shard[order], start[order], owner[order]
            end = start + windows[order]
            opens = np.ones(len(order), bool)
            opens[1:] = (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1]) | (start[1:] - end[:-1] >= length)
            place = np.arange(len(order))
            opens |= (place - np.maximum.accumulate(np.where(opens, place, 0))) % CHAIN == 0
            heads = np.flatnonzero(opens)
            tails = np.append(heads[1:], len(order))[: len(heads)] - 1
            rows, shards, starts = owner[heads], shard[heads], start[heads]
            text = data.tobytes()
            low, high = (borders[rows] + starts).tolist(), (borders[rows] + end[tails] + length - 1).tolist()
            bodies = [text[x:y] for x, y in zip(low, high, strict=True)]
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shards, pa.int64()),
                    chunk.column("doc_id").take(taken),
                    chunk.column("version").take(taken),
                    pa.array(starts, pa.int64()),
                    pa.array(bodies, pa.binary()),
                ],
                names=["shard", "doc_id", "version", "start", "body"],
            )

    return texts.mapInArrow(trimmed(run), "shard long, doc_id long, version long, start long, body binary")


def compare(passages: DataFrame, length: int, shards: int) -> DataFrame:
    """(doc_id, version, spans) of rows (shard, doc_id, version, start, body)."""

    def run(rows: pa.Table) -> pa.Table:
        found = shard_spans(rows.column("body").to_pylist(), length)
        trim_memory()  # the next shard may come to another worker
        starts = rows.column("start").to_pylist()
        spans = [[{"first": s + a, "last": s + b} for a, b in own] for s, own in zip(starts, found, strict=True)]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table({"doc_id": rows.column("doc_id"), "version": rows.column("version"), "spans": pa.array(spans, kind)})

    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)))
    schema = "doc_id long, version long, spans array<struct<first:long,last:long>>"
    return dealt.groupBy("shard").applyInArrow(run, schema).filter(F.size("spans") > 0)


# --- anchors with more passages than a shard holds ----------------------------------------


def windows_of(texts: DataFrame, length: int) -> DataFrame:
    """(shard, window, doc_id, version, start): the windows of the runs that are ``hot``, hashed.

    Rows are (doc_id, version, text, runs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", TEXT_BYTES):
            data, borders = text_bytes(chunk.column("text"))
            for row, runs in enumerate(chunk.column("runs").to_pylist()):
                hashes = _rolling(data[borders[row] : borders[row + 1]], length).view(np.int64)
                hot = [r for r in runs if r["hot"]]
                counts = [r["windows"] for r in hot]
                starts = np.concatenate([np.arange(r["start"], r["start"] + r["windows"]) for r in hot])
                taken = pa.array(np.full(len(starts), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([r["shard"] for r in hot], np.int64), counts)),
                        pa.array(hashes[starts]),
                        chunk.column("doc_id").take(taken),
                        chunk.column("version").take(taken),
                        pa.array(starts),
                    ],
                    names=["shard", "window", "doc_id", "version", "start"],
                )

    hot = texts.filter(F.exists("runs", lambda r: r["hot"]))
    return hot.mapInArrow(trimmed(run), "shard long, window long, doc_id long, version long, start long")


def matched(windows: DataFrame, length: int) -> DataFrame:
    """(doc_id, version, spans) of the windows that stand in several passages of their anchor."""
    again = windows.groupBy("shard", "window").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    spans = F.array(F.struct(F.col("start").alias("first"), (F.col("start") + length).alias("last")))
    return windows.join(again.hint("merge"), ["shard", "window"], "left_semi").select("doc_id", "version", spans.alias("spans"))


# --- the job ---------------------------------------------------------------------------


def dedupe(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row.

    Removed is each UTF-8 byte covered by a string of ``length`` bytes that also starts at
    another place of any text, judged on the texts as they are. ``kept`` is what is left, as
    bytes. A null text is empty; repeated rows are texts of their own and so repeat each
    other; rows without an id are treated alike. No other column is read. Equality of
    passages that share an anchor is decided by 64-bit hashes of both.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("version"), "text")
    every = stored(runs(rows, length), "suffix-all-runs")
    passages = every.groupBy("anchor", "passage").agg(F.count("*").alias("times"), F.min("doc_id").alias("owner"))
    anchors = passages.groupBy("anchor").agg(
        F.sum("times").alias("total"), F.count("*").alias("kinds"), F.min("owner").alias("owner")
    )
    shared = passages.drop("owner").join(anchors.filter("total > 1").hint("merge"), "anchor").drop("total")
    # Every run of a shared anchor; of equal passages one goes to the shards, or sends its windows.
    hot = F.col("kinds") * (2 * length - ANCHOR) > SHARD_BYTES
    shared = stored(shared, "suffix-passages")
    one = Window.partitionBy("anchor", "passage").orderBy("doc_id", "version", "start")
    met = (
        every.join(shared.hint("merge"), ["anchor", "passage"])
        .withColumn("first", F.row_number().over(one) == 1)
        .withColumn("goes", (F.col("kinds") > 1) & ~hot & F.col("first"))
        .withColumn("hot", hot & F.col("first"))
        .withColumn("twice", F.col("times") > 1)
        .select("anchor", F.coalesce("owner", F.lit(0)).alias("owner"), "doc_id", "version", "start", "windows", "goes", "hot", "twice")
    )
    met = stored(met, "suffix-runs")
    large = met.filter("goes").groupBy("owner").agg(F.sum(F.col("windows") + length - 1).alias("bytes"))
    large = large.filter(F.col("bytes") > SHARD_BYTES).select("owner", F.lit(True).alias("large"))
    shard = F.when(F.col("large") | F.col("hot"), F.xxhash64("owner", "anchor")).otherwise(F.col("owner"))
    by_text = stored(
        met.join(large.hint("merge"), "owner", "left")
        .groupBy("doc_id", "version")
        .agg(F.collect_list(F.struct(shard.alias("shard"), "start", "windows", "goes", "hot", "twice")).alias("runs")),
        "suffix-by-text",
    )
    key = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("version") == F.col("_version"))
    texts = likely_among(rows, "version", by_text.select("version")).join(
        by_text.withColumnsRenamed({"doc_id": "_id", "version": "_version"}).hint("merge"), key
    )
    held = stored(texts.select("doc_id", "version", "text", "runs"), "suffix-texts")
    # Rows that repeat a text send it as often, and rightly find it repeated.
    senders = held.filter(F.exists("runs", lambda r: r["goes"]))
    sent = stored(chained(senders, length), "suffix-sent")
    size = sent.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-int(size) // DEALT_BYTES))
    found = stored(compare(sent, length, shards), "suffix-spans")
    if not shared.filter(hot).isEmpty():
        found = found.unionByName(matched(stored(windows_of(held, length), "suffix-windows"), length))
    spans = found.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    whole = F.transform(
        F.filter("runs", lambda r: r["twice"]),
        lambda r: F.struct(r["start"].alias("first"), (r["start"] + r["windows"] + length - 1).alias("last")),
    )
    cut = held.join(spans.hint("merge"), key, "left").select(
        "doc_id", "text", F.concat(whole, F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>"))).alias("spans")
    )
    named = by_text.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
    # Digests are taken before the join: texts only move if ``kept`` is asked for.
    facts = rows.select(
        "doc_id",
        "version",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.encode("text", "UTF-8").alias("kept"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    nothing = F.lit(0).cast("long")
    plain = facts.join(named.hint("merge"), key, "left_anti").select(
        "doc_id", "n_bytes", nothing.alias("n_removed"), nothing.alias("n_spans"), "kept", "kept_sha256"
    )
    return remove(cut).unionByName(plain)


def remove(cut: DataFrame) -> DataFrame:
    """Rows (doc_id, text, spans of bytes) without the bytes in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", TEXT_BYTES):
            data, borders = text_bytes(chunk.column("text"))
            out = []
            for row, spans in enumerate(chunk.column("spans").to_pylist()):
                own = data[borders[row] : borders[row + 1]]
                edges = np.zeros(len(own) + 1, np.int32)
                if spans:
                    np.add.at(edges, [s["first"] for s in spans], 1)
                    np.add.at(edges, [s["last"] for s in spans], -1)
                gone = np.cumsum(edges[:-1]) > 0
                heads = gone.copy()
                heads[1:] &= ~gone[:-1]
                kept = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), int(heads.sum()), kept, hashlib.sha256(kept).hexdigest()))
            sizes, removed, number, kept, names = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(number, pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array(names),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return cut.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents")).drop("kept")
