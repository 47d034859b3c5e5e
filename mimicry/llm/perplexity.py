"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model counts 5-grams of characters in trusted texts, white space being one blank. Counts, context sums,
discounts and probabilities are tables joined shard by shard; no task and not the driver
holds the model. Documents are scored in lots of blocks: a lot sends its different n-grams to
the tables, gets their probabilities back, and meets its own packed texts again by its name.
So what is moved is one row for each n-gram of a lot, and it grows with the corpus. Shuffles
are dropped as soon as their result is stored.

A character is 12 bits of a key: the code point below U+1000, and one of the same 4,096
classes by hash above. Contexts and suffixes of n-grams are then shifts and masks.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import chunks, likely_among, shuffles_dropped, stored, table, trim_memory, trimmed
from mimicry.llm.ngrams import characters_of

ORDER = 5
WIDTH = 12
COUNT_BYTES = 2 << 20  # of text counted at a time
PART_BYTES = 1 << 19  # of text looked up at a time
BLOCK_BYTES = 8 << 20  # of text packed at a time
LOT_BYTES = 64 << 20  # of text that looks its n-grams up together
QUANTILE = 0.995
#: One in so many trusted documents is not trained on: thresholds come from those.
HELD_OUT = 8
_BLANK = 32


def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, borders): the 5-grams that end at each character and blank of each text.

    Before a text stand blanks; a text without letters has no n-gram.
    """
    letters = characters_of(column)
    codes = letters.codes.astype(np.int64)
    codes = np.where(codes < 1 << WIDTH, codes, (codes * 2654435761 >> 7) & ((1 << WIDTH) - 1))
    sizes = np.where(letters.counts > 0, np.diff(letters.borders), 0)
    padded = np.concatenate(([0], np.cumsum(sizes + ORDER - 2)))
    stream = np.full(int(padded[-1]), _BLANK, dtype=np.int64)
    used = np.repeat(letters.counts > 0, np.diff(letters.borders))
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stream[np.repeat(padded[:-1] + ORDER - 2, sizes) + within] = codes[used]
    many = max(0, len(stream) - ORDER + 1)
    keys = np.zeros(many, np.int64)
    for k in range(ORDER):
        keys = (keys << WIDTH) | stream[k : k + many]
    counts = np.maximum(sizes - 1, 0)
    starts = np.repeat(padded[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return keys[starts], np.concatenate(([0], np.cumsum(counts)))


def tail(key: Column | str, order: int) -> Column:
    """The last ``order`` characters of a key."""
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseAND(F.lit((1 << (WIDTH * order)) - 1))


def context(key: Column | str) -> Column:
    return F.shiftright(key, WIDTH)


# --- the model -------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """``grams[k]``: (key, p) of the n-grams of order k; ``weights[k]``: (context, weight)."""

    grams: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    unseen: float  # the chance of a character that no trusted text holds


def count(texts: DataFrame) -> DataFrame:
    """(key, c): how often each 5-gram stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", COUNT_BYTES):
            keys, counts = np.unique(keys_of(chunk.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "c"])

    return texts.mapInArrow(trimmed(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What is taken from n-grams seen once, twice and more often, by how many there are."""
    row = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    each = []
    for k, (now, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        each.append(min(max(k - (k + 1) * y * after / now, 0.05), k - 0.05) if now else 0.5 * k)
    return each[0], each[1], each[2]


def fit(texts: DataFrame) -> Model | None:
    """Count the texts and derive all orders; None without a letter to count."""
    counts = {ORDER: stored(count(texts), "lm-counts")}
    if counts[ORDER].isEmpty():
        return None
    for order in range(ORDER - 1, 0, -1):
        # Below the highest order an n-gram counts the characters it has been seen after.
        types = counts[order + 1].groupBy(tail("key", order).alias("key")).agg(F.count("*").alias("c"))
        counts[order] = stored(types, "lm-counts")
    grams, weights, unseen = {}, {}, 1.0
    for order in range(1, ORDER + 1):
        low, mid, high = discounts(counts[order])
        taken = F.when(F.col("c") == 1, low).when(F.col("c") == 2, mid).otherwise(high)
        rows = counts[order].select("key", context("key").alias("context"), "c", taken.alias("taken"))
        sums = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("taken").alias("given"))
        sums = sums.withColumn("weight", F.col("given") / F.col("total"))
        parts = rows.join(sums, "context").select("key", "weight", ((F.col("c") - F.col("taken")) / F.col("total")).alias("own"))
        if order == 1:
            kinds = counts[1].count()
            weight = sums.first()["weight"]
            unseen = weight / (kinds + 1)
            found = parts.select("key", (F.col("own") + F.lit(unseen)).alias("p"))
        else:
            lower = grams[order - 1].select(F.col("key").alias("shorter"), F.col("p").alias("lower"))
            found = (
                parts.withColumn("shorter", tail("key", order - 1))
                .join(lower, "shorter")
                .select("key", (F.col("own") + F.col("weight") * F.col("lower")).alias("p"))
            )
            weights[order] = stored(sums.select("context", "weight"), "lm-weights")
        grams[order] = stored(found, "lm-grams")
    return Model(grams, weights, unseen)


def chances(model: Model, wanted: DataFrame) -> DataFrame:
    """(key, logp) of different rows (key): each 5-gram's last character after the others."""
    return _chances(model, wanted, ORDER).select("key", F.log("p").alias("logp"))


def _chances(model: Model, wanted: DataFrame, order: int) -> DataFrame:
    """(key, p) of different n-grams of an order: what no trusted text holds asks the order below."""
    if order == 1:
        return wanted.join(model.grams[1], "key", "left").select("key", F.coalesce("p", F.lit(model.unseen)).alias("p"))
    seen = stored(wanted.join(model.grams[order], "key", "left"), "lm-seen")
    rest = seen.filter("p is null").select("key", context("key").alias("context"), tail("key", order - 1).alias("shorter"))
    lower = _chances(model, rest.select(F.col("shorter").alias("key")).distinct(), order - 1)
    backed = (
        rest.join(lower.withColumnsRenamed({"key": "shorter", "p": "lower"}), "shorter")
        .join(model.weights[order], "context", "left")
        .select("key", (F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p"))
    )
    return seen.filter("p is not null").unionByName(backed)


# --- scoring ---------------------------------------------------------------------------


def _name(chunk: pa.RecordBatch) -> int:
    """The name of a block or of the lot it opens, the same whenever its rows are read again."""
    ids = chunk.column("id").to_pylist()
    sizes = pc.binary_length(chunk.column("text")).to_pylist()
    return zlib.crc32(repr((ids, sizes)).encode()) | (zlib.adler32(repr(ids[:64]).encode()) & 0x7FFFFFFF) << 32


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(name of its lot, whether it opens the lot, block) of all blocks of a task in turn."""
    name, size = 0, LOT_BYTES
    for block in chunks(batches, "text", BLOCK_BYTES):
        opens = size >= LOT_BYTES
        if opens:
            name, size = _name(block), 0
        size += block.column("text").nbytes
        yield name, opens, block


def lot_keys(rows: DataFrame) -> DataFrame:
    """(lot, key): the different 5-grams of each lot of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(name: int, keys: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), name, np.int64)), pa.array(keys)], names=["lot", "key"])

        of, keys = 0, np.zeros(0, np.int64)
        for name, opens, block in _lots(batches):
            if opens and len(keys):
                yield sent(of, keys)
            of, keys = name, keys[:0] if opens else keys
            parts = [np.unique(keys_of(part.column("text"))[0]) for part in chunks(iter([block]), "text", PART_BYTES)]
            keys = np.unique(np.concatenate([keys, *parts]))
        if len(keys):
            yield sent(of, keys)

    return rows.mapInArrow(trimmed(run), "lot long, key long")


def packed(rows: DataFrame) -> DataFrame:
    """(lot, body): the rows of each lot, compressed block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for name, _, block in _lots(batches):
            body = squeeze.compress(pickle.dumps(block.to_pydict()))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.binary())], names=["lot", "body"])

    return rows.mapInArrow(trimmed(run), "lot long, body binary")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(id, n, logp): characters and their summed log chance for each of rows (id, text)."""
    kinds = rows.schema["id"].dataType.simpleString()
    needed = stored(lot_keys(rows), "lm-needed")
    known = chances(model, needed.select("key").distinct())
    answers = needed.join(known, "key").select("lot", "key", "logp")

    def run(bodies: pa.Table, answer: pa.Table) -> pa.Table:
        keys, logs = answer.column("key").to_numpy(), answer.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        ids, counts, sums = [], [], []
        for body in bodies.column("body").to_pylist():
            own = pickle.loads(zstandard.ZstdDecompressor().decompress(body))
            for start in range(0, len(own["id"]), 128):
                part = pa.array(own["text"][start : start + 128], pa.string())
                asked, borders = keys_of(part)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                if len(asked) and (not len(keys) or (keys[at] != asked).any()):
                    raise ValueError("a lot of texts got another name when it was read again: n-grams without an answer")
                run_sum = np.concatenate(([0.0], np.cumsum(logs[at] if len(keys) else asked * 0.0)))
                sums.append(run_sum[borders[1:]] - run_sum[borders[:-1]])
                counts.append(np.diff(borders))
            ids += own["id"]
        trim_memory()  # the next lot may come to another worker
        return pa.table(
            {
                "id": pa.array(ids, pa.int64() if kinds == "bigint" else pa.string()),
                "n": np.concatenate(counts) if counts else np.zeros(0, np.int64),
                "logp": np.concatenate(sums) if sums else np.zeros(0),
            }
        )

    groups = packed(rows).groupBy("lot").cogroup(answers.groupBy("lot"))
    return groups.applyInArrow(run, f"id {kinds}, n long, logp double")


def _perplexities(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) of rows (doc_id, text, lang) by the texts of the ids learned from."""
    model = fit(likely_among(docs, "doc_id", learned).join(learned.hint("merge"), "doc_id", "left_semi").select("text"))
    if model is None:
        model = Model({k: _nothing(docs, "key long, p double") for k in range(1, ORDER + 1)}, {k: _nothing(docs, "context long, weight double") for k in range(2, ORDER + 1)}, 0.5)
    sums = scored(docs.select(F.to_json(F.struct("doc_id", "lang")).alias("id"), "text"), model)
    parsed = F.from_json("id", "doc_id long, lang string")
    result = sums.select(parsed.alias("id"), "n", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"))
    return stored(result.select("id.doc_id", "id.lang", F.col("n").alias("n_chars"), "perplexity"), "lm-scores")


def classify(
    docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE
) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept) of every document.

    ``trusted`` has the ids of trusted texts: most train the model, one in ``HELD_OUT`` sets
    the thresholds. A language's threshold is the ``quantile`` of these documents'
    perplexities; a null language is one of its own, and a language without any takes the
    quantile over all. Texts
    that are null or have no letter have no perplexity and are not kept. Rows are kept one
    for one, other columns ignored. Without trusted text nothing has a threshold, and every
    text with a letter is kept.
    """
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    ids = trusted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    with shuffles_dropped(docs.sparkSession):
        result = _perplexities(plain, ids.filter(~held_out | F.col("doc_id").isNull()))
    reference = result.join(ids.filter(held_out).hint("merge"), "doc_id", "left_semi").filter("perplexity is not null")
    by_lang = reference.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    overall = reference.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("overall")).first()["overall"]
    limits = by_lang.select(F.col("lang").alias("of"), "own")
    placed = result.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return placed.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def _nothing(docs: DataFrame, schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], schema)


def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), labels)
