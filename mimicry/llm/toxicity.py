"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Document counts of each hashed n-gram under both labels cover every labelled document; the
``FEATURES`` n-grams whose ratio is surest stay. A document is the set of these it holds,
each worth its ratio; logistic regression on a bounded, balanced sample weighs them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import chunks, table
from mimicry.llm.langid import remainder
from mimicry.llm.ngrams import distinct, gathered, letters_of

SIZES = (3, 4, 5, 6)
BITS = 20
FEATURES = 32_768
PER_LABEL = 6_000  # training documents of a label in the regression, at most about this many
SMOOTHING = 1.0
RIDGE = 3.0
STEPS = 200
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by hashed n-gram, the ratio worked in; 0 for n-grams left out
    bias: float


def label_counts(labelled: DataFrame) -> DataFrame:
    """(id, toxic, clean): in how many documents of each label an n-gram occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mark = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, np.int32)
        for chunk in chunks(batches, "text"):
            labels = chunk.column("toxic").to_pylist()
            texts = gathered(letters_of(chunk.column("text")), SIZES, BITS, True)
            for ids, label in zip(texts, labels, strict=True):
                seen[label][distinct(ids, mark)] += 1
        ids = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(seen[1][ids]), pa.array(seen[0][ids])], names=["id", "toxic", "clean"]
        )

    counted = labelled.select("text", "toxic").mapInArrow(count, "id long, toxic long, clean long")
    return counted.groupBy("id").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_ratios(labelled: DataFrame, totals: dict[int, int], features: int) -> np.ndarray:
    """Smoothed log-count ratios of the n-grams whose ratio is the most errors from 0."""
    share = {k: F.lit(float(totals.get(k, 0) + 2 * SMOOTHING)) for k in (0, 1)}
    toxic, clean = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    rows = (
        label_counts(labelled)
        .select(
            "id",
            F.log((toxic / share[1]) / (clean / share[0])).alias("ratio"),
            F.sqrt(1 / toxic + 1 / clean).alias("error"),
        )
        .orderBy(F.desc(F.abs("ratio") / F.col("error")), "id")
        .limit(features)
        .collect()
    )
    out = np.zeros(1 << BITS)
    for row in rows:
        out[row["id"]] = row["ratio"]
    return out


def regress(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; entries (row, column, value)."""
    weights, bias = np.zeros(width), 0.0
    ahead, ahead_bias = weights.copy(), bias
    n = len(labels)
    sizes = np.bincount(rows, values * values, n)
    rate = 1.0 / (0.25 * (np.median(sizes[sizes > 0]) if sizes.any() else 1.0) * 4 + RIDGE / n)
    for step in range(STEPS):
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * ahead[columns], n) + ahead_bias, -40, 40)))
        error = chance - labels
        slope = np.bincount(columns, values * error[rows], width) / n + RIDGE / n * ahead
        new, new_bias = ahead - rate * slope, ahead_bias - error.mean()
        push = step / (step + 3)
        ahead, ahead_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, *, features: int = FEATURES, per_label: int = PER_LABEL) -> Model:
    """Learn from rows (doc_id, text) and labels (doc_id, toxic), toxic 0 or 1; others are passed over.

    Counts cover every labelled text, for which texts move once. The regression's sample is
    drawn from the labels, at most about 2 * ``per_label`` of them, so it is small enough to
    go to the texts. Without both labels every score is 1 or 0, as the one label says.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if totals.get(1) else -40.0)
    ratios = log_ratios(docs.join(known.hint("merge"), "doc_id"), totals, features)
    places = np.flatnonzero(ratios)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    wanted = F.lit(False)
    for label, n in totals.items():
        wanted = wanted | ((F.col("toxic") == label) & (draw < int(1_000_000 * min(1.0, per_label / n))))
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mark = shared.value, np.zeros(1 << BITS, np.int32)
        column = np.zeros(1 << BITS, np.int32)
        column[np.flatnonzero(own)] = np.arange(np.count_nonzero(own), dtype=np.int32)
        for chunk in chunks(batches, "text"):
            texts = gathered(letters_of(chunk.column("text")), SIZES, BITS, True)
            sets = [np.sort(column[distinct(ids[own[ids] != 0], mark)]).tobytes() for ids in texts]
            yield pa.RecordBatch.from_arrays([chunk.column("toxic"), pa.array(sets, pa.binary())], names=["toxic", "held"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, labels = [], []
        for batch in batches:
            labels += batch.column("toxic").to_pylist()
            sets += [np.frombuffer(s, np.int32) for s in batch.column("held").to_pylist()]
        if not sets:
            return
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        columns = np.concatenate(sets)
        weights, bias = regress(rows, columns, ratios[places][columns], np.array(labels, float), len(places))
        out = np.zeros(1 << BITS, np.float32)
        out[places] = weights * ratios[places]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((out, bias))], pa.binary())], names=["model"])

    sample = docs.join(F.broadcast(known.filter(wanted)), "doc_id").select("text", "toxic")
    measured = sample.mapInArrow(measure, "toxic int, held binary").repartition(1).sortWithinPartitions("toxic", "held")
    found = measured.mapInArrow(fit, "model binary").collect()
    return Model(*pickle.loads(found[0]["model"])) if found else Model(np.zeros(1 << BITS, np.float32), -40.0)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` (a struct of its columns) with ``score``, the chance of label 1.

    Null, empty and letterless texts hold no n-gram and get what the bias alone says.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value.weights, shared.value.bias
        mark = np.zeros(1 << BITS, np.int32)
        for chunk in chunks(batches, "text"):
            sums = np.full(chunk.num_rows, bias)
            for i, ids in enumerate(gathered(letters_of(chunk.column("text")), SIZES, BITS, True)):
                worth = weights[ids]
                held = np.flatnonzero(worth)
                if len(held):
                    sums[i] += weights[distinct(ids[held], mark)].sum(dtype=np.float64)
            chances = 1 / (1 + np.exp(-np.clip(sums, -40, 40)))
            yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(chances)], names=["row", "score"])

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs, labels.filter(~held_out))
    found = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.held_out").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
