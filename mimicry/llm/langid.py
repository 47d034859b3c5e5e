"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are relative frequencies of hashed 1- to 3-grams times their inverse document
frequency, counted over every training document. Follow-the-regularised-leader with an
elastic-net penalty learns the weights on a bounded sample with as many documents of each
language; a part of the sample it does not see sets the temperature of the probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import chunks, table, trimmed
from mimicry.llm.ngrams import distinct, gathered, hashed, letters_of

SIZES = (1, 2, 3)
BITS = 16
PER_LANGUAGE = 1_500  # training documents of a language, at most about this many
UNKNOWN = "und"
SCALE = 20.0
LEAST_SCORE = 0.4  # below it a document's language counts as unknown
TEXT_BYTES = 1 << 18  # of text at a time: n-grams take some fifty times as much


@dataclass(frozen=True)
class Penalty:
    """Learning rate and penalties of follow-the-regularised-leader."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (2 ** BITS + 1, languages): idf and scale worked in; the last row is the bias
    temperature: float


def remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many of the texts hold each n-gram: a bounded vector, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mark = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int32)
        for chunk in chunks(batches, "text", TEXT_BYTES):
            for ids in gathered(letters_of(chunk.column("text")), SIZES, BITS, False):
                seen[distinct(ids, mark)] += 1
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["id", "n"])

    rows = texts.select("text").mapInArrow(trimmed(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BITS)
    for row in rows:
        out[row["id"]] = row["n"]
    return out


@dataclass(frozen=True)
class Example:
    """The n-grams of a text, in 32 bits each: how often each stands there, of how many."""

    ids: np.ndarray
    counts: np.ndarray
    total: int
    label: int

    def features(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, values), the bias last."""
        values = self.counts / self.total * idf[self.ids] * SCALE
        return np.append(self.ids, 1 << BITS), np.append(values, 1.0)


def learn(examples: list[Example], idf: np.ndarray, classes: int, penalty: Penalty, seed: int = 7) -> np.ndarray:
    """Weights (features, classes) after ``epochs`` passes of per-coordinate FTRL-proximal.

    The last feature is a bias without penalty.
    """
    width = (1 << BITS) + 1
    z, n = np.zeros((width, classes)), np.zeros((width, classes))
    order = np.random.default_rng(seed)

    def weights(ids: np.ndarray) -> np.ndarray:
        zs, root = z[ids], np.sqrt(n[ids])
        l1 = np.where(ids == width - 1, 0.0, penalty.l1)[:, None]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((penalty.beta + root) / penalty.alpha + penalty.l2)

    for _ in range(penalty.epochs):
        for k in order.permutation(len(examples)):
            ids, values = examples[k].features(idf)
            own = weights(ids)
            gradient = softmax(values @ own)
            gradient[examples[k].label] -= 1.0
            steps = values[:, None] * gradient[None, :]
            grown = n[ids] + steps * steps
            z[ids] += steps - (np.sqrt(grown) - np.sqrt(n[ids])) / penalty.alpha * own
            n[ids] = grown
    return weights(np.arange(width))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on examples the weights have not seen."""
    if not len(labels):
        return 1.0
    tried = np.geomspace(0.25, 4.0, 49)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE, penalty: Penalty = Penalty()) -> Model:
    """Learn from rows of (doc_id, text, lang) with a language and a text.

    Document frequencies cover all rows; the regression sees a seeded sample of about
    ``per_language`` rows of each language, in one task. One in five of them calibrates.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), np.zeros(((1 << BITS) + 1, 0)), 1.0)
    frequencies = document_frequencies(known)
    idf = np.log((1 + sum(counts.values())) / (1 + frequencies)) + 1.0
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(1_000_000 * min(1.0, per_language / n))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, mark, seen = [], np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int64)
        for chunk in chunks(batches, "text", TEXT_BYTES):
            labels = chunk.column("lang").to_pylist()
            for ids, lang in zip(gathered(letters_of(chunk.column("text")), SIZES, BITS, False), labels, strict=True):
                if len(ids):
                    own = distinct(ids, mark)
                    np.add.at(seen, ids, 1)
                    examples.append(Example(own.astype(np.int32), seen[own].astype(np.int32), len(ids), languages.index(lang)))
                    seen[own] = 0
        apart = len(examples) // 5
        weights = learn(examples[apart:], idf, len(languages), penalty)
        logits = np.array([values @ weights[ids] for ids, values in (example.features(idf) for example in examples[:apart])])
        temperature = best_temperature(logits, np.array([example.label for example in examples[:apart]], dtype=np.int64))
        weights[:-1] *= idf[:, None] * SCALE
        model = pickle.dumps((weights.astype(np.float32), temperature))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    sample = known.filter(wanted).select("doc_id", "text", "lang").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text")
    weights, temperature = pickle.loads(sample.select("text", "lang").mapInArrow(trimmed(fit), "model binary").collect()[0]["model"])
    return Model(languages, weights, temperature)


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` (a struct of its columns) with ``lang_pred`` and ``score``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing was learned. The score is the calibrated probability of the language named.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, temperature = shared.value.languages, shared.value.weights, shared.value.temperature
        names = np.array([*languages, UNKNOWN], dtype=object)
        for chunk in chunks(batches, "text", TEXT_BYTES):
            letters = letters_of(chunk.column("text"))
            rows = chunk.num_rows
            sums, totals = np.zeros((rows, len(languages))), np.zeros(rows)
            for ids, at in hashed(letters, SIZES, BITS, False):
                for k in range(len(languages)):
                    run = np.concatenate(([0.0], np.cumsum(weights[ids, k], dtype=np.float64)))
                    sums[:, k] += run[at[1:]] - run[at[:-1]]
                totals += np.diff(at)
            known = (letters.counts > 0) & (len(languages) > 0)
            best, scores = np.full(rows, len(languages)), np.zeros(rows)
            if known.any():
                logits = sums[known] / totals[known][:, None] + weights[-1]
                chances = softmax(logits / temperature)
                best[known], scores[known] = chances.argmax(axis=1), chances.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("row"), pa.array(names[best], pa.string()), pa.array(np.clip(scores, 0, 1))],
                names=["row", "lang_pred", "score"],
            )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(trimmed(score), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, *, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without texts that have no letter or whose language is not certain enough."""
    found = identify(docs, model, text=text)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out))
    read = docs.select("doc_id", held_out.alias("held_out"), "text")
    return _flat(identify(read, model), "doc_id", "held_out")


def _flat(found: DataFrame, *kept: str) -> DataFrame:
    return found.select(*[F.col(f"row.{c}").alias(c) for c in kept], "lang_pred", "score")
