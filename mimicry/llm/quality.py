"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over whole texts. Trees are grown on histograms of
a bounded sample of labelled documents; a chosen direction for some statistics holds in
every tree, because a split against it is refused and the two sides' values are kept apart
by the middle between them. The ensemble is flattened into arrays of nodes, so that one
step moves all documents one level down all trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import SPACE, chunks, mixed, span_hashes, table, text_bytes, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_short_lines", "n_chars")
#: Statistics the trees see, and the direction of the score along them: -1 never rises.
FEATURES = (
    ("symbols_per_char", -1),
    ("dup_lines_share", -1),
    ("repeat_words_share", -1),
    ("upper_share", -1),
    ("digits_share", 0),
    ("marks_per_char", 0),
    ("distinct_words_share", 0),
    ("chars_per_word", 0),
    ("words_per_line", 0),
    ("log_words", 0),
)
SAMPLE = 20_000  # labelled documents the trees are grown on, at most about this many
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.2
RIDGE = 1.0
LEAST_WEIGHT = 2.0
KEEP = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


# --- statistics ------------------------------------------------------------------------


def _sums(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[borders])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key the place of its first equal, and thereby whether it occurs before."""
    order = np.argsort(keys, kind="stable")
    same = np.concatenate(([False], keys[order][1:] == keys[order][:-1]))
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
    first = np.empty(len(keys), dtype=np.int64)
    first[order] = order[heads] if len(keys) else order
    return first


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text; a null text has none. Words end at ASCII white space."""
    data, borders = text_bytes(column)
    rows = len(borders) - 1
    words = words_of(data, borders)
    heads = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(words.first),
        "word_chars": _sums(heads & ~SPACE[data], borders),
        "n_symbols": _sums(_SYMBOL[data], borders),
        "n_upper": _sums(_UPPER[data], borders),
        "n_digits": _sums(_DIGIT[data], borders),
        "n_marks": _sums(_MARK[data], borders),
        "n_chars": _sums(heads, borders),
    }
    owner = np.repeat(np.arange(rows), out["n_words"])
    salt = mixed(np.arange(1, rows + 1, dtype=np.uint64))
    hashes = span_hashes(data, words.starts, words.ends)

    first = _repeats(hashes ^ salt[owner])
    out["n_distinct_words"] = np.bincount(owner[first == np.arange(len(first))], minlength=rows)

    n = max(0, len(hashes) - 2)
    inside = owner[:n] == owner[2:] if n else np.zeros(0, bool)
    windows = mixed(hashes[:n] * np.uint64(3) + mixed(hashes[1 : n + 1]) * np.uint64(5) + mixed(mixed(hashes[2 : n + 2])) * np.uint64(7))
    at = np.flatnonzero(inside)
    first = _repeats(windows[at] ^ salt[owner[at]])
    again = first != np.arange(len(at))
    twice = again.copy()
    twice[first[again]] = True
    covered = np.zeros(len(hashes) + 3, dtype=np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + 3, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(covered)[: len(hashes)] > 0], minlength=rows)

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((borders[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, borders[1:])))
    line_owner = np.searchsorted(borders[1:], ends, side="left")
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, line_owner = starts[filled], ends[filled], line_owner[filled]
    line_words = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
    first = _repeats(span_hashes(data, starts, ends) ^ salt[line_owner])
    out["n_dup_lines"] = np.bincount(line_owner[first != np.arange(len(first))], minlength=rows)
    out["n_lines"] = np.bincount(line_owner, minlength=rows)
    out["n_short_lines"] = np.bincount(line_owner[line_words < 5], minlength=rows)
    return {name: out[name].astype(np.int64) for name in (*COUNTS, *EXTRA)}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of the statistics the trees see, in the order of ``FEATURES``."""
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    lines = np.maximum(counts["n_lines"], 1)
    columns = {
        "symbols_per_char": counts["n_symbols"] / chars,
        "dup_lines_share": counts["n_dup_lines"] / lines,
        "repeat_words_share": counts["n_repeat_words"] / words,
        "upper_share": counts["n_upper"] / chars,
        "digits_share": counts["n_digits"] / chars,
        "marks_per_char": counts["n_marks"] / chars,
        "distinct_words_share": counts["n_distinct_words"] / words,
        "chars_per_word": counts["word_chars"] / words,
        "words_per_line": counts["n_words"] / lines,
        "log_words": np.log1p(counts["n_words"]),
    }
    return np.column_stack([columns[name] for name, _ in FEATURES])


# --- trees -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in flat arrays; a leaf points to itself, so walking on is harmless."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.bias + self.value[at].sum(axis=1), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, directions: Sequence[int], *, trees: int = TREES) -> Forest:
    """Boost depth-limited trees on the logistic loss; ``y`` is 0 or 1."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    base = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), np.log(base / (1 - base)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        gradient, weight = chance - y, np.maximum(chance * (1 - chance), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.inf, 0, 0, 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, own, depth, low, high = todo.pop()
            found = _best_split(binned[own], gradient[own], weight[own], cuts, directions, low, high) if depth < DEPTH else None
            if found is None:
                value = np.clip(-gradient[own].sum() / (weight[own].sum() + RIDGE), low, high) * RATE
                nodes[at] = [0, np.inf, at, at, float(value)]
                margin[own] += value
                continue
            j, cut, left_value, right_value = found
            below = binned[own, j] <= cut
            children = len(nodes), len(nodes) + 1
            nodes.extend([[0, np.inf, 0, 0, 0.0], [0, np.inf, 0, 0, 0.0]])
            nodes[at] = [j, cuts[j][cut], *children, 0.0]
            middle = (left_value + right_value) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            sides = bounds.get(directions[j], ((low, high), (low, high)))
            for child, part, side in zip(children, (own[below], own[~below]), sides, strict=True):
                todo.append((child, part, depth + 1, *side))
    flat = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    whole = flat[:, [0, 2, 3]].astype(np.int32)
    return Forest(
        whole[:, 0], flat[:, 1], whole[:, 1], whole[:, 2], flat[:, 4], np.array(roots, np.int32), float(np.log(base / (1 - base)))
    )


def _best_split(binned, gradient, weight, cuts, directions, low, high):
    """(feature, bin, left value, right value) of the best allowed split, or None."""
    total_g, total_w = gradient.sum(), weight.sum()
    if total_w < 2 * LEAST_WEIGHT and len(gradient) < 40:
        return None
    parent = total_g**2 / (total_w + RIDGE)
    best, gain = None, 1e-4
    for j, borders in enumerate(cuts):
        if not len(borders):
            continue
        g = np.cumsum(np.bincount(binned[:, j], gradient, len(borders) + 1))[:-1]
        w = np.cumsum(np.bincount(binned[:, j], weight, len(borders) + 1))[:-1]
        n = np.cumsum(np.bincount(binned[:, j], minlength=len(borders) + 1))[:-1]
        left = np.clip(-g / (w + RIDGE), low, high)
        right = np.clip(-(total_g - g) / (total_w - w + RIDGE), low, high)
        gains = g**2 / (w + RIDGE) + (total_g - g) ** 2 / (total_w - w + RIDGE) - parent
        fine = (n >= 10) & (n <= len(gradient) - 10) & (directions[j] * (right - left) >= 0)
        gains = np.where(fine, gains, -np.inf)
        k = int(gains.argmax())
        if gains[k] > gain:
            best, gain = (j, k, float(left[k]), float(right[k])), gains[k]
    return best


# --- the job ---------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Forest | None:
    """Grow the trees on rows (doc_id, text) with labels (doc_id, quality), quality 0 or 1.

    About ``sample`` labels are drawn, few enough to go to the texts. Statistics of the
    sampled texts are computed where these are; only they reach the one task that grows the
    trees. None without labels of both kinds.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    drawn = known.filter(draw < int(1_000_000 * min(1.0, sample / sum(totals.values()))))
    chosen = docs.join(F.broadcast(drawn.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            counts = statistics(chunk.column("text"))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("quality").cast(pa.int32()), *map(pa.array, counts.values())], names=["quality", *counts]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        counts = {name: rows.column(name).to_numpy() for name in (*COUNTS, *EXTRA)}
        forest = grow(features(counts), rows.column("quality").to_numpy().astype(float), [d for _, d in FEATURES])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(astuple(forest))], pa.binary())], names=["model"])

    schema = "quality int, " + ", ".join(f"{name} long" for name in (*COUNTS, *EXTRA))
    measured = chosen.select("text", "quality").mapInArrow(measure, schema)
    ordered = measured.repartition(1).sortWithinPartitions(*measured.columns)
    found = ordered.mapInArrow(fit, "model binary").collect()
    return Forest(*pickle.loads(found[0]["model"])) if found else None


def judge(docs: DataFrame, forest: Forest | None, *, text: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` as ``row`` (a struct of its columns) with the base counts, ``base_failed``, ``score`` and ``kept``.

    A null text has no words and fails. Without a forest the base rules decide alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            counts = statistics(chunk.column("text"))
            words, repeats = counts["n_words"], counts["n_repeat_words"]
            failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
            scores = shared.value.score(features(counts)) if shared.value else np.ones(chunk.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("row"),
                    *[pa.array(counts[name]) for name in COUNTS],
                    pa.array(failed),
                    pa.array(scores),
                    pa.array(~failed & (scores >= keep)),
                ],
                names=["row", *COUNTS, "base_failed", "score", "kept"],
            )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text")
    )
    counts = ", ".join(f"{name} long" for name in COUNTS)
    return rows.mapInArrow(
        run, f"row {rows.schema['row'].dataType.simpleString()}, {counts}, base_failed boolean, score double, kept boolean"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = judge(docs, train(docs, labels))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept", "score")
