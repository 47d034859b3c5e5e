"""Suffix order, shared prefixes and removed bytes against plain sorting and counting."""

from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mimicry.llm import induced, suffixes


def texts():
    draw = np.random.default_rng(0)
    for k in range(120):
        n = int(draw.integers(2, 100))
        text = draw.integers(1, int(draw.integers(2, 7)), n)
        if k % 4 == 0:
            text = np.tile(text[: max(1, n // 5)], 6)[:n]
        if k % 7 == 0:
            text = np.ones(n, dtype=np.int64)
        yield text


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_order_and_shared_prefixes(monkeypatch, levels):
    monkeypatch.setattr(induced, "INDUCED_LEVELS", levels)
    for text in texts():
        whole = [*text.tolist(), 0]
        order = sorted(range(len(whole)), key=lambda i: whole[i:])
        shared = [next(k for k in range(len(whole)) if whole[a + k] != whole[b + k]) for a, b in zip(order, order[1:])]
        got = induced.sorted_suffixes(np.append(text, 0), 10_000, induced.Files(None))
        assert got.places[::-1].tolist() == order[1:]
        assert got.shared[1:].tolist() == shared[1:][::-1]


def test_small_bulks_and_files(monkeypatch, tmp_path):
    monkeypatch.setattr(induced, "_FIRST_BULK", 4)
    monkeypatch.setattr(induced, "_MOST_BULK", 8)
    for text in texts():
        for length in (2, 5):
            windows = [tuple(text[i : i + length]) for i in range(len(text) - length + 1)]
            want = [windows.count(w) > 1 for w in windows] + [False] * (len(text) - len(windows))
            assert induced.repeated(text, length, str(tmp_path), memory=16).tolist() == want
    assert not list(tmp_path.iterdir())


def plain(docs, length):
    counts = Counter()
    for _, text in docs:
        raw = (text or "").encode()
        counts.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=int)
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(raw)] > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))[: len(raw)]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_dedupe(spark):
    draw = np.random.default_rng(2)
    word = lambda: "".join(draw.choice(list("abcdeé "), 9))
    shared = [" ".join(word() for _ in range(n)) for n in (4, 5, 9, 30)]
    docs = [(i, " ".join([word(), shared[i % 4], word(), shared[(i + 1) % 4][: 20 + i], word()])) for i in range(40)]
    docs += [(50, "x" * 500), (51, "y" * 41), (52, "ab" * 100), (53, None), (54, ""), (55, shared[3]), (55, shared[3])]
    docs += [(56, docs[3][1]), (57, docs[3][1][:60] + "-" + docs[3][1][61:]), (None, docs[7][1]), (None, None)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, version string")
    got = suffixes.dedupe(df, length=40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(docs, 40)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_owners_larger_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 300)
    draw = np.random.default_rng(4)
    base = "".join(draw.choice(list("abcdefgh "), 400))
    docs = [(i, base[:i * 9] + "#" * (i % 3) + base[i * 9 + 5 :]) for i in range(30)]
    got = suffixes.dedupe(spark.createDataFrame(docs, "doc_id long, text string"), length=40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(docs, 40)


def test_line_with_many_surroundings(spark, monkeypatch):
    """A line shorter than a window stands in many documents; some share more than the line."""
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2_000)
    draw = np.random.default_rng(6)
    word = lambda n: "".join(draw.choice(list("abcdefgh "), n))
    line = word(35)
    ends = [word(30) for _ in range(20)]
    docs = [(i, word(70) + line + ends[i % 20][: i % 28] + word(70)) for i in range(150)]
    docs += [(200 + i, docs[i][1][:90] + word(3) + docs[i][1][90:]) for i in range(5)] + [(300, docs[9][1])] * 2
    sizes = []
    compare = suffixes.compare

    def watched(passages, length, shards):
        sizes.extend(r["n"] for r in passages.groupBy("shard").agg(F.sum(F.length("body")).alias("n")).collect())
        return compare(passages, length, shards)

    monkeypatch.setattr(suffixes, "compare", watched)
    got = suffixes.dedupe(spark.createDataFrame(docs, "doc_id long, text string"), length=40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(docs, 40)
    assert max(sizes) <= 2_000


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = suffixes.op2_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(docs, 200)


def test_no_documents(spark):
    assert suffixes.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_worker_holds_little_beside_its_texts():
    """Memory follows a piece of the texts, not a whole batch, and is given back at the end."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    text = "".join(np.random.default_rng(8).choice(list("abcdefgh "), 2_000))
    texts = [f"{i}{text}{i}" for i in range(1_500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1_500)), "version": [0] * 1_500, "text": texts})
    tracemalloc.start()
    try:
        found = sum(len(part) for part in suffixes.runs(Rows(), 200)(iter([batch])))
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert found > 1_500
    assert peak < 64 << 20 and held < 4 << 20
