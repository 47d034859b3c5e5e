"""Token ids, pieces and their places against plain encoding and counting."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mimicry.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
TEXTS = [
    "Hello world, it's the 12 dogs'  tail\tÉlan élan\n\nΣΊΣΥΦΟΣ İstanbul ſ",
    "<|startoftext|> a <|endoftext|>b <|",
    "á éb ' 's don't 'RE \x0b\x0c\x1c x y z 😀😀 1a2b3c ab-cd_ef",
    "",
    "日本語テキスト मराठी ١٢٣",
    None,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_by_word_ids_are_the_tokenizers(tokenizer):
    store = packing.WordTokens(PATH, max_bytes=2_000)
    signs = random.Random(3)
    alphabet = "ab AZé'’\n\t12,.<|>-ßñ́ΣİÅ日 "
    texts = TEXTS + ["".join(signs.choices(alphabet, k=60)) for _ in range(200)]
    for start in range(0, len(texts), 40):  # the store is emptied between some of them
        part = texts[start : start + 40]
        ids, borders = store.encode(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            want = tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids[borders[i] : borders[i + 1]].tolist() == want, text


def plain_pieces(tokenizer, docs, capacity):
    out = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], dtype="<u4")
            out.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
    return Counter(out)


def test_pack(spark, tokenizer):
    docs = [(i, t, 1) for i, t in enumerate(TEXTS)]
    docs += [(100 + i, "word " * n, 2) for i, n in enumerate((3, 50, 63, 64, 65, 200, 31, 32, 1))] + [(100, "word " * 3, 2)] * 5
    docs += [(None, "no id", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length int")
    rows = packing.pack(df, capacity=64).collect()
    assert Counter(tuple(r)[:5] for r in rows) == plain_pieces(tokenizer, [d[:2] for d in docs], 64)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 1


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(rooms))
            return
        for k in sorted(set(rooms), reverse=True):
            if k >= lengths[i]:
                rest = list(rooms)
                rest.remove(k)
                place(i + 1, [*rest, k - lengths[i]])
        if len(rooms) + 1 < best or i == 0:
            place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_best_packing_within_reach():
    draw = random.Random(5)
    for _ in range(150):
        capacity = draw.choice((10, 20, 30))
        lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 8))), reverse=True)
        left = dict(Counter(lengths))
        fixed = packing.reduce_dominated(left, capacity)
        used = sum(r.bins for r in fixed)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert used + (fewest(rest, capacity) if rest else 0) == fewest(lengths, capacity), lengths
        runs = packing.solve(dict(Counter(lengths)), capacity)
        assert all(sum(r.lengths) <= capacity for r in runs)
        assert Counter(x for r in runs for x in r.lengths * r.bins) == Counter(lengths)


def test_query(spark, tokenizer):
    rows = packing.op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r)[:5] for r in rows) == plain_pieces(tokenizer, docs, packing.CAPACITY)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY
    assert len(used) <= -(-sum(used.values()) // packing.CAPACITY) + 1
