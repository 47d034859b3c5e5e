"""Components of similar documents against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from mimicry.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(lowered)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(docs, percent=80):
    """doc_id -> smallest reachable doc_id, and the sets; ids may repeat."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in parent}


def corpus(seed=1, families=12):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(draw.choices(vocabulary, k=9))
    docs = []
    for _ in range(families):
        base = draw.choices(vocabulary, k=draw.choice((1, 3, 6, 12, 30, 80, 200)))
        for _ in range(draw.randint(1, 9)):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            docs.append((line + "\n") * (draw.random() < 0.4) + " ".join(words))
    draw.shuffle(docs)
    return [(3 * i - 20, t) for i, t in enumerate(docs)]


def check(spark, docs):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n int, component string")
    want = plain(docs)
    got = jaccard.join(df).collect()
    assert len(got) == len(docs)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(shingles(t))) for i, t in docs)
    for r in got:
        if r.doc_id is not None and r.n_shingles:
            assert r.component_id == want[r.doc_id], r
    return got


def test_components(spark):
    check(spark, corpus())


def test_odd_rows(spark):
    docs = corpus(5, 5)
    docs += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "a b c d e")]
    docs += [(907, docs[0][1]), (907, docs[0][1]), (None, docs[0][1]), (None, None), (908, "É é"), (909, "é é")]
    got = check(spark, docs)
    assert {r.doc_id: r.component_id for r in got if not r.n_shingles and r.doc_id} == {900: 900, 901: 901, 902: 902}


def test_rounds_and_blocks(spark, monkeypatch):
    """The same result if entries are compared in many small blocks, and in rounds."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "ROUNDS", 3)
    monkeypatch.setattr(jaccard, "COMMON_SHARE", 1.0)
    check(spark, corpus(9, 8))


def test_every_similar_pair_shares_an_entry():
    """Whatever the allocation: two sets within the bound meet under some key."""
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 13, 40, 150, 420):
        for _ in range(20):
            a = draw.integers(0, 1 << 62, n).astype(np.uint64)
            top = n * 100 // 80
            m = int(draw.integers(n, top + 1))
            most = jaccard.largest_difference(n, m, 80)
            swaps = (most - (m - n)) // 2
            b = np.concatenate((a[swaps:], draw.integers(0, 1 << 62, m - n + swaps).astype(np.uint64)))
            sets = jaccard.Sets(np.concatenate((np.sort(a), np.sort(b))), np.array([0, n, n + m]), np.zeros(2), np.zeros(2))
            places = len(jaccard.band_starts(m, 80))
            for band_at in range(8):
                bands = [
                    (list(jaccard._allocations(low, high, 80)) * 8)[band_at * 4]
                    for low, high in jaccard.band_edges(places, 80)
                ]
                keys, rows = jaccard.entries_of(sets, bands, 80, np.sort(a[: n // 3]))
                left, right = keys[rows == 0], keys[rows == 1]
                met = {(x >> 2) for x in left.tolist()} & {(x >> 2) for x in right.tolist()}
                fine = any(
                    (x & 3) & (y & 3) == 0
                    for g in met
                    for x in left[left >> 2 == g].tolist()
                    for y in right[right >> 2 == g].tolist()
                )
                assert fine, (n, m, band_at)


def test_one_of_each(spark):
    docs = corpus(2, 6)
    docs += [(docs[0][0], docs[0][1]), (None, "no id")]
    df = spark.createDataFrame([(*d, "l") for d in docs], "doc_id long, text string, row string")
    kept = jaccard.one_of_each(df).collect()
    want = plain(docs)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in want if want[i] == i)
    assert sum(r.doc_id is None for r in kept) == 1


def test_templates_without_an_id(spark):
    """Two edited versions of one text link, whether or not the text itself has an id."""
    draw = random.Random(8)
    docs = []
    for i in range(24):
        words = [f"t{i}w{draw.randrange(10_000)}" for _ in range(150)]
        docs.append((None, " ".join(words)))
        docs += [(2 * i + k, " ".join([*words[:at], "edited", *words[at + 1 :]])) for k, at in enumerate((40, 110))]
    got = check(spark, docs)
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in got if r.doc_id is not None)


def test_hashes_do_not_depend_on_the_chunk():
    texts = ["a b c d e f", "x", None, "a b c d e f g"]
    whole = jaccard.sets_of(pa.array(texts))
    for i, text in enumerate(texts):
        alone = jaccard.sets_of(pa.array([text], pa.string()))
        assert alone.items.tolist() == whole.items[whole.borders[i] : whole.borders[i + 1]].tolist()


def test_no_documents(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
