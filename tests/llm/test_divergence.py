"""Counts, shares, distances and ranks against plain loops; perfect hashes against sets."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mimicry.llm import divergence as dv
from mimicry.llm.perfecthash import PerfectHash, key_hashes

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
FORCED = {"shard_keys": 3, "round_bytes": 200, "dense_bytes": 64, "block_terms": 2, "tile_sources": 2}


def plain(docs, min_docs, top):
    docs = [(lang or "", source or "", [t.translate(UPPER) for t in TERM.findall(text or "")]) for lang, source, text in docs]
    seen, count = Counter(), Counter()
    for lang, _, terms in docs:
        seen.update((lang, t) for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in seen.items():
        if n >= min_docs:
            kept[lang].add(t)
    for lang, source, terms in docs:
        count.update((lang, source, t) for t in terms if t in kept[lang])
    groups = {(lang, source) for lang, source, _ in docs}

    def share(n, total, v):
        return 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)

    out = []
    for lang, source in groups:
        words, mates = kept[lang], sorted(s for x, s in groups if x == lang)
        totals = {s: sum(count[lang, s, t] for t in words) for s in mates}
        p = {s: {t: share(count[lang, s, t], totals[s], len(words)) for t in words} for s in mates}
        q = {t: share(sum(count[lang, s, t] for s in mates), sum(totals.values()), len(words)) for t in words}
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in words)) for s in mates if s != source]
        over = [(t, p[source][t] - q[t]) for t in words if count[lang, source, t] and p[source][t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", over, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank + 1) for rank, (item, value) in enumerate(ranked)]
    return sorted(out)


def made():
    rng = random.Random(5)
    words = ["the", "The", "naïve", "ÄB", "日本", "a_b", "x1y", "😀", "Zz", "don't", "\u0080", "K", "é"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(260):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "S2", "ß", "", None, "s7"])
        lang = rng.choice(["en"] * 5 + ["de", "", None, "fr"])
        rows.append((lang, source, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))))
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("xx", "only", "rare words"), ("yy", "a", "1 2"), ("yy", "b", None)]
    rows += [("en", "s0", "long tail " * 30_000)] + [("en", "s1", "copy of one row")] * 20
    return rows


@pytest.mark.parametrize("settings", [{}, FORCED])
@pytest.mark.parametrize("min_docs", [8, 10_000])
def test_audit(spark, settings, min_docs):
    rows = made()
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    got = dv.audit(docs.repartition(5), min_docs=min_docs, top=4, **settings).collect()
    assert sorted(map(tuple, got)) == plain(rows, min_docs, 4)


def test_empty_and_named_columns(spark):
    schema = "`a.b` string, src string, body string"
    assert dv.audit(spark.createDataFrame([], schema), lang="a.b", source="src", text="body").collect() == []
    rows = [("en", "x", "one two"), ("en", "y", "one one")] * 2
    got = dv.audit(spark.createDataFrame(rows, schema), lang="a.b", source="src", text="body", min_docs=2).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2, 50)


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    n, total, terms = 3_000_000_000_000_001, 9_000_000_000_000_007, 12_345_678
    got = spark.range(1).select(dv.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)


def test_perfect_hash():
    keys = [f"key{i}".encode() * (i % 7 + 1) for i in range(5_000)] + [b"", b"\0", "é".encode()]
    hashed = PerfectHash.unpacked(*PerfectHash.build(pa.array(keys, pa.binary())).packed())
    asked = pa.array([*keys, b"none", b"key", *[f"x{i}".encode() for i in range(5_000)]], pa.binary())
    slots = hashed.slots(asked, key_hashes(asked))
    assert sorted(slots[: len(keys)]) == list(range(len(keys)))  # minimal and perfect
    assert (slots[len(keys) :] == -1).all()  # the stored key decides
    assert len(PerfectHash.build(pa.array([], pa.binary()))) == 0


def test_equal_hashes_are_listed(monkeypatch):
    from mimicry.llm import perfecthash

    monkeypatch.setattr(perfecthash, "key_hashes", lambda keys: np.array([7 if k in (b"a", b"b") else hash(k) for k in keys.to_pylist()]).astype(np.uint64))
    keys = pa.array([b"a", b"b", b"c", b"d"], pa.binary())
    hashed = PerfectHash.unpacked(*PerfectHash.build(keys).packed())
    asked = pa.array([b"a", b"b", b"c", b"d", b"e"], pa.binary())
    slots = hashed.slots(asked, perfecthash.key_hashes(asked))
    assert sorted(slots[:4]) == [0, 1, 2, 3] and slots[4] == -1
