"""Targets, taken words and repetitions against a plain loop."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from mimicry.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share, most):
    """Clamp and hand on the excess until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, clamped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        if not free:
            return {s: float(most * n) for s, n in sizes.items()}
        level = (budget - sum(most * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not over:
            return {s: float(most * n) if s in clamped else level * weight[s] for s, n in sizes.items()}
        clamped |= over


DOCS = [
    *[(i, "w " * (i % 13 + 1), ("big", "big", "mid", "small")[i % 4]) for i in range(120)],
    (200, None, "mid"), (201, "", "empty"), (202, " \n", "empty"), (203, "no source", None), (203, "no source", None),
    (None, "no id", "mid"), (204, "x " * 4_000, "long"),
]
SCHEMA = "doc_id long, text string, source string, size int, target string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 9, "clash") for d in DOCS], SCHEMA)


@pytest.mark.parametrize(("share", "most"), [(1.5, 2), (0.4, 2), (1.9, 3), (2.5, 2)])
def test_mix(docs, share, most):
    rows = mixing.mix(docs, share=share, max_epochs=most).collect()
    assert Counter((r.doc_id, r.row.text, r.row.target) for r in rows) == Counter((d[0], d[1], "clash") for d in DOCS)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in DOCS:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes, mixing.WEIGHTS, share, most)
    for r in rows:
        assert r.size == len(WORD.findall(r.row.text or "")) and r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(want[r.row.source])
        assert 0 <= r.taken <= most * r.size
        taken[r.row.source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 1, source


def test_reruns_agree(docs):
    first, second = (sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 7))
    assert first == second


def test_repeated(docs):
    copies = Counter((r.doc_id, r.text) for r in mixing.repeated(docs).collect())
    words, sizes = defaultdict(int), defaultdict(int)
    for doc_id, text, source in set(DOCS):
        words[source] += copies[doc_id, text] * len(WORD.findall(text or ""))
    for _, text, source in DOCS:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS)
    for source in ("big", "mid", "small", "long"):
        assert abs(words[source] - want[source]) <= max(14, 4_000 * (source == "long")), source
    assert copies[201, ""] == copies[202, " \n"] == copies[200, None] == 1
    order = {i: hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest() for i, _, s in DOCS if s == "big"}
    often = [copies[i, t] for i, t, s in sorted((d for d in DOCS if d[2] == "big"), key=lambda d: order[d[0]])]
    assert often == sorted(often, reverse=True)


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(mixing.OP10_SQL)
    columns = [c[0] for c in cursor.description]
    got = mixing.op10_source_mix(spark, sf)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())


def test_native_plan(spark):
    plan = mixing.op10_source_mix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0
