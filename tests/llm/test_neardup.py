"""Links and components of vectors against all pairs; how sure the estimates are."""

from __future__ import annotations

from collections import Counter

import numpy as np

from mimicry.llm import neardup


def plain(rows, threshold=0.9):
    """(n_links, component) of each row; ids may repeat."""
    usable = []
    for k, (i, v) in enumerate(rows):
        fine = i is not None and v and None not in v and np.isfinite(v).all() and any(v)
        usable.append(np.array(v, float) / np.linalg.norm(v) if fine else None)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = usable[a], usable[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = i if find(k) not in least else min(i, least[find(k)])
    return Counter(
        (str(i), links[k], str(least[find(k)]), i is not None and least[find(k)] == i) for k, (i, _) in enumerate(rows)
    )


def vectors(seed, n=500, dims=24):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[draw.integers(len(rows))][1])
            v = base / np.linalg.norm(base) + draw.normal(0, draw.choice([0.02, 0.06]), dims)
        else:
            v = draw.normal(0, 1, dims)
        rows.append((int(i * 3 - 50), [float(x) for x in v * draw.choice([1e-3, 1, 50])]))
    return rows


def compare(spark, rows, **how):
    df = spark.createDataFrame([(*r, 4) for r in rows], "vec_id long, embedding array<double>, weight int")
    got = neardup.near_duplicates(df, **how).collect()
    return Counter((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got), plain(rows)


def test_links(spark):
    got, want = compare(spark, vectors(1))
    found, there = (sum(k[1] * n for k, n in c.items()) for c in (got, want))
    assert found >= 0.99 * there and there > 500
    assert sum((got & want).values()) >= 0.99 * sum(want.values())


def test_odd_vectors(spark):
    rows = vectors(2, 60, 5)
    rows += [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [float("nan")] * 5)]
    rows += [(905, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1])]
    rows += [(908, rows[3][1]), (909, rows[3][1]), (909, rows[3][1])]
    got, want = compare(spark, rows)
    assert got == want


def test_one_id_on_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.999, 0.01, 0.0]), (3, [0.0, 0.999, 0.01]), (4, [0.0, 0.0, 1.0])]
    rows += [(7, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, 0.99]), (1, [0.0, 1.0, 0.0])]
    got, want = compare(spark, rows)
    assert got == want
    assert got[("1", 1, "1", True)] == 1 and got[("1", 2, "1", True)] == 2


def test_without_probes_every_pair_is_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    got, want = compare(spark, vectors(4, 300, 8), probes=None)
    assert got == want and sum(k[1] * n for k, n in want.items()) > 100


def test_small_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PER_CELL", 8)
    got, want = compare(spark, vectors(3, 300, 8))
    found, there = (sum(k[1] * n for k, n in c.items()) for c in (got, want))
    assert there >= found >= 0.97 * there


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in table], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in neardup.op6_embedding_near_dedup(spark, sf).collect()}
    assert all(got[r.vec_id] <= w for r, w in zip(table, want, strict=True))
    assert sum(got.values()) >= 0.9 * want.sum()


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(8)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in draw.normal(size=(2, 600, 64)))
    y = 0.9 * x + 0.436 * y
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    codes, factors = neardup.encode(x)
    guess, width = neardup.estimates(codes, factors, y)
    error = guess - x @ y.T
    assert abs(error.mean()) < 2e-3
    assert (np.abs(error) <= width[:, None]).mean() > 0.995


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
