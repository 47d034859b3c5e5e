"""The memory of first sightings: what it holds, what a look-up reads, how many folders it keeps."""

from __future__ import annotations

import re

import pytest

from mimicry.sources import files
from mimicry.sources.keyed import KeyedStore, Run

SCHEMA = "k string, n bigint, v string"


def keyed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_rows_win_over_many_batches(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ("k", "n"), fan=3, part_rows=4)
    held, most = {}, 0
    for batch in range(20):
        rows = [(f"k{i}", None if i % 7 == 0 else i % 5, f"{batch}") for i in range(batch * 2, batch * 2 + 9)]
        store.merge(batch)
        fresh = store.absent(keyed(spark, rows).persist(), batch)
        for _ in range(2):  # a replayed batch replaces its run
            store.add(fresh, batch)
        for k, n, v in rows:
            held.setdefault((k, n), v)
        most = max(most, len(files.subfolders(spark, f"{tmp_path}/s")))
    assert {(r.k, r.n): r.v for r in store.rows().collect()} == held
    assert store.rows().count() == len(held)
    assert len(store.runs()) <= 3 * 3 and most <= 14  # sizes 0, 1 and 2, and what a merge has just replaced
    assert [r.last + 1 for r in store.runs()][:-1] == [r.first for r in store.runs()][1:]
    assert store.rows(before=5).count() <= store.rows().count()


def test_a_look_up_lists_only_the_parts_of_its_keys(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ("k",), fan=2, part_rows=10)
    for batch in range(4):
        store.merge(batch)
        store.add(keyed(spark, [(f"k{batch}-{i}", i, "x" * 50) for i in range(100)]), batch)
    store.merge(4)
    (run,) = store.runs()
    assert run == Run(0, 3, 64)
    found = store.stored_keys(keyed(spark, [("k1-7", 0, ""), ("none", 0, "")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = re.search(r"key_part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    listed = set((parts[1] or parts[2]).split(","))
    want = {str(r[0]) for r in keyed(spark, [("k1-7", 0, ""), ("none", 0, "")]).select(store._place(64)).collect()}
    assert listed == want and len(listed) <= 2
    assert "v#" not in re.search(r"ReadSchema: (\S+)", plan)[1]  # keys only
    assert {r.k for r in found.collect()} >= {"k1-7"} and found.count() < 40
    assert [r.k for r in store.absent(keyed(spark, [("k1-7", 0, ""), ("none", 0, ""), (None, 1, "")])).collect()] != []


def test_a_merge_that_broke_off_is_done_again(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ("k",), fan=2, part_rows=100)
    for batch in range(2):
        store.add(keyed(spark, [(f"k{batch}", 1, "")]), batch)
    half = tmp_path / "s" / Run(0, 1, 1).name
    half.mkdir()
    (half / "part-00000.parquet").write_bytes(b"cut off")
    assert {r.k for r in store.rows().collect()} == {"k0", "k1"}  # not yet whole: does not count
    store.merge(2)
    assert store.runs() == [Run(0, 1, 1)] and {r.k for r in store.rows().collect()} == {"k0", "k1"}
    assert len(files.subfolders(spark, f"{tmp_path}/s")) == 3  # what was replaced goes with the next batch
    store.merge(3)
    assert files.subfolders(spark, f"{tmp_path}/s") == [Run(0, 1, 1).name]


def test_empty_store_and_null_keys(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ("k", "n"))
    assert store.rows().collect() == [] and store.runs() == []
    rows = keyed(spark, [(None, None, "a"), ("x", None, "b")])
    assert store.absent(rows).count() == 2
    store.add(rows, 0)
    assert store.absent(rows, 1).count() == 0
    log = KeyedStore(spark, f"{tmp_path}/log", SCHEMA, fan=2)
    for batch in range(5):
        log.merge(batch)
        log.add(rows, batch)
    assert log.rows().count() == 10 and len(log.runs()) <= 3


def test_small_files_are_created_once(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    (tmp_path / "a").mkdir()
    assert files.create(spark, path, "one é") is True
    assert files.create(spark, path, "two") is False
    assert files.read_small(spark, path) == "one é"
    assert files.subfolders(spark, f"{tmp_path}/a") == ["b.json"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_small(spark, f"{tmp_path}/none")
