"""Nodes against a dictionary of prefixes; rebuilt conversations and end digests against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mimicry.llm import trie as tr

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            said[conv].append((turn is not None, turn or 0, key, (role, text)))
    return {c: [x[-1] for x in sorted(t)] for c, t in said.items()}


def plain_rebuilt(said):
    out = {}
    for c, own in said.items():
        base = c - (abs(c) % 100 * (1 if c >= 0 else -1))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(base, [])[:h] + own[h:]
    return out


def plain_nodes(said):
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        leaves[prefix] = sum(leaves[x] for x in below) or 1
        own = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        saved[prefix] = own + sum(saved[x] for x in below)
    rows = []
    for prefix, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(said[c]) == len(prefix))
        rows.append((
            min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), len(children[prefix]),
            leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def made(seed):
    rng = random.Random(seed)
    rows = []
    common = [("system", "you are helpful 😀"), ("user", "hi"), ("assistant", "")]
    for c in [*range(0, 230), -250, -200, -7, 10**15]:
        if c == 100:
            continue  # a group without its first conversation
        kind = rng.random()
        if kind < 0.3:
            turns = list(common)  # one common conversation
        elif kind < 0.6:
            turns = common[:1] + [(rng.choice("ua"), rng.choice(["x", "y", "é" * 40])) for _ in range(rng.randrange(5))]
        else:
            turns = [(rng.choice(["u", None, ""]), rng.choice(["x", None, "", "long " * 2_000])) for _ in range(rng.randrange(1, 9))]
        numbers = rng.choice([list(range(len(turns))), [3 * i - 4 for i in range(len(turns))]])
        if numbers and rng.random() < 0.2:
            numbers[0] = None
        rows += [(c, n, *t) for n, t in zip(numbers, turns, strict=True)]
    rows += [(300, 1, "u", "tied"), (300, 1, "u", "tied"), (300, 1, "a", "tied too"), (None, 0, "u", "nobody"), (None, None, None, None)]
    rows += [(301, i, "u", f"turn {i % 3}") for i in range(700)] + [(302, i, "u", f"turn {i % 3}") for i in range(650)]
    rng.shuffle(rows)
    return rows


def result(trie):
    rows = trie.nodes.join(tr.end_digests(trie.members), "ends", "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return sorted(((*(r[c] for c in names), r.ends_sha256 or none) for r in rows), key=str)


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 10**6), (2, 40), (3, 7), (4, 150)])
def test_nodes(spark, seed, shard_turns):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, shard int, key string")
    own = tr.sequences(tr.turns(df))
    said = ordered(rows)
    assert result(tr.prefix_trie(own, shard_turns)) == plain_nodes(said)
    assert result(tr.prefix_trie(tr.rebuilt(own), shard_turns)) == plain_nodes(plain_rebuilt(said))


def test_empty_and_turnless(spark):
    assert tr.prefix_trie(tr.sequences(tr.turns(spark.createDataFrame([], SCHEMA)))).nodes.collect() == []
    rows = [(i, 0, "u", "alone") for i in range(101, 160)]
    own = tr.sequences(tr.turns(spark.createDataFrame(rows, SCHEMA)))
    assert result(tr.prefix_trie(tr.rebuilt(own), 5)) == plain_nodes(plain_rebuilt(ordered(rows)))
    only = own.select("conv_id", F.slice("turns", 1, 0).alias("turns"))
    assert result(tr.prefix_trie(only)) == plain_nodes({c: [] for c in range(101, 160)})


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?"), (2, 0, "user", "hi"), (2, 1, None, None)]
    said = tr.turns(spark.createDataFrame(rows, SCHEMA))
    nodes = tr.spoken(tr.prefix_trie(tr.sequences(said)).nodes, said).collect()
    got = sorted((r.depth, r.conv_id, r.role, r.text) for r in nodes if r.depth)
    assert got == [(1, 1, "user", "hi"), (2, 1, "assistant", "yes?"), (2, 2, "", "")]
    assert [(r.role, r.text) for r in nodes if not r.depth] == [(None, None)]


def test_many_ends_of_one_sequence(spark):
    ids = spark.range(-3_000, 30_000).withColumnRenamed("id", "conv_id").withColumn("ends", F.lit(b"x"))
    got = tr.end_digests(ids.repartition(7)).collect()
    want = hashlib.sha256(",".join(map(str, range(-3_000, 30_000))).encode()).hexdigest()
    assert [(bytes(r.ends), r.ends_sha256) for r in got] == [(b"x", want)]
