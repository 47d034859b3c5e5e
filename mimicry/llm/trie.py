"""The trie of conversation prefixes, from sorted sequences and their common prefixes.

A turn is 16 bytes of a hash of its role and text, a conversation the sequence of them; equal
sequences are one class. Classes are sorted over ranges, the shards. In a shard every candidate
prefix (a class and a depth) searches how far it reaches to either side by itself: a binary
search over a sparse table of minima of the common prefixes of neighbours. A candidate that
starts at its own class is a node; its counts are differences of running sums over the classes,
its smallest member a range minimum.

Prefixes that cross an end of their shard (at most the turns that the two classes there share)
give one partial row a shard, named by a hash of the prefix; these rows are added up by Spark,
so a first turn that most conversations share is spread over all shards. All counts add up:
saved tokens are the tokens of all members below a node, less those of its different turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mimicry.llm.common import stored, table, text_bytes

KEY_BYTES = 16
SHARD_TURNS = 200_000  # turns of different sequences in a shard, about

ROWS = (
    "id binary, parent_id binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, tokens long, distinct_tokens long, before long, key binary, ends binary"
)


@dataclass
class Trie:
    """``nodes`` (conv_id, the smallest member; depth; parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens; key of the last turn; ends, naming the sequence that ends here) and
    ``members`` (conv_id, ends): where each conversation ends."""

    nodes: DataFrame
    members: DataFrame


def turns(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text, key, points) of each turn; null role or text is empty.

    Rows without a conversation belong to none and are left out.
    """
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("_key", F.unhex(F.sha2(framed, 256))).select(
        "*", F.expr(f"substring(_key, 1, {KEY_BYTES})").alias("key"), F.char_length("text").alias("points")
    ).drop("_key")


def sequences(said: DataFrame) -> DataFrame:
    """(conv_id, turns) in the order of the turns, null first, equal ones by their keys.

    The keys of a conversation, 20 bytes a turn, are one row; its texts are not.
    """
    whole = F.sort_array(F.collect_list(F.struct("turn", "key", "points")))
    return said.groupBy("conv_id").agg(whole.alias("turns")).select(
        "conv_id", F.transform("turns", lambda x: F.struct(x.key.alias("key"), x.points.alias("points"))).alias("turns")
    )


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> Trie:
    """The trie of (conv_id, turns); ids are distinct and not null, turns may be an empty array.

    No rows have no trie, not even a root. Columns besides the two play no part.
    """
    joined = F.array_join(F.transform("turns", lambda x: x.key.cast("string")), "").cast("binary")
    keyed = rows.select("conv_id", joined.alias("keys"), F.col("turns.points").alias("points"))
    keyed = stored(keyed.withColumn("ends", F.unhex(F.sha2("keys", 256))), "trie-sequences")
    classes = keyed.groupBy("ends").agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("points").alias("points")
    )
    classes = stored(classes, "trie-classes")
    size = classes.agg(F.coalesce(F.sum(F.size("points")), F.lit(0))).first()[0]
    dealt = classes.repartitionByRange(-(-size // shard_turns) or 1, "keys").withColumn("shard", F.spark_partition_id())
    shards = stored(dealt, "trie-shards")
    by_shard = Window.orderBy("shard")  # one row a shard
    ends = shards.groupBy("shard").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    ends = ends.select("shard", F.lag("last").over(by_shard).alias("before"), F.lead("first").over(by_shard).alias("after"))
    beside = ends.select("shard", F.expr("stack(2, -1, before, 1, after) AS (side, keys)")).filter("keys IS NOT NULL")
    grouped = shards.withColumn("side", F.lit(0)).unionByName(beside, allowMissingColumns=True).groupBy("shard")
    found = stored(grouped.applyInArrow(_shard_nodes, ROWS), "trie-nodes")
    return Trie(_completed(found), keyed.select("conv_id", "ends"))


def _completed(found: DataFrame) -> DataFrame:
    """Add up the partial rows and look up the parents that are among them."""
    sums = ("n_convs", "n_children", "n_leaves", "tokens", "distinct_tokens")
    same = ("parent_id", "depth", "before", "key", "ends")
    crossing = found.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in same]
    )
    crossing = stored(crossing.withColumn("parent_conv_id", F.lit(None).cast("long")), "trie-crossing")
    inside = found.filter("id IS NULL")
    under = inside.filter("parent_id IS NOT NULL").unionByName(crossing.filter("parent_id IS NOT NULL"))
    above = crossing.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("_parent"))
    under = under.join(above, "parent_id", "left").withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    whole = inside.filter("parent_id IS NULL").unionByName(under).unionByName(crossing.filter("parent_id IS NULL"))
    saved = F.col("tokens") - F.col("n_convs") * F.col("before") - F.col("distinct_tokens")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "key", "ends"
    )


def _common(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it."""
    size = np.diff(start)
    most = np.minimum(size[:-1], size[1:])
    pair = np.repeat(np.arange(len(most)), most)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
    differ = np.flatnonzero((words[start[pair] + place] != words[start[pair + 1] + place]).any(axis=1))
    which, first = np.unique(pair[differ], return_index=True)
    most[which] = place[differ[first]]
    return most


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at ``[level][i]`` the minimum of 2**level values from i on."""
    levels = [values]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]))
    return levels


def _extents(minima: list[np.ndarray], place: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last class around each place with at least ``depth`` turns in common throughout."""
    left, right = place.copy(), place.copy()
    last = len(minima[0]) - 1
    for level in range(len(minima) - 1, -1, -1):
        row, step = minima[level], 1 << level
        far = row[np.minimum(right + 1, len(row) - 1)] >= depth
        right = np.where((right + step <= last) & far, right + step, right)
        far = row[np.maximum(left - step + 1, 0)] >= depth
        left = np.where((left - step >= 0) & far, left - step, left)
    return left, right


def _range_minimum(minima: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    level = np.frexp((right - left + 1).astype(float))[1] - 1
    out = np.empty(len(left), dtype=np.int64)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(minima[k][left[at]], minima[k][right[at] - (1 << k) + 1])
    return out


def _prefix_ids(keys: bytes, most: int) -> list[bytes]:
    """A hash of the first 0 to ``most`` turns."""
    running, out = hashlib.sha256(), []
    for depth in range(most + 1):
        out.append(running.digest())
        running.update(keys[depth * KEY_BYTES : (depth + 1) * KEY_BYTES])
    return out


def _shard_nodes(group: pa.Table) -> pa.Table:
    """Nodes of a shard, and partial rows of the prefixes that cross its ends."""
    side = group.column("side")
    classes = group.filter(pc.equal(side, 0)).sort_by("keys")
    k = len(classes)
    beside = [group.filter(pc.equal(side, s)).column("keys").to_pylist() for s in (-1, 1)]
    data, borders = text_bytes(pa.array([*beside[0], *classes.column("keys").to_pylist(), *beside[1]], pa.large_binary()))
    words = np.frombuffer(data.tobytes(), dtype=np.uint64).reshape(-1, KEY_BYTES // 8)
    start = borders // KEY_BYTES
    shared = np.full(k + 1, -1, dtype=np.int64)  # with the class before, and the one behind the last
    inner = slice(0 if beside[0] else 1, k + 1 if beside[1] else k)
    shared[inner] = _common(words, start)
    if beside[0]:
        start = start[1:]
    start = start[: k + 1]
    size = np.diff(start)
    first, final = int(shared[0]), int(shared[k])

    points = np.zeros(len(words) + 1, dtype=np.int64)
    lists = classes.column("points").combine_chunks()
    points[start[0] + 1 : start[k] + 1] = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    count, least = (classes.column(c).to_numpy().astype(np.int64) for c in ("n", "least"))

    def running(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)])

    own_tokens = points[start[1:]] - points[start[:-1]]
    new_tokens = points[start[1:]] - points[start[:-1] + np.maximum(shared[:k], 0)]
    members, tokens, different = running(count), running(count * own_tokens), running(new_tokens)
    leaves = running(shared[1:] < size)

    reach = shared[:k].copy()
    reach[0] = -1
    minima = _minima(reach)
    lowest = np.maximum(reach, 0)
    tried = size - lowest + 1
    place = np.repeat(np.arange(k), tried)
    depth = lowest[place] + np.arange(len(place)) - np.repeat(np.cumsum(tried) - tried, tried)
    left, right = _extents(minima, place, depth)
    smallest = _range_minimum(_minima(least), left, right)
    from_left = (left == 0) & (depth <= first)
    crosses = from_left | ((right == k - 1) & (depth <= final))

    ids = np.full(len(place), None, dtype=object)
    for at, most, row in ((from_left, first, 0), (crosses & ~from_left, final, k - 1)):
        where = np.flatnonzero(at)
        if len(where):
            named = _prefix_ids(words[start[row] : start[row + 1]].tobytes(), most)
            ids[where] = np.array([*named, None], dtype=object)[depth[where]]

    here = np.flatnonzero(left == place)  # each candidate at its own first class: the nodes
    up = here - 1  # candidates of a class stand by depth, from its parent's on
    top = depth[here] == 0
    l, r, d = left[here], right[here], depth[here]
    new = d > shared[l]
    order = np.sort(reach[1:] * (k + 1) + np.arange(1, k))
    branches = np.searchsorted(order, d * (k + 1) + r, side="right") - np.searchsorted(order, d * (k + 1) + l, side="right")
    children = branches + ((size[l] > d) & (shared[l] <= d))
    before = points[start[l] + np.maximum(d - 1, 0)]
    own = np.where(new, points[start[l + 1]] - before, new_tokens[l])
    last = words[np.maximum(start[l] + d - 1, 0)] if len(words) else np.zeros((len(l), 2), np.uint64)
    keys = np.ascontiguousarray(last).tobytes()
    ends = classes.column("ends").combine_chunks().take(pa.array(np.where(new & (d == size[l]), l, -1), mask=~(new & (d == size[l]))))
    columns = {
        "id": pa.array(ids[here], pa.binary()),
        "parent_id": pa.array(np.where(top, None, ids[up]), pa.binary()),
        "conv_id": pa.array(smallest[here]),
        "parent_conv_id": pa.array(smallest[up], mask=top | np.array([x is not None for x in ids[up]], dtype=bool)),
        "depth": pa.array(d),
        "n_convs": pa.array(members[r + 1] - members[l]),
        "n_children": pa.array(children),
        "n_leaves": pa.array(leaves[r + 1] - leaves[l]),
        "tokens": pa.array(tokens[r + 1] - tokens[l]),
        "distinct_tokens": pa.array(own + different[r + 1] - different[l + 1]),
        "before": pa.array(before - points[start[l]]),
        "key": pa.array([None if t else keys[i * KEY_BYTES : (i + 1) * KEY_BYTES] for i, t in enumerate(top)], pa.binary()),
        "ends": ends.cast(pa.binary()),
    }
    return pa.table(columns)


def spoken(nodes: DataFrame, said: DataFrame) -> DataFrame:
    """``nodes`` with role and text of the last turn, null for the root; ``said`` comes from :func:`turns`."""
    texts = said.groupBy("key").agg(F.min(F.struct("role", "text")).alias("_said"))
    return nodes.join(texts, "key", "left").select(*nodes.columns, "_said.role", "_said.text")


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each run of one sequence, joined by commas; rows come sorted."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, ids = batch.column("ends"), batch.column("conv_id")
        starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(ends[1:], ends[:-1]).to_numpy(zero_copy_only=False)) + 1])
        runs = pa.ListArray.from_arrays(pa.array([*starts, len(ids)], pa.int32()), ids.cast(pa.string()))
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([ends.take(at), ids.take(at), pc.binary_join(runs, ",")], ["ends", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the fragments of each sequence, in order; one running state is held."""
    current, running = None, hashlib.sha256()
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if ends == current:
                running.update(b",")
            else:
                if current is not None:
                    out.append((current, running.hexdigest()))
                current, running = ends, hashlib.sha256()
            running.update(ids.encode())
        yield _digest_rows(out)
    if current is not None:
        yield _digest_rows([(current, running.hexdigest())])


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["ends", "ends_sha256"]
    )


def end_digests(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256) over the ascending ids of each sequence's conversations.

    Ids are sorted over ranges and joined in fragments where they lie, so a sequence of very
    many conversations reaches the task that hashes it as few rows.
    """
    ranged = members.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id")
    parts = ranged.select("ends", "conv_id").mapInArrow(_fragments, "ends binary, first long, ids string")
    met = parts.repartition("ends").sortWithinPartitions("ends", "first").select("ends", "ids")
    return met.mapInArrow(_digested, "ends binary, ends_sha256 string")


GROUP, MOST_SHARED = 100, 6


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns) of each conversation with the first h turns of its group's first one.

    h = crc32(decimal conv_id) % 6; all turns if there are fewer, none if the group's first
    conversation is absent; then the conversation's own turns after its first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, MOST_SHARED - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("int")
    rows = own.withColumn("_base", base).withColumn("_h", h).join(heads, "_base", "left")
    tail = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    head = F.slice("_head", F.lit(1), F.col("_h"))
    return rows.select("conv_id", F.when(F.col("_head").isNull(), tail).otherwise(F.concat(head, tail)).alias("turns"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(table(spark, sf_dir, "conversations"))
    trie = prefix_trie(rebuilt(stored(sequences(said), "trie-conversations")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ending = trie.nodes.filter("ends IS NOT NULL").join(end_digests(trie.members), "ends").select(*columns, "ends_sha256")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return ending.union(trie.nodes.filter("ends IS NULL").select(*columns, none))


# The same result for an independent engine: prefixes as lists, CRC-32 bit by bit.
OP11_SQL = """
WITH said AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
  SELECT conv_id, turns, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
         lambda c: list_transform(range(8), lambda i: (ord(c) >> i::INT) & 1)))) AS message
  FROM said),
shared AS (
  SELECT conv_id, turns, xor(list_reduce(message, lambda crc, bit:
           xor(crc >> 1, CASE WHEN (crc & 1) <> bit THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
  FROM bits),
whole AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM shared a LEFT JOIN shared b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS at_end, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS points
  FROM whole, unnest(range(len(turns) + 1)) u(d)),
nodes AS MATERIALIZED (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth),
family AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[1:n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
below AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.points) AS saved_tokens
  FROM family b, unnest(range(b.depth + 1)) u(d) JOIN family a ON a.depth = d AND a.prefix = b.prefix[1:d]
  GROUP BY a.conv_id, a.depth)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM family f JOIN below b ON b.conv_id = f.conv_id AND b.depth = f.depth
"""
