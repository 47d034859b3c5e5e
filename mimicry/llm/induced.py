"""Suffixes of a text in order, with common prefixes, by external induced sorting.

Two scans induce all suffixes from those that start a local minimum (LMS): an ascending one
those that are larger than their successor, a descending one the others. A scan is a
priority queue of suffix tuples (symbol, place, number of the tuple that induced it); what
leaves it is written in order together with the length of the prefix it shares with the
tuple before, which is one more than the least such value between the two that induced
them. The LMS suffixes themselves are sorted by naming their substrings and recursion; below
``INDUCED_LEVELS`` levels, where a name stands for some ten symbols of the text, a few rounds
of doubling settle what is left.

The queue takes and gives tuples in bulk: a run of tuples leaves at once as long as nothing
it induces belongs before its end. Its runs, the history of common prefixes and the range
minima over it go to files in ``folder`` beyond ``memory`` tuples. Prefixes are followed to
``limit`` symbols only; suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np

MEMORY = 1 << 22
INDUCED_LEVELS = 2
_NEVER = np.int64(np.iinfo(np.int64).max)  # beyond all keys
_FIRST_BULK = 1 << 12
_MOST_BULK = 1 << 18


class Files:
    """Arrays in memory up to a size, and in files of the folder beyond it."""

    def __init__(self, folder: str | None, memory: int = MEMORY):
        self.folder, self.memory = folder, memory

    def empty(self, n: int, dtype: type) -> np.ndarray:
        if self.folder is None or n <= self.memory:
            return np.empty(n, dtype=dtype)
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        mapped = np.memmap(path, dtype=dtype, mode="w+", shape=n)
        os.unlink(path)  # the mapping keeps the file until it is given up
        return mapped

    def kept(self, values: np.ndarray) -> np.ndarray:
        out = self.empty(len(values), values.dtype)
        out[:] = values
        return out


class BulkQueue:
    """A priority queue of (key, place, source); equal keys leave as they came.

    Runs are sorted arrays; a new run is merged with those not larger than itself, so there
    are few. Long runs are files.
    """

    def __init__(self, files: Files):
        self.files = files
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.at: list[int] = []

    def push(self, keys: np.ndarray, places: np.ndarray, sources: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        run = keys[order], places[order], sources[order]
        while self.runs and len(self.runs[-1][0]) - self.at[-1] <= 2 * len(run[0]):
            older, at = self.runs.pop(), self.at.pop()
            both = [np.concatenate((old[at:], new)) for old, new in zip(older, run, strict=True)]
            order = np.argsort(both[0], kind="stable")
            run = tuple(x[order] for x in both)
        self.runs.append(tuple(map(self.files.kept, run)))
        self.at.append(0)

    def peek(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first ``most`` tuples in order, and the run each is in."""
        parts = [tuple(x[at : at + most] for x in run) for run, at in zip(self.runs, self.at, strict=True)]
        if not parts:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing, nothing
        keys, places, sources = (np.concatenate(x) for x in zip(*parts, strict=True))
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(keys, kind="stable")[:most]
        return keys[order], places[order], sources[order], of[order]

    def drop(self, of: np.ndarray) -> None:
        for run, n in enumerate(np.bincount(of, minlength=len(self.runs))):
            self.at[run] += int(n)
        left = [i for i, (run, at) in enumerate(zip(self.runs, self.at, strict=True)) if at < len(run[0])]
        self.runs, self.at = [self.runs[i] for i in left], [self.at[i] for i in left]


class RangeMinima:
    """Values in the order they come, and least values of ranges of them."""

    def __init__(self, n: int, dtype: type, files: Files):
        self.levels = [files.empty(max(1, n), dtype)]
        self.n, self.files = 0, files

    def append(self, values: np.ndarray) -> None:
        start, self.n = self.n, self.n + len(values)
        self.levels[0][start : self.n] = values
        step, level = 1, 1
        while 2 * step <= self.n:
            if level == len(self.levels):
                self.levels.append(self.files.empty(len(self.levels[0]), self.levels[0].dtype))
            low = max(0, start - 2 * step + 1)
            high = self.n - 2 * step + 1
            below = self.levels[level - 1]
            self.levels[level][low:high] = np.minimum(below[low:high], below[low + step : high + step])
            step, level = 2 * step, level + 1

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of each range, its last included; ranges are not empty."""
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        depth = np.frexp(last - first + 1)[1] - 1
        for level in np.unique(depth):
            own = depth == level
            values = self.levels[level]
            out[own] = np.minimum(values[first[own]], values[last[own] - (1 << int(level)) + 1])
        return out


@dataclass
class Order:
    places: np.ndarray
    shared: np.ndarray  # with the suffix before, 0 for the first


def scan(
    keys: np.ndarray, induces: np.ndarray, seeds: Order, runs: np.ndarray, behind: np.ndarray, limit: int, total: int, files: Files
) -> Order:
    """All seeds and all that they induce, in ascending order of the keys.

    Under one key what is induced stands before the seeds. ``induces`` tells of each place
    whether the suffix one before it is to be induced; ``runs`` how often its symbol repeats
    from there on, ``behind`` how often before.
    """
    queue = BulkQueue(files)
    out = _Output(keys, induces, runs, behind, limit, total, files)
    seed, bulk = 0, _FIRST_BULK
    seed_keys = keys[seeds.places]
    while True:
        k, p, s, of = queue.peek(bulk)
        sk = seed_keys[seed : seed + bulk]
        if not len(k) and not len(sk):
            break
        # Keys from ``bound`` on may go on beyond what is seen.
        bound = min([x[-1] for x in (k, sk) if len(x) == bulk], default=_NEVER)
        n_q, n_s = int(np.searchsorted(k, bound, "left")), int(np.searchsorted(sk, bound, "left"))
        if len(k) and k[0] == out.begun:  # a key that was begun piece by piece is ended so
            n_q, n_s = int(np.searchsorted(k, k[0], "right")), 0
            out.piece(k[:n_q], p[:n_q], s[:n_q], seeds.places[:0], seeds.shared[:0], queue, of)
        elif n_q + n_s:
            part = slice(seed, seed + n_s)
            n_q, n_s = out.whole_keys(k[:n_q], p[:n_q], s[:n_q], seeds.places[part], seeds.shared[part], queue, of)
            bulk = min(_MOST_BULK, max(_FIRST_BULK, 2 * (n_q + n_s)))
        elif bulk < _MOST_BULK:
            bulk = _MOST_BULK
            continue
        else:  # one key with more tuples than are looked at: piece by piece
            n_q = int(np.searchsorted(k, bound, "right"))
            n_s = 0 if n_q else int(np.searchsorted(sk, bound, "right"))
            part = slice(seed, seed + n_s)
            out.piece(k[:n_q], p[:n_q], s[:n_q], seeds.places[part], seeds.shared[part], queue, of)
        seed += n_s
    return Order(out.places[: out.done], out.history.levels[0][: out.done])


class _Output:
    """What has left the queue, and what of it is still needed to go on."""

    def __init__(self, keys, induces, runs, behind, limit: int, total: int, files: Files):
        self.keys, self.induces, self.runs, self.behind, self.limit = keys, induces, runs, behind, limit
        self.places = files.empty(total, np.int32)
        self.history = RangeMinima(total, np.min_scalar_type(limit), files)
        self.done = 0
        self.begun: int | None = None
        self.last = (np.iinfo(np.int64).min, -1, -1, False)  # key, source, place, and whether it was a seed

    def _shared(self, k, p, s, is_seed, seeds_shared):
        """What each tuple shares with the one before, of sources that have left already."""
        before_k, before_s = np.concatenate(([self.last[0]], k[:-1])), np.concatenate(([self.last[1]], s[:-1]))
        before_p = np.concatenate(([self.last[2]], p[:-1]))
        before_seed = np.concatenate(([self.last[3]], is_seed[:-1]))
        same = k == before_k
        shared = np.zeros(len(k), np.int64)
        both = np.flatnonzero(same & ~is_seed & ~before_seed)
        shared[both] = 1 + self.history.least(before_s[both] + 1, s[both]).astype(np.int64)
        seam = np.flatnonzero(same & is_seed & ~before_seed)
        shared[seam] = np.minimum(self.runs[p[seam]], self.runs[before_p[seam]])
        own = np.flatnonzero(is_seed)
        kept = same[own] & before_seed[own]
        shared[own[kept]] = seeds_shared[kept]
        return shared

    def _leave(self, k, p, s, is_seed, shared, queue: BulkQueue, sends) -> None:
        self.history.append(np.minimum(shared, self.limit))
        self.places[self.done : self.done + len(p)] = p
        at = np.flatnonzero(sends)
        queue.push(self.keys[p[at] - 1], (p[at] - 1).astype(np.int32), (self.done + at).astype(np.int32))
        self.done += len(p)
        self.last = (k[-1], s[-1], p[-1], bool(is_seed[-1]))

    def whole_keys(self, k, p, s, seed_places, seed_shared, queue: BulkQueue, of) -> tuple[int, int]:
        """Let whole keys leave, as many as nothing they induce belongs among.

        A tuple induces those before it in a run of its symbol in turn. Under a key they all
        follow the tuples at hand, round by round: in each the next of every run that is
        long enough, in the same order.
        """
        n_q, n_s = len(k), len(seed_places)
        back = self.behind[p]
        ends = p - back
        sk = self.keys[seed_places]
        sent = np.concatenate(
            [np.where(self.induces[x], self.keys[x - 1], _NEVER) for x in (ends, seed_places)]
        )
        every = np.concatenate((k, sk))
        order = np.argsort(every, kind="stable")
        least = np.minimum.accumulate(sent[order])
        first_bad = np.flatnonzero(every[order][1:] >= least[:-1])
        if len(first_bad):  # the keys before the one that would get more
            stop = every[order][first_bad[0] + 1]
            n_q, n_s = int(np.searchsorted(k, stop, "left")), int(np.searchsorted(sk, stop, "left"))
            k, p, s, back, sk, seed_places, seed_shared = k[:n_q], p[:n_q], s[:n_q], back[:n_q], sk[:n_s], seed_places[:n_s], seed_shared[:n_s]
        queue.drop(of[:n_q])
        owner = np.repeat(np.arange(n_q), back + 1)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(back + 1) - (back + 1), back + 1)
        rounds = np.lexsort((owner, turn, k[owner]))
        owner, turn = owner[rounds], turn[rounds]
        # Shared by neighbours of a later round: what they shared, and one more each round.
        plain = np.zeros(n_q, bool)
        base = self._shared(k, p, s, plain, seed_shared[:0])
        shared = turn.copy()
        follows = np.zeros(len(owner), bool)
        follows[1:] = (turn[1:] == turn[:-1]) & (k[owner[1:]] == k[owner[:-1]])
        if follows.any():
            at = np.flatnonzero(follows)
            between = RangeMinima(n_q, np.int32, Files(None))
            between.append(base)
            shared[at] = turn[at] + between.least(owner[at - 1] + 1, owner[at])
        heads = ~follows & (turn == 0)
        shared[heads] = base[owner[heads]]

        all_k = np.concatenate((k[owner], sk))
        order = np.argsort(all_k, kind="stable")
        all_p = np.concatenate((p[owner] - turn, seed_places))[order]
        all_s = np.concatenate((s[owner], np.full(n_s, -1)))[order]
        is_seed = order >= len(owner)
        all_k = all_k[order]
        joined = np.concatenate((shared, np.zeros(n_s, np.int64)))[order]
        with_seeds = self._seams(all_k, all_p, is_seed, seed_shared)
        joined = np.where(is_seed, with_seeds, joined)
        inner = np.concatenate((turn < back[owner], np.zeros(n_s, bool)))[order]
        self._leave(all_k, all_p, all_s, is_seed, joined, queue, self.induces[all_p] & ~inner)
        return n_q, n_s

    def _seams(self, k, p, is_seed, seed_shared):
        before_k = np.concatenate(([self.last[0]], k[:-1]))
        before_p = np.concatenate(([self.last[2]], p[:-1]))
        before_seed = np.concatenate(([self.last[3]], is_seed[:-1]))
        shared = np.zeros(len(k), np.int64)
        seam = np.flatnonzero(is_seed & (k == before_k) & ~before_seed)
        shared[seam] = np.minimum(self.runs[p[seam]], self.runs[before_p[seam]])
        own = np.flatnonzero(is_seed)
        kept = (k == before_k)[own] & before_seed[own]
        shared[own[kept]] = seed_shared[kept]
        return shared

    def piece(self, k, p, s, seed_places, seed_shared, queue: BulkQueue, of) -> None:
        """Let a part of one key leave: what is induced, or if nothing is, seeds."""
        is_seed = np.full(len(k) or len(seed_places), not len(k))
        if len(k):
            queue.drop(of[: len(k)])
            self.begun = int(k[0])
        else:
            p, k, s = seed_places, self.keys[seed_places], np.full(len(seed_places), -1)
        shared = self._shared(k, p, s, is_seed, seed_shared)
        self._leave(k, p, s, is_seed, shared, queue, self.induces[p])


def names_of(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the substrings ``symbols[start:end + 1]``, and how many symbols each rank
    shares with the one before.

    Substrings are compared a packed word at a time; those already told apart drop out.
    """
    bits = max(1, int(symbols.max(initial=1) + 1).bit_length())
    each = max(1, 62 // bits)
    n = len(starts)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the substring at each place of the order
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    shared = np.zeros(n, np.int64)
    sizes = ends - starts + 1
    active = np.arange(n)
    depth = 0
    while len(active):
        of = order[active]
        word = np.zeros(len(of), np.int64)
        for k in range(each):
            at = starts[of] + depth + k
            word = (word << bits) | np.where(depth + k < sizes[of], symbols[np.minimum(at, len(symbols) - 1)] + 1, 0)
        again = np.lexsort((word, group[active]))
        order[active] = of[again]
        word = word[again]
        g = group[active]
        differs = np.zeros(len(active), bool)
        differs[1:] = (word[1:] != word[:-1]) & (g[1:] == g[:-1])
        at = np.flatnonzero(differs)
        if len(at):
            gap = np.frexp((word[at] ^ word[at - 1]).astype(np.float64))[1]
            same = each - 1 - (gap - 1) // bits
            # Beyond 53 bits a float may round up to the next power; settle by comparison.
            for _ in range(2):
                shift = (each - 1 - same) * bits
                high = (word[at] >> shift) == (word[at - 1] >> shift)
                same = np.where(high, same + 1, same)
            shared[active[at]] = depth + same
            new[active[at]] = True
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        count = np.diff(np.append(heads, n))
        depth += each
        ended = sizes[order] <= depth
        active = np.flatnonzero((count[group] > 1) & ~ended)
    names = np.empty(n, np.int32)
    names[order] = group
    return names, shared[np.flatnonzero(new)]


def sorted_suffixes(text: np.ndarray, limit: int, files: Files, level: int = 0) -> Order:
    """Suffixes of ``text`` in descending order, each with what it shares with the one before.

    ``text`` is integers, the last 0 and smaller than all others; that suffix is left out.
    Places are 32-bit numbers: a text has less than 2 ** 31 symbols.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    heads, ends = np.append(0, change), np.append(change, n)
    place = np.arange(n, dtype=np.int32)
    heads, ends = heads.astype(np.int32), ends.astype(np.int32)
    runs = np.repeat(ends, ends - heads) - place
    behind = place - np.repeat(heads, ends - heads)
    small = text[np.minimum(place + runs, n - 1)] > text  # smaller than its successor
    small[-1] = True
    first = small.copy()
    first[0] = False
    first[1:] &= ~small[:-1]
    minima = np.flatnonzero(first).astype(np.int32)
    del place, heads, ends, first

    seeds = _sorted_minima(text, small, minima, runs, limit, files, level)
    up = ~small  # the suffix before a place is induced in the ascending scan if it is large
    induced_up = np.zeros(n, bool)
    induced_up[1:] = up[:-1]
    large = scan(text, induced_up, seeds, runs, behind, limit, int(up.sum()) + len(minima), files)
    own = up[large.places]
    # No minimum stands between two large suffixes of one symbol.
    large = Order(large.places[own], large.shared[own])
    back = np.concatenate(([0], large.shared[1:][::-1])) if len(own) else large.shared
    same = np.zeros(len(large.places), bool)
    same[1:] = text[large.places[1:]] == text[large.places[:-1]]
    back = np.concatenate(([0], np.where(same[1:], large.shared[1:], 0)[::-1])) if len(same) else back
    induced_down = np.zeros(n, bool)
    induced_down[1:] = small[:-1]
    down = Order(large.places[::-1], back)
    return scan(-text, induced_down, down, runs, behind, limit, n, files)


def doubled(text: np.ndarray, limit: int, files: Files, level: int = 0) -> Order:
    """Like ``sorted_suffixes``: ranks by one symbol, then by twice as many, up to the limit.

    What neighbours share follows from the rounds in which their ranks were still equal.
    """
    n = len(text)
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < limit and ranks[-1].max() + 1 < n:
        # Beyond the end stands nothing, smaller than any rank.
        key = ranks[-1] * (n + 1)
        key[:-width] += ranks[-1][width:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")[::-1]
    order = order[order != n - 1]
    x, y = order[1:].copy(), order[:-1].copy()
    shared = np.zeros(len(order), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (x < n) & (y < n)
        same = np.zeros(len(x), bool)
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        step = same * (1 << k)
        shared[1:] += step
        x, y = x + step, y + step
    return Order(order, np.minimum(shared, limit))


def _sorted_minima(text, small, minima, runs, limit, files, level) -> Order:
    """The LMS suffixes in ascending order, by names of their substrings and recursion."""


    def characters(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Characters shared by suffixes whose first different symbol is the one at ``q``.

        If only its type differs, the shorter of the two runs is shared as well.
        """
        px, py = x + q, y + q
        return np.minimum(limit, q + np.where(text[px] == text[py], np.minimum(runs[px], runs[py]), 0))

    # A symbol is a character with its type: of equal ones the small suffix comes later.
    stops = np.append(minima[1:], minima[-1:])
    names, apart = names_of(2 * text + small, minima, stops)
    order = np.argsort(names, kind="stable")
    shared = np.zeros(len(minima), np.int64)
    if len(apart) == len(minima) or 2 << level >= limit:
        x, y, high, low = minima[order][1:], minima[order][:-1], names[order][1:], names[order][:-1]
        told = np.flatnonzero(high != low)
        shared[1:] = limit  # a name covers the limit: equal names, equal prefixes
        shared[1 + told] = characters(x[told], y[told], apart[high[told]])
        return Order(minima[order], shared)
    deeper = (sorted_suffixes if level + 1 < INDUCED_LEVELS else doubled)(names, limit, files, level + 1)
    # The last name is the sentinel's, the smallest; the recursion leaves it out.
    order = np.append(deeper.places, len(minima) - 1)[::-1]
    equal = np.concatenate(([0, 0], deeper.shared[1:][::-1])).astype(np.int64)[: len(order)]
    # Prefixes are followed to the limit only, so larger values need not be told apart.
    minimum = RangeMinima(len(apart), np.min_scalar_type(limit), files)
    minimum.append(np.minimum(apart, limit))
    x, y, e = order[1:], order[:-1], equal[1:]
    e = np.minimum(e, len(minima) - 1 - np.maximum(x, y))
    low, high = names[y + e], names[x + e]
    shared[1:] = limit
    told = np.flatnonzero((low != high) & (equal[1:] < limit))
    x, y, e = x[told], y[told], e[told]
    symbols = minimum.least(np.minimum(low, high)[told] + 1, np.maximum(low, high)[told]).astype(np.int64)
    covered = minima[x + e] - minima[x]
    shared[1 + told] = np.minimum(limit, covered + characters(minima[x + e], minima[y + e], symbols))
    return Order(minima[order], shared)


def repeated(text: np.ndarray, limit: int, folder: str | None = None, memory: int = MEMORY) -> np.ndarray:
    """Whether the ``limit`` symbols from each place on also start at another place.

    ``text`` holds positive integers; places closer than ``limit`` to the end are judged by
    what they share, which cannot reach the limit.
    """
    found = np.zeros(len(text), bool)
    if len(text) < 2:
        return found
    order = sorted_suffixes(np.append(text, 0).astype(np.int32), limit, Files(folder, memory))
    hit = np.flatnonzero(order.shared >= limit)
    found[order.places[hit]] = True
    found[order.places[hit - 1]] = True
    return found
