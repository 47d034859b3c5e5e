"""Minimal perfect hashes over sets of keys, with the keys stored for verification.

A level gives every key left a place; keys alone in theirs keep it, the others go to the next
level. A key's slot is the rank of its place among all that are taken, so ``n`` keys have the
slots 0 to n - 1. A key that is not in the set may land on a taken place too: a look-up is
answered only if the key stored at the slot is the one asked for. Keys whose 64-bit hashes are
equal never part; they are listed after the levels and found by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mimicry.llm.common import mixed, span_hashes, text_bytes

SPARE = 2.0  # places for each key that is left
LEVELS = 48
_SEED = 0xD1B54A32D192ED03


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of binary keys."""
    data, borders = text_bytes(keys)
    return span_hashes(data, borders[:-1], borders[1:])


def _places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    seed = np.uint64(_SEED * (level + 1) % (1 << 64))
    return (mixed(hashes ^ seed) % np.uint64(width)).astype(np.int64)


@dataclass
class PerfectHash:
    """``levels`` are the taken places, ``keys`` the keys in the order of their slots."""

    levels: list[np.ndarray]
    keys: pa.Array

    def __post_init__(self) -> None:
        self.ranks, before = [], 0
        for taken in self.levels:
            self.ranks.append(before + np.cumsum(taken, dtype=np.int64) - 1)
            before += int(taken.sum())
        self.listed = {key.as_py(): before + i for i, key in enumerate(self.keys[before:])}

    def __len__(self) -> int:
        return len(self.keys)

    @classmethod
    def build(cls, keys: pa.Array) -> PerfectHash:
        """Of distinct binary keys."""
        keys = keys.cast(pa.large_binary())
        hashes = key_hashes(keys)
        left, levels, order = np.arange(len(keys)), [], []
        while len(left) and len(levels) < LEVELS:
            width = int(SPARE * len(left)) + 1
            place = _places(hashes[left], len(levels), width)
            alone = np.bincount(place, minlength=width)[place] == 1
            taken = np.zeros(width, dtype=bool)
            taken[place[alone]] = True
            levels.append(taken)
            order.append(left[alone][np.argsort(place[alone])])
            left = left[~alone]
        return cls(levels, keys.take(pa.array(np.concatenate([*order, left]))))

    def slots(self, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not in the set."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, taken in enumerate(self.levels):
            place = _places(hashes[left], level, len(taken))
            hit = taken[place]
            found[left[hit]] = self.ranks[level][place[hit]]
            left = left[~hit]
        at = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[at])), keys.take(pa.array(at)).cast(pa.large_binary()))
        found[at[~same.to_numpy(zero_copy_only=False).astype(bool)]] = -1
        if self.listed:
            for i in left:
                found[i] = self.listed.get(keys[int(i)].as_py(), -1)
        return found

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Widths and bits of the levels, borders and bytes of the keys."""
        data, borders = text_bytes(self.keys)
        widths = np.array([len(level) for level in self.levels], dtype=np.int64)
        bits = b"".join(np.packbits(level).tobytes() for level in self.levels)
        return widths.tobytes(), bits, borders.astype(np.int64).tobytes(), data.tobytes()

    @classmethod
    def unpacked(cls, widths: bytes, bits: bytes, borders: bytes, data: bytes) -> PerfectHash:
        levels, start, flat = [], 0, np.frombuffer(bits, dtype=np.uint8)
        for width in np.frombuffer(widths, dtype=np.int64):
            stop = start + (int(width) + 7) // 8
            levels.append(np.unpackbits(flat[start:stop], count=int(width)).astype(bool))
            start = stop
        n = len(borders) // 8 - 1
        keys = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(borders), pa.py_buffer(data)])
        return cls(levels, keys)
