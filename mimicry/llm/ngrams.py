"""Character n-grams of many texts at once, hashed, with the row each one belongs to."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from mimicry.llm.common import text_bytes

_PLANE = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: its lower case, and whether it is a letter."""
    lower, letter = np.arange(_PLANE, dtype=np.uint32), np.zeros(_PLANE, dtype=bool)
    for code in range(_PLANE):
        small = chr(code).lower()
        lower[code] = ord(small) if len(small) == 1 else code
        letter[code] = unicodedata.category(chr(code))[0] == "L"
    return lower, letter


@dataclass
class Letters:
    """Lower-case letters of the texts in a row, every run of others one blank.

    Each text starts and ends with a blank. ``borders[i]:borders[i + 1]`` are the places
    of text i; ``counts`` its letters.
    """

    codes: np.ndarray
    borders: np.ndarray
    counts: np.ndarray


def letters_of(column: pa.Array) -> Letters:
    codes, borders, is_letter = _decoded(column)
    lower, _ = _folds()
    folded = np.where(codes < _PLANE, lower[np.minimum(codes, _PLANE - 1)], codes)
    return _spaced(folded, borders, is_letter, is_letter)


def characters_of(column: pa.Array) -> Letters:
    """Like ``letters_of``, with all characters as they are; only white space turns to blanks."""
    codes, borders, is_letter = _decoded(column)
    return _spaced(codes, borders, ~((codes == 32) | ((codes >= 9) & (codes <= 13))), is_letter)


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, borders = text_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    _, letter = _folds()
    is_letter = letter[np.minimum(codes, _PLANE - 1)]
    for code in np.unique(codes[codes >= _PLANE]):
        is_letter[codes == code] = unicodedata.category(chr(code))[0] == "L"
    return codes, heads[borders], is_letter


def _spaced(codes: np.ndarray, borders: np.ndarray, shown: np.ndarray, is_letter: np.ndarray) -> Letters:
    """What is shown, each run of others as one blank, and a blank around each text."""
    keep = shown.copy()
    keep[1:] |= shown[:-1]  # the first of a run of others stays, as a blank
    starts = borders[:-1]
    full = np.flatnonzero(borders[1:] > starts)
    keep[starts[full]] = shown[starts[full]]
    kept = np.concatenate(([0], np.cumsum(keep)))[borders]
    sizes = np.diff(kept)
    new = np.concatenate(([0], np.cumsum(sizes + 2)))
    out = np.full(int(new[-1]), 32, dtype=np.uint32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(int(kept[-1])) + 2 * rows + 1] = np.where(shown, codes, 32)[keep]
    total = np.concatenate(([0], np.cumsum(is_letter)))[borders]
    return Letters(out, new, np.diff(total))


def hashed(letters: Letters, sizes: tuple[int, ...], bits: int, inside_words: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, borders) for each size: ids of the n-grams, text by text, below 2 ** bits.

    ``inside_words`` leaves out n-grams with a blank between their ends.
    """
    codes = letters.codes.astype(np.uint64)
    n_all = len(codes)
    blank = letters.codes == 32
    value = np.zeros(n_all, dtype=np.uint64)
    crossing = np.zeros(n_all, dtype=bool)
    for size in range(1, max(sizes) + 1):
        room = n_all - size + 1
        if room <= 0:
            value, crossing = value[:0], crossing[:0]
        else:
            value = (value[:room] + codes[size - 1 :] + np.uint64(1)) * _STEP
            value ^= value >> np.uint64(29)
            crossing = crossing[:room] | (blank[size - 2 : size - 2 + room] if size > 2 else False)
        if size not in sizes:
            continue
        ends = np.maximum(letters.borders[1:] - size + 1, letters.borders[:-1])
        marks = np.zeros(max(room, 0) + 1, dtype=np.int32)
        np.add.at(marks, np.minimum(letters.borders[:-1], max(room, 0)), 1)
        np.add.at(marks, np.minimum(ends, max(room, 0)), -1)
        valid = np.cumsum(marks[:-1]) > 0
        if inside_words:
            valid &= ~crossing
        elif size == 1:
            valid &= ~blank[: len(valid)]
        ids = ((value[valid] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
        where = np.concatenate(([0], np.cumsum(valid)))
        yield ids, where[np.minimum(letters.borders, max(room, 0))]


def distinct(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The different ids of one text; ``mark`` is scratch of one int32 for each id."""
    order = np.arange(len(ids), dtype=np.int32)
    mark[ids] = order
    return ids[mark[ids] == order]


def gathered(letters: Letters, sizes: tuple[int, ...], bits: int, inside_words: bool) -> Iterator[np.ndarray]:
    """All ids of each text in turn."""
    parts = list(hashed(letters, sizes, bits, inside_words))
    for i in range(len(letters.borders) - 1):
        yield np.concatenate([ids[at[i] : at[i + 1]] for ids, at in parts])
