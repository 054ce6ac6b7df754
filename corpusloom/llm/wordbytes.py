"""Words of many texts at once, as arrays over the bytes of an Arrow column.

Nothing here makes a Python object per word or per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a finalizer of the multiply-and-shift kind)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit value for a pair in order."""
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right + np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """1, b, b^2, ... modulo 2^64, and the same of the inverse of b."""
    both = []
    for base in (_BASE, _INVERSE):
        out = np.full(count, base, dtype=np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts with about ``most`` bytes, so that arrays over the bytes stay small
    however many rows a batch has. A longer text is a part of its own."""
    part = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, lower-cased from A to Z, and the end of each text in them.
    Null texts are empty. Bytes of neighbouring texts touch."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return _LOWER[data], offsets[1:] - offsets[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (a run without white space), and the number of words in each
    text. Words do not reach over the end of a text.

    Hashes are differences of running polynomial sums, brought to a common power.
    """
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[ends < len(data)]
    first[cuts] = inside[cuts]  # a text begins here
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    stops = np.flatnonzero(last)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # blocks of words, so that sums stay of bounded length
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + _BLOCK)))
        low = starts[i]
        part = data[low : stops[j - 1] + 1].astype(np.uint64)
        up, down = _powers(max(_BLOCK, 1 << int(len(part) - 1).bit_length()))
        sums = np.cumsum((part + np.uint64(1)) * up[: len(part)], dtype=np.uint64)
        s, e = starts[i:j] - low, stops[i:j] - low
        before = np.where(s > 0, sums[s - 1], np.uint64(0))
        out[i:j] = mix((sums[e] - before) * down[s] + (e - s).astype(np.uint64))
        i = j
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return out, counts
