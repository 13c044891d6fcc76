"""Words of whole Arrow batches as NumPy arrays: places, and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        known = np.cumprod(out)
        if len(known) <= 1 << 22:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for pieces of at most ``most_bytes``, or one row where that is longer."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most_bytes, "right")) - 1)
        high = min(high, len(column))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """The words of some rows: ``start`` and ``end`` in the bytes, ``first`` the index of each row's first word (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, word: np.ndarray = ~SPACE):
        """``word`` tells of each byte whether it is part of a word."""
        self.data = _LOWER[data] if lower else data
        word = word[self.data]
        inner = offsets[1:-1]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edges = inner[inner < len(word)]
        begins[edges] = word[edges]
        self.start = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = inner[inner > 0] - 1
        ends[last] = word[last]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A hash for each word that depends on its bytes and length alone."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power(_INVERSE, n)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash for each run of ``size`` words; positions whose run would leave the array are not in it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n]
        out *= np.uint64((0x9FB21C651E98DF25 + 2 * seed * 0x632BE5AB) % (1 << 64) | 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[:n], out[rest : rest + n])
