"""Fingerprints of byte ranges and words, on whole buffers at once.

A range is hashed as a polynomial modulo 2^64 from two prefix values, so any
number of overlapping ranges costs one pass over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII upper case to lower case, and the bytes that part words: space and 9 to 13.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PARTS = np.zeros(256, bool)
PARTS[[9, 10, 11, 12, 13, 32]] = True


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Ranges:
    """Fingerprints of ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        up, self._down = _tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def rolling(self, length: int) -> np.ndarray:
        """All ranges of one length, by start."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without copying, and where each row starts (null: no bytes)."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def parts(offsets: np.ndarray, most: int = 1 << 20, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together (one row at least), so that work arrays stay small."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words do not cross rows."""
    solid = ~PARTS[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    opens[firsts] |= solid[firsts]
    starts = np.flatnonzero(opens)
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | opens[1:]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(values: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``size`` words in a row; a row with fewer words has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n_rows), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    out = np.repeat(np.minimum(counts, size), many).astype(np.uint64)
    for k in range(size):
        live = at + k < first[owner + 1]
        word = values[np.minimum(at + k, len(values) - 1)] if len(values) else np.zeros(0, np.uint64)
        out = np.where(live, mix(out * np.uint64(_BASE) + word), out)
    return out, owner


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64 bits as Spark's long."""
    return x.view(np.int64)
