"""Vectorised views of text columns inside tasks: bytes, words, k-grams and their 64-bit hashes.

Everything works on one flat byte array for many texts, in chunks of a few MB. Memory is
a fixed multiple of the chunk, or of the largest single text where one is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once.
CHUNK = 1 << 20

_GOLD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_GOLD))


class Rolling:
    """Additive polynomial hashes of byte ranges; two families give independent values."""

    def __init__(self, family: int = 0):
        self.table = seeded(256, 2 * family + 1)
        self.p = int(seeded(1, 2 * family + 2)[0]) | 1
        self.inv = pow(self.p, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << (n + 1).bit_length()
            for name, base in (("up", self.p), ("down", self.inv)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of ``data``, for ``between``."""
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``ranges`` of data whose prefix sums are known."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair; equal bytes give equal values."""
        return self.between(self.sums(data), start, end)

    def grams(self, data: np.ndarray, k: int) -> np.ndarray:
        """Hash of each ``data[i:i+k]``; ``k`` is a power of two."""
        h, m, p = self.table[data], 1, self.p
        while m < k:
            h = h[:-m] * np.uint64(p) + h[m:]
            p, m = p * p % (1 << 64), 2 * m
        return mix(h)


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset: array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(array: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about ``limit`` bytes."""
    data, offsets = column(array)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to lower case, other bytes as they are."""
    return _FOLD[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of True that lie in one row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of all words: runs of bytes other than space and 0x09-0x0D."""
    return runs(~SPACE[data], offsets)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Start of each of ``n`` rows in a sorted row column, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by both."""
    if not len(rows):
        return rows, values
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    values = values.copy()
    cut = np.flatnonzero(rows[1:] != rows[:-1]) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
        values[i:j].sort()
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles as sorted (row, hash); fewer words than ``size`` give one shingle."""
    with np.errstate(over="ignore"):
        at = bounds(rows, n_rows)
        count = np.diff(at)
        odd = seeded(size, 77) | np.uint64(1)
        last = len(hashes) - size + 1
        parts_r, parts_v = [], []
        if last > 0:
            ok = rows[:last] == rows[size - 1:]
            value = np.zeros(last, np.uint64)
            for j in range(size):
                value += hashes[j: j + last] * odd[j]
            parts_r.append(rows[:last][ok])
            parts_v.append(mix(value[ok]))
        for r in np.flatnonzero((count > 0) & (count < size)):
            value = np.uint64(count[r])
            for j, h in enumerate(hashes[at[r]: at[r + 1]]):
                value += h * odd[j]
            parts_r.append(np.array([r]))
            parts_v.append(mix(np.array([value ^ np.uint64(_GOLD)], np.uint64)))
    if not parts_r:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return distinct(np.concatenate(parts_r), np.concatenate(parts_v))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))
