"""Byte-level kernels in numpy over many texts at once.

A piece is a run of whole texts laid end to end, so that array operations run
over about a megabyte at a time whatever the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: Odd multiplier of the polynomial hash (modulo 2^64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """[first, last) rows of each piece; a text over the limit is a piece of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n at least."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        done = 1
        while done < size:  # the next block is the one so far times BASE^done
            up[done : 2 * done] = up[:done] * np.uint64(pow(BASE, done, 1 << 64))
            down[done : 2 * done] = down[:done] * np.uint64(pow(BASE_INVERSE, done, 1 << 64))
            done *= 2
        _powers.clear()
        _powers[size] = up, down
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any stretches of one byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        values = data.astype(np.uint64)
        values += np.uint64(0x1F3)
        values *= self.up[:n]
        np.cumsum(values, out=self.sums[1:])

    def grams(self, q: int) -> np.ndarray:
        """Mixed hash of the q bytes from each position on."""
        n = len(self.sums) - q
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.sums[q:] - self.sums[:n]
        h *= self.down[:n]
        return mix(h)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each [start, end), its length included."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sliding(values: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of each w neighbours, in three passes over the array."""
    n = len(values)
    if n < w:
        return values[:0]
    if w == 1:
        return values
    padded = -(-n // w) * w
    rows = np.empty(padded, values.dtype)
    rows[:n] = values
    rows[n:] = values[-1]
    rows = rows.reshape(-1, w)
    before = pick.accumulate(rows, axis=1).ravel()
    after = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(after[: n - w + 1], before[w - 1 : n])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, end) as sorted maximal runs; runs that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], np.append(end[at[1:] - 1], end[-1])
