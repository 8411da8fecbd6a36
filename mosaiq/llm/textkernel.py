"""Vectorised word boundaries and word hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
STEP_BYTES = 2_000_000

_U = np.uint64
_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, b, _U)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def binary(column: pa.Array) -> pa.Array:
    """As large_binary, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_binary array."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(lengths: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each row: byte starts and ends, row bounds, 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = True) -> None:
        self.raw, self.offsets = buffers(column)
        self.data = _LOWER[self.raw] if lower else self.raw
        solid = ~_SPACE[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inside = self.offsets[1:-1]
        inside = inside[(inside > 0) & (inside < len(solid))]
        first[inside] = solid[inside]
        last[inside - 1] = solid[inside - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        power, inverse = _power_tables(len(self.data))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[self.data] * power[: len(self.data)])])
            return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, and their bounds; a row of 1 to k-1 words has one window, all its words."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(out[-1]) - out[row] + bounds[row]
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), _U)
        for j in range(k):
            here = j < n[row]
            w = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else h
            h = np.where(here, mix(h * _U(0x9E3779B97F4A7C15) + w + _U(j + 1)), h)
    return h, out
