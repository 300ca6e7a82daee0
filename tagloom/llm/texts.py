"""Texts in Arrow batches as numpy arrays: words, their hashes, hashes of word runs.

A batch is cut into chunks of bounded size and each chunk is handled with array operations over
its UTF-8 bytes. Only a single text longer than a chunk makes a chunk larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

# Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[9, 10, 11, 12, 13, 32]] = True
# For terms: everything but letters and digits; bytes beyond ASCII belong to letters.
NOT_ALPHANUMERIC = np.ones(256, bool)
NOT_ALPHANUMERIC[48:58] = NOT_ALPHANUMERIC[65:91] = NOT_ALPHANUMERIC[97:123] = False
NOT_ALPHANUMERIC[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 at least of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, factor in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return mix(np.arange(n, dtype=np.uint64), seed) | np.uint64(1)


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of at most ``limit`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(utf8(batch.column(column))[1]))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; a null is an empty text."""
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        _, offsets, data = column.buffers()
        return _bytes(column, offsets, data)
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    return _bytes(column, offsets, data)


def _bytes(column: pa.Array, offsets: pa.Buffer, data: pa.Buffer | None) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a chunk in order; ``first[i]:first[i+1]`` are those of row ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def joined(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b - 1`` of one row, joined by one blank."""
        if a >= b:
            return b""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())


def split_words(
    column: pa.Array, separators: np.ndarray = WHITE_SPACE, lower: bool = False
) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def runs_hashes(hashes: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of the ``length`` values from each position on; one per full run."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(constants(length, seed)):
        total += hashes[j : j + n] * factor
    return mix(total, seed)


def byte_runs_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * inverse[:n])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out
