"""Words and their hashes for whole Arrow columns at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Texts are never cut: a column is walked in byte segments that begin at word starts, so memory is bounded
by the segment and not by the longest text.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SIGNS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base & MASK, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """All words of a column: byte starts and ends, and at[d] the index of text d's first word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def of(self, d: int) -> list[bytes]:
        """The words of text d."""
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes().split()

    def hashes(self) -> np.ndarray:
        """A polynomial hash of every word's bytes, mixed with its length."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        k = 0
        while k < len(self.starts):
            first = self.starts[k]
            stop = max(k + 1, int(np.searchsorted(self.ends, first + SEGMENT, "right")))
            last = self.ends[stop - 1]
            up, down = _power_table(last - first + 1)
            total = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(SYMBOL[self.data[first:last]] * up[: last - first], out=total[1:])
            s, e = self.starts[k:stop] - first, self.ends[k:stop] - first
            out[k:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            k = stop
        return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def find_words(column: pa.Array | pa.ChunkedArray, fold: bool = False, between: np.ndarray = SPACE) -> Words:
    """The words of every text; ``fold`` lower-cases A to Z first, ``between`` marks the bytes between words."""
    data, offsets = text_buffers(column)
    if fold:
        data = FOLD[data]
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(first)
    return Words(data, offsets, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``width``-word window inside one text, and its first word's index."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        value *= np.uint64(BASE)
        value += hashes[j : j + n]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    begin = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(value[begin]), begin


def blocks(table: pa.Table | pa.RecordBatch, text: str, size: int = 2 << 20, rows: int = 2000):
    """Row ranges (start, stop) of about ``size`` text bytes and at most ``rows`` rows, at least one row each."""
    column = table.column(text)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size_of = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(size_of, dtype=np.int64)])
    row = 0
    while row < table.num_rows:
        stop = max(row + 1, min(row + rows, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, stop
        row = stop


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its tasks and stands beside the next stage's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
