"""Vectorised word segmentation and hashing over Arrow string columns.

A column of texts is one byte buffer with row offsets. Words are found for all rows of a slice at once; each word gets
a 64-bit hash from a prefix sum of ``table[byte] * base**position`` (base odd, so it has an inverse mod 2**64), which
costs a few nanoseconds a byte and no Python object per word. Slices bound the memory, not the length of a row: a row
longer than a slice is a slice of its own, and hashing works through it in chunks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Byte classes: words split at ASCII white space only.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Byte classes: words are runs of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Returns what this worker has freed to the system: workers live on, and hold what a task has needed at most."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _CHUNK) + 1, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * _CHUNK:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, ``rows`` at most and with at most ``most`` bytes of text together, one row at least."""
    _, offs = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a slice: ``starts``/``ends`` in ``data``, ``first[r]:first[r + 1]`` those of row ``r``."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool):
        raw, self.offsets = buffers(column)
        self.raw = raw
        self.data = LOWER[raw] if lower else raw
        inside = kind[self.data]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before).astype(np.int32)  # a column's buffer has less than 2 GB
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after).astype(np.int32) + np.int32(1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def hashes(self) -> np.ndarray:
        out, n, at = np.empty(len(self.starts), np.uint64), len(self.starts), 0
        while at < n:
            origin = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, origin + _CHUNK, "right")))
            s, e = self.starts[at:to] - origin, self.ends[at:to] - origin
            power, inverse = _power_tables(int(e[-1]) + 1)
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(_TABLE[self.data[origin : origin + e[-1]]] * power[: e[-1]], out=sums[1:])
            out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            at = to
        return mix(out)

    def windows(self, hashes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
        """A hash for each run of ``length`` words; :meth:`whole` says which of them lie in one row."""
        n = len(hashes) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        factor = np.uint64((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[lane])
        acc = np.full(n, np.uint64(length + 1000 * lane + 1), np.uint64)
        for k in range(length):
            acc *= factor
            acc += hashes[k : k + n]
        return mix(acc)

    def whole(self, length: int) -> np.ndarray:
        """For each run of ``length`` words, whether it lies in one row."""
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.empty(0, bool)
        ok = np.ones(n, bool)
        for k in range(1, length):  # runs that begin less than ``length`` words before a row's end
            at = self.first[1:-1] - k
            ok[at[(at >= 0) & (at < n)]] = False
        return ok

    def without(self, gone: np.ndarray) -> list[bytes]:
        """Each row without the words of ``gone`` (a flag per word); a word goes with what follows it up to the next word."""
        keep = np.zeros(len(self.raw) + 1, np.int8)
        reach = np.append(self.starts[1:], len(self.raw))
        last = self.first[1:][self.counts > 0] - 1
        reach[last] = self.offsets[1:][self.counts > 0]
        np.add.at(keep, self.starts[gone], 1)
        np.add.at(keep, reach[gone], -1)
        mask = np.cumsum(keep[:-1]) == 0
        kept, offs = self.raw[mask], np.concatenate([[0], np.cumsum(mask)])[self.offsets]
        data = kept.tobytes()
        return [data[offs[r] : offs[r + 1]] for r in range(len(self.counts))]


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """A flag for each of ``n`` words: whether a run of ``length`` words from one of ``starts`` covers it."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
