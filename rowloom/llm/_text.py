"""Words of many texts at once: spans and 64-bit hashes over the UTF-8 bytes of Arrow columns."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Freed arrays of 1 MB and more go back to the system at once: Python workers live on between
# stages, and what they held on to would count against the executor in the next one.
try:
    _libc = ctypes.CDLL(None)
    for _key, _value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
        _libc.mallopt(_key, _value)
    _libc.malloc_trim  # noqa: B018  asks whether there is one
except (AttributeError, OSError):  # another C library than glibc
    _libc = None
pa.set_memory_pool(pa.system_memory_pool())


@contextmanager
def reused(limit: int = 32 << 20) -> Iterator[None]:
    """Inside, freed arrays of less than the limit (32 MB at most) stay for the next ones, which spares a fault for each of their pages; at the end all go back."""
    if _libc is None:
        yield
        return
    try:
        for key in (-3, -1):
            _libc.mallopt(key, limit)
        yield
    finally:
        for key in (-3, -1):
            _libc.mallopt(key, 1 << 20)
        _libc.malloc_trim(0)

#: Bytes of text that are hashed in one go; a longer document makes a chunk of its own.
CHUNK = 1 << 20


def byte_class(separators) -> np.ndarray:
    """256 flags: whether a byte belongs to a word. Bytes from 0x80 on are parts of characters beyond ASCII."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: A-Z count as a-z.
PLAIN = byte_class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_RNG = np.random.default_rng(20260101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int):
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        out = []
        for base in (_R, _RI):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


@dataclass
class Words:
    """data: the chunk's bytes; off: document bounds in it; start, end: of each word; at: the first word of each document, and the end."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits of each word, A-Z as a-z."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        up, down = _tables(len(self.data))
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def split(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a text column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    off = np.frombuffer(bounds, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole, off


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds from 0) of runs of whole documents."""
    data, off = byte_view(column)
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, min(end, rows), data[off[row]:off[min(end, rows)]], off[row:min(end, rows) + 1] - off[row]
        row = min(end, rows)


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n words; empty where there are fewer. Runs that cross documents are the caller's to leave out."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, np.uint64(mix_int(salt * 1000003 + n)))
    for j in range(n):
        out = (out ^ h[j:j + m]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def text_batches(batches, limit: int = CHUNK):
    """For mapInArrow: (batch, first, end, bytes, bounds) over column `text`."""
    for batch in batches:
        for first, end, data, off in chunks(batch.column(batch.schema.get_field_index("text")), limit):
            yield batch, first, end, data, off
