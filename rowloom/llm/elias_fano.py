"""Rising integers in Elias-Fano form, over NumPy arrays that may be views of a mapped file.

A value is split: its low bits are packed, its high bits are a unary code of the gaps. Access,
and the search of a value within a range, work on arrays of queries; the bits around a query are all that is touched.
"""
from __future__ import annotations

import json
import mmap
import os
from functools import cached_property

import numpy as np
import pyarrow.fs as pafs


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the form of rising values in [0, universe)."""
    n = len(values)
    v = values.astype(np.uint64)
    l = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
    low = np.zeros((n * l + 7) // 8 + 8, np.uint8)
    if l:
        shifts = np.arange(l, dtype=np.uint64)
        for i in range(0, n, 1 << 16):
            bits = ((v[i:i + (1 << 16), None] >> shifts) & np.uint64(1)).astype(np.uint8)
            part = np.packbits(bits.ravel(), bitorder="little")
            low[i * l // 8:i * l // 8 + len(part)] = part
    high = (v >> np.uint64(l)).astype(np.int64)
    size = n + (int(universe - 1) >> l if universe else 0) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    zeros = np.arange(len(rank), dtype=np.int64) * 64 - rank
    narrow = np.uint32 if len(words) < 1 << 26 else np.uint64
    return {"low": low, "words": words, "ones": rank.astype(narrow), "zeros": zeros.astype(narrow), "meta": np.array([n, l], np.int64)}


def relative(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Values that rise within each range [bounds[i], bounds[i + 1]) but not across them, made to: each is added to the last before its range."""
    if not len(values):
        return values.astype(np.uint64)
    some = bounds[:-1][bounds[1:] > bounds[:-1]]
    ends = np.append(some[1:], len(values)) - 1
    base = np.concatenate([[0], np.cumsum(values[ends].astype(np.uint64))[:-1]]).astype(np.uint64)
    return values.astype(np.uint64) + np.repeat(base, np.diff(np.append(some, len(values))))


#: The place of the r-th set bit of a byte, at 8 * byte + r.
_SELECT = np.zeros(256 * 8, np.int64)
for _byte in range(256):
    for _r, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _SELECT[8 * _byte + _r] = _at


def _every(byte: int) -> np.uint64:
    return np.uint64(int.from_bytes(bytes([byte] * 8), "little"))


_1, _2, _4, _ONE, _TOP, _BYTE = _every(0x55), _every(0x33), _every(0x0F), _every(0x01), _every(0x80), np.uint64(0xFF)


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit: its byte by counts of all bytes at once, then by table."""
    s = word - ((word >> np.uint64(1)) & _1)
    s = (s & _2) + ((s >> np.uint64(2)) & _2)
    s = ((s + (s >> np.uint64(4))) & _4) * _ONE  # each byte: set bits up to it
    r = r.view(np.uint64)
    k = np.bitwise_count(((r * _ONE | _TOP) - s) & _TOP).astype(np.uint64) << np.uint64(3)
    before = ((s << np.uint64(8)) >> k) & _BYTE
    return k.view(np.int64) + _SELECT[((((word >> k) & _BYTE) << np.uint64(3)) + r - before).view(np.int64)]


def _trailing(word: np.ndarray) -> np.ndarray:
    """Zeros below the lowest set bit."""
    return np.bitwise_count(~word & (word - np.uint64(1))).astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.l = (int(x) for x in arrays["meta"])
        low = arrays["low"]
        self.low8 = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))
        self.words = arrays["words"]
        self.ones, self.zeros = arrays["ones"], arrays["zeros"]
        self.mask = np.uint64((1 << self.l) - 1)

    def low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.l
        return (self.low8[bit >> 3] >> (bit & 7).view(np.uint64)) & self.mask

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        rank = self.ones if ones else self.zeros
        w = np.searchsorted(rank, i.astype(rank.dtype), "right") - 1  # of one type, else the mapped array would be copied
        word = self.words[w]
        return w * 64 + _in_word(word if ones else ~word, i - rank[w].astype(np.int64))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).view(np.uint64)
        return ((high << np.uint64(self.l)) | self.low(i)).view(np.int64)

    def two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1."""
        bit = self._select(i, True)
        rest = (self.words[bit >> 6] >> (bit & 63).view(np.uint64)) >> np.uint64(1)
        after = bit + 1 + _trailing(rest)
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(i[far] + 1, True)
        full = lambda b, k: (((b - k).view(np.uint64) << np.uint64(self.l)) | self.low(k)).view(np.int64)
        return full(bit, i), full(after, i + 1)

    def base(self, lo: np.ndarray) -> np.ndarray:
        """What relative() added to the values of the ranges that begin at lo."""
        out = np.zeros(len(lo), np.int64)
        later = np.flatnonzero(lo > 0)
        out[later] = self[lo[later] - 1]
        return out

    def within(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray) -> np.ndarray:
        """find() of values relative to their ranges [lo, hi), as relative() made them; an empty range holds none."""
        # past the last of all values there is no bucket to look in
        at = np.full(len(value), -1, np.int64)
        want = value.view(np.int64) + base
        some = np.flatnonzero((lo < hi) & (want <= self.last))
        if len(some) == len(at):
            return self.find(want.view(np.uint64), lo, hi)
        at[some] = self.find(want[some].view(np.uint64), lo[some], hi[some])
        return at

    @cached_property
    def last(self) -> int:
        return int(self[np.array([self.n - 1])][0]) if self.n else -1

    def find(self, value: np.ndarray, lo=None, hi=None) -> np.ndarray:
        """The place of each value (uint64), in [lo, hi) if given, or -1: a search by low bits for the last that isn't above it among those of its high bits."""
        out = np.full(len(value), -1, np.int64)
        if not self.n or not len(value):
            return out
        b = (value >> np.uint64(self.l)).view(np.int64)
        bit = np.where(b > 0, self._select(np.maximum(b - 1, 0), False) + 1, 0)
        start = bit - b
        # the bucket's ones follow; where they reach the word's end, its closing zero is looked up
        rest = ~(self.words[bit >> 6] >> (bit & 63).view(np.uint64))
        run = _trailing(rest)
        stop = start + run
        far = np.flatnonzero(run + (bit & 63) >= 64)
        stop[far] = self._select(b[far], False) - b[far]
        if lo is not None:
            start, stop = np.maximum(start, lo), np.minimum(stop, hi)
        want = value & self.mask
        size = stop - start
        live = np.flatnonzero(size > 1)
        at, left, sought = start[live], size[live], want[live]
        while len(live):
            half = left >> 1
            middle = at + half
            at = np.where(self.low(middle) <= sought, middle, at)
            left -= half
            more = left > 1
            # one that is left alone stays where it is, so they are put aside only when many
            if 4 * np.count_nonzero(more) < 3 * len(live):
                start[live] = at
                live, at, left, sought = live[more], at[more], left[more], sought[more]
        some = np.flatnonzero(size > 0)
        at = start[some]
        ok = self.low(at) == want[some]
        out[some[ok]] = at[ok]
        return out


def save(folder: str, name: str, arrays: dict[str, np.ndarray], attempt: str) -> None:
    """One file of all arrays, each at a multiple of 64 bytes, renamed when complete."""
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    at, index = 0, {}
    for k, a in arrays.items():
        index[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}.{attempt}") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    fs.move(f"{path}/{name}.{attempt}", f"{path}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays as views: of the mapped file where the folder is mounted, else of its bytes."""
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    if fs.type_name == "local":
        with open(f"{path}/{name}", "rb") as f:
            whole = mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ)
    else:
        with fs.open_input_stream(f"{path}/{name}") as f:
            whole = f.read()
    size = int.from_bytes(whole[:8], "little")
    index = json.loads(whole[8:8 + size])
    return {k: np.frombuffer(whole, dtype, n, 8 + size + at) for k, (dtype, n, at) in index.items()}


def part(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k: arrays[f"{prefix}.{k}"] for k in ("low", "words", "ones", "zeros", "meta")})


def prefixed(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}
