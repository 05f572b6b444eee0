"""Byte-level BPE by a monoid tree reduction.

A piece of text (a match of the pattern) is halved until the halves have four bytes; each leaf is
merged by rank, and neighbours are joined by encoding a window around their border anew. The
window doubles on a side until the token outside it and the token next to it encode to
themselves as a pair. A sequence of which each neighbouring pair encodes to itself is the
encoding of the whole, so what lies outside is then settled. Decoding joins the tokens'
bytes up a tree.

Frequent pieces, leaves and windows come from bounded tables of each worker. The vocabulary is read once by the
driver from a path that is a parameter and travels with the task; it is as large as its file.

Defined cases: a null or empty text has no tokens and decodes to nothing; ids count from the
rank file. Repeated rows and ids get a row each; other columns are kept by `tokenize`, whose own
columns win over clashing names, and dropped by `digests`.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces that a worker's table holds before it starts anew.
TABLE = 150_000
#: Bytes of a leaf; every longer piece goes down the tree.
LEAF = 4
#: Leaves and windows of up to so many bytes are kept, at most LEAVES of them.
SHORT, LEAVES = 12, 60_000
#: Windows longer than this are merged by a heap.
LONG = 96


class Bpe:
    def __init__(self, vocabulary: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.bytes_of = {b: a for a, b in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.table = _Table(self)

    def leaf(self, piece: bytes) -> list[int]:
        """Merges by rank, of equal ranks the left one first."""
        rank, parts = self.rank, [piece[i:i + 1] for i in range(len(piece))]
        if len(parts) > LONG:
            return self._long_leaf(piece)
        none = 1 << 60
        near = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while near and (low := min(near)) != none:
            i = near.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                near[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[p] for p in parts]

    def _long_leaf(self, piece: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow long."""
        rank, n = self.rank, len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := rank.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := rank.get(piece[prev[i]:stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return [rank[piece[i:end[i]]] for i in range(n) if alive[i]]

    def settled(self, a: int, b: int) -> bool:
        """Whether the two tokens, written one after the other, encode to themselves."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > TABLE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            inner = self.window(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            fixed_left = i >= len(left) or self.settled(left[-i - 1], inner[0])
            fixed_right = j >= len(right) or self.settled(inner[-1], right[j])
            if fixed_left and fixed_right:
                return left[:-i] + inner + right[j:]
            i, j = i if fixed_left else min(2 * i, len(left)), j if fixed_right else min(2 * j, len(right))

    def window(self, piece: bytes) -> list[int]:
        """A leaf, or what lies around a border; short ones come up often and are kept."""
        found = self.leaves.get(piece)
        if found is None:
            found = self.leaf(piece)
            if len(piece) <= SHORT:
                if len(self.leaves) >= LEAVES:
                    self.leaves.clear()
                self.leaves[piece] = found
        return found

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.window(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """A match that is a token is that token, as in the rank files' own library."""
        whole = self.rank.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.table.__getitem__, self.pattern.findall(text))), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Table(dict):
    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.piece(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= TABLE:
                self.clear()
            self[piece] = out
        return out


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(vocabulary: bytes, pattern: str) -> Bpe:
    """One codec for a worker, whatever the number of its tasks."""
    key = hashlib.sha256(vocabulary).hexdigest(), pattern
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(vocabulary, pattern)
    return _loaded[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the hash of the ids and the hash of what they decode to."""
    vocabulary = _read(path)

    def run(batches):
        bpe = loaded(vocabulary, pattern)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for x in batch.column(1):
                ids = bpe.encode(x.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with `tokens` (the ids) and `n_tokens`."""
    vocabulary = _read(path)
    docs = docs.drop("tokens", "n_tokens")
    schema = T.StructType(docs.schema.fields + [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        bpe = loaded(vocabulary, pattern)
        for batch in batches:
            at, off = [], [0]
            for x in batch.column(batch.schema.get_field_index("text")):
                at.append(bpe.encode(x.as_py() or "").astype(np.int32))
                off.append(off[-1] + len(at[-1]))
            flat = np.concatenate(at) if at else np.empty(0, np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens, pa.array(np.diff(off), pa.int64())], names=[*batch.schema.names, "tokens", "n_tokens"])

    return docs.mapInArrow(run, schema)


def detokenize(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df(…, tokens) with `text`, the decoded tokens; bytes that are no UTF-8 become U+FFFD."""
    vocabulary = _read(path)
    df = df.drop("text")
    schema = T.StructType([*df.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        bpe = loaded(vocabulary, pattern)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []).decode(errors="replace") for x in batch.column(batch.schema.get_field_index("tokens"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with tokens, n_tokens and `exact`: whether they decode to the very text. One pass, so a codec is held once for each task."""
    vocabulary = _read(path)
    docs = docs.drop("tokens", "n_tokens", "exact")
    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])

    def run(batches):
        bpe = loaded(vocabulary, pattern)
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                at, off, exact = [], [0], []
                for x in batch.column(batch.schema.get_field_index("text")):
                    text = x.as_py() or ""
                    at.append(bpe.encode(text).astype(np.int32))
                    off.append(off[-1] + len(at[-1]))
                    exact.append(bpe.decode(at[-1].tolist()) == text.encode())
                tokens = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(at), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, tokens, pa.array(np.diff(off), pa.int64()), pa.array(exact)], names=[*batch.schema.names, "tokens", "n_tokens", "exact"])

    return docs.mapInArrow(run, schema)
