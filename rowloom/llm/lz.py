"""Lempel-Ziv fingerprints: the phrases of a text's LZ78 parse, as minimum hashes.

A text is parsed, byte by byte, into phrases each of which is a known phrase and one more
byte. The set of phrases is hashed and summed up as 16 low bits of 64 minima; the share of
equal lanes, less what chance makes equal, is the likeness.

The query needs each document's successor in order of id. Rows are cut into ranges by
exact bounds (`_order`), shuffled once and sorted; the row that follows a range is sent to
it too, so no task needs another's output, and a lost task is done again from the shuffle.

Defined cases: null counts as empty; an empty text has no phrases, its fingerprint is all
zeros, and it is like another empty text (1) and unlike any other (0). Documents of equal id follow each other by text; a
null id comes last. A single document is its own successor. Repeated rows get a row each; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._order import run_of, upper_bounds

LANES = 64
_rng = np.random.default_rng(1977)
_A = (_rng.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _rng.integers(0, 2**63, LANES, dtype=np.uint64)[:, None]
EMPTY = "0" * (4 * LANES)


def parse(data: bytes, known: dict[int, int], node: int, ends: list[int], base: int) -> int:
    """Goes on with a parse: known maps (phrase, byte) to a phrase; ends gets the end of each new phrase."""
    get, add, size = known.get, ends.append, (len(known) + 1) << 8
    for i, c in enumerate(data, base + 1):
        key = node + c
        node = get(key)
        if node is None:
            known[key] = size
            size += 256
            add(i)
            node = 0
    return node


def fingerprint_of(data: bytes, ends: list[int]) -> str:
    """Of the phrases that end at `ends`, and the unfinished last one."""
    if not data:
        return EMPTY
    stop = np.array(ends if ends and ends[-1] == len(data) else [*ends, len(data)])
    start = np.concatenate([[0], stop[:-1]])
    raw = np.frombuffer(data, np.uint8)
    up, down = X._tables(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_EXACT[raw] * up[:len(raw)], out=sums[1:])
    h = np.unique(X.mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
    low = np.full(LANES, np.uint64(2**64 - 1))
    for i in range(0, len(h), 512):
        np.minimum(low, (h[None, i:i + 512] * _A + _B).min(1), out=low)
    return (X.mix(low) & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()


_EXACT = np.random.default_rng(1978).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def fingerprint(text: str | None) -> str:
    data, ends = (text or "").encode(), []
    parse(data, {}, 0, ends, 0)
    return fingerprint_of(data, ends)


def likeness(a: str, b: str) -> float:
    if a == EMPTY or b == EMPTY:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return max(0.0, (float((x == y).mean()) - 2.0**-16) / (1 - 2.0**-16))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _edited(text: str, after: str):
    """Fingerprints of the text and of its edited form, whose common beginning is parsed once; the hash of the edited form."""
    half = len(text) // 2
    head, tail, new = text[:len(text) - half].encode(), text[len(text) - half:].encode(), after[:half].encode()
    known: dict[int, int] = {}
    ends: list[int] = []
    node = parse(head, known, 0, ends, 0)
    other, other_ends = known.copy(), ends.copy()
    parse(tail, known, node, ends, len(head))
    parse(new, other, node, other_ends, len(head))
    return fingerprint_of(head + tail, ends), fingerprint_of(head + new, other_ends), hashlib.sha256(head + new).hexdigest()


def _deal(bounds: list[int]):
    """Each row with its range; the largest of a range is also the successor of the range above, the largest of all that of the smallest."""
    upper = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            keys = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            at = run_of(keys, upper) if len(upper) else np.zeros(len(keys), np.int64)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            at[null] = 0
            edge = np.flatnonzero(np.isin(keys, upper) & ~null) if len(upper) else np.flatnonzero(null)
            take = np.concatenate([np.arange(len(keys)), edge])
            target = np.concatenate([at, (at[edge] + 1) % max(1, len(upper))])
            guest = np.concatenate([np.zeros(len(keys), bool), np.ones(len(edge), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(guest), ids.take(pa.array(take)), batch.column(1).cast(pa.string()).take(pa.array(take))], names=["run", "guest", "doc_id", "text"])

    return run


def edits(docs: DataFrame, *, rows_a_run: int = 4000) -> DataFrame:
    """For each document its fingerprint, that of its edited form, and how like they and the next document's are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    runs = max(1, -(-n // rows_a_run))
    tops = upper_bounds(docs, "doc_id", F.lit(1), runs)
    if tops:
        # as bounds the largest id of each run; each batch sends one candidate for a run
        largest = docs.select("doc_id").mapInArrow(_largest(tops), "run int, k long").groupBy("run").agg(F.max("k").alias("k"))
        tops = sorted(r.k for r in largest.collect())
    dealt = docs.mapInArrow(_deal(tops), "run int, guest boolean, doc_id long, text string")
    parts = max(1, len(tops))
    dealt = dealt.repartitionById(parts, F.col("run")).sortWithinPartitions("run", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def finish(batches):
        last = None  # the row that waits for its successor
        out: list[tuple] = []

        def done(row, after):
            a, b, digest = _edited(row[2], after[2])
            return row[1], len(row[2]), digest, a, b, likeness(a, b)

        waiting = None
        for batch in batches:
            run_, guest, ids, texts = (c.to_pylist() for c in batch.columns)
            for row in zip(run_, ids, texts, guest, strict=True):
                if last is not None and not last[3] and row[0] == last[0]:
                    made = done(last, row)
                    if waiting is not None:
                        out.append((*waiting, likeness(waiting[3], made[3])))
                    waiting = made
                    if row[3]:
                        out.append((*waiting, likeness(waiting[3], fingerprint(row[2]))))
                        waiting = None
                elif last is not None and row[0] == last[0]:
                    continue  # a second guest of equal id: the first is the successor
                last = row
                if len(out) >= 1000:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    return dealt.mapInArrow(finish, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(out):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _largest(bounds: list[int]):
    """The largest key of each run, in each batch."""
    upper = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy()
            at = run_of(keys, upper)
            runs = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array([int(keys[at == r].max()) for r in runs], pa.int64())], names=["run", "k"])

    return run
