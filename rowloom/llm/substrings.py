"""Exact removal of long repeats: every byte of a `length`-byte string that also starts earlier.

A suffix array over a corpus needs one address space, so the corpus is first cut into
groups that can be sorted apart, without losing a repeat:

1. In each window of `length` bytes the 50-byte gram of least hash (the leftmost) is its
   anchor; equal windows have equal anchors at equal places. Neighbouring windows of one
   anchor form a unit. A document sends a row for each of its distinct units: hashes of anchor and
   of unit, and where it starts; about a row for 25 bytes, without text.
2. Rows meet by anchor, sorted, and are read as a stream. Of equal units all but the first
   are repeats as a whole. An anchor with unequal units is examined further, once for each distinct unit.
3. The bytes of those units are cut from the texts and grouped by anchor; each group's suffix
   array (`suffixes`, by linear grouping) brings equal windows together, and all but the
   first of them are repeats. Groups of more than `large` units (a parameter, LARGE unless told) are
   dealt out by window instead of by anchor, so none grows with the input.
4. A last scan adds the repeats inside a document and takes the covered bytes out.

So the suffix array decides between unequal units; equal units meet by 128 bits of hashes of unit
and anchor, windows of the groups over `large` by as many of window and anchor, and repeats within a
document by hashes held against the bytes.

Defined cases: a null text is empty and loses nothing; a text shorter than `length` keeps all; a null
doc_id counts as smaller than any; rows that repeat a doc_id with the same text are judged against
smaller ids and against themselves, not against each other; with other texts, one doc_id means one document and
spans of one of its texts may be taken from all. Other columns are kept by `remove`, ignored by `digests`.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import free, keep, mark_ids, only_ids
from .suffixes import suffix_array

GRAM = 50
#: Units of an anchor from which its windows are dealt out one by one.
LARGE = 1000
NULL = np.iinfo(np.int64).min
_PLACE = np.uint64(0xFFFFFF)
_EXACT = np.random.default_rng(1979).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Start positions of a text that are hashed in one go.
PIECE = 4 << 20


def _sums(data: np.ndarray):
    up, down = X._tables(len(data) + 1)
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_EXACT[data] * up[:len(data)], out=s[1:])
    return s, down


def units_of(data: np.ndarray, off: np.ndarray, length: int):
    """(anchor, unit, document, first window, windows less one, anchor's place in the first window) of all units of a chunk."""
    width = length - GRAM + 1
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    s, down = _sums(data)
    v = X.mix((s[GRAM:] - s[:-GRAM]) * down[:n - GRAM + 1])
    m = (v & ~_PLACE) | np.arange(len(v), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[:span - width], m[width - span:])
    p = (m & _PLACE).astype(np.int64)
    i = np.arange(len(p))
    doc = np.searchsorted(off, i, "right") - 1
    ok = i + length <= off[doc + 1]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    last = np.ones(len(p), bool)
    last[:-1] = new[1:] | ~ok[1:]
    a, b = np.flatnonzero(new & ok), np.flatnonzero(last & ok)
    unit = X.mix((s[b + length] - s[a]) * down[a] + (p[a] - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return v[p[a]], unit, doc[a], a, b - a, p[a] - a


def _pieces(data: np.ndarray, off: np.ndarray, length: int):
    """The chunk, or a very long text in pieces that overlap by a window: (bytes, bounds, start of the piece)."""
    if len(data) <= PIECE + length:
        yield data, off, 0
    else:
        for x in range(0, len(data), PIECE):
            part = data[x:x + PIECE + length - 1]
            yield part, np.array([0, len(part)]), x


def _ids(batch, first, end):
    return batch.column(0).slice(first, end - first).cast(pa.int64()).fill_null(int(NULL)).to_numpy(zero_copy_only=False)


def _units(length: int):
    def run(batches):
        for batch, first, end, data, off in X.text_batches(batches):
            ids = _ids(batch, first, end)
            for part, bounds, base in _pieces(data, off, length):
                m, u, d, a, n, o = units_of(part, bounds, length)
                if not len(m):
                    continue
                # of equal units of a document the first
                order = np.lexsort((a, u, d))
                once = np.ones(len(order), bool)
                once[1:] = (u[order][1:] != u[order][:-1]) | (d[order][1:] != d[order][:-1]) | (m[order][1:] != m[order][:-1])
                k = np.sort(order[once])
                place = ((a[k] - bounds[d[k]] + base) << 16) | (n[k] << 8) | o[k]
                yield pa.RecordBatch.from_arrays([pa.array(m[k].view(np.int64)), pa.array(u[k].view(np.int64)), pa.array(ids[d[k]]), pa.array(place)], names=["m", "u", "doc", "at"])

    return run


FOUND = "doc long, m long, at long"


def _meet(batches):
    """Rows sorted by (m, u, doc, at): repeats of whole units (m null), and first units of anchors that have several."""
    carry = None  # (m, u, doc, at) of the last unit's first row
    waiting, told = None, True  # the last anchor's first unit, and whether it was told
    for batch in batches:
        if not batch.num_rows:
            continue
        m, u, d, a = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if carry is not None:
            m, u, d, a = (np.concatenate([[c], x]) for c, x in zip(carry, (m, u, d, a), strict=True))
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (u[1:] != u[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
        again = ~new & ((d != d[start]) | (a >> 16 != a[start] >> 16))
        # the first row is the carried one and no new unit
        f = np.flatnonzero(new)
        if carry is not None:
            f = f[1:]
        fm, fd, fa = m[f], d[f], a[f]
        if waiting is not None:
            fm, fd, fa = (np.concatenate([[w], x]) for w, x in zip(waiting, (fm, fd, fa), strict=True))
        several = np.zeros(len(fm), bool)
        if len(fm) > 1:
            same = fm[1:] == fm[:-1]
            several[1:] |= same
            several[:-1] |= same
        if len(fm):
            tell = several.copy()
            if waiting is not None and told:
                tell[0] = False
            first = int(np.flatnonzero(fm == fm[-1])[0]) if fm[0] == fm[-1] else int(len(fm) - np.argmax(fm[::-1] != fm[-1]))
            told = bool(several[-1]) or (waiting is not None and first == 0 and told)
            waiting = (fm[-1], fd[-1], fa[-1])
            fm, fd, fa = fm[tell], fd[tell], fa[tell]
        carry = tuple(x[start[-1]] for x in (m, u, d, a))
        n, k = int(again.sum()), len(fm)
        if n + k:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([d[again], fd])), pa.array(np.concatenate([np.zeros(n, np.int64), fm]), mask=np.arange(n + k) < n), pa.array(np.concatenate([a[again], fa])),
            ], names=["doc", "m", "at"])


def _contexts(length: int):
    """(m, doc, first window, bytes) of the units asked for; wants: binary of (m, at) pairs."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                for x in wants:
                    a, n, o = x["at"] >> 16, (x["at"] >> 8) & 0xFF, x["at"] & 0xFF
                    if a + n + length <= len(raw):
                        out.append((x["m"], doc, a, o, raw[a:a + n + length], x["large"]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["m", "doc", "a", "o", "raw", "large"])

    return run


def _window_hashes(raws: list[bytes], length: int):
    """Of all windows of all texts: which text, where, hash."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    s, down = _sums(data)
    i = np.arange(len(data) - length + 1)
    which = np.searchsorted(ends, i, "right")
    ok = i + length <= ends[which]
    i, which = i[ok], which[ok]
    return which, i - (ends[which] - np.array([len(r) for r in raws])[which]), X.mix((s[i + length] - s[i]) * down[i])


def repeats_in(group: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """Spans (doc, start, end) of the windows of a group (doc, start, anchor's place, bytes) that also start earlier, by its suffix array."""
    # A unit whose neighbourhood of the anchor, to either side, is its own shares no window with another.
    half = (length - GRAM) // 2
    seen: dict[tuple, int] = {}
    keys = []
    for _, _, o, raw in group:
        left = (0, raw[o - half:o]) if o >= half else None
        right = (1, raw[o + GRAM:o + GRAM + half]) if len(raw) >= o + GRAM + half else None
        keys.append((left, right))
        for k in (left, right):
            if k:
                seen[k] = seen.get(k, 0) + 1
    group = [g for g, ks in zip(group, keys, strict=True) if any(k and seen[k] > 1 for k in ks)]
    if len(group) < 2:
        return []
    raws = [g[3] for g in group]
    text: list[int] = []
    for r in raws:
        text.extend(r)
        text.append(-1)
    order = np.array(suffix_array(text))
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    which = np.searchsorted(starts, order, "right") - 1
    at = order - starts[which]
    sizes = np.array([len(r) for r in raws])
    ok = at + length <= sizes[which]
    which, at = which[ok], at[ok]
    # suffixes that begin with equal windows are neighbours now
    flat = np.frombuffer(b"".join(raws), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(flat, length)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    where = base[which] + at
    new = np.ones(len(where), bool)
    new[1:] = (view[where[1:]] != view[where[:-1]]).any(1)
    doc, begin = np.array([g[0] for g in group])[which], np.array([g[1] for g in group])[which] + at
    run = np.cumsum(new) - 1
    least = np.lexsort((begin, doc, run))
    first = least[np.concatenate([[True], run[least][1:] != run[least][:-1]])]
    dup = (doc != doc[first][run]) | (begin != begin[first][run])
    return _merged(doc[dup], begin[dup], length)


def _merged(doc: np.ndarray, begin: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    if not len(doc):
        return []
    order = np.lexsort((begin, doc))
    doc, begin = doc[order], begin[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + 1)
    a = np.flatnonzero(cut)
    b = np.concatenate([a[1:], [len(doc)]]) - 1
    return list(zip(doc[a].tolist(), begin[a].tolist(), (begin[b] + length).tolist(), strict=True))


def _resolve(length: int):
    """Groups sorted by m, each at most LARGE units, to spans."""

    def run(batches):
        key, group = None, []
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for m, doc, a, o, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if m != key:
                    if len(group) > 1:
                        out += repeats_in(group, length)
                    key, group = m, []
                group.append((doc, a, o, raw))
            if len(out) > 1000:
                yield _spans(out)
                out = []
        if len(group) > 1:
            out += repeats_in(group, length)
        if out:
            yield _spans(out)

    return run


def _spans(out):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "a", "b"])


def _explode(length: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                which, at, h = _window_hashes(part.column(4).to_pylist(), length)
                doc, a = (part.column(k).to_numpy(zero_copy_only=False)[which] for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(pa.array(which)), pa.array(doc), pa.array(a + at)], names=["h", "m", "doc", "a"])

    return run


def spans(docs: DataFrame, length: int = 100, large: int | None = None) -> DataFrame:
    """(doc, a, b): bytes [a, b) of document doc are covered by strings that start in other documents before, or in it; repeats within one document only are left to the last scan."""
    if not GRAM + 20 <= length <= GRAM + 250:
        raise ValueError(f"length must be from {GRAM + 20} to {GRAM + 250}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = docs.mapInArrow(_units(length), "m long, u long, doc long, at long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keep(units.repartition(n, "m").sortWithinPartitions("m", "u", "doc", "at").mapInArrow(_meet, FOUND), "units")
    whole = found.where("m is null").select("doc", F.shiftright("at", 16).alias("a"), (F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(F.lit(255)) + length).alias("b"))
    asked = found.where("m is not null")
    large = asked.groupBy("m").count().where(F.col("count") > (LARGE if large is None else large)).select("m", F.lit(True).alias("large"))
    wants = asked.join(large, "m", "left").groupBy("doc").agg(F.collect_list(F.struct("m", "at", F.coalesce("large", F.lit(False)).alias("large"))).alias("wants"))
    key = F.coalesce("doc_id", F.lit(int(NULL))).alias("doc")
    texts = only_ids(docs.select(key, "text"), "doc", asked, "doc")
    contexts = keep(texts.join(wants, "doc").mapInArrow(_contexts(length), "m long, doc long, a long, o int, raw binary, large boolean"), "contexts")
    small = contexts.where("not large").repartition(n, "m").sortWithinPartitions("m", "doc", "a").mapInArrow(_resolve(length), "doc long, a long, b long")
    windows = contexts.where("large").mapInArrow(_explode(length), "h long, m long, doc long, a long")
    first = windows.groupBy("h", "m").agg(F.min(F.struct("doc", "a")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h", "m", "f")
    wide = windows.join(first, ["h", "m"]).where((F.col("doc") != F.col("f.doc")) | (F.col("a") != F.col("f.a"))).select("doc", "a", (F.col("a") + length).alias("b"))
    return whole.union(small).union(wide)


def _own_repeats(raw: np.ndarray, length: int):
    """Starts of windows that start earlier in the same text."""
    if len(raw) < length + 1:
        return np.empty(0, np.int64)
    s, down = _sums(raw)
    h = X.mix((s[length:] - s[:-length]) * down[:len(raw) - length + 1])
    t = np.sort(h)
    if not (t[1:] == t[:-1]).any():
        return np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order][1:] == h[order][:-1])
    # equal hashes are held against the bytes
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.concatenate([(view[order[k + 1]] == view[order[k]]).all(1) for k in np.array_split(again, max(1, len(again) >> 16))])
    return order[again[same] + 1]


def covered(raw: bytes, given, length: int) -> list[tuple[int, int]]:
    """Maximal runs to take out of a text: the given spans and its own repeats."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.zeros(len(data) + 1, np.int64)
    own = _own_repeats(data, length)
    np.add.at(edge, own, 1)
    np.add.at(edge, own + length, -1)
    for x in given or ():
        a, b = min(x["a"], len(data)), min(x["b"], len(data))
        edge[a] += 1
        edge[b] -= 1
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True))


def _kept(raw: bytes, runs) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_spans(docs: DataFrame, length: int, large: int | None = None):
    """docs that may have spans with them, and the rest with none: only the former are shuffled."""
    doc, maybe, given = free(docs, "doc", "maybe", "spans")
    found = keep(spans(docs, length, large), "spans").withColumnRenamed("doc", doc)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL)))
    grouped = found.groupBy(doc).agg(F.collect_list(F.struct("a", "b")).alias(given))
    flagged = mark_ids(docs.withColumn(doc, key), doc, found, doc, maybe)
    some = flagged.where(F.col(maybe)).join(grouped, doc, "left")
    none = flagged.where(~F.col(maybe)).withColumn(given, F.lit(None).cast("array<struct<a:long,b:long>>"))
    columns = [*docs.columns, given]
    return some.select(columns).union(none.select(columns))


def digests(docs: DataFrame, length: int = 100, large: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is kept."""
    rows = _with_spans(docs.select("doc_id", "text"), length, large)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                runs = covered(raw, given, length)
                out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = 100, large: int | None = None) -> DataFrame:
    """docs, all columns, with the repeats taken out of text (whole characters: one that is covered in part stays) and n_chars to match."""
    rows, schema = _with_spans(docs, length, large), docs.schema

    def run(batches):
        for batch in batches:
            at, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            texts, counts = [], batch.column(n).to_pylist() if n >= 0 else None
            for i, (text, given) in enumerate(zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if text:
                    raw = text.encode()
                    runs = []
                    for a, b in covered(raw, given, length):
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        runs.append((a, b))
                    if runs:
                        text = _kept(raw, runs).decode()
                        if counts:
                            counts[i] = len(text)
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            if counts:
                columns[n] = pa.array(counts, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(run, schema)
