"""Benchmark decontamination: windows of benchmark words found in documents.

The benchmark's windows are hashed into one sorted array that every task gets; the
documents are scanned once, as bytes, without a shuffle. A hit of the hash is verified
on the words themselves. The array is broadcast only while the windows number at most
`max_broadcast_windows`; beyond it the same windows are joined by hash instead.

Defined cases: a null or empty text has no words and no hits; an item without words is
ignored; an item of fewer than `width` words is one window of all its words; repeated rows
and repeated ids are judged row by row, each for itself; an item id that comes with several
texts counts once; a null item id is ignored. Other columns of the input are left alone
unless they clash with the output's, whose names then win.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import free

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<struct<start:int,end:int>>"


def plain_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOW))


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    return X.split(data, np.array([0, len(data)]), X.PLAIN).hashes()


class Windows:
    """The windows of all items: hashes by length, and for each the words and the items they are of."""

    def __init__(self, items, width: int):
        self.width, self.of = width, {}
        for item_id, text in items:
            if item_id is None:
                continue
            w = plain_words(text)
            n = min(width, len(w))
            if n:
                for i, h in enumerate(X.grams(_word_hashes(w), n).tolist()):
                    self.of.setdefault((n, h), {}).setdefault(tuple(w[i:i + n]), set()).add(str(item_id))
        self.sorted = {n: np.array(sorted(h for m, h in self.of if m == n), np.uint64) for n in {m for m, _ in self.of}}

    def flags(self, n: int) -> np.ndarray:
        """A bit for the low 16 bits of each hash, asked before the search."""
        f = np.zeros(1 << 16, bool)
        f[(self.sorted[n] & np.uint64(0xFFFF)).astype(np.int64)] = True
        return f


def _scan(windows: Windows):
    def scan(batches):
        early = {n: windows.flags(n) for n in windows.sorted}
        for batch, first, end, data, off in X.text_batches(batches):
            w = X.split(data, off, X.PLAIN)
            h = w.hashes()
            hits: dict[int, list] = {}
            for n, known in windows.sorted.items():
                g = X.grams(h, n)
                maybe = np.flatnonzero(early[n][(g & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.searchsorted(known, g[maybe])
                at[at == len(known)] = 0
                for i in maybe[known[at] == g[maybe]].tolist():
                    doc = int(np.searchsorted(w.at, i, "right")) - 1
                    if i + n > w.at[doc + 1]:
                        continue  # the window would run into the next document
                    words = tuple(bytes(data[w.start[j]:w.end[j]]).decode().translate(_LOW) for j in range(i, i + n))
                    if found := windows.of[n, int(g[i])].get(words):
                        hits.setdefault(doc, []).append((i, i + n, found))
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(first, end - first)
            counts = np.diff(w.at)
            n_hit, items, spans = np.zeros(end - first, np.int64), [[] for _ in range(end - first)], [[] for _ in range(end - first)]
            for doc, found in hits.items():
                items[doc] = sorted(set().union(*(x[2] for x in found)))
                runs: list[list[int]] = []
                for a, b, _ in sorted(found, key=lambda x: x[:2]):
                    if runs and a < runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                n_hit[doc] = sum(b - a for a, b in runs)
                base = int(off[doc])
                spans[doc] = [{"start": int(w.start[a]) - base, "end": int(w.end[b - 1]) - base} for a, b in runs]
            yield pa.RecordBatch.from_arrays([
                ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans"])

    return scan


def _too_many(benchmark: DataFrame, limit: int) -> bool:
    """Whether the items' characters allow more windows than the limit: a window needs two characters at least."""
    total = benchmark.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    return total > limit


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """A row for each row of docs(doc_id, text): its words, the words hit, the items found and the spans of bytes hit."""
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    if not _too_many(benchmark, max_broadcast_windows):
        windows = Windows(((r.item_id, r.text) for r in benchmark.toLocalIterator()), width)
        return docs.mapInArrow(_scan(windows), SCHEMA)
    return _scan_by_join(docs, benchmark, width)


def _positions(width: int, short: bool):
    """All windows of up to `width` words: (hash, id, first byte, end byte, first word, words). short: an item of fewer words is one window."""

    def run(batches):
        for batch, first, end, data, off in X.text_batches(batches, 1 << 18):
            w = X.split(data, off, X.PLAIN)
            h, key = w.hashes(), batch.column(0).slice(first, end - first)
            for n in range(1, width + 1):
                g = X.grams(h, n)
                i = np.arange(len(g))
                doc = np.searchsorted(w.at, i, "right") - 1
                ok = i + n <= w.at[doc + 1]
                if short and n < width:
                    ok &= np.diff(w.at)[doc] == n
                i, doc = i[ok], doc[ok]
                raw = data.tobytes()
                words = [" ".join(raw[w.start[k]:w.end[k]].decode().translate(_LOW) for k in range(j, j + n)) for j in i.tolist()] if short else None
                cols = [pa.array(g[ok].astype(np.int64)), key.take(pa.array(doc)), pa.array(i - w.at[doc]), pa.array(np.full(len(i), n))]
                cols += [pa.array(words, pa.string())] if short else [pa.array(w.start[i] - off[doc]), pa.array(w.end[i + n - 1] - off[doc])]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "key", "i", "n", *(["words"] if short else ["a", "b"])])

    return run


def _digest() -> Column:
    """A text's 256 bits, which stand for it in joins."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """For benchmarks of any size: windows of both sides meet by hash; words are compared after the join."""
    docs = docs.withColumn("row", _digest())
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("key"), "text")
    items = items.mapInArrow(_positions(width, True), "h long, key string, i long, n long, words string").select("h", "n", "key", "words").distinct()
    found = docs.select("row", "text").distinct().mapInArrow(_positions(width, False), "h long, key binary, i long, n long, a long, b long").withColumnRenamed("key", "row")
    found = found.join(items, ["h", "n"]).join(docs.select("row", F.encode("text", "UTF-8").alias("raw")).dropDuplicates(["row"]), "row")
    lower = F.translate(F.decode(F.expr("substring(raw, int(a + 1), int(b - a))"), "UTF-8"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = found.where(F.regexp_replace(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), "^ | $", "") == F.col("words"))
    per = found.groupBy("row").agg(
        F.sort_array(F.collect_set("key")).alias("items"),
        F.sort_array(F.collect_set(F.struct("i", (F.col("i") + F.col("n")).alias("j"), "a", "b"))).alias("w"),
    )
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD.pattern), 0)
    merged = F.expr(
        "aggregate(w, array(named_struct('i', -1L, 'j', -1L, 'a', -1L, 'b', -1L)), (s, x) -> if(x.i < element_at(s, -1).j,"
        " concat(slice(s, 1, size(s) - 1), array(named_struct('i', element_at(s, -1).i, 'j', greatest(element_at(s, -1).j, x.j), 'a', element_at(s, -1).a, 'b', greatest(element_at(s, -1).b, x.b)))), concat(s, array(x))))"
    )
    out = docs.join(per, "row", "left").withColumn("m", merged)
    none = F.col("items").isNull()
    return out.select(
        "doc_id", F.size(words).cast("long").alias("n_words"),
        F.when(none, F.lit(0)).otherwise(F.expr("aggregate(slice(m, 2, size(m)), 0L, (s, x) -> s + x.j - x.i)")).cast("long").alias("n_hit"),
        F.when(none, F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.when(none, F.lit("")).otherwise(F.array_join("items", ",")), 256).alias("items_sha256"),
        F.when(none, F.expr("cast(array() as array<string>)")).otherwise(F.col("items")).alias("items"),
        F.when(none, F.expr("cast(array() as array<struct<start:int,end:int>>)")).otherwise(F.expr("transform(slice(m, 2, size(m)), x -> named_struct('start', int(x.a), 'end', int(x.b)))")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, drop_from: int = 2, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """docs with all its columns: rows that `drop_from` items or more are found in go; from the others the spans hit are taken out of the text, each for one space, and n_chars follows."""
    if _too_many(benchmark, max_broadcast_windows):
        given, n = free(docs, "spans", "n_items")
        # what is found is the text's, whatever its id
        (key,) = free(docs, "row")
        rows = docs.withColumn(key, _digest())
        texts = docs.select("text").distinct()
        found = _scan_by_join(texts.select(_digest().alias("doc_id"), "text"), benchmark.select("item_id", "text"), width).where("n_items > 0")
        found = found.select(F.col("doc_id").alias(key), F.col("spans").alias(given), F.col("n_items").alias(n)).dropDuplicates([key])
        text = F.expr(f"aggregate(reverse(`{given}`), encode(text, 'UTF-8'), (s, x) -> concat(substring(s, 1, x.start), encode(' ', 'UTF-8'), substring(s, x.end + 1)))")
        out = rows.join(found, key, "left").where(F.coalesce(n, F.lit(0)) < drop_from).withColumn("text", F.when(F.col(given).isNull(), F.col("text")).otherwise(F.decode(text, "UTF-8")))
        return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)
    windows = Windows(((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator()), width)
    inner, schema = _scan(windows), docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            done, keep, texts = 0, [], batch.column(at).to_pylist()
            for found in inner(iter([batch])):
                for i, (items, spans) in enumerate(zip(found.column(3).to_pylist(), found.column(6).to_pylist(), strict=True), done):
                    keep.append(items < drop_from)
                    if spans and items < drop_from:
                        raw = texts[i].encode()
                        for s in reversed(spans):
                            raw = raw[:s["start"]] + b" " + raw[s["end"]:]
                        texts[i] = raw.decode()
                done += found.num_rows
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            n = batch.schema.get_field_index("n_chars")
            if n >= 0:
                lengths = [old if t is None else len(t) for t, old in zip(texts, batch.column(n).to_pylist(), strict=True)]
                out = out.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
