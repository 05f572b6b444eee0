"""Near-duplicate documents by b-bit MinHash.

1. One scan turns each text into: the size and a 128-bit hash of its shingle set, the low
   4 bits of 128 minima packed into 8 longs, and a key for each band of minima.
2. Documents of equal sets are one node; its smallest id stands for it.
3. Nodes that share a band key are candidates: first each against the smallest of its
   bucket; then, in buckets with many pairs between unlinked parts, each member of another part
   against one more, picked by hash, as long as that pays; then, in the buckets left, the parts against each
   other in blocks, but nothing inside a bucket's largest part. A pair goes on if sizes allow the threshold and the
   collision-corrected likeness from the bit counts is within six standard errors of it. Of the parts a pair
   also goes only if the shingles of their pivot that both have, and all that the one with
   fewer others has beside them, would reach the threshold: an upper bound, so no link is lost.
4. What is left is confirmed on the full sets, from texts that a bitmap of fixed size picked
   out of the scan. Pairs are dealt to tiles of bounded size, by their pivot or by the cells of
   both ends; a text is sent once to each of its tiles, never once for each pair.
5. Links become components by alternating large-star and small-star steps; later rounds walk
   only the links between parts already joined.

The bands are chosen so that a pair at the threshold shares none with a chance under one in
a million. No bucket is capped; hot buckets cost a row for each member, and blocks of
1,024 where parts stay apart: members times those outside the largest part.

Defined cases: a null or empty text has an empty set and is linked with nothing; a null
doc_id is never linked, and its component is null; rows that repeat a doc_id with the same text are
one node and each gets the result; an id that comes with several texts is linked by any of them.
Other columns are ignored.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import drop, free, keep, mark_ids, only_ids

MINIMA, BITS = 128, 4
_rng = np.random.default_rng(73)
_A = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold is missed less than once in a million."""
    for rows in range(12, 0, -1):
        if (1 - (percent / 100) ** rows) ** (MINIMA // rows) < 1e-6:
            return MINIMA // rows, rows
    return MINIMA, 1


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int):
    """For each document of a chunk the sorted distinct hashes of its shingles."""
    w = X.split(data, off, X.SPACED)
    h = w.hashes()
    g = X.grams(h, k)
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(g[a:b - k + 1])
        elif b > a:
            yield X.grams(h[a:b], b - a, salt=1)
        else:
            yield h[:0]


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.uint64(2**64 - 1))
    for i in range(0, len(s), 256):
        np.minimum(out, (s[None, i:i + 256] * _A[:, None] + _B[:, None]).min(1), out=out)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, 16 to a long."""
    low = (X.mix(m) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        for batch, first, end, data, off in X.text_batches(batches):
            size, hi, lo, sig, keys = [], [], [], [], []
            for s in shingle_sets(data, off, k):
                size.append(len(s))
                hi.append(X.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                lo.append(X.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                m = minima(s)
                sig.append(pack(m))
                part = m[:bands * rows].reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(rows):
                    key = X.mix(key ^ part[:, j]) * np.uint64(0xD6E8FEB86659FD93)
                keys.append(key.view(np.int64))
            lists = lambda v, n: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * n), pa.array(np.concatenate(v)))
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(first, end - first).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(np.array(lo, np.uint64).view(np.int64)), lists(sig, MINIMA * BITS // 64), lists(keys, bands)], names=["doc_id", "n_shingles", "hi", "lo", "sig", "bands"])

    return run


def likeness(a: str, b: str) -> Column:
    """From the count of equal lanes, less the equal ones that chance makes."""
    terms = []
    for i in range(MINIMA * BITS // 64):
        x = f"({a}[{i}] ^ {b}[{i}])"
        terms.append(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)")
    equal = F.lit(1.0) - F.expr(" + ".join(terms)) / float(MINIMA)
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def _possible(percent: int) -> Column:
    """Whether sizes allow the threshold, and the bits don't speak against it."""
    t = percent / 100
    p = t + (1 - t) * 2.0**-BITS
    margin = 6 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - 2.0**-BITS)
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sizes & (likeness("sa", "sb") >= t - margin)


COMPARED = "a long, b long, linked boolean, beyond long, bits array<long>"
#: Members and shingles that a tile of comparisons holds at most, about, from either side.
TILE, TILE_SHINGLES = 256, 1 << 20
#: A round of further pivots is followed by another if it linked this share of its pairs, or left at most that share of the open ones.
LINKS, CLOSES = 1 / 64, 0.9


def _compare(k: int, percent: int):
    """Of rows sorted by tile, its texts (b null) before its pairs: for each pair whether the full sets are linked, how many shingles of b are not of a, and which of a's (in order of hash) are of b.

    The sets of one tile are held at a time, so a text comes once for each of its tiles and not for each of its pairs.
    """

    def run(batches):
        tile, held = None, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                texts = part.filter(pc.is_null(part.column(2)))
                sets = (s for _, _, data, off in X.chunks(texts.column(3)) for s in shingle_sets(data, off, k))
                pairs, linked, beyond, bits = [], [], [], []
                for t, a, b in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if t != tile:
                        tile, held = t, {}
                    if b is None:
                        held.setdefault(a, []).append(next(sets))
                        continue
                    for x in held.get(a, ()):
                        for y in held.get(b, ()):
                            at = np.searchsorted(y, x)
                            at[at == len(y)] = 0
                            shared = y[at] == x if len(y) else np.zeros(len(x), bool)
                            both = int(shared.sum())
                            pairs.append((a, b))
                            linked.append(bool(len(x)) and 100 * both >= percent * (len(x) + len(y) - both))
                            beyond.append(len(y) - both)
                            bits.append(np.packbits(np.pad(shared, (0, -len(x) % 64)), bitorder="little").view(np.int64))
                if pairs:
                    ids = [pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(linked, pa.bool_()), pa.array(beyond, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["a", "b", "linked", "beyond", "bits"])

    return run


def _tiles(count: Column, shingles: Column) -> Column:
    """How many parts of a group of so many members and shingles make tiles of bounded size."""
    return F.ceil(F.greatest(count / TILE, shingles / TILE_SHINGLES, F.lit(1.0))).cast("int")


def _by_hub(pairs: DataFrame, hub: str, other: str) -> DataFrame:
    """(a, b, tile) of pairs in which `hub` repeats: its pairs in tiles by hash of the other (whose shingles are `n`)."""
    sizes = pairs.groupBy(hub).agg(_tiles(F.count("*"), F.sum("n")).alias("parts"))
    tile = F.xxhash64(hub, F.pmod(F.xxhash64(other), F.col("parts")))
    return pairs.join(sizes, hub).select("a", "b", tile.alias("tile"))


def compare(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, tile) compared on their full sets."""
    ends = pairs.select("tile", F.col("a").alias("id")).union(pairs.select("tile", "b")).distinct()
    texts = only_ids(docs.select("doc_id", "text"), "doc_id", ends, "id")
    none = F.lit(None)
    rows = ends.join(texts, F.col("doc_id") == F.col("id")).select("tile", F.col("id").alias("a"), none.cast("long").alias("b"), "text")
    rows = rows.union(pairs.select("tile", "a", "b", none.cast("string")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tile").sortWithinPartitions("tile", "b").mapInArrow(_compare(k, percent), COMPARED)


def _first_shared() -> Column:
    return F.expr("filter(zip_with(ba, bb, (x, y) -> if(x = y, x, null)), x -> x is not null)[0]")


def _beyond_reach(percent: int) -> Column:
    """Whether two members that were both compared with one pivot share too few of its shingles to be linked, whatever they share beside it."""
    most = F.expr("aggregate(zip_with(ta, tb, (x, y) -> bit_count(x & y)), 0, (s, x) -> s + x)") + F.least("ea", "eb")
    return F.coalesce(most * 100 < (F.col("na") + F.col("nb") - most) * percent, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for each id in links (a, b): the smallest id that it reaches. Links stay in the cluster; each step has one row a link."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v")))
        old, edges = edges, keep(small.distinct(), "links")
        drop(old)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))


def _joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """The parts (id, part), joined further by links (a, b): only links between parts are walked."""
    named = links.select("a", "b")
    for end in ("a", "b"):
        named = named.join(part.select(F.col("id").alias(end), F.col("part").alias("p" + end)), end, "left")
    between = named.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
    more = components(between).select(F.col("id").alias("part"), "component_id")
    ids = part.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("part").alias("part"))
    return ids.join(more, "part", "left").select("id", F.coalesce("component_id", "part").alias("part"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text); linked when 100 * intersection >= percent * union."""
    bands, rows = bands_for(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = keep(docs.mapInArrow(_sketch(shingle, bands, rows), "doc_id long, n_shingles long, hi long, lo long, sig array<long>, bands array<long>"), "sketches")
    same = ["hi", "lo", "n_shingles"]
    stand = keep(sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "sets")
    own = keep(sketched.select("doc_id", *same).join(stand, same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("node")), "rows")
    nodes = sketched.join(stand.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same])
    nodes = keep(nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "bands"), "nodes")
    drop(sketched, stand)
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    members = keep(keyed.join(buckets, "key").distinct(), "members")
    sketch = nodes.select("id", "n", "sig")
    side = lambda x: sketch.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("sig").alias("s" + x))
    possible = lambda p: p.join(side("b"), "b").join(side("a"), "a").where(_possible(percent))
    pairs = members.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = keep(possible(pairs).select("a", "b", F.col("nb").alias("n")).distinct(), "pairs")
    compared = keep(compare(docs, keep(_by_hub(pairs, "a", "b"), "tiles"), shingle, percent), "compared")
    tried, links = pairs.select("a", "b"), compared.where("linked").select("a", "b").distinct()
    part = keep(components(links).select("id", F.col("component_id").alias("part")), "parts")

    # A part: what links already join. Buckets of one part are done. While a bucket's pairs between
    # parts far outnumber its members, each of these meets one more of them, another in each bucket and round.
    # A round reads all texts, so there is another only if the last one linked a share of its pairs or closed a
    # share of the open ones; the blocks find what is left in any case.
    before, yields = None, False
    for turn in itertools.count():
        parted = members.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
        sizes = parted.groupBy("key", "part").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("key", "id", F.lit(turn)), F.col("id").alias("i"))).alias("h"))
        split = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("n"), F.min(F.struct("h", "part")).alias("p"), F.max(F.struct("c", "part")).alias("l")).where("n > 1")
        split = keep(split.select("key", F.col("l.part").alias("largest"), F.ceil(F.col("l.c") / block).cast("int").alias("inner"), F.ceil((F.col("m") - F.col("l.c")) / block).cast("int").alias("outer"), "m", ((F.col("m") * F.col("m") - F.col("s")) / 2).alias("open"), F.col("p.h.i").alias("pivot"), F.col("p.part").alias("its")), "split")
        wide = split.where(F.col("open") > 8 * F.col("m"))
        pending = wide.agg(F.sum("open")).first()[0]
        if not pending or before and not yields and pending > CLOSES * before:
            break
        before, wide = pending, wide.select("key", "pivot", "its")
        met = parted.join(wide, "key").where("part != its").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), "pivot")
        met = met.groupBy("a", "b").agg(F.min("pivot").alias("hub")).join(tried, ["a", "b"], "left_anti")
        met = keep(possible(met).select("a", "b", "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("na", "nb").alias("n")), "met")
        more = keep(compare(docs, keep(_by_hub(met, "hub", "other"), "tiles"), shingle, percent).where("linked").select("a", "b").distinct(), "more")
        linked = more.count()
        if not linked:
            break
        yields = linked >= LINKS * met.count()
        tried, old, part = tried.union(met.select("a", "b")), part, keep(_joined(part, more), "parts")
        drop(old, split)
    seen = compared.groupBy(F.col("a").alias("first"), F.col("b").alias("id")).agg(F.max("beyond").alias("e"), F.first("bits").alias("t"), F.count("*").alias("texts")).where("texts = 1").drop("texts")
    left = parted.join(split.select("key", "largest", "inner", "outer"), "key").join(nodes, "id").join(seen, ["first", "id"], "left")
    # blocks 0 to outer - 1 hold what is outside the bucket's largest part and meet all blocks; the inner ones, from outer on, hold that part and don't meet each other
    apart = F.col("part") != F.col("largest")
    left = keep(left.withColumn("blk", F.when(apart, F.pmod(F.xxhash64("id"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).cast("int")), "left")
    # a pair that shares several bands is made by the first of them
    one = left.select("key", F.col("bands").alias("ba"), F.col("id").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("e").alias("ea"), F.col("t").alias("ta"), F.col("blk").alias("x"), F.explode(F.expr("sequence(if(blk < outer, blk, 0), outer - 1)")).alias("y"))
    two = left.where("blk < outer").select("key", F.col("bands").alias("bb"), F.col("id").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("e").alias("eb"), F.col("t").alias("tb"), F.explode(F.expr("concat(sequence(0, blk), sequence(outer, outer + inner - 1))")).alias("x"), F.col("blk").alias("y"))
    rest = one.join(two, ["key", "x", "y"]).where((F.col("pa") != F.col("pb")) & ((F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))) & (F.col("key") == _first_shared()) & _possible(percent) & ~_beyond_reach(percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    # tiles of these: by the smallest pivot of either end, in parts by hash
    cell = left.groupBy("id").agg(F.min("first").alias("cell"), F.first("n").alias("n"))
    cell = cell.join(cell.groupBy("cell").agg(_tiles(F.count("*"), F.sum("n")).alias("parts")), "cell")
    cell = keep(cell.select("id", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("at")), "cells")
    for end in ("a", "b"):
        rest = rest.join(cell.select(F.col("id").alias(end), F.col("at").alias("c" + end)), end)
    tiles = keep(rest.select("a", "b", F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("tile")), "tiles")
    drop(left)
    more = keep(compare(docs, tiles, shingle, percent).where("linked").select("a", "b"), "more")
    found = keep(_joined(part, more), "parts")
    out = own.join(found.select(F.col("id").alias("node"), F.col("part").alias("c")), "node", "left")
    drop(nodes, members, pairs, compared, part, split, cell, tiles, more)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "node"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, without the rows that near_duplicates() does not keep, and once each where a row's id and text repeat.

    Only rows whose id a bitmap of fixed size names are shuffled. Rows without id or words stay, and
    those of an id that comes with several texts, as what one of them repeats the others may not.
    """
    id_, maybe = free(docs, "id_", "maybe_")
    found = keep(near_duplicates(docs, shingle=shingle, percent=percent).where("doc_id is not null"), "kept")
    each = found.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("rows"), F.bool_and("kept").alias("stays"))
    odd = each.where("rows > 1 or not stays").select(id_, "rows", "stays")
    marked = mark_ids(docs, "doc_id", odd, id_, maybe)
    some = marked.where(F.col(maybe)).dropDuplicates(["doc_id", "text"])
    several = some.groupBy(F.col("doc_id").cast("long").alias(id_)).count().where("count > 1").select(id_)
    gone = odd.where("not stays").join(several, id_, "left_anti").select(id_)
    some = some.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
    return some.select(docs.columns).union(marked.where(~F.col(maybe)).select(docs.columns))
