"""Language-model scores from a trie of words, pairs and triples in Elias-Fano form.

The model is a trigram model with absolute discounts, each order interpolated with the one
below, in which words never seen share one class: P(w) = (c - d) / N, P(unseen) = d V / N with
d from the counts of counts; P(w | v) = max(c(vw) - D, 0) / c(v) + D n(v) / c(v) P(w), with n(v)
the distinct successors of v and D = DISCOUNT; and P(w | uv) from c(uvw), c(uv), n(uv) and
P(w | v) likewise. A context never seen hands on the lower order. Each text begins after a
start and ends with an end; its first token has the start alone as context.

It is built in three passes without a global sort or a driver-side table. Tasks count what
they scan and send sorted, delta-coded blocks to shards, by hash of the first word. A shard
writes its part of the levels to the shared folder: words by hash, with counts; the
successors of each word; and the successors of each pair, not by id but by their place among
the successors of the pair's second word, which is what stays small. Ranges are delimited by
monotone pointers, ranges' values made to rise across them, probabilities and back-off weights
quantised to 16 bits. Scoring maps these files and searches the successor within the context's
range; pages are read as queries touch them. Word ids follow the order of hashes, so a shard
holds a run of ids. Words are told apart by 64-bit hashes.

A shard holds about SHARD bytes of text; shards number 2^MOST at most, beyond which they grow, so
that tasks times shards stays bounded. The driver gets one row of sums for each shard.

Defined cases: null or empty text is the end alone; without training rows each score is 0;
rows that repeat an id are separate texts; a null id's checksum is that of the empty text. Other columns are ignored.
"""
from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import elias_fano as ef
from ._labels import fold
from ._shared import new_folder

START, END = np.uint64(0xA5B35705F1C3D2E9), np.uint64(0x3C79AC492BA7B653)
DISCOUNT = 0.75
SHARD = 32 << 20
#: Bits of the number of shards, at most.
MOST = 16
#: Shards whose levels a worker keeps mapped.
MAPPED = 8_000
#: Distinct entries that a task holds before it sends them.
HELD = 3_000_000
#: Bytes of text that are scored together.
TOGETHER = 4 << 20
#: Logarithms from -DEEPEST to 0 are kept in 65,535 steps.
DEEPEST = 12.0


def _tokens(data, off):
    """Hashes with an end after each document, and the bounds of documents in them."""
    w = X.split(data, off, X.SPACED)
    h = w.hashes()
    return np.insert(h, w.at[1:], END), w.at + np.arange(len(w.at))


def _before(x: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """What stands before each token; `first` before a document's first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


def _distinct(keys: np.ndarray, bits: int):
    """The distinct keys (uint64, below 2^bits) in order, and for each key its place among them.

    Keys are sorted with their positions in the lowest bits of one number, which is several times
    as fast as a sort of positions by keys. Where there is no room, their highest bits go with the
    positions, and should different keys share these, positions are sorted after all.
    """
    room = np.uint64(len(keys).bit_length())
    low = (np.uint64(1) << room) - np.uint64(1)
    fits = bits + int(room) <= 64
    both = (keys << room if fits else keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).view(np.int64)
    rising = both >> room if fits else keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(rising[1:], rising[:-1], out=new[1:])
    if not fits and (new[1:] & (both[1:] >> room == both[:-1] >> room)).any():
        return np.unique(keys, return_inverse=True)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return rising[new], back


def _counted(keys: np.ndarray, counts: np.ndarray):
    """Equal keys in one, in order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Gaps and counts, byte by byte of equal weight, so that the many zero bytes lie together."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unblock(raw: bytes):
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8)
    gaps = np.ascontiguousarray(planes[:8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


BLOCK = "shard int, block binary"
LEVEL = "shard long, keys long, most long"


def _send(keys, counts, shard_of):
    shard = shard_of(keys)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(keys))
    for i in range(0, len(cuts), 64):
        yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[i:i + 64]], pa.int32()), pa.array([_block(keys[a:b], counts[a:b]) for a, b in zip(cuts[i:i + 64], ends[i:i + 64], strict=True)], pa.binary())], names=["shard", "block"])


def _reusing(run):
    """A pass over batches that keeps freed memory until its end."""

    def kept(batches):
        with X.reused():
            yield from run(batches)

    return kept


def _count(keys_of, shard_of):
    def run(batches):
        held: list[tuple] = []
        size = 0
        look = keys_of()
        for _, _, _, data, off in X.text_batches(batches, TOGETHER >> 1):
            held.append(np.unique(look(data, off), return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [_counted(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from _send(*held[0], shard_of)
                    held, size = [], 0
        if held:
            yield from _send(*_counted(*map(np.concatenate, zip(*held, strict=True))), shard_of)

    return _reusing(run)


def _gathered(batches):
    """For each shard of a partition its keys and counts; equal keys are put together as blocks come."""
    got: dict[int, list] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got.setdefault(s, []).append(_unblock(b))
            size[s] = size.get(s, 0) + len(got[s][-1][0])
            if size[s] > HELD and size[s] > 2 * len(got[s][0][0]):
                got[s] = [_counted(*map(np.concatenate, zip(*got[s], strict=True)))]
                size[s] = len(got[s][0][0])
    for s in sorted(got):
        yield s, *_counted(*map(np.concatenate, zip(*got.pop(s), strict=True)))


def _attempt() -> str:
    t = TaskContext.get()
    return f"{t.taskAttemptId() if t else 0}-{uuid.uuid4().hex[:8]}"


def _write_words(folder: str, bits: int):
    def run(batches):
        for s, keys, counts in _gathered(batches):
            base = np.uint64((s << (64 - bits)) if bits else 0)
            arrays = ef.prefixed("words", ef.encode(keys - base, 1 << (64 - bits)))
            arrays["counts"] = counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)
            ef.save(folder, f"words-{s}", arrays, _attempt())
            real = counts[keys != START]
            row = (s, len(keys), len(real), int(real.sum()), int((real == 1).sum()), int((real == 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["shard", "ids", "v", "n", "n1", "n2"])

    return _reusing(run)


#: What each step stands for.
_SHARES = 10.0 ** (-np.arange(65536).astype(float) / 65535 * DEEPEST)


def _steps(log: np.ndarray) -> np.ndarray:
    """Logarithms from -DEEPEST to 0 in 16 bits."""
    return np.round(np.clip(-log / DEEPEST, 0, 1) * 65535).astype(np.uint16)


def _level(group: np.ndarray, value: np.ndarray, counts: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    """A level of keys sorted by group and value: pointers by group, values relative to their group's, discounted shares, and the groups' back-off weights."""
    pointers = np.searchsorted(group, np.arange(groups + 1))
    sums = np.bincount(group, weights=counts, minlength=groups)
    rising = ef.relative(value, pointers)
    arrays = ef.prefixed("pointers", ef.encode(pointers, len(group) + 1))
    arrays |= ef.prefixed("next", ef.encode(rising, int(rising[-1]) + 1 if len(rising) else 1))
    arrays["p"] = _steps(np.log10((counts - DISCOUNT) / sums[group]))
    n = np.diff(pointers)
    arrays["backoff"] = _steps(np.log10(np.where(n > 0, DISCOUNT * n / np.maximum(sums, 1), 1.0)))
    return arrays


def _write_level(kind: str, folder: str, base: np.ndarray, shift: int):
    """Writes a shard's level of keys whose bits from `shift` on are the context's number, less base of the shard, and those below the successor."""

    def run(batches):
        for s, keys, counts in _gathered(batches):
            group = (keys >> np.uint64(shift)).astype(np.int64) - int(base[s])
            arrays = _level(group, keys & np.uint64((1 << shift) - 1), counts, int(base[s + 1] - base[s]))
            ef.save(folder, f"{kind}-{s}", arrays, _attempt())
            most = int(np.bincount(group).max()) if len(group) else 0
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (s, len(keys), most)], names=["shard", "keys", "most"])

    return _reusing(run)


class Model:
    """Where the files are, and the sums that the probabilities need. base: ids, and pairs: numbers of pairs, before each shard."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.base = np.zeros((1 << bits) + 1, np.int64)
        self.pairs = np.zeros((1 << bits) + 1, np.int64)
        self.v = self.n = self.n1 = self.n2 = 0
        self.shift = 0
        self.triples: set[int] = set()

    def learn_words(self, rows):
        ids = np.zeros(1 << self.bits, np.int64)
        for r in rows:
            ids[r.shard] = r.ids
            self.v, self.n, self.n1, self.n2 = self.v + r.v, self.n + r.n, self.n1 + r.n1, self.n2 + r.n2
        self.base = np.concatenate([[0], np.cumsum(ids)])
        if self.base[-1] >= 1 << 32:
            raise ValueError("the vocabulary has 2^32 words or more")
        self.d = min(0.95, max(0.05, self.n1 / max(1, self.n1 + 2 * self.n2)))

    def learn_pairs(self, rows):
        keys = np.zeros(1 << self.bits, np.int64)
        most = 0
        for r in rows:
            keys[r.shard], most = r.keys, max(most, r.most)
        self.pairs = np.concatenate([[0], np.cumsum(keys)])
        #: bits of a place among successors; the number of a pair takes those above
        self.shift = max(1, most.bit_length())
        if int(self.pairs[-1]).bit_length() + self.shift > 64:
            raise ValueError("pairs and successors are too many for 64 bits")

    def reader(self) -> Reader:
        """One for a worker and model, so that its tasks share the mapped levels."""
        for other in [k for k in _readers if k != self.folder]:
            del _readers[other]
        found = _readers.setdefault(self.folder, Reader(self))
        found.m = self  # a later stage knows more of the model
        return found


class Reader:
    """Lookups in mapped levels; a level is opened when first asked for, the longest unused is closed."""

    def __init__(self, model: Model):
        self.m, self.open = model, OrderedDict()

    def _get(self, name: str, make):
        if name not in self.open:
            self.open[name] = make(ef.load(self.m.folder, name))
            if len(self.open) > MAPPED:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def _words(self, s: int):
        return self._get(f"words-{s}", lambda a: (ef.part(a, "words"), a["counts"]))

    def _level(self, kind: str, s: int):
        return self._get(f"{kind}-{s}", lambda a: (ef.part(a, "pointers"), ef.part(a, "next"), a["p"], a["backoff"]))

    def ids(self, hashes: np.ndarray):
        """Ids (-1: unseen) and counts of rising hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bits = self.m.bits
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        for s in np.unique(shard):
            if self.m.base[s + 1] == self.m.base[s]:
                continue
            i = np.flatnonzero(shard == s)
            level, c = self._words(int(s))
            at = level.find(hashes[i] - np.uint64((int(s) << (64 - bits)) if bits else 0))
            ok = at >= 0
            ids[i[ok]] = at[ok] + self.m.base[s]
            counts[i[ok]] = c[at[ok]]
        return ids, counts

    def _after(self, kind: str, base: np.ndarray, context: np.ndarray, value: np.ndarray):
        """For contexts in rising order and successors relative to them: the discounted share (0 if unseen), the context's back-off weight (1 if it has no successor), the successor's number in the level (-1 if unseen) and its place among the context's."""
        share, backoff = np.zeros(len(context)), np.ones(len(context))
        number, place = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        shard = np.searchsorted(base, context, "right") - 1
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(1, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            if a == b:
                break
            s = int(shard[a])
            if kind == "triples" and s not in self.m.triples or kind == "pairs" and self.m.pairs[s + 1] == self.m.pairs[s]:
                continue
            pointers, following, p, weights = self._level(kind, s)
            # once for each context, then for its successors
            local = context[a:b] - base[s]
            first = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]]))
            each = np.diff(np.append(first, len(local)))
            local = local[first]
            lo, hi = pointers.two(local)
            weight = np.where(hi > lo, _SHARES[weights[local]], 1.0)
            start = following.base(lo)
            lo, hi, start, backoff[a:b] = (np.repeat(x, each) for x in (lo, hi, start, weight))
            at = following.within(value[a:b], lo, hi, start)
            ok = at >= 0
            share[a:b][ok] = _SHARES[p[at[ok]]]
            if kind == "pairs":
                number[a:b] = np.where(ok, at + self.m.pairs[s], -1)
                place[a:b] = np.where(ok, at - lo, -1)
        return share, backoff, number, place

    def pairs(self, ids: np.ndarray, v: np.ndarray, w: np.ndarray):
        """_after() of each distinct pair of the words w after v (places among ids), then the pairs' second words, and for each occurrence its place among the pairs."""
        bits = len(ids).bit_length()
        keys, back = _distinct((v.view(np.uint64) << np.uint64(bits)) | w.view(np.uint64), 2 * bits)
        second = (keys & np.uint64((1 << bits) - 1)).view(np.int64)
        context, value = ids[(keys >> np.uint64(bits)).view(np.int64)], ids[second]
        # a word never seen has no id; it is asked for past all of them, for the context's sake
        value = np.where(value < 0, 0xFFFFFFFF, value).view(np.uint64)
        return *self._known("pairs", self.m.base, context, value), second, back

    def triples(self, number: np.ndarray, place: np.ndarray, pair: np.ndarray, at: np.ndarray):
        """Discounted share and back-off weight of each distinct pair of pairs, one after the other in a text, the second of them, and for each occurrence its place. number and place: of the pairs (-1: unseen), pair: of each token, at: bounds of documents."""
        bits = len(number).bit_length()
        # 0: no pair before
        keys, back = _distinct((_before(pair + 1, at, 0).view(np.uint64) << np.uint64(bits)) | pair.view(np.uint64), 2 * bits)
        second = (keys & np.uint64((1 << bits) - 1)).view(np.int64)
        context, value = np.append(-1, number)[(keys >> np.uint64(bits)).view(np.int64)], place[second]
        value = np.where(value < 0, (1 << self.m.shift) - 1, value).view(np.uint64)  # no place is so high
        return *self._known("triples", self.m.pairs, context, value)[:2], second, back

    def _known(self, kind: str, base: np.ndarray, context: np.ndarray, value: np.ndarray):
        """_after() where contexts may be unseen (-1) and rise otherwise."""
        some = np.flatnonzero(context >= 0)
        if len(some) == len(context):
            return self._after(kind, base, context, value)
        n = len(context)
        out = np.zeros(n), np.ones(n), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for x, y in zip(out, self._after(kind, base, context[some], value[some]), strict=True):
            x[some] = y
        return out


_readers: dict[str, Reader] = {}


def _read(reader: Reader, data: np.ndarray, off: np.ndarray):
    """Tokens of a chunk with their contexts: bounds of documents, ids and counts of the distinct words, the place among these of each token and of the word before it."""
    tok, at = _tokens(data, off)
    names, inverse = _distinct(np.append(tok, START), 64)
    ids, counts = reader.ids(names)
    w = inverse[:-1]
    return at, ids, counts, w, _before(w, at, inverse[-1])


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """A model of docs(text), its levels in the folder (in the shared one unless told)."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ngrams")
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(0, (size // SHARD).bit_length()))
    model = Model(folder, bits)
    with_key = docs.select(F.lit(0).alias("doc_id"), "text")

    def sent(look, shard_of):
        return with_key.mapInArrow(_count(look, shard_of), BLOCK).repartitionById(1 << bits, F.col("shard"))

    def words():
        def look(data, off):
            tok, at = _tokens(data, off)
            return np.concatenate([tok, np.full(len(at) - 1, START)])

        return look

    by_hash = (lambda k: (k >> np.uint64(64 - bits)).astype(np.int64)) if bits else (lambda k: np.zeros(len(k), np.int64))
    model.learn_words(sent(words, by_hash).mapInArrow(_write_words(folder, bits), "shard long, ids long, v long, n long, n1 long, n2 long").collect())

    def pairs():
        reader = model.reader()

        def look(data, off):
            _, ids, _, w, v = _read(reader, data, off)
            ids = ids.view(np.uint64)
            return (ids << np.uint64(32))[v] | ids[w]

        return look

    base = model.base
    by_word = lambda k: np.searchsorted(base, (k >> np.uint64(32)).astype(np.int64), "right") - 1
    model.learn_pairs(sent(pairs, by_word).mapInArrow(_write_level("pairs", folder, base, 32), LEVEL).collect())

    def triples():
        reader = model.reader()

        def look(data, off):
            at, ids, _, w, v = _read(reader, data, off)
            _, _, number, place, _, pair = reader.pairs(ids, v, w)
            before = _before(number[pair], at, -1)
            some = np.flatnonzero(before >= 0)
            return (before[some].view(np.uint64) << np.uint64(model.shift)) | place[pair[some]].view(np.uint64)

        return look

    numbers, shift = model.pairs, model.shift
    by_pair = lambda k: np.searchsorted(numbers, (k >> np.uint64(shift)).astype(np.int64), "right") - 1
    model.triples = {r.shard for r in sent(triples, by_pair).mapInArrow(_write_level("triples", folder, numbers, shift), LEVEL).collect()}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs(doc_id, text)."""

    def run(batches):
        reader = model.reader()
        for batch, first, end, data, off in X.text_batches(batches, TOGETHER):
            docs_ = end - first
            at, ids, c, w, v = _read(reader, data, off)
            n, size = model.n, model.v
            base = np.log10((c + 0.1) / (n + 0.1 * (size + 1)))
            if n:
                p = np.where(c > 0, (c - model.d) / n, model.d * size / n)
                share, backoff, number, place, second, pair = reader.pairs(ids, v, w)
                p = share + backoff * p[second]
                share, backoff, second, triple = reader.triples(number, place, pair, at)
                log = np.log10(share + backoff * p[second])[triple]
            else:
                log = np.zeros(len(w))
            total = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  each document has an end at least
            ids_ = batch.column(0).slice(first, docs_).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids_, pa.array(np.diff(at), pa.int64()), pa.array(total((c > 0).astype(np.int64)[w])), pa.array(total(base[w])), pa.array(total(log))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(_reusing(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scored(docs: DataFrame, *, folds: int = 10, held: int = 0) -> DataFrame:
    """Scores of all rows by a model of those whose checksum modulo `folds` isn't `held`."""
    model = train(docs.where(fold(folds) != held))
    out = score(docs, model)
    return out.select("doc_id", (fold(folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
