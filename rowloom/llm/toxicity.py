"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

A lexicon of words and word beginnings is learnt from a bounded sample of labelled rows
(SAMPLE): those that toxic texts hold more often than chance allows, by log-odds. Features
are densities of its words, their nearness to a second person, capitals, punctuation and
obfuscation rates. Trees are fitted on the sample, the calibration on out-of-fold scores.
Words are counted and features computed on the executors; the driver gets numbers alone.
Scoring is one scan without a shuffle; each text is read whole, as bytes.

Defined cases: null counts as empty, whose features are all 0; a label other than 0 or 1 is
ignored; without labelled rows of both kinds the score is the mean label (0.5 if there are
none). Repeated rows get equal scores, a row each; other columns are kept by `reject` and ignored by `score`.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import Isotonic, cell, fold, sample

#: Labelled rows that are learnt from, at most.
SAMPLE = 8_000
#: Cells of the sample: folds of two halves.
CELLS = 8
#: Bytes of word beginnings that the lexicon may hold.
STEMS = (5, 6, 7, 8, 9)
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15
NEAR = 5

YOU = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vos vosotros".split()
_LEET = {ord(a): ord(b) for a, b in zip("013457", "oieast", strict=True)}
_leet_map = np.arange(256, dtype=np.uint8)
for _a, _b in _LEET.items():
    _leet_map[_a] = _b
_digit = np.zeros(256, bool)
_digit[48:58] = True


def _hash_all(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    return X.split(data, np.array([0, len(raw)]), X.PLAIN).hashes()


class Lexicon:
    """Hashes and weights; a stem's hash is that of its bytes as a word, marked by its length."""

    def __init__(self, words: dict[int, float], stems: dict[int, float]):
        self.tables = []
        for d in (words, stems):
            keys = np.array(sorted(d), np.uint64)
            self.tables.append((keys, np.array([d[k] for k in keys.tolist()], float)))

    def look(self, h: np.ndarray, which: int) -> np.ndarray:
        keys, weights = self.tables[which]
        out = np.zeros(len(h))
        if len(keys):
            early = np.zeros(1 << 14, bool)
            early[(keys & np.uint64(0x3FFF)).astype(np.int64)] = True
            i = np.flatnonzero(early[(h & np.uint64(0x3FFF)).astype(np.int64)])
            at = np.searchsorted(keys, h[i])
            at[at == len(keys)] = 0
            ok = keys[at] == h[i]
            out[i[ok]] = weights[at[ok]]
        return out


def _stem_hashes(w: X.Words, n: int):
    """Words longer than n bytes, and the hash of the first n."""
    i = np.flatnonzero(w.end - w.start > n)
    cut = X.Words(w.data, w.off, w.start[i], w.start[i] + n, w.at)
    return i, X.mix(cut.hashes() + np.uint64(n))


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


class Counts:
    """Of a sample in CELLS cells: in how many toxic and other texts of each a word or stem occurs."""

    def __init__(self, texts: np.ndarray, which: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.texts, self.which, self.key, self.n = texts, which, key, n  # n: (keys, cells, 2), texts: (cells, 2)

    def lexicon(self, cells: list[int], least: int = 4, bar: float = 2.0) -> Lexicon:
        """Words and stems in at least `least` toxic texts of the cells whose smoothed log-odds exceed `bar`; and they need to say more than chance by six standard errors."""
        neg, pos = (max(1, int(self.texts[cells, k].sum())) for k in (0, 1))
        m, n = (self.n[:, cells, k].sum(1).astype(float) for k in (0, 1))
        odds = np.log((n + 0.5) / (pos + 1)) - np.log((m + 0.5) / (neg + 1))
        share = (n + m) / (pos + neg)
        z = (n / pos - m / neg) / np.maximum(1e-9, np.sqrt(share * (1 - share) * (1 / pos + 1 / neg)))
        ok = (n >= least) & (odds > bar - 0.5 * self.which) & (z > 6)
        return Lexicon(*(dict(zip(self.key[i].tolist(), odds[i].tolist(), strict=True)) for i in (np.flatnonzero(ok & (self.which == k)) for k in (0, 1))))


def _occur(batches):
    """(which, key, slot, n) over a task's rows (cell, y, text): texts of each slot, 2 * cell + y, with a word (which 0) or stem (1)."""
    for batch in batches:
        slot = 2 * batch.column(0).to_numpy() + batch.column(1).to_numpy()
        for first, _, data, off in X.chunks(_lower(batch.column(2))):
            w = X.split(data, off, X.PLAIN)
            h = w.hashes()
            doc = np.searchsorted(w.at, np.arange(len(h)), "right") - 1
            for which, (i, g) in [(0, (np.arange(len(h)), h)), *((1, _stem_hashes(w, n)) for n in STEMS)]:
                d = doc[i]
                order = np.lexsort((g, d))
                g, d = g[order], d[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                g, t = g[new], slot[first + d[new]]
                order = np.lexsort((t, g))
                g, t = g[order], t[order]
                at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])])) if len(g) else np.empty(0, np.int64)
                n = np.diff(np.append(at, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which, np.int32)), pa.array(g[at].view(np.int64)), pa.array(t[at].astype(np.int32)), pa.array(n.astype(np.int32))], names=["which", "key", "slot", "n"])


def count(rows: DataFrame, least: int = 3) -> Counts:
    """Of rows (cell, y, text); only what `least` toxic texts hold reaches the driver."""
    texts = np.zeros((CELLS, 2), np.int64)
    for r in rows.groupBy("cell", "y").count().collect():
        texts[r.cell, r.y] = r["count"]
    seen = rows.select("cell", "y", "text").mapInArrow(_occur, "which int, key long, slot int, n int")
    each = [F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i in range(2 * CELLS)]
    some = seen.groupBy("which", "key").agg(*each).where(sum(F.col(f"n{2 * c + 1}") for c in range(CELLS)) >= least).toArrow()
    n = np.column_stack([some.column(f"n{i}").to_numpy() for i in range(2 * CELLS)]).reshape(-1, CELLS, 2)
    return Counts(texts, some.column("which").to_numpy(), some.column("key").to_numpy().view(np.uint64), n)


N_FEATURES = 18


def features(column: pa.Array, *lexica: Lexicon) -> np.ndarray:
    """A row of densities and rates for each text; of several lexica, their rows one after the other."""
    rows = []
    you = np.sort(_hash_all(YOU))
    plain = [(X.byte_view(c)) for c in (column,)][0]
    for first, end, data, off in X.chunks(_lower(column)):
        docs = end - first
        w = X.split(data, off, X.PLAIN)
        h = w.hashes()
        n_words = np.maximum(1, np.diff(w.at)).astype(float)
        doc = np.searchsorted(w.at, np.arange(len(h)), "right") - 1
        total = lambda v, d=doc: np.bincount(d, weights=v, minlength=docs)[:docs]
        stems = [_stem_hashes(w, n) for n in STEMS]
        sums = np.concatenate([[0], np.cumsum(_digit[data])])
        digits = sums[w.end] - sums[w.start]
        mixed = (digits > 0) & (digits < w.end - w.start)
        plainly = np.flatnonzero(mixed)
        leet = X.Words(_leet_map[data], w.off, w.start[plainly], w.end[plainly], w.at).hashes() if len(plainly) else h[:0]
        addressed = np.isin(h, you)
        at = np.flatnonzero(addressed)
        one = lambda v: (v > 0).astype(float)
        # capitals and signs are of the text as it is
        whole, bounds = plain
        raw, roff = whole[bounds[first]:bounds[end]], bounds[first:end + 1] - bounds[first]
        size = np.maximum(1, np.diff(roff)).astype(float)
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[roff]).astype(float)
        capital = (raw >= 65) & (raw <= 90)
        letter = capital | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        loud = raw == 33
        sign = ~letter & (raw > 32) & ~((raw >= 48) & (raw <= 57))
        twice = np.zeros(len(raw), bool)
        twice[1:] = sign[1:] & (raw[1:] == raw[:-1])
        letters = np.maximum(1.0, count(letter))
        same = [
            np.log1p(n_words), count(capital) / letters, count(loud) / size, count(sign) / size, count(twice) / size,
            total(mixed.astype(float)) / n_words, total(addressed.astype(float)) / n_words,
        ]
        columns = []
        for lexicon in lexica:
            exact, stem, hard, near, top = (np.zeros(k) for k in (len(h), len(h), len(h), len(h), docs))
            exact[:] = lexicon.look(h, 0)
            for i, g in stems:
                stem[i] = np.maximum(stem[i], lexicon.look(g, 1))
            hard[plainly] = lexicon.look(leet, 0)
            hit = np.maximum(np.maximum(exact, stem), hard)
            hits = np.flatnonzero(hit > 0)
            if len(at) and len(hits):
                k = np.searchsorted(at, hits)
                gap = np.full(len(hits), NEAR + 1)
                for side in (k - 1, k):
                    ok = (side >= 0) & (side < len(at))
                    s = at[np.where(ok, side, 0)]
                    ok &= doc[s] == doc[hits]
                    gap = np.where(ok, np.minimum(gap, np.abs(s - hits)), gap)
                near[hits] = gap <= NEAR
            np.maximum.at(top, doc[hits], hit[hits])
            lex, lex_stem = total(one(exact)), total(one(stem))
            columns += [
                lex, lex / n_words, total(exact) / n_words, lex_stem, lex_stem / n_words, total(stem) / n_words, top,
                total(one(hard)) / n_words, total(near), total(near) / n_words, total(one(hit)) / n_words, *same,
            ]
        rows.append(np.column_stack(columns))
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES * len(lexica)))


class Trees:
    """Boosted trees of the logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, BINS)), np.quantile(c[c > 0], np.linspace(0, 1, BINS)) if (c > 0).any() else []]))[:-1] for c in x.T]
        b = self._bin(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, q - y, q * (1 - q))
            self.trees.append(tree)
            raw += self._walk(b, tree)

    def _bin(self, x):
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def _grow(self, b, g, h, lam=1.0):
        """Nodes in heap order: (feature, bin) or a leaf's value."""
        tree: list = [None] * (2 ** (DEPTH + 1))
        todo = [(1, np.arange(len(g)))]
        while todo:
            node, i = todo.pop()
            gs, hs = g[i].sum(), h[i].sum()
            best = (1e-6, None)
            if node < 2**DEPTH and len(i) >= 10:
                for f in range(b.shape[1]):
                    n = len(self.cuts[f]) + 1
                    gl, hl = np.cumsum(np.bincount(b[i, f], g[i], n))[:-1], np.cumsum(np.bincount(b[i, f], h[i], n))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam)
                    gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k))
            if best[1] is None:
                tree[node] = -RATE * gs / (hs + lam)
            else:
                tree[node] = best[1]
                left = b[i, best[1][0]] <= best[1][1]
                todo += [(2 * node, i[left]), (2 * node + 1, i[~left])]
        return tree

    def _walk(self, b, tree):
        out = np.zeros(len(b))
        todo = [(1, np.arange(len(b)))]
        while todo:
            node, i = todo.pop()
            if isinstance(tree[node], tuple):
                f, k = tree[node]
                left = b[i, f] <= k
                todo += [(2 * node, i[left]), (2 * node + 1, i[~left])]
            else:
                out[i] = tree[node]
        return out

    def __call__(self, x):
        b = self._bin(x)
        return self.base + sum(self._walk(b, t) for t in self.trees)


class Model:
    def __init__(self, mean: float, lexicon: Lexicon | None = None, trees: Trees | None = None, calibrate: Isotonic | None = None):
        self.mean, self.lexicon, self.trees, self.calibrate = mean, lexicon, trees, calibrate

    def __call__(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.mean)
        return self.calibrate(self.trees(features(column, self.lexicon)))


def _described(lexica: list[dict]):
    """(doc_id, y, x) of rows (doc_id, cell, y, text): their features by each model's lexicon for their cell, one after the other."""

    def run(batches):
        for batch in batches:
            cells = batch.column(1).to_numpy()
            for c in np.unique(cells):
                part = batch.filter(pa.array(cells == c))
                for i in range(0, part.num_rows, 512):
                    some = part.slice(i, 512)
                    x = features(some.column(3), *(look[int(c)] for look in lexica))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), lists], names=["doc_id", "cell", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = SAMPLE) -> Model:
    """The driver gets counts of words and features of the sampled rows, no texts.

    A model is fitted without each fold, for the calibration, and one on all. The lexicon from
    one half of its rows is what its trees see on the other, and the other way round; so its
    words count no more in fitting than they will later.
    """
    rows = sample(docs, labels, "toxic", learn, limit).select("doc_id", cell(CELLS), "y", "text")
    counts = count(rows)
    n = counts.texts.sum(0)
    mean = float(n[1] / n.sum()) if n.sum() else 0.5
    if not n.all():
        return Model(mean)
    lexica, last = [], None
    for k in (*range(CELLS // 2), None):
        rest = [c for c in range(CELLS) if c // 2 != k]
        last = counts.lexicon(rest)
        halves = [counts.lexicon([c for c in rest if c % 2 != half], 3) for half in (0, 1)]
        lexica.append({c: last if c // 2 == k else halves[c % 2] for c in range(CELLS)})
    got = rows.mapInArrow(_described(lexica), "doc_id long, cell int, y int, x array<double>").toArrow().sort_by("doc_id")
    y, fold_of = got.column("y").to_numpy().astype(float), got.column("cell").to_numpy() // 2
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(lexica), N_FEATURES)
    raw = np.zeros(len(y))
    for k in range(CELLS // 2):
        mine, rest = fold_of == k, fold_of != k
        if len(set(y[rest].tolist())) == 2:
            raw[mine] = Trees(x[rest, k], y[rest])(x[mine, k])
    return Model(mean, last, Trees(x[:, -1], y), Isotonic(raw, y))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    column = batch.column(batch.schema.get_field_index("text"))
    return pc.fill_null(column.cast(pa.string()), "")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for each row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model(_texts(batch)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose score is `at` or more."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model(_texts(batch)) < at, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, at: float = 0.3, limit: int = SAMPLE) -> DataFrame:
    out = score(docs, fit(docs, labels, fold(folds) != held, limit))
    return out.select("doc_id", (fold(folds) == held).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
