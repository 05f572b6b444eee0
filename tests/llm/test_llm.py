"""The operators against SQL, brute force, exact round trips and held-out labels, and on odd inputs."""
import base64
import hashlib
import random
import re
import resource
import textwrap

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import _text, bpe, decontaminate, elias_fano, licenses, lz, minhash, ngrams, quality, queries, substrings, suffixes, toxicity, warc
from rowloom.llm._labels import Isotonic, fold
from rowloom.llm._order import upper_bounds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts(n, seed=1, words=60):
    """Documents with near and exact copies, shared passages, and nulls and empties."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    out = []
    for i in range(n):
        k = r.random()
        if out and k < 0.2:
            t = r.choice(out) or ""
        elif out and k < 0.45 and (t := r.choice(out)):
            w = t.split(" ")
            w[r.randrange(len(w))] = "x" + str(i)
            t = " ".join(w)
        else:
            t = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, words)))
            t = t + " " + passage if k > 0.9 else t
        out.append(None if k > 0.985 else t)
    return [*out, "", None, "one", "One Two", "a" * 700, "ab" * 400 + passage * 3]


def frame(spark, values, extra=False):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df.withColumn("score", F.lit("mine")).withColumn("rep", F.lit(1)).withColumn("maybe_", F.lit(1)).withColumn("row", F.lit(2)).withColumn("tokens", F.lit("t")) if extra else df


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])


# --- 1 ---


def brute_components(values, k, percent):
    sets = []
    for t in values:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(values)))
    for _ in values:
        before = list(comp)
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            break
    return [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, comp))]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    values = texts(220)
    got = minhash.near_duplicates(frame(spark, values), shingle=k, percent=percent)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute_components(values, k, percent)


def test_near_duplicates_in_blocks_and_rounds(spark):
    """One bucket with many members around the threshold, in blocks of 8."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    values = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = f"z{r.random()}"
        values.append(" ".join(w))
    got = minhash.near_duplicates(frame(spark, values), shingle=3, percent=85, block=8)
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute_components(values, 3, 85)


def test_near_duplicates_rounds_that_link_little(spark, monkeypatch):
    """A large part, and texts linked with one of its members each or with none: rounds end when they don't pay, and blocks find the rest."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(128)]
    changed = lambda w, at: [f"z{r.random()}" if i in at else x for i, x in enumerate(w)]
    part = [changed(base, {2 * i + 3}) for i in range(60)]
    apart = [changed(w, set(r.sample([j for j in range(1, 127, 2) if j != 2 * i + 3], 3))) for i, w in enumerate(part)]
    alone = [changed(base, set(r.sample(range(2, 127, 2), 6))) for _ in range(150)]
    values = [" ".join(w) for w in [*part, *apart, *alone]]
    r.shuffle(values)
    kept, write = [], minhash.keep
    monkeypatch.setattr(minhash, "keep", lambda df, kind="table": kept.append(kind) or write(df, kind))
    got = minhash.near_duplicates(frame(spark, values), shingle=3, percent=85, block=8)
    assert sorted(tuple(x) for x in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute_components(values, 3, 85)
    assert 1 <= kept.count("met") <= 2


def test_keep_one(spark):
    values = texts(120, 3)
    kept = {i for i, _, _, k in brute_components(values, 5, 80) if k}
    df = frame(spark, values, extra=True)
    out = minhash.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(kept)
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in minhash.keep_one(odd).collect()) == ["1", "None", "None"]


# --- 2, 5 ---


def test_license_whole_text_over_lines(spark):
    body = licenses.TEMPLATES["mit-grant"][1]
    w = body.split()
    broken = "\n".join(" ".join(w[i:i + 6]) for i in range(0, len(w), 6))
    got = licenses.scan(spark.createDataFrame([(1, broken), (2, None), (3, "nothing here")], "doc_id long, text string"), least=0.8).collect()
    assert {r.doc_id: r.license for r in got} == {1: "MIT", 2: None, 3: None}


def wrapped(text, width=70, mark="# "):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_license_wrapped_inside_a_long_document(spark):
    prose = "\n".join(" ".join(f"w{(i * 7 + j) % 211} of the" for j in range(8)) for i in range(200))
    headers = {"Apache-2.0": "apache-2.0-header", "MIT": "mit-grant", "ISC": "isc-grant", "GPL-3.0-or-later": "gpl-3.0-header"}
    docs = [(x, f"{prose}\n{wrapped(licenses.TEMPLATES[name][1])}\n{prose}", name) for x, name in headers.items()]
    docs += [(licenses.TEXTS[name][0], f"{prose}\n{wrapped(licenses.TEXTS[name][1])}\n{prose}", name) for name in ("mit-text", "isc-text", "bsd-3-clause-text", "apache-2.0-text", "gpl-2.0-text")]
    docs += [("MIT", f"{prose} and then this here is all Released under the MIT License. {prose}", "mit-notice"), ("MIT", "MIT License\n\nCopyright (c) 2020 A\n\n" + wrapped(licenses.TEXTS["mit-text"][1], mark=""), "mit-text"), (None, prose, None)]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(docs)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.license, r.template) for r in got] == [(x, name) for x, _, name in docs]
    assert all(r.dice == 1 for r in got if r.license)


def test_license_runs_agree_with_brute_force():
    r = random.Random(5)
    for _ in range(300):
        words = "abcd"[: r.randint(2, 4)]
        texts_ = {str(i): ("L", " ".join(r.choice(words) for _ in range(r.randint(2, 9)))) for i in range(3)}
        w = [r.choice(words + "xy") for _ in range(r.randint(0, 30))]
        sizes, best = [len(licenses.bigrams(t)) for _, t in texts_.values()], None
        if max(sizes) >= 2 * min(sizes):
            continue
        for a in range(len(w)):
            for b in range(a + 2, len(w) + 1):
                mine = licenses.bigrams(" ".join(w[a:b]))
                for name, (_, t) in texts_.items():
                    d = 2 * len(mine & licenses.bigrams(t)) / (len(mine) + len(licenses.bigrams(t)))
                    if d >= 0.8 and (best is None or (-d, name) < best):
                        best = -d, name
        got = licenses.Matcher(texts_, 0.8).scan(" ".join(w))
        assert (got[2], got[1]) == ((-best[0], best[1]) if best else (None, None))


def test_decontamination_by_join_agrees_with_broadcast(spark):
    values, items = texts(80, 7), [(1, "w0 " * 3), (2, None), (None, "x y")]
    long = [t for t in values if t and len(t.split()) > 20]
    items += [(10 + i, " ".join(t.split()[2:14])) for i, t in enumerate(long[:5])] + [(30, "One"), (31, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.scan(frame(spark, values), b)
    two = decontaminate.scan(frame(spark, values), b, max_broadcast_windows=0)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))
    df = frame(spark, values, extra=True)
    a, c = decontaminate.clean(df, b), decontaminate.clean(df, b, max_broadcast_windows=0)
    assert a.columns == df.columns and sorted((r.doc_id, r.text) for r in a.collect()) == sorted((r.doc_id, r.text) for r in c.collect())
    gone = {r.doc_id for r in one.collect() if r.n_items >= 2}
    assert {r.doc_id for r in a.collect()} == set(range(len(values))) - gone
    assert decontaminate.scan(a.select("doc_id", "text"), b).agg(F.max("n_items")).first()[0] <= 1


# --- 3, 8 ---


def auc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in p for b in n])


@pytest.mark.parametrize("name,label,least", [("op3_quality_classifier", "quality", 0.8), ("op8_toxicity", "toxic", 0.9)])
def test_held_out(spark, name, label, least):
    d = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, d)
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", label).collect()
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(rows) > 20 and auc([tuple(r) for r in rows]) >= least
    assert out.where("score < 0 or score > 1 or score is null or (predicted = 1) != (score >= 0.3)").count() == 0


def test_classifiers_without_labels(spark):
    df, none = frame(spark, ["a", None, ""]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.scored, toxicity.scored):
        assert {r.score for r in f(df, none).collect()} == {0.5}
    model = toxicity.fit(df, none, fold(4) != 2)
    assert toxicity.reject(frame(spark, ["a"], extra=True), model, at=0.6).count() == 1


@given(st.lists(st.tuples(st.floats(-5, 5), st.booleans()), max_size=40))
@settings(max_examples=50, deadline=None)
def test_isotonic_rises(pairs):
    f = Isotonic([x for x, _ in pairs], [float(y) for _, y in pairs])
    v = f(np.linspace(-6, 6, 50))
    assert (np.diff(v) >= -1e-12).all() and (v >= 0).all() and (v <= 1).all()


# --- 4 ---


def lz_brute(text):
    known, phrases, cur = set(), set(), b""
    for c in (text or "").encode():
        cur += bytes([c])
        if cur not in known:
            known.add(cur)
            phrases.add(cur)
            cur = b""
    return phrases | ({cur} if cur else set())


def test_fingerprints(spark):
    values = texts(60, 9)
    got = {r.doc_id: r for r in lz.edits(frame(spark, values), rows_a_run=7).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        t, after = t or "", values[i - 1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == lz.fingerprint(t) and r.edited_fingerprint == lz.fingerprint(edited)
        assert r.near_next == lz.likeness(lz.fingerprint(t), lz.fingerprint(after))
    a, b = max(values[:60], key=lambda t: len(t or "")), values[-1]
    x, y = lz_brute(a), lz_brute(b)
    assert abs(lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) - len(x & y) / len(x | y)) < 0.25
    assert lz.likeness(lz.fingerprint(a), lz.fingerprint(a)) == 1 and lz.likeness(lz.EMPTY, lz.EMPTY) == 1
    one = spark.createDataFrame([(None, "abcd")], "doc_id long, text string")
    assert lz.edits(one).collect()[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_bounds(spark):
    df = spark.createDataFrame([(k,) for k in [*range(500), *[7] * 3000]], "k long")
    tops = upper_bounds(df, "k", F.lit(1), 10)
    assert tops == sorted(set(tops)) and tops[-1] == 499 and 3 <= len(tops) <= 12


# --- 6 ---


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 500
    rows = [(5, "http://a/5", big), (2, None, big), (9, "http://a/9", "small"), (1, "http://a/1", "small"), (7, "u\r\nv", None), (None, "n", big), (2, None, big), (11, "z", big + "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit(1))
    made = []
    for k in (1, 2):
        folder = f"file://{tmp_path}/{k}"
        m = warc.write(df.repartition(3), folder, roll=400, run_bytes=700)
        made.append(sorted((r.file, r.sha256) for r in m.collect()))
        got = sorted(map(tuple, warc.read(spark, folder).select("page_id", "record_type", "refers_to", "payload_bytes").collect()), key=str)
    assert made[0] == made[1] and len(made[0]) > 2
    kinds = {(p, t, r) for p, t, r, _ in got}
    assert kinds == {(5, "revisit", 2), (2, "response", None), (9, "response", None), (1, "response", None), (7, "response", None), (None, "revisit", 2), (11, "response", None)}
    assert len(got) == 8 and warc.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


# --- 7 ---


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Bpe(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.one_of(st.text(max_size=200), st.text("ab ", max_size=400), st.text("thequickénß中 \n", max_size=300)))
@settings(max_examples=300, deadline=None)
def test_bpe_like_the_library(codec, text):
    own, library = codec
    ids = own.encode(text).tolist()
    assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_long_pieces(codec):
    own, library = codec
    r = random.Random(2)
    for t in ("a" * 5000, "=" * 3001, "".join(r.choice("abcdeé") for _ in range(6000)), "ab" * 2500, " " * 999 + "x"):
        assert own.encode(t).tolist() == library.encode_ordinary(t)


def test_bpe_tree_with_tables_that_keep_starting_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 3)
    monkeypatch.setattr(bpe, "LEAVES", 2)
    with open(VOCABULARY, "rb") as f:
        own = bpe.Bpe(f.read(), public_tokenizers.PATTERN)
    r = random.Random(7)
    for n in (1, 4, 5, 9, 24, 25, 60, 97, 300):
        for _ in range(30):
            piece = "".join(r.choice("aeintrs kxé") for _ in range(n)).encode()
            assert own.tree(piece) == own.leaf(piece)
            assert own.decode(own.tree(piece)) == piece


def test_bpe_queries(spark, codec):
    values = texts(40, 4)
    got = {r.doc_id: r for r in bpe.digests(frame(spark, values), VOCABULARY, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(values):
        ids = codec[1].encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    out = bpe.round_trip(frame(spark, values, extra=True), VOCABULARY, public_tokenizers.PATTERN)
    assert out.where("not exact").count() == 0 and out.count() == len(values)
    back = bpe.detokenize(bpe.tokenize(frame(spark, values), VOCABULARY, public_tokenizers.PATTERN).drop("text"), VOCABULARY, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(values)}


# --- 9 ---


@given(st.lists(st.integers(0, 10**12), max_size=200, unique=True), st.integers(1, 10**6))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, gap):
    v = np.array(sorted(values), np.uint64)
    e = elias_fano.EliasFano(elias_fano.encode(v, 10**12 + 1))
    assert e[np.arange(len(v))].tolist() == v.tolist()
    assert e.find(v).tolist() == list(range(len(v)))
    if len(v) > 1:
        a, b = e.two(np.arange(len(v) - 1))
        assert a.tolist() == v[:-1].tolist() and b.tolist() == v[1:].tolist()
    other = np.array([x + gap for x in v.tolist() if x + gap <= 10**12 and x + gap not in values], np.uint64)
    assert (e.find(other) == -1).all()


@given(st.lists(st.lists(st.integers(0, 10**6), max_size=12, unique=True).map(sorted), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_elias_fano_by_ranges(groups):
    flat = np.array([x for g in groups for x in g], np.uint64)
    bounds = np.cumsum([0, *map(len, groups)])
    rising = elias_fano.relative(flat, bounds)
    e = elias_fano.EliasFano(elias_fano.encode(rising, int(rising[-1]) + 1 if len(rising) else 1))
    for g, lo, hi in zip(groups, bounds[:-1], bounds[1:]):
        asked = sorted({*g, *(x + 1 for x in g), 0, 2**32 - 1})
        want = [int(lo) + g.index(x) if x in g else -1 for x in asked]
        low, high = np.full(len(asked), lo), np.full(len(asked), hi)
        assert e.within(np.array(asked, np.uint64), low, high, e.base(low)).tolist() == want


def test_elias_fano_looks(monkeypatch):
    """One look at the low bits where a range has one value of the bucket, and in long buckets at most one more than halvings need."""
    looks = [0]
    low = elias_fano.EliasFano.low
    monkeypatch.setattr(elias_fano.EliasFano, "low", lambda self, i: (looks.__setitem__(0, looks[0] + len(i)), low(self, i))[1])
    for group, most in (([7], 1), (list(range(100, 9100, 3)), 13)):
        values, bounds = np.array(group * 50, np.uint64), np.arange(51) * len(group)
        # a far last value makes the buckets wide
        rising = np.append(elias_fano.relative(values, bounds), np.uint64(10**9))
        e = elias_fano.EliasFano(elias_fano.encode(rising, 10**9 + 1))
        lo = np.repeat(bounds[:-1], len(group))
        base = e.base(lo)
        e.last  # noqa: B018  looked up once
        looks[0] = 0
        assert e.within(values, lo, lo + len(group), base).tolist() == list(range(len(values)))
        assert looks[0] <= most * len(values)
        assert (e.within(values + np.uint64(1), lo, lo + len(group), base) == -1).all()


@pytest.mark.parametrize("bits", [20, 40, 64])
def test_distinct_keys(bits):
    r = np.random.default_rng(bits)
    some = r.integers(0, 1 << min(bits, 63), 500, dtype=np.uint64)
    for keys in (some, r.choice(some, 5000), r.integers(0, 9, 3000, dtype=np.uint64), np.append(some, (np.uint64(1) << np.uint64(bits - 1)) + np.arange(40, dtype=np.uint64)[::-1]), some[:1]):
        for got, want in zip(ngrams._distinct(keys, bits), np.unique(keys, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()


def test_memory_is_reused():
    if _text._libc is None:
        pytest.skip("no glibc")
    faults = lambda: resource.getrusage(resource.RUSAGE_THREAD).ru_minflt
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * resource.getpagesize()
    with _text.reused():
        before = faults()
        for _ in range(40):
            np.full(1 << 20, 1)
        assert faults() - before < 40 * 2048 // 4
        several = [np.full(1 << 20, 1) for _ in range(12)]
        most = resident()
        del several
    assert resident() < most - 12 * (6 << 20)


@pytest.mark.parametrize("shard", [1 << 30, 700])
def test_language_model(spark, monkeypatch, shard):
    monkeypatch.setattr(ngrams, "SHARD", shard)
    values = texts(80, 6)
    docs = frame(spark, values).cache()
    train = {r.doc_id for r in docs.where(fold(10) != 0).collect()}
    words = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x] + ["</s>"]
    count, pair, after, triple, after2, pairs2 = {}, {}, {}, {}, {}, {}
    for i in train:
        before = ["<s>"]
        count["<s>"] = count.get("<s>", 0) + 1
        for w in words(values[i]):
            count[w] = count.get(w, 0) + 1
            pair[before[-1], w] = pair.get((before[-1], w), 0) + 1
            if len(before) > 1:
                k = (*before[-2:], w)
                triple[k] = triple.get(k, 0) + 1
                pairs2[k[:2]] = pairs2.get(k[:2], 0) + 1
            before.append(w)
    for v, _ in pair:
        after[v] = after.get(v, 0) + 1
    for u, v, _ in triple:
        after2[u, v] = after2.get((u, v), 0) + 1
    n, v = sum(c for w, c in count.items() if w != "<s>"), len(count) - 1
    n1, n2 = (sum(c == k for w, c in count.items() if w != "<s>") for k in (1, 2))
    d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    got = {r.doc_id: r for r in ngrams.scored(docs).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        base = score = 0.0
        before = ["<s>"]
        for w in words(t):
            c = count.get(w, 0)
            base += np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            p = (c - d) / n if c else d * v / n
            if before[-1] in after:
                p = (max(pair.get((before[-1], w), 0) - 0.75, 0) + 0.75 * after[before[-1]] * p) / count[before[-1]]
            k = tuple(before[-2:])
            if k in after2:
                p = (max(triple.get((*k, w), 0) - 0.75, 0) + 0.75 * after2[k] * p) / pairs2[k]
            score += np.log10(p)
            before.append(w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words(t)), sum(w in count for w in words(t)), n, i not in train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 1e-3 * max(1, abs(score))


# --- 10 ---


@given(st.lists(st.integers(0, 3), max_size=120))
@settings(max_examples=200, deadline=None)
def test_suffix_array(s):
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_removed(values, length):
    seen, out = set(), []
    for t in values:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                mark[i:i + length] = b"\1" * length
            seen.add(w)
        out.append((raw, mark))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    values = texts(100, seed)
    got = {r.doc_id: r for r in substrings.digests(frame(spark, values), large=3 if seed == 2 else None).collect()}
    for i, (raw, mark) in enumerate(brute_removed(values, 100)):
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        runs = len(re.findall(b"\1+", bytes(mark)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()), i
    df = frame(spark, values).withColumn("extra", F.lit(1))
    out = substrings.remove(df)
    assert out.columns == df.columns and all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def test_repeats_in_very_long_texts(spark):
    """Passages at the bounds of the pieces in which a text of over 4 MiB is hashed."""
    r = random.Random(9)
    long = "".join(r.choices("0123456789abcdef", k=(4 << 20) + 60_000))
    cuts = [0, (4 << 20) - 120, (4 << 20) - 5, (4 << 20) + 30_000]
    values = [long, "x".join(long[c:c + 200] for c in cuts), long[-150:] + "y" + long[:99]]
    got = {r.doc_id: r for r in substrings.digests(frame(spark, values)).collect()}
    assert [got[i].n_removed for i in range(3)] == [0, 800, 150]
    assert got[1].kept_sha256 == hashlib.sha256(b"xxx").hexdigest()


# --- all: nulls, repeats, clashing names, long texts ---


def odd(spark):
    rows = [(None, "a b c d e f g h i"), (None, None), (1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (2, None), (3, ""), (4, "word " * 300_000), (5, "a b c d e f g h i")]
    return spark.createDataFrame([(i, t, "mine", "t", 7) for i, t in rows], "doc_id long, text string, score string, tokens string, row int")


def test_odd_rows(spark):
    df, none = odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(1, "c d e"), (1, "c d e"), (None, "a b")], "item_id long, text string")
    outs = {
        "near": minhash.near_duplicates(df), "licences": licenses.scan(df), "quality": quality.scored(df, none), "toxic": toxicity.scored(df, none), "lz": lz.edits(df), "bench": decontaminate.scan(df, b),
        "join": decontaminate.scan(df, b, max_broadcast_windows=0), "bpe": bpe.digests(df, VOCABULARY, public_tokenizers.PATTERN), "lm": ngrams.scored(df), "repeats": substrings.digests(df),
    }
    for name, out in outs.items():
        got = [tuple(r) for r in out.collect()]
        assert len(got) == 8 and sorted(str(r[0]) for r in got) == ["1", "1", "2", "3", "4", "5", "None", "None"], name
        twice = [r for r in got if r[0] == 1]
        assert name == "lz" or twice[0] == twice[1], name
    near = {r.doc_id: r for r in outs["near"].collect() if r.doc_id}
    assert [near[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 1] and near[4].n_shingles == 1
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None", "None"]
    for out in (decontaminate.clean(df, b), substrings.remove(df), toxicity.reject(df, toxicity.fit(df, none, fold(4) != 2), 0.9)):
        assert out.columns == df.columns and out.count() == 8


def test_ids_with_several_texts_keep_them(spark):
    a, b = "one two three four five six seven", "quite other words stand in this one here"
    df = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.keep_one(df).collect()) == [(1, a), (2, a), (2, b)]


# --- 3, 4, 8 by brute force ---


def test_quality_statistic(spark):
    """The score is the isotonic step of the two compressed sizes' difference."""
    import zstandard

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, fold(5) != 0)
    sizes = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in model.dictionaries]
    some = docs.limit(50).collect()
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in some:
        raw = (r.text or "").encode()
        x = (len(sizes[0].compress(raw)) - len(sizes[1].compress(raw))) / len(raw) if raw else 0.0
        at = np.interp(x, model.calibrate.x, model.calibrate.p)
        assert abs(got[r.doc_id] - min(1, max(0, at))) < 1e-12


def test_toxicity_counts_and_features(spark):
    from rowloom.llm import _text as X

    texts_ = ["You vile fool! you FOOL", "a kind word", "vile, vile f00l", "fool you", "plain text here", ""]
    y = [1, 0, 1, 1, 0, 0]
    rows = spark.createDataFrame([(i % 8, label, t) for i, (t, label) in enumerate(zip(texts_, y))], "cell int, y int, text string").repartition(3)
    counts = toxicity.count(rows, least=2)
    words = {w: int(X.split(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), X.PLAIN).hashes()[0]) for w in ("vile", "fool", "you", "kind")}
    whole = dict(zip(counts.key[counts.which == 0].tolist(), counts.n[counts.which == 0].sum(1).tolist()))
    assert {w: whole.get(h) for w, h in words.items()} == {"vile": [0, 2], "fool": [0, 2], "you": [0, 2], "kind": None}
    assert counts.texts.sum(0).tolist() == [3, 3]
    lexicon = toxicity.Lexicon({words["vile"]: 2.0, words["fool"]: 3.0}, {})
    x = toxicity.features(pa.array(texts_), lexicon)
    assert x[:, 0].tolist() == [3, 0, 2, 1, 0, 0] and x[0, 1] == 3 / 5 and x[0, 6] == 3.0  # words of the lexicon, their density, the heaviest
    assert x[2, 7] == 1 / 3 and x[0, 8] == 3 and x[2, 8] == 0 and x[3, 8] == 1  # obfuscated, near a second person
    assert abs(x[0, 12] - 5 / 18) < 1e-12 and abs(x[0, 13] - 1 / len(texts_[0])) < 1e-12


# --- empty tables, and the pipeline ---


def test_empty_tables(spark):
    df = frame(spark, []).limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([], "item_id long, text string")
    outs = [minhash.near_duplicates(df), minhash.keep_one(df), licenses.scan(df), quality.scored(df, none), toxicity.scored(df, none), lz.edits(df), decontaminate.scan(df, b), decontaminate.clean(df, b),
            bpe.digests(df, VOCABULARY, public_tokenizers.PATTERN), ngrams.scored(df), substrings.digests(df), substrings.remove(df)]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= set(out.columns)
        out = corpus_pipeline.keep(out, "test")
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "near-duplicates":
            texts_ = {r.doc_id: r.text for r in docs.collect()}
            ids = sorted(texts_)
            want = {ids[i] for i, _, _, k in brute_components([texts_[x] for x in ids], 5, 80) if k}
            assert after == want
        if name in ("long repeats", "tokens"):
            assert after == before
        docs = out
    assert docs.where("not exact").count() == 0


def test_pipeline_on_odd_rows_and_empty_tables(spark, sf):
    rows = [(None, "a b c d e f g h i"), (None, None), (1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (2, None), (3, ""), (5, "a b c d e f g h i"), (6, "other words that stand alone here")]
    for values, want in ((rows, ["1", "2", "3", "6", "None", "None"]), ([], [])):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in values], SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.keep(stage(spark, docs, sf), "odd")
        assert sorted(str(r.doc_id) for r in docs.collect()) == want


def test_arrow_views():
    from rowloom.llm import _text as X

    column = pa.array(["A b", None, "", "é c"])
    (row, end, data, off), = X.chunks(column)
    w = X.split(data, off, X.SPACED)
    assert (row, end, np.diff(w.at).tolist()) == (0, 4, [2, 0, 0, 2])
