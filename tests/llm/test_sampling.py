"""Vector codes, importance resampling and source mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchtide.llm import mixing, resampling, vectorcodes
from benchtide.llm.prefix import running_sums
from tests.llm.conftest import ODD

# ----------------------------------------------------------------- prefix sums


def test_running_sums_against_a_loop(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < .6 else rnd.choice(["a", "b", None]), rnd.randrange(10 ** 9), rnd.randrange(9))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(7)
    got = running_sums(df, ["k"], [F.col("o")], {"s": F.col("v"), "n": F.lit(1)}).collect()
    seen, want = defaultdict(lambda: [0, 0]), {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want[k, o] = tuple(seen[k])
        seen[k][0] += v
        seen[k][1] += 1
    assert {(r.k, r.o): (r.s, r.n) for r in got} == want and len(got) == 3000


# ----------------------------------------------------------------- vector codes

def nearest(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(-1)
    at = d.argmin(axis=1)          # the first of the nearest
    return at, d[np.arange(len(x)), at]


@pytest.mark.parametrize("kind", ["spread", "few values", "all equal", "clusters"])
def test_tree_finds_the_first_nearest_entry(kind):
    rnd = np.random.default_rng(5)
    if kind == "spread":
        book, x = rnd.integers(-900, 900, (256, 6)), rnd.integers(-900, 900, (700, 6))
    elif kind == "few values":       # many equal entries and equal distances
        book, x = rnd.integers(0, 3, (256, 3)), rnd.integers(0, 3, (700, 3))
    elif kind == "all equal":
        book, x = np.full((256, 4), 7), rnd.integers(0, 9, (50, 4))
    else:
        centres = rnd.integers(-10 ** 6, 10 ** 6, (12, 4))
        book = centres[rnd.integers(0, 12, 256)] + rnd.integers(-9, 9, (256, 4))
        x = centres[rnd.integers(0, 12, 700)] + rnd.integers(-9, 9, (700, 4))
    found = vectorcodes.Search(book, vectorcodes.build(book), x)
    at, d = nearest(x, book)
    assert (found.entry == at).all() and (found.best == d).all()
    if kind == "clusters":           # whole subtrees are left out
        assert found.compared < 0.6 * book.shape[0] * len(x)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) by comparing all parts with all entries."""
    kept = [(i, np.floor(np.array(v, float) * 1024).astype(int), lab) for i, v, lab in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v, _ in kept])
    width = x.shape[1] // parts
    books = [x[:entries, p * width:(p + 1) * width] for p in range(parts)]
    for rnd in range(rounds + 1):
        found = [nearest(x[:, p * width:(p + 1) * width], books[p]) for p in range(parts)]
        if rnd == rounds:
            break
        for p in range(parts):
            new = books[p].copy()
            for e in range(len(new)):
                own = x[found[p][0] == e][:, p * width:(p + 1) * width]
                if len(own):
                    new[e] = own.sum(axis=0) // len(own)
            books[p] = new
    error = sum(f[1] for f in found)
    totals = Counter()
    for (_, _, lab), e in zip(kept, error):
        totals[lab] += int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()
    return sorted(((i, "".join(f"{found[p][0][n]:02x}" for p in range(parts)), int(error[n]), totals[lab], digest)
                   for n, (i, _, lab) in enumerate(kept)), key=repr)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_codes_against_brute_force_with_odd_rows(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-.5, 0., .25, .2501]) * rnd.choice([1, 1, 2]) for _ in range(8)], rnd.choice([0, 1, None]))
            for i in range(600)]
    rows += [(7, rows[7][1], 0), (None, [.1] * 8, 1), (None, [.3] * 8, 1), (900, None, 1), (901, [None] + [.1] * 7, 0),
             (902, [float("nan")] + [.1] * 7, 0), (903, [.1] * 7 + [float("-inf")], 0)]
    got = vectorcodes.code_report(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)


def test_few_rows_empty_tables_and_unequal_lengths(spark):
    few = [(i, [float(i)] * 4, None) for i in range(3)]
    got = vectorcodes.code_report(spark.createDataFrame(few, VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(few)
    assert vectorcodes.code_report(spark.createDataFrame([], VECTORS)).count() == 0
    assert vectorcodes.code_report(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    for bad in ([(1, [1.] * 4, 0), (2, [1.] * 8, 0)], [(1, [1.] * 6, 0)], [(1, [], 0)], [(1, [1e30] * 4, 0)]):
        with pytest.raises(ValueError):
            vectorcodes.code_report(spark.createDataFrame(bad, VECTORS))


def test_encode_keeps_columns_of_any_name_and_decodes(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rnd.normal(size=8)], i % 3, "r", "e", f"x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS + ", row string, error string, `a.b` string")
    model = vectorcodes.train(vectorcodes.usable(df))
    got = vectorcodes.encode(df, model).orderBy("vec_id").collect()
    assert [r["a.b"] for r in got] == [f"x{i}" for i in range(300)] and {r["row"] for r in got} == {"r"}
    back = model.decode(np.array([r.codes for r in got]))
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 1024)
    assert ((x - back) ** 2).sum(axis=1).astype(int).tolist() == [r.error for r in got]


# ----------------------------------------------------------------- resampling

RESAMPLE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = RESAMPLE_WORD.findall(low)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            count.update(map(bucket, features(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
            for b in range(10000)}
    rows = []
    for i, x in docs:
        words, feats = features(x)
        weight = sum(gain[bucket(f)] for f in feats)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))
        rows.append([i, len(feats), weight, weight + noise, None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(rnd, n):
    pool = [f"{w}{i}" for i, w in enumerate(["Alpha", "béta", "gamma", "漢字", "x-y", "don't", "42"] * 30)]
    return [(i, rnd.choice([" ", ", ", "\n", "\x00", "\x7f"]).join(rnd.choices(pool, k=rnd.randrange(60)))) for i in range(n)]


def test_resampling_against_brute_force_with_odd_rows(spark, docs):
    rnd = random.Random(11)
    rows = corpus(rnd, 400) + ODD
    target = [t for _, t in corpus(rnd, 20)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resampling.resample_report(docs(rows).repartition(6), bench).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(rows, target)


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resample_report(docs([]), none).count() == 0
    rows = [(i, "one two three " * 9) for i in range(40)]
    got = resampling.resample_report(docs(rows), none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(rows, [])
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_resample_keeps_columns_of_any_name(spark):
    rows = [(i, "word " * 30 + str(i), "a", "b", "c") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string, `_score` string, rank string")
    got = resampling.resample(df, df.limit(0)).collect()
    assert {(r.doc_id, r.text, r.row, r["_score"]) for r in got} == {r[:4] for r in rows}
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_features_do_not_depend_on_the_chunks(monkeypatch, size):
    monkeypatch.setattr(resampling, "CHUNK_WORDS", size)
    texts = [t for _, t in corpus(random.Random(2), 30)] + ["", "a", "a b", "z" * 5000 + " q " + "é" * 3000]
    got = defaultdict(Counter)
    for doc, buckets, _ in resampling.batch_features([t.encode() for t in texts]):
        for d, b in zip(doc.tolist(), buckets.tolist()):
            got[d][b] += 1
    for d, t in enumerate(texts):
        assert got[d] == Counter(map(bucket, features(t)[1]))


def test_crc_of_joined_strings():
    rnd = random.Random(6)
    a, b = [[rnd.randbytes(rnd.choice([0, 1, 3, 300, 70000])) for _ in range(40)] for _ in "ab"]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = resampling.join_crc(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


# ----------------------------------------------------------------- mixing

def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] > epochs * sizes[s] * free}
        if not over:
            return {s: float(epochs * sizes[s]) if s in capped else left * w[s] / free for s in names}
        capped |= over


DOCS = "doc_id bigint, text string, source string"


def mixed_rows(rnd, n, sources):
    return [(i, " ".join(["w"] * rnd.randrange(12)), rnd.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a", "b", None], list("abcdefghijk") + [None] + ["é"] * 40,
                                     ["tiny"] + ["z"] * 80 + ["b"] * 3])
def test_mix_meets_the_targets(spark, sources):
    rnd = random.Random(len(sources))
    rows = mixed_rows(rnd, 900, sources) + [(5, "again and again", sources[0]), (None, None, sources[0]), (None, "no id", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(sizes)
    by_size = defaultdict(set)
    for s in sizes:
        by_size[sizes[s]].add(want[s])
    for r in got:
        assert any(r.target == pytest.approx(t, rel=1e-12) for t in by_size[r.source_size])
        assert 0 <= r.taken <= 3 * r["size"]
    full = mixing.mix(mixing.sized(df)).collect()
    taken = Counter()
    for r in full:
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: math.floor(t) for s, t in want.items()}
    if len(sources) == 3:      # reruns agree, however the rows lie
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_report(df.repartition(3)).collect()))


@pytest.mark.parametrize("scale", [100_000_000, 3_000_000_000])
def test_targets_of_more_words_than_an_int_holds(spark, scale):
    """The words still to share, times a weight, pass 2^31 (the first case) or do so alone."""
    sizes = {"a": 7 * scale + 1, "b": scale, "c": 3 * scale, None: 2 * scale, "tiny": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes), rel=1e-12)


def test_mixed_texts_hold_the_taken_words(spark):
    rows = mixed_rows(random.Random(4), 300, ["a", "b", "c", "c", "c"]) + [(999, "  lead\tand  trail \n" * 50, "a")]
    mixed = mixing.mix(mixing.sized(spark.createDataFrame(rows, DOCS)))
    texts = mixing.mixed_texts(mixed).collect()
    words = Counter()
    for r in texts:
        assert len(r.text.split()) == r.words
        words[r.doc_id] += r.words
    assert words == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})
    whole = {i: t for i, t, _ in rows}
    assert all(whole[r.doc_id].startswith(r.text) for r in texts)
    assert len({(r.doc_id, r.epoch) for r in texts}) == len(texts)


def test_mix_of_odd_rows_empty_tables_and_clashing_names(spark, docs):
    got = mixing.mix_report(docs(ODD)).collect()
    assert sorted(r["size"] for r in got) == sorted(
        len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t in ODD)
    assert sum(r.taken for r in got) == sum(r["size"] for r in got)     # one source: all of it, once
    assert mixing.mix_report(docs([])).count() == 0
    blank = mixing.mix_report(docs([(1, None), (2, " ")])).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in blank] == [(0, 0, 0.0, 0)] * 2
    rows = [(i, "a b c", "s", "r", "k", "c") for i in range(9)]
    df = spark.createDataFrame(rows, DOCS + ", row string, `_key` string, `_chunk` string")
    out = mixing.mix(mixing.sized(df)).collect()
    assert {(r.row, r["_key"], r["_chunk"], r.taken) for r in out} == {("r", "k", "c", 3)}
