"""Corpus operators: brute force, round trips, odd rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from benchtide.llm import minhash, packing, pii, shards, suffixes, tokens
from benchtide.llm.components import components
from tests.llm.conftest import ODD

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def prose(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


# --------------------------------------------------------------- components

def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(1, 90)]
    parent = list(range(600))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in nodes}


# ----------------------------------------------------------- near duplicates

def shingle_sets(text):
    words = WORDS.findall((text or "").encode().lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets = [shingle_sets(t) for _, t in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0] if sets[i] else rows[i][0]) for i in range(len(rows))}


def near_rows(seed):
    rnd = random.Random(seed)
    rows, common = [], prose(rnd, 60)
    for i in range(30):
        rows.append(prose(rnd, rnd.randint(3, 150)) + (common if i % 3 == 0 else []))
    for copies, base in ((40, prose(rnd, 140)), (12, prose(rnd, 60)), (5, ["One", "two"])):
        for k in range(copies):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(10 ** 6)}"
            rows.append(text)
    rnd.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_groups_against_brute_force(docs, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows(block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == plain_groups(rows)


def test_bit_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 4000, np.uint64)
    for j in (0.3, 0.85):
        shared = int(2 * j * 2000 / (1 + j))
        x, y = a[:2000], np.concatenate([a[:shared], a[2000:4000 - shared]])
        bits = [np.frombuffer(minhash.packed_bits(minhash.minima(v)), np.uint64) for v in (x, y)]
        assert minhash.estimated_similarity(minhash.agreeing(*bits)) == pytest.approx(j, abs=0.12)


def test_near_duplicates_on_odd_rows(docs):
    got = minhash.near_duplicates(docs(ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.kept and r.component_id == r.doc_id
        assert (r.n_shingles == 0) == (r.doc_id in (1, 2, 3))
    assert minhash.near_duplicates(docs([])).count() == 0
    kept = minhash.drop_near_duplicates(docs(ODD + [(7, "REPEATED row"), (9, "a text without an id")]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 9]
    clash = docs([(1, "a b c")]).withColumns({"kept": F.lit(0), "_row": F.lit(1)})
    assert minhash.drop_near_duplicates(clash).columns == clash.columns


def test_the_stage_links_pairs_below_the_limit_of_op3(spark, docs):
    rnd = random.Random(16)
    base = prose(rnd, 300, 10 ** 6)
    copy, other = list(base), list(base)
    for k in range(6):
        copy[20 + 50 * k] = f"x{k}"
    for k in range(9):
        other[10 + 33 * k] = f"y{k}"
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(other)), (4, " ".join(prose(rnd, 50)))]
    sets = [shingle_sets(t) for _, t in rows]
    share = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.8 <= share[1] < 0.85 and share[2] < 0.8
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect()} == {1, 3, 4}
    assert all(r.kept for r in minhash.near_duplicates(docs(rows)).collect())
    # the blocks of a bucket, too
    rows = near_rows(7)
    sets = [shingle_sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), similarity=80).collect()}
    assert got == dict(enumerate(root))


# ------------------------------------------------------------------ suffixes

def plain_removal(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i:i + 100]
            if s in seen:
                gone[i:i + 100] = b"\x01" * 100
            seen.add(s)
        text = bytes(gone)
        out[d] = (len(raw), sum(gone), len(re.findall(b"\x01+", text)),
                  hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_removal_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    monkeypatch.setattr(suffixes, "FLUSH", 2000)
    suffixes._powers.cache_clear()
    rnd = random.Random(8)
    passages = [" ".join(prose(rnd, 40)) for _ in range(4)] + ["-" * 260, "ab" * 90, "é" * 120]
    rows = []
    for i in range(60):
        parts = [" ".join(prose(rnd, rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 40)
            parts += [p[a:a + rnd.randint(80, 300)], " ".join(prose(rnd, rnd.randint(0, 9)))]
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    rows += [(70 + k, rows[k][1]) for k in range(5)] + [(80, None), (81, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffixes.removal_report(docs(rows)).collect()}
    suffixes._powers.cache_clear()
    assert got == plain_removal(rows)


def test_removal_on_odd_rows(docs):
    got = suffixes.removal_report(docs(ODD + [(None, "z" * 150), (7, "z" * 150), (7, "z" * 150)])).collect()
    assert len(got) == len(ODD) + 3
    assert sorted((r.n_removed, r.n_spans) for r in got if r.n_bytes == 150) == [(149, 1), (150, 1), (150, 1)]
    # "word " repeats with a period of 5: all but the first period and a string
    assert {r.n_removed for r in got if r.doc_id == 4} == {200000 - 5}
    assert suffixes.removal_report(docs([])).count() == 0
    names = ["lo", "hi", "doc", "tie", "_doc", "_tie", "_raw", "_lo", "_hi", "c0", "whole", "a.b"]
    clash = docs([(1, "x"), (2, "z" * 150), (3, "z" * 150)]).withColumns({c: F.lit(c) for c in names})
    kept = suffixes.drop_repeats(clash)
    assert kept.columns == clash.columns + ["kept"]
    rows = sorted(kept.collect())
    assert [bytes(r.kept) for r in rows] == [b"x", b"z", b""]
    assert all(r[c] == c for r in rows for c in names)


# ------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    def digits(s):
        return [int(c) for c in s if c.isdigit()]
    def luhn(s):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits(s)[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text)
            if 12 <= len(digits(m.group())) <= 19 and luhn(m.group())]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_rules_against_brute_force(docs):
    rnd = random.Random(9)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c-d@e.f", "q+", ".", "1.2.3.4", "256.1.1.1", "01.002.3.255", "9.9.9.9.9.9",
             "4465758382889437", "4465 7583 8288 9437", "44657-58382-889437-", "0" * 13, "1" * 25, " ", "-", "é", "\n",
             "+1 (743) 555-3824", "+49 30", "+1234567890123456", "+1+2", "漢", "7", "_%", "a.b@c.de"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 9)))) for i in range(400)]
    rows += [(1000, "9" * 60000), (1001, "1 " * 30000), (1002, "a" * 50000 + "@"), (1003, "1." * 30000),
             (1004, "x@" + "y." * 20000 + "z")]
    got = {r.doc_id: r for r in pii.report(docs(rows)).collect()}
    for i, t in rows:
        base = plain_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (i, t[:80], base[:80], got[i].spans[:80])
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_disclosing_words_go_and_common_ones_stay(docs):
    rows = [(i, f"mail to Zebulon quixotic from number{i} town today a@b.org and then {w} more words")
            for i, w in enumerate(["alpha", "beta", "gamma"])]
    rows += [(10 + i, f"today the town was {w} and then more words of it") for i, w in enumerate("pqrstuvw")]
    got = {r.doc_id: r for r in pii.report(docs(rows)).collect()}
    text = rows[0][1]
    named = {text[int(a):int(b)]: k for k, a, b in (s.split(":") for s in got[0].spans.split(","))}
    assert named["a@b.org"] == "email" and named["Zebulon"] == named["quixotic"] == "term"
    assert "today" not in named and "town" not in named and "alpha" not in named
    assert got[10].spans == ""
    clean = {r.doc_id: r for r in pii.sanitise(docs(rows), length_col="n_chars").collect()}
    assert "[EMAIL]" in clean[0].text and "Zebulon" not in clean[0].text and "today" in clean[0].text
    assert clean[0].n_chars == len(clean[0].text) and clean[10].text == rows[3][1]


def spans_of(row, text):
    return {text[int(a):int(b)]: k for k, a, b in (s.split(":") for s in row.spans.split(",") if s)}


def test_fixed_signatures_and_copies_count(docs):
    sign = "with the kindest regards of Marmaduke Featherstonehaugh ok mm@b.org or ask the office on the second floor here"
    rows = [(i, f"row{i} {w} {sign}") for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    rows += [(10 + i, "write to Xanthippe at x@y.org") for i in range(3)] + [(20, "write to Balthazar at z@y.org")]
    rows += [(30 + i, "write to someone at noon") for i in range(8)]
    got = {r.doc_id: r for r in pii.report(docs(rows)).collect()}
    assert spans_of(got[0], rows[0][1])["Featherstonehaugh"] == "term"
    assert all(spans_of(got[10 + i], rows[4][1])["Xanthippe"] == "term" for i in range(3))
    assert spans_of(got[20], rows[7][1]) == {"z@y.org": "email"}


def test_disclosing_words_go_wherever_they_stand(docs):
    far = "and then the usual things of the day were told over and over again until late "
    rows = [(i, f"mm@b.org {far}Marmaduke {far}Marmaduke w{i}") for i in range(6)]
    rows += [(10, f"of no one: MARMADUKE {far}"), (11, far), (12, far)] + [(20 + i, far) for i in range(10)]
    got = {r.doc_id: r for r in pii.report(docs(rows)).collect()}
    assert got[0].spans.count("term:") == 2 and got[10].spans.startswith("term:11:20")
    assert got[11].spans == "" and spans_of(got[10], rows[6][1]).keys() == {"MARMADUKE"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    assert not any("marmaduke" in t.lower() for t in clean.values()) and clean[11] == far


def test_pii_on_odd_rows(docs):
    got = pii.report(docs(ODD)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got)
    same = pii.sanitise(docs(ODD)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in same) == sorted((i or -1, t or "") for i, t in ODD)
    assert pii.report(docs([])).count() == 0
    clash = docs([(1, "a@b.cd")]).withColumns({"base": F.lit(1), "spans": F.lit(2)})
    out = pii.sanitise(clash)
    assert out.columns == clash.columns and out.first().text == "[EMAIL]" and out.first().base == 1


# ------------------------------------------------------- tokens and packing

TEXTS = ["", " ", "plain Words, it's WE'RE 12 34!!", "x_y__ 1² \x0b\x1d×÷ßẞÀ q--!!", "é ç  y z\x1cq", "Σας ΟΔΟΣ x²½",
         "<|endoftext|> a", "ab cd e", "漢字 \U0001f600 ok", "don't   stop\tnow\r\n"]


def whole_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_path()).encode(text, add_special_tokens=False).ids


def test_tokens_equal_the_tokenizers():
    import pyarrow as pa
    tokenizer = tokens.WordTokenizer(tokens.default_path())
    for _ in range(2):  # the second time from the store
        for text, ids in zip(TEXTS, tokenizer.encode(pa.array(TEXTS, pa.string()))):
            assert ids.tolist() == whole_ids(text), text


def test_packing_is_gapless_and_near_the_bound(docs, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join(prose(rnd, rnd.randint(0, 120)))) for i in range(300)] + [(400, "long text " * 700)] + ODD
    pieces = packing.cut_documents(docs(rows), capacity=256)
    monkeypatch.setattr(packing, "BLOCK", 64)
    got = packing.pack(pieces, capacity=256).collect()
    expected = []
    for d, t in rows:
        ids = np.array(whole_ids(t or "") + [1], "<u4")
        expected += [(d, k, at, len(ids[at:at + 256]), zlib.crc32(ids[at:at + 256]))
                     for k, at in enumerate(range(0, len(ids), 256))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)) == sorted(map(key, expected))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * -(-sum(r.length for r in got) // 256)
    assert packing.pack(packing.cut_documents(docs([]))).count() == 0


def test_packing_keeps_columns_of_any_name(docs):
    names = ["uid", "uid_", "block", "bin", "size", "sequence_id", "offset"]
    pieces = docs([(i, "a b c") for i in range(5)]).withColumn("length", F.lit(4)).withColumns(
        {c: F.lit(c) for c in names})
    out = packing.pack(pieces)
    assert sorted(out.columns) == sorted(pieces.columns)
    assert all(r[c] == c for r in out.collect() for c in names[:5])
    assert sorted(r.offset for r in out.collect()) == [0, 4, 8, 12, 16]


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 200)
    a, b = packing.Bins(sizes, 100), packing.Bins(sizes, 100)
    a.best_fit(np.argsort(-sizes).tolist())
    b.best_fit(rng.permutation(200).tolist())
    child = packing.crossover(a, b, rng)
    assert sorted(p for own in child.items for p in own) == list(range(200))
    assert all(sizes[own].sum() + f == 100 and f >= 0 for own, f in zip(child.items, child.free))
    best = packing.evolve(sizes, 100, [a.assignment()], rng)
    assert len(best.items) <= len(a.items)


# -------------------------------------------------------------------- shards

@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = shards.feistel(np.arange(n), n, 42)
    assert sorted(out.tolist()) == list(range(n))
    if n >= 1000:
        assert (out != shards.feistel(np.arange(n), n, 43)).mean() > 0.9


def test_shards_round_trip(spark, docs, tmp_path, monkeypatch):
    rnd = random.Random(7)
    rows = [(i, " ".join(prose(rnd, rnd.randint(0, 300)))) for i in range(80)] + ODD
    path = str(tmp_path / "shards")
    shards.write_sequences(shards.sequences(docs(rows), 64), f"{path}-sequences")
    numbered, n = shards.number(spark, f"{path}-sequences")
    shards.write_shards(numbered, n, path, 64, per_shard=16, rounds=2)
    back = shards.read_shards(spark, path, 64).collect()
    assert sorted(r.slot for r in back) == list(range(n))
    assert all(r.slot == r.shard * 16 + r["at"] // shards.stride(64) for r in back)
    spans = {r.slot: r.docs for r in numbered.select("slot", "docs").collect()}
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(np.array(whole_ids(t or "") + [1], np.uint16).tobytes())
    got = defaultdict(dict)
    for r in back:
        at = 0
        for d in spans[r.slot]:
            got[d.doc_id].setdefault(d.start, []).append(bytes(r.ids[2 * at:2 * (at + d.length)]))
            at += d.length
        assert at == r.n_tokens
    for doc, own in texts.items():
        if len(own) == 1:
            assert b"".join(v[0] for _, v in sorted(got[doc].items())) == own[0]
    assert sum(r.n_tokens for r in back) == sum(len(b) // 2 for own in texts.values() for b in own)
    digests = {r.slot: r.ids_crc32 for r in shards.shard_digests(spark, path, 64).collect()}
    assert digests == {r.slot: zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4")) for r in back}
    assert shards.materialise(docs([])).count() == 0


def test_shards_go_on_after_a_lost_range(spark, docs, tmp_path, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, " ".join(prose(rnd, rnd.randint(0, 300)))) for i in range(60)] + ODD
    given = docs(rows).withColumn("slot", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("uid", F.lit(2))
    settings = {"length": 64, "per_shard": 16, "rounds": 3}
    want = {tuple(r) for r in shards.shard_digests(
        spark, _written(shards, given, str(tmp_path / "once"), settings), 64).select("slot", "n_tokens").collect()}
    path = str(tmp_path / "twice")
    write, calls = shards.write_range, []

    def dies(numbered, path, first, last, *rest):
        calls.append(first)
        write(numbered, path, first, last, *rest)
        if len(calls) == 2:
            # all of the range is written but its mark
            raise RuntimeError("lost")

    monkeypatch.setattr(shards, "write_range", dies)
    with pytest.raises(RuntimeError):
        shards.materialise(given, path, **settings)
    got = shards.materialise(docs([]), path, **settings).collect()
    assert calls[1] == calls[2] and len(calls) == 4
    assert {(r.slot, r.n_tokens) for r in got} == want and len(got) == len(want)
    shards.materialise(given, path, **settings)
    assert len(calls) == 4
    with pytest.raises(ValueError):
        shards.materialise(given, path, key=1, **settings)


def _written(shards, given, path, settings):
    shards.materialise(given, path, **settings)
    return path


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages_take_effect(spark, tmp_path):
    rnd = random.Random(11)
    item = " ".join(prose(rnd, 30, 10 ** 6))
    texts = [" ".join(prose(rnd, 80, 5000)) for _ in range(30)]
    texts[1] = texts[0]
    texts[2] = texts[0] + " tail"
    texts[5] += " " + item
    texts[6] = "short"
    texts[7] = "the same five words again " * 20
    texts[8] += " someone@example.org"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(30)) - {1, 2, 5, 6, 7}
    clean = texts[8].replace("someone@example.org", "[EMAIL]")
    ids = np.array(whole_ids(clean) + [1], "<u4")
    assert {(r.length, r.ids_crc32) for r in got if r.doc_id == 8} == {(len(ids), zlib.crc32(ids))}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, fn in corpus_pipeline.STAGES[:-1]:
        docs = fn(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
