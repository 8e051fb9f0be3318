"""Per-row operators: brute force, learned accuracy, odd rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benchtide.llm import decontaminate, langid, ngrams, quality, repetition, secrets
from benchtide.llm.common import code_points, held_out
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


# ------------------------------------------------------------ quality rules

def plain_rules(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b é", max_size=200))
def test_rules_against_brute_force(text):
    m = repetition.measure(text)
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"],
            m["base_failed"]) == plain_rules(text)
    assert not (m["kept"] and m["base_failed"])


def test_equal_hashes_of_different_windows_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 4])
    every, later = repetition.repeated_windows(ids, np.zeros(5, np.uint64), 2)
    assert every.tolist() == [0, 3] and later.tolist() == [3]


def test_rules_on_odd_rows(docs):
    got = repetition.repetition_report(docs(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].kept
    assert by[4].base_failed and by[4].n_repeat_words == 40000
    assert repetition.repetition_report(docs([])).count() == 0
    clash = docs([(7, "one two three four five six seven eight nine ten")]).withColumn("kept", F.lit("x"))
    assert repetition.keep_unrepetitive(clash).columns == clash.columns
    assert repetition.keep_unrepetitive(clash).count() == 1


# ---------------------------------------------------------------- languages

def test_language_model_learns_and_ignores_the_held_out(spark, docs):
    rnd = random.Random(1)
    syllables = {"aa": ["tha", "wen", "olk"], "bb": ["çi", "ño", "rré"]}
    rows = [(i, " ".join("".join(rnd.choices(syllables[k], k=3)) for _ in range(20)), k)
            for i, k in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df.where(~held_out(F.col("doc_id"))))
    got = langid.predict(df, model).where(held_out(F.col("doc_id"))).collect()
    assert got and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.predict(docs(ODD + [(9, "12 34 !!")]), model).collect()}
    assert {odd[k].lang_pred for k in (1, 2, 3, 9)} == {"und"} and odd[4].lang_pred in ("aa", "bb")
    clash = langid.predict(df.withColumn("_id_result", F.lit("own")), model)
    assert {r["_id_result"] for r in clash.collect()} == {"own"} and "lang_pred" in clash.columns
    none = langid.train(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(docs([]), model).count() == 0


def test_language_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["x", "y"], rng.normal(size=(1 << langid.BITS, 2)), np.zeros(2))
    texts = ["abc def", "", "q", "some longer text here", "é"]
    together = model.score(texts)
    for i, t in enumerate(texts):
        one = model.score([t])
        assert one[0][0] == together[0][i] and one[1][0] == pytest.approx(together[1][i])


def test_held_out_is_the_contracts_fold(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# ------------------------------------------------------------------ quality

def test_word_hashes_split_at_white_space():
    starts, hashes = ngrams.word_hashes(code_points("  ab c\tab\n"))
    assert starts.tolist() == [2, 5, 7] and hashes[0] == hashes[2] != hashes[1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t", max_size=60), st.integers(1, 12))
def test_pieces_of_a_text_count_what_the_whole_does(text, block):
    before, ngrams.BLOCK_CHARS = ngrams.BLOCK_CHARS, block
    try:
        words = [int(h) for part in ngrams.text_word_hashes(text) for h in part]
        chars = sorted(int(b) for part in ngrams.text_char_ngrams(text, (1, 3, 5), 15) for b in part)
    finally:
        ngrams.BLOCK_CHARS = before
    assert words == [int(h) for h in ngrams.word_hashes(code_points(text))[1]]
    assert chars == sorted(int(b) for _, part in ngrams.char_ngrams(code_points(text), (1, 3, 5), 15) for b in part)


def test_quality_learns_held_out_accuracy(spark, docs):
    rnd = random.Random(2)
    def text(good):
        return " ".join(rnd.choice(["fine", "words", "flow", "here"] if good else ["$$x", "B!!", "##k", "Z%%"])
                        for _ in range(30))
    rows = [(i, text(i % 3 > 0)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    model = quality.train(docs(rows), labels.where(~held_out(F.col("doc_id"))))
    got = quality.predict(docs(rows), model).where(held_out(F.col("doc_id"))).collect()
    assert got and all(r.predicted == int(r.doc_id % 3 > 0) for r in got)
    odd = quality.predict(docs(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.predict(docs([]), model).count() == 0
    bare = quality.train(docs(rows), labels.where("false"))
    assert {r.score for r in quality.predict(docs(rows[:3]), bare).collect()} == {0.5}


def test_quality_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS), 0.1)
    texts = ["some words", "", "x", "  blank ends ", "more\nlines here"]
    together = model.score(texts)
    assert together == pytest.approx([model.score([t])[0] for t in texts])


# ------------------------------------------------------------------ secrets

def plain_secret_spans(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Token", " = ", "api_key", "'", ":", "AKIA", "ABCDEFGHIJKLMNOP", "abc123", "0123456789abcdef",
                                 "é", "\n", "secret", "=", "x"]), max_size=12).map("".join))
def test_secret_rules_against_brute_force(text):
    assert secrets.rule_spans(text) == plain_secret_spans(text)


def test_secret_scan_trains_and_keeps_the_rules(spark, docs):
    rnd = random.Random(5)
    def key(n):
        return "".join(rnd.choices("0123456789abcdef", k=n))
    def word(n):
        return "".join(rnd.choices("abcdefghij", k=n))
    rows = [(i, f'{word(5)} token = "{key(40)}" {word(6)} {word(20)}X {word(17)}Y8 tail') for i in range(120)]
    df = docs(rows)
    scanner = secrets.train(df)
    assert scanner is not None and scanner.threshold >= secrets.LEAST
    got = {r.doc_id: r for r in secrets.scan(df, scanner).collect()}
    for i, t in rows:
        base = secrets.listed(plain_secret_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[i].spans.split(","))
    # an unlabelled key (upper-case hex fits no rule) scores above plain words
    shown = f"key {key(40).upper()} end"
    (a, b), = secrets.candidates(shown)
    plain = f"word {word(30)}Q9 end"
    (c, d), = secrets.candidates(plain)
    assert scanner.scores(secrets.windows(shown, a, b))[0] > scanner.scores(secrets.windows(plain, c, d))[0]
    odd = secrets.scan(docs(ODD), scanner).collect()
    assert len(odd) == len(ODD) and all(r.spans == "" for r in odd)
    assert secrets.scan(docs([]), None).count() == 0 and secrets.train(docs([])) is None


def test_secret_training_takes_every_finding(spark, docs, monkeypatch):
    """1,650 distinct findings a class, some of many windows: more than one
    part's worth, none left out."""
    rnd = random.Random(6)
    def draw(letters, n):
        return "".join(rnd.choices(letters, k=n))
    long = draw("0123456789abcdef", 24 + 40 * 30)
    rows = [(i, "\n".join(f"{draw('klmnop', 5)} {draw('0123456789abcdef', 32)} {draw('klmnop', 6)} {draw('ghijklm', 20)}X1"
                          for _ in range(11))) for i in range(150)] + [(200, long), (201, long), (202, None)]
    df = docs(rows)
    got = secrets.labelled_findings(df).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.at):
        whole[r.finding] = whole.get(r.finding, "") + r.piece[r.start:r.end]
        assert (secrets.windows(r.piece, r.start, r.end).shape == (1, secrets.WINDOW)) and r.end - r.start <= secrets.VALUE
    plain = {w for _, t in rows if t for w in t.split() if len(w) >= 20}
    assert len(whole) == 3301 and set(whole.values()) == plain
    held = {r.finding for r in got if r.held_out}
    assert held.isdisjoint(r.finding for r in got if not r.held_out) and 600 < len(held) < 1050
    seen, learn = spark.sparkContext.accumulator(0), secrets.Learner.learn
    def counted(self, rows, labels, share):
        seen.add(len(rows))
        learn(self, rows, labels, share)
    monkeypatch.setattr(secrets.Learner, "learn", counted)
    monkeypatch.setattr(secrets, "PART_WINDOWS", 500)
    scanner = secrets.train(df)
    assert seen.value == secrets.EPOCHS * 2 * sum(not r.held_out for r in got)
    assert scanner.recall >= secrets.RECALL
    values = {k: [r for r in got if r.held_out and r.label == k] for k in (0, 1)}
    high = {k: [scanner.scores(secrets.windows(r.piece, r.start, r.end))[0] >= scanner.threshold for r in v]
            for k, v in values.items()}
    assert np.mean(high[1]) >= 0.97 and np.mean(high[0]) <= 0.03


def test_findings_calibrate_like_arrays(spark, docs):
    rnd = random.Random(8)
    rows = [(i, f"{''.join(rnd.choices('abcdef0123456789', k=30))} or {''.join(rnd.choices('ghij', k=20))}Z9") for i in range(200)]
    net = secrets.Network.fresh(np.random.default_rng(2))
    pieces = secrets.labelled_findings(docs(rows))
    got = secrets.calibrate_findings(net, pieces)
    plain = pieces.collect()
    labels = np.array([float(r.label) for r in plain])
    want = secrets.calibrate(net, np.concatenate([secrets.windows(r.piece, r.start, r.end) for r in plain]), labels)
    assert np.allclose([got.slope, got.shift, got.threshold, got.recall],
                       [want.slope, want.shift, want.threshold, want.recall], rtol=1e-3)


def test_network_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = secrets.Network.fresh(rng)
    rows = np.stack([secrets.windows("abc key=Zz91aaaaBBBBccccDDDD tail", 8, 28)[0],
                     secrets.windows("plain wordsarelonghereabc yes", 6, 25)[0]])
    y, w = np.array([1.0, 0.0]), np.ones(2)
    def loss():
        p = 1 / (1 + np.exp(-net.logits(rows)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    for param, grad in zip(net.params(), net.gradients(rows, y, w)):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        was, step = param[at], 1e-5
        param[at] = was + step
        up = loss()
        param[at] = was - step
        down = loss()
        param[at] = was
        assert grad[at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-7)


# --------------------------------------------------------- decontamination

def test_overlaps_survive_substitutions_and_spare_clean_texts(spark, docs):
    rnd = random.Random(3)
    def prose(n):
        return ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 7))) for _ in range(n)]
    items = [prose(40) for _ in range(20)] + [prose(9), prose(5)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, "")],
                                  "item_id bigint, text string")
    rows, expected = [], set()
    for d in range(60):
        words = prose(80)
        if d % 2:
            i = rnd.randrange(20)
            part = list(items[i][:rnd.choice([20, 40])])
            for k in range(4, len(part), 9):
                part[k] = "changed"
            words[30:30] = [w.upper() + "," for w in part]
            expected.add((d, i))
        rows.append((d, " ".join(words)))
    rows.append((100, "lead " + " ".join(items[20]) + " tail"))
    expected.add((100, 20))
    got = decontaminate.overlaps(docs(rows + ODD[:4]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    kept = decontaminate.drop_contaminated(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in expected}
    none = bench.where("false")
    assert decontaminate.overlaps(docs(rows), none).count() == 0
    assert decontaminate.drop_contaminated(docs(rows), none).count() == len(rows)
    assert decontaminate.overlaps(docs([]), bench).count() == 0


def test_items_in_blocks_give_the_same(spark, docs, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    bench = spark.createDataFrame([(i, " ".join(words[i * 20:i * 20 + 20])) for i in range(10)],
                                  "item_id bigint, text string")
    df = docs([(1, " ".join(words[15:75])), (2, "nothing of it " * 10)])
    whole = sorted(map(tuple, decontaminate.overlaps(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert len(list(decontaminate.item_blocks(bench, "item_id", "text"))) > 3
    assert sorted(map(tuple, decontaminate.overlaps(df, bench).collect())) == whole and len(whole) >= 3


def seed_hits(size, masks, changed):
    """Fewest windows that no change reaches, over all sets of changed words."""
    sets = np.array(list(combinations(range(size), changed)), np.int64).reshape(-1, changed)
    equal = np.ones((len(sets), size), bool)
    equal[np.arange(len(sets))[:, None], sets] = False
    return int(sum(np.lib.stride_tricks.sliding_window_view(equal, len(mask), axis=1)[
        :, :, [m == "1" for m in mask]].all(axis=2).sum(axis=1) for mask in masks).min())


def test_seeds_reach_every_overlap():
    for least, most, masks, hits in decontaminate.SEEDS:
        assert all("0" in mask for mask in masks)
        for size in range(least, (most or 2 * decontaminate.MIN_WORDS - 1) + 1):
            changed = size - int(np.ceil(decontaminate.MIN_SHARE * size))
            assert seed_hits(size, masks, changed) >= hits, (size, masks)


def test_overlaps_against_every_diagonal(spark, docs):
    """Brute force: all items against all texts on all diagonals."""
    rnd = random.Random(12)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(pool, k=rnd.choice([5, 8, 10, 12, 13, 18, 40])))) for i in range(30)]
    rows = []
    for d in range(60):
        words = rnd.choices(pool, k=rnd.randrange(60))
        for _ in range(rnd.randrange(3)):
            part = rnd.choice(items)[1].split()
            part = [w if rnd.random() > rnd.choice([0, .1, .25, .3]) else "changed" for w in part]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((d, " ".join(words)))
    rows += rows[:3]
    want = []
    for d, text in rows:
        words = text.split()
        for i, item in items:
            own = item.split()
            best = None
            for diagonal in range(-len(own), len(words) + 1) if len(own) >= decontaminate.SHORTEST else ():
                lo, hi = max(0, -diagonal), min(len(own), len(words) - diagonal)
                match = np.array([own[k] == words[k + diagonal] for k in range(lo, hi)], bool)
                segment = decontaminate.overlap_segment(match, min(decontaminate.MIN_WORDS, len(own)))
                if segment:
                    same = int(match[slice(*segment)].sum())
                    if best is None or same > best[4]:
                        best = (d, i, lo + diagonal + segment[0], segment[1] - segment[0], same, len(own))
            want += [best] if best else []
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id bigint, text string")
    df = docs(rows + [(None, None), (200, "")]).withColumn("o", F.lit("x")).withColumn("item_id", F.lit(1))
    got = decontaminate.overlaps(df, bench).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 200").collect()) == sorted(
        d for d, _ in rows if d not in {w[0] for w in want})


def test_every_fourth_word_changed_is_found():
    item = [f"w{i}" for i in range(40)]
    text = [w if i % 4 != 3 else "other" for i, w in enumerate(item)]
    side = decontaminate.TestSide([(1, " ".join(item)), (2, "a1 a2 a3 a4 a5 a6 a7 a8")])
    assert (0, 2) in map(tuple, side.hits(np.array([0, 0] + [side.words.get(w, 0) for w in text])).tolist())
    assert [o["item_id"] for o in side.overlaps("x a1 a2 c a4 a5 a6 a7 a8 y")] == [2]


def test_any_qualifying_segment_counts():
    runs = [True] * 13 + [False] * 8 + [True] * 13 + [False] * 8 + [True] * 13
    near_end = [True] + [False] + [True] * 11 + [False] + [True]
    assert decontaminate.overlap_segment(np.array(runs), 13) == (0, 34)
    assert decontaminate.overlap_segment(np.array(near_end), 13) == (0, 15)
    rnd = random.Random(5)
    for _ in range(3000):
        match = np.array([rnd.random() < rnd.choice([0.7, 0.8]) for _ in range(rnd.randint(0, 45))], bool)
        least = rnd.choice([8, 13])
        every = [(a, b) for a in range(len(match)) for b in range(a + least, len(match) + 1)
                 if 4 * match[a:b].sum() >= 3 * (b - a)]
        got = decontaminate.overlap_segment(match, least)
        assert got in every if every else got is None


def test_secret_threshold_reports_its_recall():
    rng = np.random.default_rng(4)

    class Weak:
        def logits(self, rows):
            return rows[:, 0]

    labels = (np.arange(2000) % 4 == 0).astype(float)
    rows = (rng.normal(0, 1, 2000) + 0.5 * labels)[:, None]
    scanner = secrets.calibrate(Weak(), rows, labels)
    kept = (scanner.scores(rows[labels == 1]) >= scanner.threshold).mean()
    assert scanner.recall == kept < secrets.RECALL and scanner.threshold == secrets.LEAST
