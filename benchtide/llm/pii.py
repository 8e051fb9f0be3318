"""Personal data removal with information-theoretic sanitisation (operator 7).

Fixed rules find e-mail addresses, IP addresses, payment cards and phone
numbers.  Each value found is a protected entity.  Words are counted over the
whole corpus, in whole texts, once a row and outside the spans of the rules:
with ``n(t)`` rows that hold word ``t``, of which ``n(e, t)`` hold entity ``e``
too, seeing ``t`` leaves ``-log2(n(e, t) / n(t))`` bits of doubt about ``e``
(that is the entity's information content less its pointwise mutual
information with ``t``).  Words leaving at most ``REMOVE_BITS`` are removed,
those leaving at most ``GENERALISE_BITS`` are generalised, both wherever they
stand, in texts without the entity too.  ``n(e, t)`` is lowered by
``DISCOUNT`` (absolute discounting), as a word may be rare by chance: seen in
one row it stays, always seen with the entity it is generalised from two rows
on and removed from three on.

Only DataFrame and SQL functions are used.  Spans of equal texts are equal, so
they are joined by two hashes of the text.

Defined cases: a null or empty text has no spans (and stays null or empty);
spans of different kinds may overlap, all are listed, and their union is
replaced once; repeated rows, null and repeated ids are treated row by row;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.llm.common import stage, text_of

# The rules (fixed values), written so that Java neither recurses nor tries a
# run twice: a match starts where its first run starts (or, for e-mail, where
# the match before ended), and quantifiers that nothing can follow don't back up.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
# 12 to 19 digits, the whole of a chain of digits
CARD = (r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+"
        r"(?![\x20-]?[0-9])")
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"

WORD = r"\p{L}{3,}+"
DISCOUNT = 0.75
REMOVE_BITS = 0.5
GENERALISE_BITS = 1.5
# parts that the rows of one word or entity are dealt to in a join
SALTS = 16

# the hits of texts are broadcast up to this size, 64 bytes a text and a word
BROADCAST_BYTES = 32 << 20

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Matches of a pattern with their places: what lies between the matches
    tells where they are.  ``keep`` chooses matches by their values."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(
        F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("value")))

    def place(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), x["value"].alias("value"))
        out = F.concat(acc["out"], F.array(span))
        if keep is not None:
            out = F.when(keep(x["value"]), out).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), place,
                         lambda acc: acc["out"])
    return placed


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[\x20-]", ""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substr(digits, i, F.lit(1)).cast("int") * 2
            - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the rules, by start, then kind as listed."""
    none = F.array().cast(_SPAN)

    def rule(guard: Column, pattern: str, rank: int, valid=None) -> Column:
        spans = located(text, pattern, KINDS[rank], rank)
        if valid is not None:
            spans = F.filter(spans, lambda s: valid(s["value"]))
        return F.when(guard, spans).otherwise(none)

    def phone_digits(value: Column) -> Column:
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)

    rules = [
        rule(F.contains(text, F.lit("@")), EMAIL, 0),
        rule(text.rlike(r"[0-9]\.[0-9]"), IP, 1, lambda v: v.rlike(IP_VALID)),
        rule(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), CARD, 2, _luhn),
        rule(F.contains(text, F.lit("+")), PHONE, 3, phone_digits)]
    return F.array_sort(F.concat(*rules))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _key(text: Column) -> dict[str, Column]:
    return {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit("second"), text)}


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(
        F.regexp_replace(span["value"], r"[^0-9.]", "")))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in the places of the spans."""
    def step(acc, s):
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), end - start))
        return F.struct(end.alias("at"), out.alias("out"))

    filled = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, filled).otherwise(text)


def _words(plain: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), F.lower))


def _dealt_join(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row of ``by`` for their key; the rows of a frequent
    key are dealt to ``SALTS`` parts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("_k1", "_k2"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(by.withColumn("_salt", salts), [key, "_salt"]).drop("_salt")


def _read(docs: DataFrame, text: Column) -> DataFrame:
    """_k1, _k2, base, words: of every text the spans of the rules and the
    different words outside them, found once and written."""
    rows = docs.select(text.alias("text"), base_spans(text).alias("base"), *[
        v.alias(k) for k, v in _key(text).items()])
    return stage(rows.select("_k1", "_k2", "base", _words(blanked(F.col("text"), F.col("base"))).alias("words")),
                 "pii-texts")


def disclosing_words(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(word, kind): words to remove (``term``) or generalise (``hint``)."""
    # pairs seen in one row are never flagged: entities and words of one row go
    values = found.select("_k1", "_k2", "copies", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    repeated = values.groupBy("entity").agg(F.sum("copies").alias("n_entity")).where("n_entity > 1")
    values = stage(_dealt_join(values, repeated, "entity").select("_k1", "_k2", "entity", "n_entity"), "pii-entities")
    most = values.groupBy("_k1", "_k2").agg(F.max("n_entity").alias("most"))
    words = stage(found.join(most, ["_k1", "_k2"]).select(
        "_k1", "_k2", "copies", "most", F.explode("words").alias("word")), "pii-near")
    # every word of the corpus is counted, summed in each partition first
    counts = (texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
              .where("n > 1").join(words.select("word").distinct(), "word", "left_semi"))

    def may(n_both: str) -> Column:
        return F.col("n") <= (F.col(n_both) - DISCOUNT) * 2 ** GENERALISE_BITS

    # n(e, t) is at most the entity's rows: words too frequent for them go first
    pairs = (_dealt_join(words, counts, "word").where(may("most")).join(values, ["_k1", "_k2"]).where(may("n_entity"))
             .groupBy("entity", "word").agg(F.sum("copies").alias("n_both"), F.max("n").alias("n")))
    doubt = -F.log2((F.col("n_both") - DISCOUNT) / F.col("n"))
    return (pairs.withColumn("doubt", doubt).where(F.col("doubt") <= GENERALISE_BITS)
            .groupBy("word").agg(F.max(F.when(F.col("doubt") <= REMOVE_BITS, "term").otherwise("hint")).alias("kind")))


def _disclosed(docs: DataFrame, text: Column, texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """_k1, _k2, more: the places of flagged words in every different text.
    Which texts hold which of them is a join; only those are read again."""
    held = _dealt_join(texts.select("_k1", "_k2", F.explode("words").alias("word")), flagged, "word")
    hits = stage(held.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("word", "kind")).alias("hits")), "pii-held")
    size = hits.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("words")).first()
    if (size["texts"] + size["words"]) * 64 <= BROADCAST_BYTES:
        hits = F.broadcast(hits)        # or else the texts are shuffled to it
    keyed = docs.select(text.alias("text"), *[v.alias(k) for k, v in _key(text).items()])
    rows = keyed.join(hits, ["_k1", "_k2"]).withColumn("base", base_spans(F.col("text")))
    plain, kinds = blanked(F.col("text"), F.col("base")), F.map_from_entries("hits")
    places = located(plain, WORD, "word", 0, lambda w: F.array_contains(F.col("hits.word"), F.lower(w)))

    def named(s: Column) -> Column:
        kind = F.try_element_at(kinds, F.lower(s["value"]))
        return F.struct(s["start"].alias("start"), F.when(kind == "term", len(KINDS)).otherwise(len(KINDS) + 1).alias("rank"),
                        s["end"].alias("end"), kind.alias("kind"), s["value"].alias("value"))

    return rows.select("_k1", "_k2", F.transform(places, named).alias("more")).dropDuplicates(["_k1", "_k2"])


def spans_by_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """_k1, _k2, base, spans: for every different text with personal data or
    words that disclose it, the spans of the rules, and all spans."""
    text = text_of(text_col)
    texts = _read(docs, text)
    found = texts.where(F.size("base") > 0)
    copies = found.groupBy("_k1", "_k2").agg(F.count("*").alias("copies"))
    found = stage(found.dropDuplicates(["_k1", "_k2"]).join(copies, ["_k1", "_k2"]), "pii-found")
    flagged = stage(disclosing_words(texts, found), "pii-words")
    extra = _disclosed(docs, text, texts, flagged)
    none = F.array().cast(_SPAN)
    base, more = F.coalesce(F.col("base"), none), F.coalesce(F.col("more").cast(_SPAN), none)
    return found.select("_k1", "_k2", "base").join(extra, ["_k1", "_k2"], "full").select(
        "_k1", "_k2", base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (empty lists without any)."""
    keyed = docs.withColumns(_key(text_of(text_col)))
    out = keyed.join(spans_by_text(docs, text_col), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    none = F.array().cast(_SPAN)
    return out.withColumns({"base": F.coalesce("base", none), "spans": F.coalesce("spans", none)})


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans."""
    got = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(F.col("spans")).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced: rules by the kind's name, hints by the
    class of the word (an acronym, a name, any other word), terms by nothing."""
    def step(acc, s):
        word = F.when(F.upper(s["value"]) == s["value"], "[ACRONYM]").when(
            s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        mark = F.when(s["kind"] == "term", "").when(s["kind"] == "hint", word).otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with sanitised texts (and ``length_col`` set to the new length
    of texts that changed), its columns in the same order."""
    taken = {c.lower() for c in docs.columns}
    if taken & {"base", "spans", "_k1", "_k2", "_clean"}:
        inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
        got = with_spans(inner, "_text")
        row = F.col("_row")
    else:
        got, row = with_spans(docs, text_col), None
    text = F.col(text_col) if row is None else row[text_col]
    clean = F.when(F.size("spans") > 0, sanitised(text, F.col("spans"))).otherwise(text)
    got = got.withColumn("_clean", clean)
    columns = []
    for c in docs.columns:
        old = F.col(c) if row is None else row[c]
        if c == text_col:
            old = F.col("_clean")
        elif c == length_col:
            old = F.when(F.size("spans") > 0, F.char_length("_clean").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return got.select(*columns)
