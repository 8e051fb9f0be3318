"""Mixing sources to target weights (operator 13).

Every document gets a hash-random key.  Documents are range-sorted by (source,
key), distributed prefix sums of their sizes give each one its place in its
source, and each source is cut at its exact budget: whole epochs of the source
first, then the documents in key order up to the word where the budget ends.

Targets share the words of all documents by the sources' weights, which repeat
over the sources in code point order; no target passes ``MAX_EPOCHS`` times its
source's size, and what it would have had beyond that goes to the others by
weight.  With r = cap / weight, the capped sources are those whose r is below
the level that remains for the others, and that level only rises along
ascending r, so one pass over the sources sorted by r finds them all.  Both
orders over sources are distributed sorts as well.

Defined cases: a null text has size 0; null sources are one source, last in
order; sources of size 0 have target 0; documents with equal keys (repeated or
null ids) are ordered by size, then by a hash of their columns; equal rows take
what their places give; very long texts count whole; an empty table gives no
rows; other columns pass through, whatever their names (but for those that are
added, which replace them).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.llm.common import WORD, WORD_JAVA, stage, text_of
from benchtide.llm.prefix import attach, chunk_offsets, chunked, running_sums

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
ADDED = ("size", "source_size", "target", "taken")


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """A hash-random key: 64 bits of sha256 over the seed and the id."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(seed), doc_id.cast("string")), 256), 1, 16)


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of the text."""
    return docs.withColumn("size", F.regexp_count(text_of(text_col), F.lit(WORD_JAVA)).cast("bigint"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``, the words to take."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running_sums(sizes, [], by_name, {"_rank": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("_w"),
                            (F.col("source_size") * max_epochs).alias("_cap"))
    weighed = stage(weighed.withColumn("_ratio", F.col("_cap") / F.col("_w")), "mix-weights")
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
                        F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    levels = running_sums(weighed, [], [F.col("_ratio"), *by_name],
                          {"_caps": F.col("_cap"), "_ws": F.col("_w")}, "mix-levels")
    exact = lambda c: c.cast("decimal(19,0)")
    capped = (exact(F.col("_cap")) * exact(F.lit(whole["w"]) - F.col("_ws"))
              < exact(F.col("_w")) * exact(F.lit(whole["size"]) - F.col("_caps")))
    levels = stage(levels.withColumn("_capped", capped), "mix-capped")
    full = levels.where("_capped").agg(F.coalesce(F.sum("_cap"), F.lit(0)).alias("cap"),
                                       F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    # the rest as a long: a literal below 2^31 is an int, and times the weight it passes that
    share = ((F.col("_w") * F.lit(whole["size"] - full["cap"]).cast("bigint")).cast("double")
             / F.lit(float(whole["w"] - full["w"])))
    return levels.select("source", "source_size", F.when(
        F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` (see ``sized``) with ``size``, ``source_size``, ``target`` (the
    words that the mix wants of the source) and ``taken`` (the words that it
    takes of the document, repeats counted)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(
        F.struct(*kept).alias("row"), F.col(source_col).alias("source"), F.col(size_col).alias("size"),
        mix_key(F.col(id_col), seed).alias("_key"), F.xxhash64(*hashable).alias("_tie"))
    order = [F.col("_key"), F.col("size"), F.col("_tie")]
    rows = chunked(keyed, ["source"], order, "mix-rows")
    targets = stage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                                   weights, max_epochs), "mix-targets")
    # the (chunk, source) pairs carry the plan of their source to the rows
    goal = targets.select(F.col("source").alias("_goal"), "source_size", "target")
    before = {"_before": F.col("size")}
    places = chunk_offsets(rows, ["source"], before)
    places = places.join(goal, places["source"].eqNullSafe(goal["_goal"])).drop("_goal")
    placed = attach(rows, places, ["source"], order, before).withColumn("_budget", F.floor("target"))
    epochs = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    rest = F.col("_budget") - epochs * F.col("source_size") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("row.*", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


@F.arrow_udf(T.StringType())
def first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """The text up to the end of its n-th word."""
    out = []
    for text, n in zip(texts.to_pylist(), counts.to_pylist()):
        end = 0
        for _, word in zip(range(n), WORD.finditer(text or "")):
            end = word.end()
        out.append((text or "")[:end])
    return pa.array(out, pa.string())


def mixed_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from ``mix`` over rows that carry their texts: one row
    per document and epoch, with ``epoch`` (from 0) and ``words``.  The document
    where a budget ends keeps its first words."""
    last = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))
    counts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda e: F.least(
        F.col("size"), F.col("taken") - e * F.col("size")))
    rows = mixed.select("*", F.posexplode(F.filter(counts, lambda n: n > 0)).alias("epoch", "words"))
    text = F.when(F.col("words") < F.col("size"), first_words(text_of(text_col), F.when(
        F.col("words") < F.col("size"), F.col("words")).otherwise(F.lit(0)))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """One row per document: its size and what the mix takes of it.  Texts are
    not carried through the sort."""
    narrow = sized(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               F.col(text_col).alias("text"))).drop("text")
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken")


# the same in SQL: targets by one pass over the sources sorted by cap / weight,
# places by a window over the hash keys
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(sha256(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))), 1, 16) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s),
l AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (all_w - ws) < w * (all_size - caps) AS capped FROM l),
f AS (
  SELECT coalesce(sum(cap) FILTER (WHERE capped), 0) AS cap, coalesce(sum(w) FILTER (WHERE capped), 0) AS w FROM c),
t AS (
  SELECT c.source, c.source_size,
         CASE WHEN capped THEN CAST(c.cap AS DOUBLE)
              ELSE CAST(c.w * (all_size - f.cap) AS DOUBLE) / CAST(all_w - f.w AS DOUBLE) END AS target
  FROM c, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
