"""Target-distribution importance resampling (operator 12).

Documents are drawn by how much likelier their hashed n-grams are in a target
set than in the raw set, with Gumbel noise, so that the draw follows the target
distribution without repeats.

Features come from whole batches at once: the texts of a batch are joined with
a separator that is no word character, one regex pass finds all words, a binary
search of the texts' offsets tells each word's text, and n-grams whose first
and last word lie in different texts are masked before the counts.  The pass
is read in chunks of ``CHUNK_WORDS`` words that carry the last words of the one
before, so a very long text needs no more memory than a short one.  The crc32
of an n-gram is put together from those of its words: crc32(a + b) is crc32(a)
moved over the length of b, xor crc32(b), and the move is linear.

Partitions send one count per bucket; the driver holds the 10,000 gains.

Defined cases: null and empty texts and texts without words have no features,
weight 0 and are never drawn; repeated documents count as often as they stand,
and equal scores and ids are ranked by their number of features, then weight;
a null id is hashed as the empty string and ranked last among equal scores; an
empty raw or target set has counts of 0; other columns pass through
``resample``, whatever their names (but for those that it adds).
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.llm.common import stage
from benchtide.llm.prefix import running_sums

BUCKETS = 10_000
SIZES = (1, 2, 3)
LEAST_WORDS = 20
SHARE_PERCENT = 5
SEED = "42"
CHUNK_WORDS = 1 << 18
ADDED = ("n_features", "n_words", "weight", "score", "rank")

# letters and digits of ASCII (lower-cased before) and every byte of the others
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SEPARATOR = b"\n"


# ----------------------------------------------------------------- crc32 of n-grams

def _byte_steps() -> np.ndarray:
    """The crc32 table: what a byte leaves after eight steps."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x.astype(np.uint32)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given per byte of the argument."""
    return (table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24])


def _moves() -> list[np.ndarray]:
    """Tables that move a crc over 1, 2, 4, ... 2^30 zero bytes."""
    steps = _byte_steps()
    unit = np.arange(256, dtype=np.uint32)
    table = np.stack([unit << np.uint32(8 * k) for k in range(4)])
    table = (table >> np.uint32(8)) ^ steps[table & 255]
    out = []
    for _ in range(31):
        out.append(table)
        table = _apply(table, table)
    return out


MOVES = _moves()


def join_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32(a + b) from the crcs of a and b and the length of b in bytes."""
    out = first.copy()
    for bit in range(int(length.max(initial=0)).bit_length()):
        some = (length >> bit) & 1 == 1
        out[some] = _apply(MOVES[bit], out[some])
    return out ^ second


# ----------------------------------------------------------------- features of a batch

def batch_features(texts: list[bytes]):
    """(text number, bucket) arrays of all features, chunk by chunk, and the
    text number of every word."""
    joined = _SEPARATOR.join(texts).lower()
    starts = np.cumsum([0] + [len(t) + len(_SEPARATOR) for t in texts])
    words = _WORD.finditer(joined)
    doc = np.empty(0, np.int64)
    crc = spaced = np.empty(0, np.uint32)
    length = np.empty(0, np.int64)
    carry = max(SIZES) - 1
    while True:
        found = list(islice(words, CHUNK_WORDS))
        if not found:
            return
        old = len(doc)
        at = np.fromiter((m.start() for m in found), np.int64, len(found))
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(m[0], len(seen)) for m in found), np.int64, len(found))
        plain = np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen))
        after_space = np.fromiter((zlib.crc32(w, _SPACE) for w in seen), np.uint32, len(seen))
        sizes = np.fromiter(map(len, seen), np.int64, len(seen))
        own = np.searchsorted(starts, at, side="right") - 1
        doc = np.concatenate([doc, own])
        crc = np.concatenate([crc, plain[ids]])
        spaced = np.concatenate([spaced, after_space[ids]])
        length = np.concatenate([length, sizes[ids] + 1])
        docs, buckets = [], []
        run = crc
        for n in SIZES:
            if n > 1:       # run[i]: crc of the n words from i on
                if len(run) < 2:
                    break
                run = join_crc(run[:-1], spaced[n - 1:], length[n - 1:])
            first = max(0, old - n + 1)     # n-grams that end in a new word
            whole = doc[first:len(run)] == doc[first + n - 1:]
            docs.append(doc[first:len(run)][whole])
            buckets.append(run[first:][whole].astype(np.int64) % BUCKETS)
        yield np.concatenate(docs), np.concatenate(buckets), own
        doc, crc, spaced, length = doc[-carry:], crc[-carry:], spaced[-carry:], length[-carry:]


_SPACE = zlib.crc32(b" ")


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _count(batches):
    """Per partition: features in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buckets, _ in batch_features(_texts(batch.column(0))):
            total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})


def bucket_counts(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all ``rows`` in each bucket."""
    parts = rows.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(_count, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    got = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()     # at most BUCKETS rows
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the two sets' smoothed shares."""
    s, t = raw.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_features``, ``n_words`` and ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    fields = ["n_features", "n_words", "weight"]

    @F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in fields]))
    def features(texts: pa.Array) -> pa.Array:
        gain = shared.value
        n = len(texts)
        sums = {f: np.zeros(n, np.int64) for f in fields}
        for doc, buckets, own in batch_features(_texts(texts)):
            sums["n_features"] += np.bincount(doc, minlength=n)
            sums["n_words"] += np.bincount(own, minlength=n)
            # whole numbers below 2^53, so exact as doubles
            sums["weight"] += np.bincount(doc, weights=gain[buckets], minlength=n).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(sums[f]) for f in fields], fields)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    paired = docs.select(F.struct(*kept).alias("row"), features(F.col(text_col).cast("binary")).alias("got"))
    return paired.select("row.*", *[f"got.{f}" for f in fields])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = SHARE_PERCENT, seed: str = SEED,
             carry_text: bool = True) -> DataFrame:
    """``docs`` with ``n_features``, ``n_words``, ``weight``, ``score`` and
    ``rank``: 1, 2, 3, ... for the drawn documents, null for the others.  The
    scored rows are sorted as a whole; ``carry_text=False`` leaves the texts
    out of that sort and the result."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = weigh(docs, gains, text_col)
    if not carry_text:
        scored = scored.drop(text_col)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    wrapped = stage(scored.select(
        F.struct("*").alias("row"), (F.col("n_words") >= LEAST_WORDS).alias("_able"),
        F.col("score").alias("_score"), F.col(id_col).alias("_id"), F.col("n_features").alias("_n"),
        F.col("weight").alias("_w")), "resample-scores")
    order = [F.col("_able").desc(), F.col("_score").desc(), F.col("_id").asc_nulls_last(), F.col("_n"), F.col("_w")]
    ranked = running_sums(wrapped, [], order, {"_earlier": F.lit(1)}, "resample-order")
    drawn = percent * wrapped.where("_able").count() // 100
    rank = F.when(F.col("_able") & (F.col("_earlier") < drawn), F.col("_earlier") + 1)
    return ranked.select("row.*", rank.cast("bigint").alias("rank"))


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: its weight, score and rank in the draw."""
    return resample(docs.select("doc_id", "text"), target, carry_text=False).select(
        "doc_id", "n_features", "weight", "score", "rank")
