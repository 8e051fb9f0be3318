"""Quality classifier (operator 2): supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams; a softmax layer over the average gives the classes.  Both layers are
trained by numpy stochastic gradient descent on a bounded sample of labelled
rows (``max_per_class`` each, weighted back to the class frequencies of all
labelled rows).  As the average is linear, the trained vectors are folded into
one weight per bucket for scoring, so scoring gathers one number per n-gram.

Defined cases: a null or empty text scores the bias alone; labels that are
null are skipped; with fewer than two classes in the labels every text gets
the share of label 1 as its score (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.llm.common import blocks, code_points, text_of
from benchtide.llm.ngrams import BLOCK_CHARS, char_ngrams, text_char_ngrams, text_word_hashes, word_hashes

SIZES = (3, 4, 5)
BITS = 15
DIM = 16
MAX_PER_CLASS = 1200
EPOCHS = 12
RATE = 0.5
THRESHOLD = 0.7


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of all words and character n-grams of a text."""
    total = np.zeros(1 << BITS, np.int64)
    for bucket in text_char_ngrams(text, SIZES, BITS):
        total += np.bincount(bucket, minlength=1 << BITS)
    for hashes in text_word_hashes(text):
        total += np.bincount(_word_buckets(hashes), minlength=1 << BITS)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass
class QualityModel:
    weights: np.ndarray  # per bucket: logit of label 1 against label 0
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for lo, hi in blocks(texts, BLOCK_CHARS):
            if hi - lo == 1:
                bucket, n = feature_counts(texts[lo])
                total[lo], count[lo] = n @ self.weights[bucket], n.sum()
                continue
            lengths = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
            ends = np.cumsum(lengths)
            cps = code_points("".join(texts[lo:hi]))
            for size, bucket in char_ngrams(cps, SIZES, BITS):
                n = np.maximum(0, lengths - size + 1)
                running = np.concatenate([[0.0], np.cumsum(self.weights[bucket])])
                first = np.minimum(ends - lengths, len(bucket))
                total[lo:hi] += running[np.minimum(first + n, len(bucket))] - running[first]
                count[lo:hi] += n
            # words: a blank between texts keeps their words apart
            starts, hashes = word_hashes(code_points("\n".join(texts[lo:hi])))
            owner = np.searchsorted(ends + np.arange(hi - lo), starts, side="right")
            total[lo:hi] += np.bincount(owner, self.weights[_word_buckets(hashes)], hi - lo)
            count[lo:hi] += np.bincount(owner, minlength=hi - lo)
        logit = total / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, sample_weight: np.ndarray,
        seed: int = 17) -> QualityModel:
    """Stochastic gradient descent, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    out = np.zeros((DIM, 2))
    bias = np.log(np.array([max(sample_weight[labels == k].sum(), 1e-9) for k in (0, 1)]))
    shares = [n / n.sum() if len(n) else n.astype(float) for _, n in bags]
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps) * sample_weight[i]
            done += 1
            bucket, share = bags[i][0], shares[i]
            hidden = share @ vectors[bucket]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            vectors[bucket] -= (rate * len(bucket) ** 0.5) * share[:, None] * back
    weight = vectors @ out
    return QualityModel(weight[:, 1] - weight[:, 0], float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS,
          label_col: str = "quality") -> QualityModel:
    """Fits on at most ``max_per_class`` labelled documents of each class, those
    of the smallest hashes of doc_id; ``docs`` and ``labels`` share doc_id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label_col).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = min(max(sizes.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5
        return QualityModel(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("label") == k).orderBy(*order).limit(max_per_class) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1]).dropDuplicates(["doc_id"])

    @F.arrow_udf("struct<bucket:array<int>,n:array<int>>")
    def bag(texts: pa.Array) -> pa.Array:
        got = [feature_counts(t.as_py()) for t in texts]
        return pa.array([{"bucket": b.astype(np.int32), "n": n.astype(np.int32)} for b, n in got],
                        pa.struct([("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))

    rows = (docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
            .select("doc_id", "label", bag("text").alias("bag"))
            .orderBy(*order).limit(2 * max_per_class)).toArrow()
    y = rows.column("label").to_numpy().astype(np.int64)
    bags = [(x["bucket"].values.to_numpy(), x["n"].values.to_numpy().astype(float))
            for x in rows.column("bag")]
    share = np.array([sizes[k] / total for k in (0, 1)])
    drawn = np.array([max(1, (y == k).sum()) for k in (0, 1)]) / max(1, len(y))
    return fit(bags, y, np.clip(share / drawn, 0.2, 5.0)[y])


def predict(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` added
    (replacing columns of those names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    return (docs.withColumn("score", score(text_of(text_col)))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
