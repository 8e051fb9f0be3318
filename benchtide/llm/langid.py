"""Language identification (operator 8): multinomial naive Bayes over hashed
character n-grams.

Training counts n-grams of every labelled text with partial sums per partition;
the matrix of log probabilities has (languages x buckets) cells, checked
against ``MAX_CELLS`` before it is sent to the tasks.  Scoring gathers matrix
rows for the n-grams of a batch and sums them per text in numpy.

Defined cases: a null text, an empty one or one without letters gives ``und``
with score 0; equal scores go to the alphabetically first language; rows with
a null language train nothing; without any training row every text is ``und``, and an empty table gives no
rows; repeated rows are scored alike; very long texts are scored in pieces;
other columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.llm.common import blocks, code_points, free_name
from benchtide.llm.ngrams import BLOCK_CHARS, char_ngrams, text_char_ngrams

SIZES = (1, 2, 3)
BITS = 14
MAX_CELLS = 1 << 24
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased text with each run of other characters made one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _ngram_counts(batches):
    """Per partition: (lang, bucket, count) sums over its texts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for bucket in text_char_ngrams(text, SIZES, BITS):
                sums += np.bincount(bucket, minlength=1 << BITS)
    for lang, sums in total.items():
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)),
             pa.array(sums[used])], names=["lang", "bucket", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    log_probs: np.ndarray  # (buckets, languages)
    log_prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its posterior probability) per text."""
        total = np.tile(self.log_prior, (len(texts), 1))
        for lo, hi in blocks(texts, BLOCK_CHARS):
            if hi - lo == 1:
                for bucket in text_char_ngrams(texts[lo], SIZES, BITS):
                    counts = np.bincount(bucket, minlength=1 << BITS)
                    used = np.flatnonzero(counts)
                    total[lo] += counts[used] @ self.log_probs[used]
                continue
            lengths = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
            ends = np.cumsum(lengths)
            cps = code_points("".join(texts[lo:hi]))
            for size, bucket in char_ngrams(cps, SIZES, BITS):
                # n-grams that start in a text and also end in it
                first = ends - lengths
                count = np.maximum(0, lengths - size + 1)
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                for k in range(len(self.langs)):
                    running = np.concatenate([[0.0], np.cumsum(self.log_probs[bucket, k])])
                    a = first[some]
                    total[lo + some, k] += running[a + count[some]] - running[a]
        best = total.argmax(axis=1)
        shifted = np.exp(total - total.max(axis=1, keepdims=True))
        return best, 1.0 / shifted.sum(axis=1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          smoothing: float = 0.5) -> LanguageModel:
    """Counts over every row of ``docs`` with a language and a letter."""
    rows = (docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
            .select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("text")))
    counts = (rows.mapInArrow(_ngram_counts, "lang string, bucket int, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
              .limit(MAX_CELLS // (1 << BITS) + 1).collect()}
    langs = sorted(priors)
    if len(langs) << BITS > MAX_CELLS:
        raise ValueError(f"{len(langs)} languages or more: the model would pass {MAX_CELLS} cells")
    got = counts.toArrow()
    matrix = np.full((1 << BITS, len(langs)), smoothing)
    at = {lang: i for i, lang in enumerate(langs)}
    column = np.fromiter((at[x] for x in got.column("lang").to_pylist()), np.int64, got.num_rows)
    matrix[got.column("bucket").to_numpy(), column] += got.column("n").to_numpy()
    prior = np.array([priors[x] for x in langs], float)
    return LanguageModel(langs, np.log(matrix / matrix.sum(axis=0, keepdims=True)),
                         np.log(prior / prior.sum()) if langs else prior)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (replacing columns of
    those names)."""
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, score = m.score(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([m.langs[i] for i in best], pa.string()), pa.array(score, pa.float64())],
            ["lang", "score"])

    known = has_letter(F.col(text_col))
    got = identify(F.coalesce(letters(F.col(text_col)), F.lit("")))
    name = free_name(docs, "_id_result")
    return (docs.withColumn(name, got)
            .withColumns({"lang_pred": F.when(known, F.col(f"{name}.lang")).otherwise(UNKNOWN),
                          "score": F.when(known, F.col(f"{name}.score")).otherwise(0.0)})
            .drop(name))
