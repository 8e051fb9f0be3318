"""Quality rules by repetition coverage (operator 10).

Rolling hashes of several word n-gram lengths find the n-grams that occur more
than once in a text; the rules bound the share of a text's characters that lie
inside duplicated n-grams and duplicated lines.

Defined cases: a null or empty text has no words and fails the length rule;
duplicated rows are judged alike, each on its own; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from benchtide.llm.common import WORD, mix, text_of

# n-gram length -> largest share of word characters inside repeats of an
# n-gram, its first occurrence not counted (fixed values: the published
# repetition thresholds for n = 5..10)
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# largest share of the characters in lines that repeat an earlier line
LINE_LIMIT = 0.30
MIN_WORDS = 10
SYMBOLS = "#*$%&|<>"

_BASE = np.uint64(0x9E3779B97F4A7C15)

_ARROW_TYPE = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("dup_ngram_share", pa.float64()), ("dup_line_share", pa.float64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_())])
RULES_TYPE = from_arrow_type(_ARROW_TYPE)


def repeated_windows(ids: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-word windows that occur at least twice, and those of
    them that are not the first.  Windows with equal hashes are compared word
    by word; if two differ, exact rows decide."""
    none = np.empty(0, np.int64)
    if len(hashes) < 2:
        return none, none
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return none, none
    a, b = order[:-1][same], order[1:][same]
    if all((ids[a + k] == ids[b + k]).all() for k in range(n)):
        return np.unique(np.concatenate([a, b])), b
    rows = np.lib.stride_tricks.sliding_window_view(ids, n)
    _, first, inverse, counts = np.unique(rows, axis=0, return_index=True, return_inverse=True,
                                          return_counts=True)
    inverse = inverse.reshape(-1)
    again = np.ones(len(rows), bool)
    again[first] = False
    return np.flatnonzero(counts[inverse] > 1), np.flatnonzero(again)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words inside the windows at ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> dict:
    """All rule inputs and the verdict for one whole text."""
    words = WORD.findall(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    values = mix((ids + 1).astype(np.uint64) * _BASE)
    repeat_words, worst = 0, 0.0
    too_much = False
    hashes = np.zeros(n, np.uint64)
    for size in range(1, max(NGRAM_LIMITS) + 1):
        if n < size:
            break
        hashes = hashes[:n - size + 1] * _BASE + values[size - 1:]
        if size not in NGRAM_LIMITS:
            continue
        starts, later = repeated_windows(ids, hashes, size)
        if not len(starts):
            break  # no longer window can repeat either
        if size == 5:
            repeat_words = int(covered(starts, size, n).sum())
        share = float(lengths[covered(later, size, n)].sum()) / chars
        worst = max(worst, share)
        too_much |= share > NGRAM_LIMITS[size]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    first = set()
    dup_lines = dup_chars = 0
    for line in lines:
        if line in first:
            dup_lines += 1
            dup_chars += len(line)
        else:
            first.add(line)
    line_share = dup_chars / max(1, sum(map(len, lines)))
    failed = n < MIN_WORDS or 100 * repeat_words > 20 * n
    return {"n_words": n, "word_chars": chars,
            "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup_lines,
            "n_repeat_words": repeat_words, "dup_ngram_share": worst,
            "dup_line_share": line_share, "base_failed": failed,
            "kept": not (failed or too_much or line_share > LINE_LIMIT)}


@F.arrow_udf(RULES_TYPE)
def repetition_rules(texts: pa.Array) -> pa.Array:
    """``measure`` per text of an Arrow batch."""
    return pa.array([measure(t.as_py() or "") for t in texts], _ARROW_TYPE)


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the rule inputs and the verdict."""
    return (docs.select(F.col(id_col).alias("doc_id"),
                        repetition_rules(text_of(text_col)).alias("r"))
            .select("doc_id", "r.*"))


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes the rules, with their columns unchanged."""
    return docs.filter(repetition_rules(text_of(text_col))["kept"])
