"""Benchmark decontamination (operator 1): spaced-seed hashing.

A seed is a mask over consecutive words that ignores some of them.  The windows
of the test items are hashed under each mask; training windows that hash alike
are hits, and where a diagonal (the place in the text less the place in the
item) has enough of them under all masks together, it is verified.  ``SEEDS``
reach every overlap that the verification accepts, whatever words it changes:
an overlap of 26 words or more can be cut into two of ``MIN_WORDS`` or more,
one of which has the same share of equal words or a higher one, and the shorter
ones are enumerated in the tests.

There both texts are compared word by word without gaps.  A diagonal is an
overlap if any segment of at least ``MIN_WORDS`` words (or the whole item, if
shorter, from ``SHORTEST`` words on) has at least ``MIN_SHARE`` equal words.
Reported is the best segment (a match counts 1, a mismatch ``-PENALTY``) if it
is such a one, or else the longest such segment, without changed words at its
ends as far as its least length allows.

The test side is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words;
each block is held against all training rows.

Defined cases: null and empty texts overlap with nothing; items shorter than
``SHORTEST`` words are never matched; repeated rows are each reported; of
diagonals with equally many equal words the first counts; long texts are read
whole; an empty table on either side gives an empty result; other columns don't
matter to ``overlaps`` and pass through ``drop_contaminated``, whatever their
names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from benchtide.llm.common import mix, text_of

WORDS = re.compile(r"[^\W_]+")
# (least and most words of an item, masks, least hits of a diagonal under them)
SEEDS = ((13, None, ("1101", "1011"), 4), (8, 12, ("101", "1001"), 3))
MIN_WORDS = 13
SHORTEST = 8
MIN_SHARE = 0.75
PENALTY = 1.5
BLOCK_WORDS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def masked_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words of every window; 0 where a word is unknown."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for k, used in enumerate(mask):
        if used == "1":
            part = ids[k:k + n]
            h = h * _BASE + part.astype(np.uint64)
            known &= part > 0
    h = mix(h) | np.uint64(1)
    h[~known] = 0
    return h


def best_segment(match: np.ndarray) -> tuple[int, int]:
    """(start, end) of the highest scoring run of a match vector."""
    total = np.concatenate([[0.0], np.cumsum(np.where(match, 1.0, -PENALTY))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[:end + 1] == low[end])[-1]), end


def overlap_segment(match: np.ndarray, least: int) -> tuple[int, int] | None:
    """(start, end) of the segment to report, None where no segment of at least
    ``least`` words has ``MIN_SHARE`` equal words."""
    if len(match) < least:
        return None
    total = np.concatenate([[0.0], np.cumsum(np.where(match, 1 - MIN_SHARE, -MIN_SHARE))])
    start, end = best_segment(match)
    if end - start >= least and total[end] >= total[start]:
        return start, end
    # the last end with at least the start's total; ``top`` falls from left to right
    top = np.maximum.accumulate(total[::-1])[::-1]
    last = np.searchsorted(-top, -total, "right") - 1
    size = last - np.arange(len(total))
    start = int(size.argmax())
    end = int(last[start])
    if end - start < least:
        return None
    while end - start > least and not match[end - 1]:
        end -= 1
    while end - start > least and not match[start]:
        start += 1
    return start, end


class TestSide:
    """Words, windows and their hashes of one block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.names, self.ids = [], []
        for name, text in items:
            words = WORDS.findall((text or "").lower())
            if len(words) >= SHORTEST:
                self.names.append(name)
                self.ids.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words]))
        self.index = []
        for least, most, masks, hits in SEEDS:
            own = [i for i, ids in enumerate(self.ids) if least <= len(ids) <= (most or len(ids))]
            if own:
                self.index.append(([self._sorted(mask, own) for mask in masks], hits))

    def _sorted(self, mask: str, own: list[int]):
        """The windows of the items ``own`` by their hashes."""
        parts = [masked_hashes(self.ids[i], mask) for i in own]
        sizes = [len(h) for h in parts]
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        place = np.concatenate([np.arange(n) for n in sizes])
        return mask, hashes[order], np.repeat(own, sizes)[order], place[order]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) pairs with enough common windows; the
        diagonal is the place in the text minus the place in the item."""
        found = []
        for seeds, least in self.index:
            pairs = []
            for mask, hashes, item, place in seeds:
                h = masked_hashes(ids, mask)
                at = np.flatnonzero(h)
                lo = np.searchsorted(hashes, h[at], "left")
                n = np.searchsorted(hashes, h[at], "right") - lo
                rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs.append((item[rows] << 32) + (np.repeat(at, n) - place[rows] + (1 << 31)))
            both, count = np.unique(np.concatenate(pairs), return_counts=True)
            both = both[count >= least]
            found.append(np.stack([both >> 32, (both & 0xFFFFFFFF) - (1 << 31)], 1))
        return np.concatenate(found) if found else np.empty((0, 2), np.int64)

    def overlaps(self, text: str) -> list[dict]:
        """The best overlap of a text with each item that it overlaps."""
        words = WORDS.findall(text.lower())
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        best: dict[int, dict] = {}
        for i, diagonal in self.hits(ids).tolist():
            own = self.ids[i]
            lo, hi = max(0, -diagonal), min(len(own), len(ids) - diagonal)
            match = own[lo:hi] == ids[lo + diagonal:hi + diagonal]
            segment = overlap_segment(match, min(MIN_WORDS, len(own)))
            if segment is None:
                continue
            start, end = segment
            size, same = end - start, int(match[start:end].sum())
            if i not in best or same > best[i]["matched"]:
                best[i] = {"item_id": self.names[i], "start_word": lo + diagonal + start,
                           "words": size, "matched": same, "item_words": len(own)}
        return list(best.values())


_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("words", pa.int32()),
                             ("matched", pa.int32()), ("item_words", pa.int32())]))


def item_blocks(items: DataFrame, item_col: str, text_col: str):
    """The test items in lists of about ``BLOCK_WORDS`` words at most (an item
    longer than that is a block of its own)."""
    block, size = [], 0
    rows = items.select(F.col(item_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        n = len(text) // 5 + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def overlap_column(spark, items: list[tuple[int, str]]):
    """A function from a text column to its overlaps with a block of items."""
    shared = spark.sparkContext.broadcast(items)
    state: dict[str, TestSide] = {}

    @F.arrow_udf(from_arrow_type(_FOUND))
    def overlaps(texts: pa.Array) -> pa.Array:
        if not state:
            state["side"] = TestSide(shared.value)
        return pa.array([state["side"].overlaps(t.as_py()) for t in texts], _FOUND)

    return overlaps


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and overlapping test item: doc_id, item_id,
    start_word (in the document), words, matched, item_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        part = rows.select("doc_id", F.explode(overlap_column(docs.sparkSession, block)("text")).alias("o"))
        part = part.select("doc_id", "o.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("doc_id", F.explode(F.lit(None).cast(from_arrow_type(_FOUND))).alias("o")).select(
            "doc_id", "o.*")
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, columns unchanged."""
    for block in item_blocks(items, item_col, item_text_col):
        docs = docs.where(F.size(overlap_column(docs.sparkSession, block)(text_of(text_col))) == 0)
    return docs
