"""Repeated-substring removal by blockwise suffix sorting (operator 4).

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier
(smaller doc_id, or earlier in the same document).  Only the order of equal
``LENGTH``-byte prefixes matters, so suffixes are sorted to that depth:

* Cover sample.  Of every ``LENGTH``-byte string one inner position is in the
  sample: the one whose ``GRAM``-byte string has the smallest hash, the first
  of them on ties.  Equal strings have it at the same place, which is what a
  difference cover is for; the sample is chosen by content, as a periodic one
  would hold four times as many positions.
* Sample ranks.  The suffixes that share a sample position are one run; its
  rank is the hash of its sample string, then of all bytes of the run.
* Blocks.  Runs are dealt into buckets by sample rank; each bucket is sorted
  on its own.  A run whose whole string was seen earlier goes as one.
* Long ties.  Where a sample string has several runs, the first of each run is
  spread into its suffixes; bucket by bucket these are sorted by sample rank
  and the rank of their ``LENGTH`` bytes, and all but the first go.

Ranks are 64-bit hashes, two of which must agree.

Defined cases: a null or empty text has no bytes; texts below ``LENGTH`` bytes
keep all; null ids come first; rows of one id and text count as one document
and get the same result, other texts of the same id are ordered by a hash; an empty table gives no rows; other
columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import BinaryType

from benchtide.llm.common import mix, quoted, release, stage, text_of

LENGTH = 100
GRAM = 40
# bytes of text hashed at once, and per flush to the buckets
SEGMENT = 1 << 20
FLUSH = 1 << 23
# bytes of text that one bucket stands for
PER_BUCKET = 1 << 23
LEAST_BUCKETS = 64
FIRST = -(1 << 63)

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POSITION = np.uint64((1 << 21) - 1)


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (base, inverse))


class Hashes:
    """64-bit hashes of any substrings of ``raw``."""

    def __init__(self, raw: np.ndarray, base: np.uint64):
        up, self._down = _powers(int(base), SEGMENT + 2 * LENGTH)
        values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * base)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[:len(raw)])])

    def of(self, lo, hi) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[hi] - self._sums[lo]) * self._down[lo])


def segments(texts: list[bytes]):
    """(document, offset of the part in it, its bytes) in parts of at most
    ``SEGMENT`` suffixes; a part ends ``LENGTH - 1`` bytes later."""
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            yield i, at, t[at:at + SEGMENT + LENGTH - 1]


def _segment_groups(texts: list[bytes]):
    group, size = [], 0
    for part in segments(texts):
        if len(part[2]) < LENGTH:
            continue
        if group and size + len(part[2]) > SEGMENT:
            yield group
            group, size = [], 0
        group.append(part)
        size += len(part[2])
    if group:
        yield group


def runs(texts: list[bytes]):
    """Runs of suffixes that share a sample position, as arrays: document,
    first and last start, hash of the sample string, hash of the run."""
    out = []
    for group in _segment_groups(texts):
        raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        size = np.array([len(p) for _, _, p in group])
        first = np.cumsum(size) - size
        h1, h2 = Hashes(raw, _B1), Hashes(raw, _B2)
        at = np.arange(len(raw) - GRAM + 1)
        gram = h1.of(at, at + GRAM)
        key = (gram & ~_POSITION) | at.astype(np.uint64)
        width = 1
        low = key
        span = LENGTH - GRAM + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        sample = (low & _POSITION).astype(np.int64)
        # starts whose LENGTH bytes lie in one part
        count = size - LENGTH + 1
        starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        part = np.repeat(np.arange(len(group)), count)
        own = sample[starts]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])])
        lo_at = np.flatnonzero(new)
        hi_at = np.concatenate([lo_at[1:], [len(starts)]]) - 1
        lo, hi, where = starts[lo_at], starts[hi_at], own[lo_at]
        shape = ((where - lo) * 256 + (hi - lo)).astype(np.uint64)
        whole = mix(h2.of(lo, hi + LENGTH) ^ (shape * _B1))
        doc = np.array([i for i, _, _ in group])[part[lo_at]]
        shift = np.array([o for _, o, _ in group])[part[lo_at]] - first[part[lo_at]]
        out.append((doc, lo + shift, hi + shift, gram[where], whole))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def _lists(order: np.ndarray, bounds: np.ndarray, *columns) -> list[pa.Array]:
    offsets = pa.array(bounds, pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


def _deal(buckets: int):
    """mapInArrow: the runs of the texts, deduplicated per flush and packed by
    bucket.  Input doc, tie, raw; repeats inside a flush are listed too."""
    names = ["bucket", "gram", "whole", "doc", "tie", "lo", "hi"]

    def flush(rows):
        doc_of = np.array([r[0] for r in rows], np.int64)
        tie_of = np.array([r[1] for r in rows], np.int64)
        doc, lo, hi, gram, whole = runs([r[2] for r in rows])
        bucket = (gram % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        bounds = np.concatenate([first, [len(order)]])
        cols = _lists(order, bounds, gram.view(np.int64), whole.view(np.int64), doc_of[doc], tie_of[doc],
                      lo.astype(np.int32), hi.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *cols], names=names)

    def deal(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(row[2]) >= LENGTH:
                    rows.append(row)
                    size += len(row[2])
                    if size >= FLUSH:
                        yield flush(rows)
                        rows, size = [], 0
        if rows:
            yield flush(rows)

    return deal


_RUNS = ("bucket int, gram array<bigint>, whole array<bigint>, doc array<bigint>, tie array<bigint>, "
         "lo array<int>, hi array<int>")
_SPANS = "doc bigint, tie bigint, lo int, hi int, whole boolean"


def _joined(batches, n: int) -> list[np.ndarray]:
    held = [[] for _ in range(n)]
    for batch in batches:
        for k in range(n):
            held[k].append(batch.column(k + 1).flatten().to_numpy(zero_copy_only=False))
    return [np.concatenate(h) if h else np.empty(0, np.int64) for h in held]


def _changes(*columns) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def sort_runs(batches):
    """Sorts the buckets of one task.  Yields the runs seen earlier (whole),
    and the first of each run of a sample string that has several."""
    gram, whole, doc, tie, lo, hi = _joined(batches, 6)
    if not len(gram):
        return
    order = np.lexsort((lo, tie, doc, whole, gram))
    gram, whole, doc, tie, lo, hi = (x[order] for x in (gram, whole, doc, tie, lo, hi))
    first = _changes(gram, whole)
    # a repeated row lists its runs again
    again = ~_changes(gram, whole, doc, tie, lo)
    group = np.cumsum(_changes(gram)) - 1
    several = np.bincount(group, first)[group] > 1
    seen = ~first & ~again
    keep = seen | (first & several)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x[keep]) for x in (doc, tie, lo, hi)] + [pa.array(seen[keep])],
        names=["doc", "tie", "lo", "hi", "whole"])


def _spread(buckets: int):
    """mapInArrow: ranks of all suffixes of the listed runs, packed by bucket.
    Input doc, tie, raw, lo, hi."""
    names = ["bucket", "gram", "rank", "doc", "tie", "at"]

    def flush(rows):
        parts = []
        for doc, tie, raw, los, his in rows:
            for lo, hi in zip(los, his):
                parts.append((doc, tie, lo, raw[lo:hi + LENGTH]))
        out = []
        step = max(1, SEGMENT // (2 * LENGTH))
        for i in range(0, len(parts), step):
            group = parts[i:i + step]
            raw = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
            size = np.array([len(p) for *_, p in group])
            first = np.cumsum(size) - size
            count = size - LENGTH + 1
            starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            part = np.repeat(np.arange(len(group)), count)
            h1, h2 = Hashes(raw, _B1), Hashes(raw, _B2)
            # the run's sample string, as when the runs were made
            at = np.arange(len(raw) - GRAM + 1)
            key = (h1.of(at, at + GRAM) & ~_POSITION) | at.astype(np.uint64)
            gram = np.array([h1.of(f + (k := int(np.argmin(key[f:f + LENGTH - GRAM + 1]))), f + k + GRAM)
                             for f in first])
            fields = [np.array([p[c] for p in group], np.int64)[part] for c in range(3)]
            out.append((gram[part], h2.of(starts, starts + LENGTH), fields[0], fields[1],
                        (fields[2] + starts - first[part]).astype(np.int32)))
        gram, rank, doc, tie, at = (np.concatenate(x) for x in zip(*out))
        bucket = (gram % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        used, begin = np.unique(bucket[order], return_index=True)
        bounds = np.concatenate([begin, [len(order)]])
        cols = _lists(order, bounds, gram.view(np.int64), rank.view(np.int64), doc, tie, at)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *cols], names=names)

    def spread(batches):
        rows, size = [], 0
        for batch in batches:
            for doc, tie, raw, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((doc, tie, raw, lo, hi))
                size += sum(hi) - sum(lo) + len(lo) * LENGTH
                if size >= FLUSH // 8:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return spread


_SUFFIXES = ("bucket int, gram array<bigint>, rank array<bigint>, doc array<bigint>, tie array<bigint>, "
             "at array<int>")


def sort_suffixes(batches):
    """Sorts the suffixes of one task's buckets; yields all that aren't the
    first of their kind, as runs of neighbours."""
    gram, rank, doc, tie, at = _joined(batches, 5)
    if not len(gram):
        return
    order = np.lexsort((at, tie, doc, rank, gram))
    first = _changes(gram[order], rank[order])
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    # a repeated row lists its suffixes again: they are no earlier ones
    own = (doc[order] == doc[head]) & (tie[order] == tie[head]) & (at[order] == at[head])
    gone = order[~own]
    if not len(gone):
        return
    doc, tie, at = doc[gone], tie[gone], at[gone]
    order = np.lexsort((at, tie, doc))
    doc, tie, at = doc[order], tie[order], at[order]
    once = _changes(doc, tie, at)
    doc, tie, at = doc[once], tie[once], at[once]
    new = _changes(doc, tie, at - np.arange(len(at)))
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[lo]), pa.array(tie[lo]), pa.array(at[lo]), pa.array(at[hi]),
         pa.array(np.ones(len(lo), bool))], names=["doc", "tie", "lo", "hi", "whole"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    own = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, *(c.alias(name) for name, c in {"_doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST)),
                             "_tie": F.xxhash64(text), "_raw": text.cast("binary")}.items()))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` as ``c0``, ``c1``, ... (so that no name clashes) with ``_lo`` and ``_hi`` (first and last starts of the runs of
    repeated strings, null without any), ``_raw``, ``_doc`` and ``_tie``."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    size = keyed.agg(F.sum(F.octet_length("_raw"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // PER_BUCKET))
    texts = keyed.select("_doc", "_tie", "_raw")
    spans = stage(texts.mapInArrow(_deal(buckets), _RUNS).repartition(buckets, "bucket")
                  .mapInArrow(sort_runs, _SPANS), "suffix-runs")
    release(spark)

    def per_document(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc", "tie").agg(F.collect_list("lo").alias("_lo"), F.collect_list("hi").alias("_hi"))

    ties = per_document(spans.where("not whole"))
    tied = (texts.join(ties, (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie")))
            .select("_doc", "_tie", "_raw", "_lo", "_hi"))
    more = stage(tied.mapInArrow(_spread(buckets), _SUFFIXES).repartition(buckets, "bucket")
                 .mapInArrow(sort_suffixes, _SPANS), "suffix-ties")
    release(spark)
    gone = per_document(spans.where("whole").unionByName(more))
    return keyed.join(gone, (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie")), "left").drop(
        "doc", "tie")


def removed_runs(size: int, lo, hi) -> np.ndarray:
    """Maximal removed byte runs of a text as rows (start, end)."""
    if lo is None or not len(lo):
        return np.empty((0, 2), np.int64)
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, np.asarray(lo), 1)
    np.add.at(edge, np.asarray(hi) + LENGTH, -1)
    mask = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    return np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2)


def _without(raw: bytes, gone: np.ndarray) -> bytes:
    if not len(gone):
        return raw
    at, out = 0, []
    for lo, hi in gone.tolist():
        out.append(raw[at:lo])
        at = hi
    return b"".join(out) + raw[at:]


_DIGEST = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string())])


@F.arrow_udf(from_arrow_type(_DIGEST))
def removal_digest(raw: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    out = []
    for r, a, b in zip(raw, lo, hi):
        text = r.as_py()
        gone = removed_runs(len(text), a.as_py(), b.as_py())
        out.append({"n_bytes": len(text), "n_removed": int((gone[:, 1] - gone[:, 0]).sum()),
                    "n_spans": len(gone), "kept_sha256": hashlib.sha256(_without(text, gone)).hexdigest()})
    return pa.array(out, _DIGEST)


@F.arrow_udf(BinaryType())
def kept_bytes(raw: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    return pa.array([_without(t, removed_runs(len(t), a, b))
                     for t, a, b in zip(raw.to_pylist(), lo.to_pylist(), hi.to_pylist())], pa.binary())


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    got = repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return got.select(F.col("c0").alias("doc_id"), removal_digest("_raw", "_lo", "_hi").alias("d")).select("doc_id", "d.*")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 out_col: str = "kept") -> DataFrame:
    """``docs`` with the remaining bytes of each text in ``out_col``."""
    return repeats(docs, id_col, text_col).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out_col],
        kept_bytes("_raw", "_lo", "_hi").alias(out_col))
