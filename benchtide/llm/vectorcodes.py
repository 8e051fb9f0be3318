"""Vector code compression (operator 11): product quantisation in whole
numbers, nearest entries found through a GNAT over each codebook.

A vector is cut into equal consecutive parts; each part position has a
codebook of at most 256 entries, fitted by a few rounds of assigning every
part to its nearest entry and averaging.  The nearest entry is found in a
geometric near-neighbour access tree over the entries: a node holds split
points, every other entry belongs to its nearest split point, and for each
pair (split, child) the node knows the range of distances from the split to
the child's entries.  A query at distance d from a split, with its best entry
so far at distance r, leaves out a child when [d - r, d + r] misses that range.

Distances in the tests are square roots in doubles, widened outwards by
``MARGIN`` so that rounding never leaves a child out wrongly, and the tests are
strict, so an entry at the same distance is always met; which entry wins is
decided by squared distances in whole numbers, ties to the lower index.

Every row is read in each round; partitions send one sum per part and entry,
and the codebooks (parts x 256 entries) are the only thing the driver holds.

Defined cases: rows whose vector is null, or holds null or non-finite
components, are dropped; repeated ids and rows each count and are coded alike;
null ids come last among the first entries, and equal ids are ordered by their
vectors; fewer than 256 rows give fewer entries; an empty table gives no
rows; null labels are one label; other columns pass through ``encode``,
whatever their names (but for ``codes`` and ``error``, which it replaces).
Vectors of different lengths, of a length that the parts don't divide, or with
components too large for exact 64-bit sums raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.llm.common import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# split points of a node; sets of at most LEAF entries are compared one by one
DEGREE = 16
LEAF = 20
MARGIN = 1e-9
# parts scored together, which bounds a task's arrays
BLOCK = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``, whole numbers.
    A product of doubles is exact as long as no sum passes 2^53."""
    reach = max(abs(x).max(initial=0), abs(y).max(initial=0))
    if x.shape[1] * (2.0 * reach) ** 2 < 2.0 ** 53:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - y[None, :, k]
        out += step * step
    return out


@dataclass
class Node:
    """A set of entries (numbers into the codebook).  A leaf has no children."""

    entries: np.ndarray
    low: np.ndarray | None = None     # (splits, children): least distance, rounded down
    high: np.ndarray | None = None    # the greatest, rounded up
    children: list["Node | None"] = field(default_factory=list)


def build(book: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The tree over ``book``; split points are chosen far from each other."""
    members = np.arange(len(book)) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    chosen = [0]
    gap = squared(book[members], book[members[:1]])[:, 0]
    while len(chosen) < DEGREE:
        far = int(gap.argmax())
        if gap[far] == 0:             # the rest equals split points
            break
        chosen.append(far)
        gap = np.minimum(gap, squared(book[members], book[members[far:far + 1]])[:, 0])
    splits = members[np.sort(chosen)]
    rest = np.setdiff1d(members, splits)
    apart = squared(book[rest], book[splits])
    home = apart.argmin(axis=1)
    n = len(splits)
    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    children: list[Node | None] = []
    for j in range(n):
        own = home == j
        if not own.any():
            children.append(None)
            continue
        away = np.sqrt(apart[own].astype(float))
        low[:, j] = away.min(axis=0) * (1 - MARGIN)
        high[:, j] = away.max(axis=0) * (1 + MARGIN)
        children.append(Node(rest[own]) if len(splits) == 1 else build(book, rest[own]))
    return Node(splits, low, high, children)


class Search:
    """Nearest entries of a block of queries in one tree."""

    def __init__(self, book: np.ndarray, tree: Node, queries: np.ndarray):
        self.book, self.queries = book, queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.full(len(queries), len(book), np.int64)
        self.compared = 0
        self.visit(tree, np.arange(len(queries)))

    def meet(self, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Compare queries with entries (ascending): the lower index wins ties."""
        apart = squared(self.queries[rows], self.book[entries])
        self.compared += apart.size
        at = apart.argmin(axis=1)
        near, entry = apart[np.arange(len(rows)), at], entries[at]
        won = (near < self.best[rows]) | ((near == self.best[rows]) & (entry < self.entry[rows]))
        self.best[rows[won]], self.entry[rows[won]] = near[won], entry[won]
        return apart

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows) or not len(node.entries):
            return
        apart = self.meet(rows, node.entries)
        if not node.children:
            return
        away = np.sqrt(apart.astype(float))
        home = apart.argmin(axis=1)
        for nearest in (True, False):   # the nearest split's child first: it narrows the rest
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                some = np.flatnonzero((home == j) == nearest)
                reach = np.sqrt(self.best[rows[some]].astype(float))[:, None] * (1 + MARGIN)
                d = away[some]
                # strictly outside, after rounding outwards
                missed = ((d * (1 - MARGIN) - reach > node.high[:, j])
                          | (d * (1 + MARGIN) + reach < node.low[:, j])).any(axis=1)
                self.visit(child, rows[some[~missed]])


@dataclass
class Codebooks:
    """Per part position: the entries (whole numbers) and the tree over them."""

    books: list[np.ndarray]

    def __post_init__(self):
        self.trees = [build(b) for b in self.books]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors x parts) nearest entries and their squared distances."""
        n, width = len(vectors), self.books[0].shape[1]
        entry, near = np.zeros((n, len(self.books)), np.int64), np.zeros((n, len(self.books)), np.int64)
        for p, (book, tree) in enumerate(zip(self.books, self.trees)):
            for lo in range(0, n, BLOCK):
                found = Search(book, tree, vectors[lo:lo + BLOCK, p * width:(p + 1) * width])
                entry[lo:lo + BLOCK, p], near[lo:lo + BLOCK, p] = found.entry, found.best
        return entry, near

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(n, parts) entry numbers back to whole-number vectors."""
        return np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)

    def digest(self) -> str:
        text = ",".join(str(x) for b in self.books for x in b.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def whole(vectors: pa.Array) -> np.ndarray:
    """Rows of ``floor(SCALE * x)`` from a list column of equal lengths."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(flat.reshape(len(vectors), -1) * SCALE).astype(np.int64)


def grouped(batches, rows: int = BLOCK):
    """Arrow batches put together to at least ``rows`` rows each (but the last)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is whole: no null, NaN or infinite component."""
    x = F.col(vector_col)
    return rows.where(x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _check(rows: DataFrame, vector_col: str, parts: int) -> int:
    """Length of the vectors (0: no rows)."""
    size = F.size(vector_col)
    got = rows.agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.max(
        F.aggregate(vector_col, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double"))))
    ).alias("largest")).first()
    if got["lo"] is None:
        return 0
    if got["lo"] != got["hi"] or got["lo"] % parts or not got["lo"]:
        raise ValueError(f"vectors of {got['lo']} to {got['hi']} components can't be cut into {parts} equal parts")
    # width * (2 * largest)^2 must fit 63 bits
    limit = (2.0 ** 62 / (got["lo"] // parts)) ** 0.5 / 2 / SCALE
    if got["largest"] >= limit:
        raise ValueError(f"component {got['largest']} is too large for exact sums (limit {limit})")
    return got["lo"]


def train(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks fitted on every row of ``rows`` (use ``usable`` first): they
    start as the vectors of the smallest ids, and each round replaces an entry
    by the floor of its parts' mean."""
    width = _check(rows, vector_col, parts) // parts
    first = (rows.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
             .orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).toArrow())
    start = whole(first.column("v").combine_chunks()) if first.num_rows else np.zeros((0, 0), np.int64)
    model = Codebooks([start[:, p * width:(p + 1) * width] for p in range(parts)])
    vectors = rows.select(F.col(vector_col).alias("v"))
    for _ in range(rounds if first.num_rows else 0):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def sums(batches):
            """Per partition: count and componentwise sum of each entry's parts."""
            m = shared.value
            n = [np.zeros(len(b), np.int64) for b in m.books]
            total = [np.zeros(b.shape, np.int64) for b in m.books]
            for batch in grouped(batches):
                x = whole(batch.column(0))
                entry, _ = m.assign(x)
                for p in range(parts):
                    n[p] += np.bincount(entry[:, p], minlength=len(n[p]))
                    np.add.at(total[p], entry[:, p], x[:, p * width:(p + 1) * width])
            for p in range(parts):
                used = np.flatnonzero(n[p])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)),
                    "n": pa.array(n[p][used]), "total": pa.array(total[p][used].tolist(), pa.list_(pa.int64()))})

        partial = vectors.mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
        found = partial.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total"))
        books = [b.copy() for b in model.books]
        for r in found.collect():      # at most parts x entries rows
            books[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
        model = Codebooks(books)
    return model


def encode(rows: DataFrame, model: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """``rows`` with ``codes`` (entry numbers in part order) and ``error`` (the
    squared distances summed over the parts)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def nearest(batches):
        m = shared.value
        parts = len(m.books)
        for batch in grouped(batches):
            entry, near = m.assign(whole(batch.column(1)))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(entry) + 1) * parts, pa.int32()),
                                             pa.array(entry.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, pa.array(near.sum(axis=1))],
                                             ["row", "codes", "error"])

    kept = [c for c in rows.columns if c.lower() not in ("codes", "error")]
    paired = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(vector_col).alias("v"))
    schema = T.StructType([paired.schema["row"], T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("error", T.LongType())])
    return paired.mapInArrow(nearest, schema).select("row.*", "codes", "error")


SALTS = 16


def label_totals(coded: DataFrame, label_col: str, total_col: str) -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of its label.  The
    totals (one row a label, summed in each partition first) are copied
    ``SALTS`` times and the rows dealt over the copies, so that a label with a
    third of all rows still meets its total in many tasks."""
    totals = (coded.groupBy(label_col).agg(F.sum("error").alias(total_col))
              .select(F.col(label_col).alias("_label"), total_col,
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy")))
    dealt = coded.withColumn("_salt", F.pmod(F.hash("vec_id", "code"), F.lit(SALTS)))
    return (dealt.join(totals, dealt[label_col].eqNullSafe(totals["_label"])
                       & (dealt["_salt"] == totals["_copy"]))
            .drop("_label", "_copy", "_salt"))


def code_report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                label_col: str = "label") -> DataFrame:
    """One row per usable vector: its code, its error and the errors of its label."""
    kept = usable(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"),
                              F.col(label_col).alias("label")))
    model = train(kept)
    coded = encode(kept, model).select(
        "vec_id", "label", F.lower(F.array_join(F.transform(
            "codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("code"), "error")
    coded = stage(coded, "vector-codes")
    return (label_totals(coded, "label", "label_error")
            .select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256")))


def _sql() -> str:
    """The same in SQL: every round compares all parts with all entries."""
    body = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cells AS (
  SELECT rn, k, (k - 1) // (len(x) // {PARTS}) AS part, (k - 1) % (len(x) // {PARTS}) AS pos, x[k] AS v
  FROM (SELECT rn, x, unnest(range(1, len(x) + 1)) AS k FROM kept)),
book0 AS (SELECT part, rn - 1 AS entry, pos, v FROM cells WHERE rn <= {ENTRIES})"""
    for r in range(ROUNDS + 1):
        body += f""",
near{r} AS (
  SELECT rn, part, entry, d FROM (
    SELECT rn, part, entry, d, row_number() OVER (PARTITION BY rn, part ORDER BY d, entry) AS nth FROM (
      SELECT c.rn, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d
      FROM cells c JOIN book{r} b ON c.part = b.part AND c.pos = b.pos
      GROUP BY c.rn, c.part, b.entry))
  WHERE nth = 1)"""
        if r < ROUNDS:
            body += f""",
mean{r} AS (
  SELECT n.part, n.entry, c.pos, CAST(sum(c.v) AS BIGINT) AS total, count(*) AS n
  FROM near{r} n JOIN cells c ON c.rn = n.rn AND c.part = n.part GROUP BY n.part, n.entry, c.pos),
book{r + 1} AS (
  SELECT b.part, b.entry, b.pos,
         CASE WHEN m.n IS NULL THEN b.v ELSE (m.total - ((m.total % m.n) + m.n) % m.n) // m.n END AS v
  FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""
    return body + f""",
coded AS (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY rn),
digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       digest.h AS codebooks_sha256
FROM kept k JOIN coded c ON k.rn = c.rn, digest
"""


SQL = _sql()
