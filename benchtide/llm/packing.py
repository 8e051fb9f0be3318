"""Best-fit packing (operator 9): a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` ids (only longer ones are
cut).  Pieces are dealt at random into blocks of about ``BLOCK`` pieces.  Each
block is evolved by several islands, one Spark row each: a crossover injects
whole well-filled bins of one parent into the other, drops the bins that would
repeat a piece and puts the displaced pieces back by best fit.  After each
epoch an island's elite migrates to the next island of its block.  Pieces of
poorly filled bins of all blocks are dealt anew into fewer blocks, level by
level, so that a block's last bins don't stay half empty.

Defined cases: a null or empty text is one piece holding only the end mark;
repeated rows and repeated or null ids are packed row by row; an empty table
gives an empty result; other columns of the pieces stay, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.llm.common import free_name, release, stage, text_of
from benchtide.llm.tokens import default_path, merged, tokenizer

CAPACITY = 4096
BLOCK = 1024
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
# bins filled less are dissolved and packed again at the next level
WELL_FILLED = 0.98

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer_path or default_path()

    def cut(batches):
        encoder = tokenizer(path)
        for batch in merged(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.documents(batch.column(1))):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, {PIECES}")


# ------------------------------------------------------------- one island

class Bins:
    """A solution: the pieces of each bin and its free room."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, pieces) -> None:
        """Each piece, largest first, into the fullest bin with room for it."""
        order = sorted((f, b) for b, f in enumerate(self.free) if f)
        for p in pieces:
            size = int(self.sizes[p])
            at = bisect_left(order, (size, -1))
            if at < len(order):
                free, b = order.pop(at)
                self.items[b].append(p)
            else:
                free, b = self.capacity, len(self.items)
                self.items.append([p])
                self.free.append(free)
            self.free[b] = free - size
            if free > size:
                insort(order, (free - size, b))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller bins."""
        fill = 1.0 - np.array(self.free) / self.capacity
        return -len(self.items), float((fill ** 2).sum())

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for b, own in enumerate(self.items):
            out[own] = b
        return out

    @classmethod
    def of(cls, assignment: np.ndarray, sizes: np.ndarray, capacity: int) -> "Bins":
        new = cls(sizes, capacity)
        new.items = [[] for _ in range(int(assignment.max()) + 1)]
        for p, b in enumerate(assignment.tolist()):
            new.items[b].append(p)
        new.free = [capacity - int(sizes[own].sum()) for own in new.items]
        return new


def crossover(host: Bins, guest: Bins, rng: np.random.Generator) -> Bins:
    """Inject well-filled bins of ``guest`` into ``host``."""
    free = np.array(guest.free)
    full = np.argsort(free, kind="stable")[:max(1, len(free) // 2)]
    injected = [guest.items[b] for b in full[rng.random(len(full)) < 0.5]] or [guest.items[int(full[0])]]
    taken = {p for own in injected for p in own}
    child = Bins(host.sizes, host.capacity)
    child.items = [list(own) for own in injected]
    displaced = []
    for own in host.items:
        kept = [p for p in own if p not in taken]
        if len(kept) == len(own):
            child.items.append(list(own))
        else:
            displaced += kept
    # mutation: the emptiest bin that was kept is displaced as well
    child.free = [child.capacity - int(child.sizes[own].sum()) for own in child.items]
    if len(child.items) > 1:
        worst = int(np.argmax(child.free))
        displaced += child.items.pop(worst)
        child.free.pop(worst)
    displaced.sort(key=lambda p: -child.sizes[p])
    child.best_fit(displaced)
    return child


def evolve(sizes: np.ndarray, capacity: int, seeds: list[np.ndarray], rng: np.random.Generator) -> Bins:
    """One epoch; ``seeds`` are elites of this island and of its neighbour."""
    least = -(-int(sizes.sum()) // capacity)
    people = [Bins.of(s, sizes, capacity) for s in seeds]
    if not people:
        people.append(Bins(sizes, capacity))
        people[0].best_fit(np.argsort(-sizes, kind="stable").tolist())
    while len(people) < POPULATION and max(people, key=Bins.fitness).fitness()[0] < -least:
        other = Bins(sizes, capacity)
        other.best_fit(np.argsort(-sizes * rng.uniform(0.9, 1.1, len(sizes)), kind="stable").tolist())
        people.append(other)
    for _ in range(GENERATIONS):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].items) <= least or len(people) < 2:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        for host, guest in ((a, b), (b, a)):
            child = crossover(people[host], people[guest], rng)
            if child.fitness() > people[-1].fitness():
                people[-1] = child
                people.sort(key=Bins.fitness, reverse=True)
    return max(people, key=Bins.fitness)


_STATE = ("block bigint, island int, uids array<bigint>, sizes array<int>, bins array<int>, "
          "n_bins int, fitness double")


def _epoch(capacity: int, seed: int, epoch: int):
    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                rng = np.random.default_rng([seed, epoch, row["block"], row["island"]])
                elites = [np.array(row[k], np.int64) for k in ("bins", "guest") if row.get(k)]
                best = evolve(sizes, capacity, elites, rng)
                row.pop("guest", None)
                row |= {"bins": best.assignment().tolist(), "n_bins": len(best.items),
                        "fitness": best.fitness()[1]}
                yield pa.RecordBatch.from_pylist([row], _ARROW_STATE)
    return step


_ARROW_STATE = pa.schema([
    ("block", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32())), ("n_bins", pa.int32()),
    ("fitness", pa.float64())])


def _pack_level(pieces: DataFrame, n: int, level: int, capacity: int, seed: int) -> DataFrame:
    """(uid, size, block, bin, offset, filled) for the pieces of one level."""
    n_blocks = max(1, round(n / BLOCK))
    # an equal deal of the uids: blocks stay near BLOCK pieces whatever the ids
    blocks = (pieces.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_blocks)).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("size"))))
                   .alias("p")))
    state = blocks.select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.col("p.uid").alias("uids"), F.col("p.size").alias("sizes"),
        F.lit(None).cast("array<int>").alias("bins"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("fitness"))
    state = state.mapInArrow(_epoch(capacity, seed, 0), _STATE)
    for epoch in range(1, EPOCHS):
        state = stage(state, "pack-islands")
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"),
                              F.col("bins").alias("guest"))
        state = state.join(guests, ["block", "island"]).mapInArrow(
            _epoch(capacity, seed, epoch), _STATE)
    best = state.groupBy("block").agg(F.max_by(
        F.struct("uids", "sizes", "bins"), F.struct(-F.col("n_bins"), F.col("fitness"), F.col("island"))).alias("b"))

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, bins = np.array(row["sizes"], np.int64), np.array(row["bins"], np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                fill = np.bincount(bins, sizes).astype(np.int64)
                offset = np.empty(len(sizes), np.int64)
                offset[order] = before - (np.cumsum(fill) - fill)[bins[order]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["uids"], pa.int64()), pa.array(sizes),
                     pa.array(np.full(len(sizes), row["block"], np.int64)), pa.array(bins),
                     pa.array(offset), pa.array(fill[bins])],
                    names=["uid", "length", "block", "bin", "offset", "filled"])

    return best.select("block", "b.*").mapInArrow(
        place, "uid bigint, length bigint, block bigint, bin bigint, offset bigint, filled bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 7) -> DataFrame:
    """``pieces`` (with a ``length`` column) with sequence_id and offset added
    (replacing columns of those names)."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    uid = free_name(pieces, "uid")
    pieces = stage(pieces.withColumn(uid, F.monotonically_increasing_id()), "pack-pieces")
    todo, left, level, placed = pieces.select(F.col(uid).alias("uid"), "length"), pieces.count(), 0, []
    while left:
        packed = stage(_pack_level(todo, left, level, capacity, seed), "pack-level")
        poor = packed.where(F.col("filled") < WELL_FILLED * capacity)
        again = poor.count() if left > BLOCK else 0
        last = again == 0 or again > left // 2
        placed.append((packed if last else packed.where(F.col("filled") >= WELL_FILLED * capacity)).select(
            "uid", (F.lit(level) * (1 << 56) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"),
            "offset"))
        if last:
            break
        todo, left, level = poor.select("uid", "length"), again, level + 1
    release(spark)
    if not placed:
        return pieces.drop(uid).withColumns({"sequence_id": F.lit(0).cast("bigint"),
                                               "offset": F.lit(0).cast("bigint")})
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return pieces.join(where.withColumnRenamed("uid", uid), uid).drop(uid)
