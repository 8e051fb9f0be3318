"""Latest-wins dispatch (J-2) in one pass over range-sorted rows.

Whether a waiting request is sent depends on rows on both sides of it: on the
state its key is in (idle, busy, or busy with a request waiting), and on what
comes next in its key, a newer waiting request or the completion that starts
it.  Both are associative, so rows are range-partitioned on ``(key, order)``
like ``keyed_scan`` does, a hot key being cut into many ranges, and each range
is read once in order.

A range doesn't know how its first key arrives, so it decides that key's rows
for all four ways (``_START``) and packs the four decisions into one number; a
request that nothing in the range decides is the range's open one.  A summary
of one row per range (the ways it turns into ways for the next range, and what
its first key does to an open request before it) is resolved in order forwards
and backwards, and broadcast back: it is as small as the number of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.operators.scan import _materialise, _same_adjacent, _same_value
from benchtide.session import checkpoint_dir

IDLE, BUSY, PENDING = 0, 1, 2
DISPATCH_TABLE = [
    [BUSY, PENDING, PENDING],   # request
    [IDLE, IDLE, BUSY],         # completion (a pending request starts)
]
_TABLE = np.array([*DISPATCH_TABLE, [IDLE, BUSY, PENDING]])

# the ways a key can arrive: idle; busy; with a request waiting that is older
# than the range's first row; with one of the same time as that row
_START = np.array([IDLE, BUSY, PENDING, PENDING])
_WAYS = len(_START)
_SENT, _DROP, _STARTED, _OPEN, _LEFT = 1, 2, 3, 4, 5     # a request's decision
_NONE, _NEWER, _CLOSED = 0, 1, 2                          # what decides an open request

_REQ, _DONE, _PID, _CODES, _CLOSE, _SUM = (
    "_bt_req", "_bt_done", "_bt_pid", "_bt_codes", "_bt_close", "_bt_sum")
_WAY, _TAIL, _TAIL_AT = "_bt_way", "_bt_tail", "_bt_tail_at"


def _segment_maps(codes: np.ndarray, seg_start: np.ndarray) -> np.ndarray:
    """Per row: the map over states from its segment's start to after the row."""
    comp, idx, step = _TABLE[codes], np.arange(len(codes)), 1
    while step < len(codes):
        valid = idx - step >= seg_start
        earlier = comp[np.where(valid, idx - step, 0)]
        comp = np.where(valid[:, None], np.take_along_axis(comp, earlier, axis=1), comp)
        step *= 2
    return comp


def _decide(t, req, done, before, newseg, pends):
    """Decisions of one batch for one way of arriving.

    ``t`` numbers the distinct times of the batch, ``pends`` is the number of
    the waiting request's time (-1: another, None: nothing waits).  Returns
    (code, index of what decides it, index of the last waiting row so far, first
    row since the last completion, stops), where stops are the rows that decide
    an open request before them."""
    n = len(t)
    idx = np.arange(n)
    bound = newseg.copy()
    bound[0] = True
    bound[1:] |= done[:-1]
    group = np.maximum.accumulate(np.where(bound, idx, 0))   # rows between completions
    waiting = req & (before != IDLE)
    last = np.maximum.accumulate(np.where(waiting, idx, -1))
    prev = np.concatenate([[-1], last[:-1]])
    known = prev >= group
    again = known & (t[prev] == t)
    if pends is not None:
        again |= ~known & (group == 0) & (t == pends)
    newest = waiting & ~again
    stops = newest | done
    upcoming = np.minimum.accumulate(np.where(stops, idx, n)[::-1])[::-1]
    upcoming = np.concatenate([upcoming[1:], [n]])
    segment = np.cumsum(newseg)
    at = np.minimum(upcoming, n - 1)
    met = (upcoming < n) & (segment[at] == segment)
    code = np.zeros(n, np.int64)
    code[req & ~waiting] = _SENT
    code[waiting & ~newest] = _DROP
    code = np.where(newest, np.where(met, np.where(done[at], _STARTED, _DROP),
                                     np.where(segment == segment[-1], _OPEN, _LEFT)), code)
    return code, upcoming, last, group, stops


class _Range:
    """One range, batch by batch.  ``waits`` holds, per way, the time of the
    waiting request (a one-row array, or ``OLDER``), or None."""

    OLDER = "older"

    def __init__(self, keys, ts, pid, first):
        self.keys, self.ts, self.pid, self.first = keys, ts, pid, first
        self.kind = first.schema.field(ts).type
        self.sum_type = pa.struct([
            ("states", pa.list_(pa.int32())), ("waits", pa.list_(pa.string())), ("began", pa.string()),
            ("next", pa.list_(pa.int32())), ("next_at", self.kind), ("whole", pa.bool_()),
            ("last", pa.struct([(f"k{i}", first.schema.field(k).type) for i, k in enumerate(keys)]))])
        self.states = _START.copy()
        self.waits = [None, None, self.OLDER, self.column(first, ts)]
        self.last_key = [self.column(first, k) for k in keys]
        self.held: list[list] = []      # [row, codes, close], open in at least one way
        self.head, self.next, self.next_at = True, np.zeros(_WAYS, np.int64), None

    @staticmethod
    def column(batch, name):
        return batch.column(batch.schema.get_field_index(name))

    def settle(self, way, code, close=None):
        for entry in self.held:
            if entry[1][way] == _OPEN:
                entry[1][way] = code
                entry[2] = close if close is not None else entry[2]

    def rows(self, batch, codes, close):
        packed = (codes << (3 * np.arange(_WAYS))).sum(axis=1).astype(np.int32)
        n = batch.num_rows
        return (batch.append_column(_PID, pa.array(np.full(n, self.pid, np.int32)))
                .append_column(_CODES, pa.array(packed)).append_column(_CLOSE, close)
                .append_column(_SUM, pa.nulls(n, self.sum_type)))

    def settled(self, everything=False):
        for entry in list(self.held):
            if everything or not (entry[1] == _OPEN).any():
                self.held.remove(entry)
                yield self.rows(entry[0], entry[1][None, :],
                                entry[2] if entry[2] is not None else pa.nulls(1, self.kind))

    def read(self, batch):
        n = batch.num_rows
        times = self.column(batch, self.ts)
        req, done = (self.column(batch, c).to_numpy(zero_copy_only=False).astype(bool) for c in (_REQ, _DONE))
        newseg = np.zeros(n, bool)
        moved = np.zeros(n, bool)
        if n > 1:
            for k in self.keys:
                newseg[1:] |= ~_same_adjacent(self.column(batch, k))
            moved[1:] = ~_same_adjacent(times)
        t = np.cumsum(newseg | moved)       # numbers the times of a key
        if not all(_same_value(self.column(batch, k).slice(0, 1), v) for k, v in zip(self.keys, self.last_key)):
            newseg[0], self.head = True, False
            for way in range(_WAYS):
                self.settle(way, _LEFT)
            self.states, self.waits = np.zeros(_WAYS, np.int64), [None] * _WAYS
        pends = [None if w is None else 0 if w is not self.OLDER and _same_value(w, times.slice(0, 1)) else -1
                 for w in self.waits]
        t -= t[0]
        breaks = np.flatnonzero(newseg[1:]) + 1
        first_break = int(breaks[0]) if len(breaks) else n
        idx = np.arange(n)
        comp = _segment_maps(np.where(req, 0, np.where(done, 1, 2)),
                             np.maximum.accumulate(np.where(newseg, idx, 0)))
        before = np.concatenate([np.arange(3)[None, :], comp[:-1]])
        before[newseg] = np.arange(3)
        codes, close = np.zeros((n, _WAYS), np.int64), np.full(n, -1)
        states, waits = self.states.copy(), list(self.waits)
        for way in range(_WAYS):
            start = np.where(idx < first_break, self.states[way], IDLE)
            code, upcoming, last, group, stops = _decide(t, req, done, before[idx, start], newseg, pends[way])
            codes[:, way] = code
            close = np.where(code == _STARTED, upcoming, close)
            stop = np.flatnonzero(stops[:first_break])
            if len(stop):
                closes = bool(done[stop[0]])
                at = times.slice(int(stop[0]), 1) if closes else None
                self.settle(way, _STARTED if closes else _DROP, at)
                if self.head and self.next[way] == _NONE:
                    self.next[way] = _CLOSED if closes else _NEWER
                    self.next_at = at if closes else self.next_at
            elif first_break < n:
                self.settle(way, _LEFT)
            states[way] = comp[-1, start[-1]]
            if states[way] != PENDING:
                waits[way] = None
            elif last[-1] >= group[-1]:
                waits[way] = times.slice(int(last[-1]), 1)
        self.states, self.waits = states, waits
        self.head &= first_break == n
        self.last_key = [self.column(batch, k).slice(n - 1, 1) for k in self.keys]
        yield from self.settled()
        is_open = (codes == _OPEN).any(axis=1)
        for i in np.flatnonzero(is_open):       # at most one per way
            self.held.append([batch.slice(int(i), 1), codes[i].copy(),
                              times.slice(int(close[i]), 1) if close[i] >= 0 else None])
        if not is_open.all():
            keep = np.flatnonzero(~is_open)
            picked = pa.array(np.maximum(close[keep], 0), mask=close[keep] < 0)
            yield self.rows(batch.take(pa.array(keep)), codes[keep], times.take(picked))

    def end(self):
        yield from self.settled(everything=True)
        text = lambda a: None if a is None or a is self.OLDER else a.cast(pa.string())[0].as_py()
        summary = {"states": self.states.tolist(), "waits": [text(w) for w in self.waits],
                   "began": text(self.column(self.first, self.ts)), "next": self.next.tolist(),
                   "whole": self.head}
        parts = [pa.array([summary[f.name]], f.type) if f.name in summary else
                 (self.next_at if self.next_at is not None else pa.nulls(1, self.kind)) if f.name == "next_at" else
                 pa.StructArray.from_arrays(self.last_key, fields=list(f.type)) for f in self.sum_type]
        yield (self.first.append_column(_PID, pa.array([self.pid], pa.int32()))
               .append_column(_CODES, pa.nulls(1, pa.int32())).append_column(_CLOSE, pa.nulls(1, self.kind))
               .append_column(_SUM, pa.StructArray.from_arrays(parts, fields=list(self.sum_type))))


def _ranges(keys: Sequence[str], ts: str):
    def run(batches):
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = _Range(keys, ts, TaskContext.get().partitionId(), batch.slice(0, 1))
            yield from state.read(batch)
        if state is not None:
            yield from state.end()

    return run


def _same(a, b) -> bool:
    return all((pd.isna(x) and pd.isna(y)) or (not pd.isna(x) and not pd.isna(y) and x == y) for x, y in zip(a, b))


def _resolve(n_keys: int):
    """How each range's first key arrives, and what becomes of the request
    that it leaves open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_PID, ignore_index=True)
        firsts = list(zip(*[pdf[f"f{i}"] for i in range(n_keys)]))
        lasts = list(zip(*[pdf[f"l{i}"] for i in range(n_keys)]))
        n = len(pdf)
        joined = [i > 0 and _same(firsts[i], lasts[i - 1]) for i in range(n)]
        way = np.zeros(n, np.int64)
        state, wait = IDLE, None
        for i in range(n):
            if not joined[i]:
                state, wait = IDLE, None
            way[i] = state if state != PENDING else PENDING + int(wait == pdf["began"][i])
            came_in, state = wait, int(pdf["states"][i][way[i]])
            wait = pdf["waits"][i][way[i]] if state == PENDING else None
            if state == PENDING and wait is None:
                wait = came_in
        tail, tail_at, times = [_LEFT] * n, [None] * n, pdf["next_at"].dtype
        for i in range(n - 2, -1, -1):
            if not joined[i + 1]:
                continue
            what = int(pdf["next"][i + 1][way[i + 1]])
            if what == _NEWER:
                tail[i] = _DROP
            elif what == _CLOSED:
                tail[i], tail_at[i] = _STARTED, pdf["next_at"][i + 1]
            elif pdf["whole"][i + 1]:
                tail[i], tail_at[i] = tail[i + 1], tail_at[i + 1]
        return pd.DataFrame({_PID: pdf[_PID], _WAY: way.astype(np.int32), _TAIL: np.array(tail, np.int32),
                             _TAIL_AT: pd.Series(tail_at, dtype=times if times.kind == "M" else object)})

    return run


def latest_wins(events: DataFrame, keys: Sequence[str], is_request: Column, is_completion: Column,
                ts: str, seq: str, partitions: int | None = None, persist_input: bool = False) -> DataFrame:
    """The request rows with ``action`` and ``dispatched_at``; see
    ``operators.builds.dispatch``."""
    checkpoint_dir(events.sparkSession)
    keys = list(keys)
    req = F.coalesce(is_request, F.lit(False))
    work = events.withColumn(_REQ, req).withColumn(_DONE, ~req & F.coalesce(is_completion, F.lit(False)))
    work = work.where(F.col(_REQ) | F.col(_DONE))
    if persist_input:
        # range partitioning samples its input in a first job
        work = work.persist(StorageLevel.MEMORY_AND_DISK)
    by = [*keys, ts, seq]
    ranged = work.repartitionByRange(partitions, *by) if partitions else work.repartitionByRange(*by)
    kind = work.schema[ts].dataType
    summary_type = T.StructType([
        T.StructField("states", T.ArrayType(T.IntegerType())), T.StructField("waits", T.ArrayType(T.StringType())),
        T.StructField("began", T.StringType()), T.StructField("next", T.ArrayType(T.IntegerType())),
        T.StructField("next_at", kind), T.StructField("whole", T.BooleanType()),
        T.StructField("last", T.StructType([T.StructField(f"k{i}", work.schema[k].dataType)
                                            for i, k in enumerate(keys)]))])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in work.schema.fields] + [
        T.StructField(_PID, T.IntegerType()), T.StructField(_CODES, T.IntegerType()),
        T.StructField(_CLOSE, kind), T.StructField(_SUM, summary_type)])
    scanned = _materialise(ranged.sortWithinPartitions(*by).mapInArrow(_ranges(keys, ts), schema))
    if persist_input:
        work.unpersist()
    parts = ["states", "waits", "began", "next", "next_at", "whole"]
    summary = scanned.where(F.col(_SUM).isNotNull()).select(
        F.lit(1).alias("_bt_one"), _PID, *[F.col(k).alias(f"f{i}") for i, k in enumerate(keys)],
        *[F.col(_SUM)["last"][f"k{i}"].alias(f"l{i}") for i in range(len(keys))],
        *[F.col(_SUM)[c].alias(c) for c in parts])
    resolved = summary.groupBy("_bt_one").applyInPandas(_resolve(len(keys)), T.StructType([
        T.StructField(_PID, T.IntegerType()), T.StructField(_WAY, T.IntegerType()),
        T.StructField(_TAIL, T.IntegerType()), T.StructField(_TAIL_AT, kind)]))
    rows = scanned.where(F.col(_SUM).isNull() & F.col(_REQ)).drop(_SUM).join(F.broadcast(resolved), _PID, "left")
    code = F.expr(f"shiftright({_CODES}, 3 * {_WAY}) & 7")
    final = F.when(code == _OPEN, F.col(_TAIL)).otherwise(code)
    at = (F.when(code == _SENT, F.col(ts)).when(code == _STARTED, F.col(_CLOSE))
          .when((code == _OPEN) & (F.col(_TAIL) == _STARTED), F.col(_TAIL_AT)))
    action = (F.when(final == _SENT, "dispatch").when(final == _DROP, "drop")
              .when(final == _STARTED, "dispatch_backlog").otherwise("backlog"))
    return (rows.withColumn("action", action).withColumn("dispatched_at", at)
            .drop(_REQ, _DONE, _PID, _CODES, _CLOSE, _WAY, _TAIL, _TAIL_AT))
