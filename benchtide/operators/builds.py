"""Batch form of the build bookkeeping: state fold (J-1), dispatch (J-2),
publish routing (J-3), latest request per key (D-5), phase durations (D-6)
and the in-flight snapshot (D-7).

The per-key sequential parts run on ``keyed_scan`` (range-partitioned, so a
hot ref is split over many tasks); everything else is partial aggregates.
Event order is ``(ts, seq)``: ``seq`` is the arrival order tie-breaker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.operators.decide import latest_wins
from benchtide.operators.scan import keyed_scan
from benchtide.operators.states import state_index
from benchtide.schemas import BUILD_STATES, FINAL_STATES, PREV_STATE, UPDATE_SUCCESS_STATES

# fold states: 0 = no build recorded, i = BUILD_STATES[i - 1]
_N_STATES = len(BUILD_STATES) + 1
_DISPATCH_CODE = len(BUILD_STATES)


def _idx(state: str | None) -> int:
    return 0 if state is None else BUILD_STATES.index(state) + 1


def fold_table() -> list[list[int]]:
    """Transition table of the build-state fold.

    A success-update event S creates the build in S when none is recorded
    and moves it to S from prev(S); a final event removes the build when it
    is absent or in prev(S); anything else leaves it as it is.  The last code
    is a dispatched request: absent (or requesting) becomes REQUESTED.
    """
    rows = []
    for s in BUILD_STATES:
        row = list(range(_N_STATES))
        prev = PREV_STATE[s]
        if s in UPDATE_SUCCESS_STATES:
            target = _idx(s)
        elif s in FINAL_STATES:
            target = 0
        else:
            rows.append(row)
            continue
        row[0] = target
        if prev is not None:
            row[_idx(prev)] = target
        rows.append(row)
    dispatch = list(range(_N_STATES))
    dispatch[0] = _idx("REQUESTED")
    dispatch[_idx("REQUESTING")] = _idx("REQUESTED")
    rows.append(dispatch)
    return rows


def state_name(idx: Column) -> Column:
    """Name of a fold state (0: none, null)."""
    names = F.array(F.lit(None).cast("string"), *[F.lit(s) for s in BUILD_STATES])
    return F.element_at(names, idx + 1)


def build_state_fold(events: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq",
                     state: str = "build_state", dispatched: str | None = None,
                     partitions: int | None = None) -> DataFrame:
    """J-1 (+D-2): apply every state event to its build, in order.

    Adds ``state_before`` / ``state_after`` (null = no build recorded),
    ``accepted`` (the event changed or removed the build), ``publish`` (a
    final event: every one yields a publish request) and ``out_of_order``
    (a final event for a build that already had one).  When ``dispatched``
    names a boolean column, those rows are dispatched requests.
    """
    table = fold_table()
    code = state_index(state) - 1
    if dispatched is not None:
        code = F.when(F.col(dispatched), F.lit(_DISPATCH_CODE)).otherwise(code)
    final = F.col(state).isin(FINAL_STATES)
    if dispatched is not None:
        final = final & ~F.col(dispatched)
    scanned = keyed_scan(events, keys, [ts, seq], code=code, table=table, flag=final,
                         state_col="_before", count_col="_finals", partitions=partitions)
    flat = F.array(*[F.lit(v) for row in table for v in row])
    code_now = F.coalesce(code, F.lit(len(table)))
    after = F.when(code_now < len(table),
                   F.try_element_at(flat, code_now * _N_STATES + F.col("_before") + 1)
                   ).otherwise(F.col("_before"))
    prev_idx = F.try_element_at(
        F.array(*[F.lit(_idx(PREV_STATE[s]) if PREV_STATE[s] else -1) for s in BUILD_STATES]),
        F.greatest(code_now, F.lit(0)) + 1)
    changes = F.col(state).isin(UPDATE_SUCCESS_STATES + FINAL_STATES)
    if dispatched is not None:
        changes = changes & ~F.col(dispatched)
    accepted = changes & ((F.col("_before") == 0) | (F.col("_before") == prev_idx))
    if dispatched is not None:
        accepted = accepted | (F.col(dispatched) & (F.col("_before") <= _idx("REQUESTING")))
    return (scanned
            .withColumn("state_after", state_name(after))
            .withColumn("state_before", state_name(F.col("_before")))
            .withColumn("accepted", F.coalesce(accepted, F.lit(False)))
            .withColumn("publish", F.coalesce(final, F.lit(False)))
            .withColumn("out_of_order", F.coalesce(final & (F.col("_finals") > 0), F.lit(False)))
            .drop("_before", "_finals"))


def live_step() -> Column:
    """Of a fold row: 1 where a build begins to be recorded, -1 where it ends."""
    return (F.col("state_after").isNotNull().cast("long") - F.col("state_before").isNotNull().cast("long"))


def live_counts(fold: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq",
                partitions: int | None = None) -> DataFrame:
    """The fold rows where a build of the key begins or ends, with ``live``:
    how many are recorded from then on."""
    rows = fold.where(live_step() != 0).withColumn("_step", live_step())
    counted = keyed_scan(rows, keys, [ts, seq], flag=F.col("_step"), state_col=None,
                         count_col="_live", partitions=partitions)
    return counted.withColumn("live", F.col("_live") + F.col("_step")).drop("_live", "_step")


def publish_requests(fold: DataFrame) -> DataFrame:
    """J-3: one publish request per final event, accepted or not."""
    return fold.filter(F.col("publish"))


def dispatch(events: DataFrame, keys: Sequence[str], is_request: Column, is_completion: Column,
             ts: str = "ts", seq: str = "seq", mode: str = "latest",
             partitions: int | None = None, persist_input: bool = False) -> DataFrame:
    """J-2: decide, per request row, whether and when its build is sent.

    ``mode="all"``: every request is sent on arrival.  ``mode="latest"``: a
    request is sent on arrival when its key is idle; while a build runs only
    the newest waiting request (latest ``ts``, earlier arrival on a tie) is
    kept and sent when the running build completes; the others are dropped;
    one still waiting at the end stays in the backlog.  ``persist_input``
    keeps an expensive input plan between Spark's sampling of it and the scan.
    The decisions are made in one pass (see ``operators.decide``).

    Returns the request rows with ``action`` in (dispatch, dispatch_backlog,
    drop, backlog) and ``dispatched_at``.
    """
    if mode == "all":
        return (events.filter(is_request)
                .withColumn("action", F.lit("dispatch"))
                .withColumn("dispatched_at", F.col(ts)))
    if mode != "latest":
        raise ValueError(f"unknown dispatch mode {mode!r}")
    return latest_wins(events, keys, is_request, is_completion, ts, seq, partitions, persist_input)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """D-5: the newest row per key; on equal ``ts`` the earlier-arrived stays.

    A max over a struct is a partial aggregate, so one hot key is combined
    map-side instead of being sorted in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(ts).alias("_t"), (-F.col(seq)).alias("_s"),
                          *[F.col(c).alias(c) for c in rest]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


# phase -> (start state, end states) for the elapsed-time columns
PHASES = {
    "updateSourceTime": ("UPDATING_SOURCE", ["UPDATING_SOURCE_COMPLETE", "UPDATING_SOURCE_FAILED"]),
    "compilationTime": ("BUILDING", ["BUILDING_COMPLETE", "BUILDING_FAILED"]),
    "benchmarkTime": ("BENCHMARKING", ["BENCHMARKING_COMPLETE", "BENCHMARKING_FAILED"]),
}


def phase_durations(events: DataFrame, keys: Sequence[str], ts: str = "ts",
                    state: str = "build_state", finished: str | None = None) -> DataFrame:
    """D-6: elapsed ms per phase from the state log: from the last start that
    is not after the phase's latest end to that end; -1 when there is no such
    start or no end.  ``finished`` names an extra column with the build's last
    event time.  Both steps are partial aggregates, so no build's events meet
    in one place; null keys form a group."""
    keys = list(keys)
    when = F.col(ts).cast("timestamp")   # also accepts TIMESTAMP_NTZ
    ends = [F.max(F.when(F.col(state).isin(done), when)).alias(f"_end_{name}")
            for name, (_, done) in PHASES.items()]
    if finished:
        ends.append(F.max(ts).alias(finished))
    per_build = events.groupBy(*keys).agg(*ends)
    side = per_build.select(*[F.col(k).alias(f"_bk{i}") for i, k in enumerate(keys)],
                            *[f"_end_{name}" for name in PHASES])
    started = events.where(F.col(state).isin([start for start, _ in PHASES.values()]))
    joined = started.join(side, [started[k].eqNullSafe(side[f"_bk{i}"]) for i, k in enumerate(keys)])
    starts = joined.groupBy(*keys).agg(*[
        F.max(F.when((F.col(state) == start) & (when <= F.col(f"_end_{name}")), when)).alias(f"_start_{name}")
        for name, (start, _) in PHASES.items()])
    starts = starts.select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)],
                           *[f"_start_{name}" for name in PHASES])
    both = per_build.join(starts, [per_build[k].eqNullSafe(starts[f"_sk{i}"]) for i, k in enumerate(keys)], "left")
    return both.select(
        *keys, *([finished] if finished else []),
        *[F.coalesce(F.unix_millis(F.col(f"_end_{name}")) - F.unix_millis(F.col(f"_start_{name}")),
                     F.lit(-1)).alias(name) for name in PHASES])


def inflight_snapshot(fold: DataFrame, keys: Sequence[str], ts: str = "ts",
                      seq: str = "seq") -> DataFrame:
    """D-7: builds still recorded after the last event, with their state."""
    last = latest_per_key(fold.select(*keys, ts, seq, "state_after"), keys, ts, seq)
    return last.filter(F.col("state_after").isNotNull()).select(
        *keys, F.col("state_after").alias("state"))


def inflight_counts(snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many builds of each key (the ref) a snapshot holds: ``builds``."""
    return snapshot.groupBy(*keys).agg(F.count(F.lit(1)).alias("builds"))


def attach_build_state(requests: DataFrame, fold: DataFrame, keys: Sequence[str],
                       ts: str = "ts", seq: str = "seq", name: str = "build_state_now") -> DataFrame:
    """D-2 (batch): each request row gets its build's current state (after
    the build's last event; null when none is recorded).  The state side is
    one row per build (a partial aggregate), joined on the build keys."""
    keys = list(keys)
    now = latest_per_key(fold.select(*keys, ts, seq, "state_after"), keys, ts, seq)
    now = now.select(*[F.col(k).alias(f"_nk{i}") for i, k in enumerate(keys)],
                     F.col("state_after").alias(name))
    cond = [requests[k].eqNullSafe(now[f"_nk{i}"]) for i, k in enumerate(keys)]
    return requests.join(now, cond, "left").drop(*[f"_nk{i}" for i in range(len(keys))])
