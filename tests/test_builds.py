"""State fold, dispatch and related goldens (event sequences from the
reference's integration tests and the dispatch rules), plus batch vs stream."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from benchtide.operators import builds
from benchtide.operators.states import prev_state, state_class
from benchtide.streaming import jobs

T0 = dt.datetime(2021, 6, 1, 10, 0, 0)

OK_SEQ = ["UPDATING_SOURCE", "UPDATING_SOURCE_COMPLETE", "BUILDING", "BUILDING_COMPLETE",
          "BENCHMARKING", "BENCHMARKING_COMPLETE"]


def fold(spark, seq, ref="refs/heads/main", bid="b1"):
    rows = [(ref, bid, T0 + dt.timedelta(seconds=i), i, s) for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "ref string, id string, ts timestamp, seq long, build_state string")
    return builds.build_state_fold(df, ["ref", "id"], "ts", "seq").orderBy("seq").collect()


def test_complete_build_publishes_once(spark):
    out = fold(spark, OK_SEQ)
    assert [r.publish for r in out] == [False] * 5 + [True]
    assert all(r.accepted for r in out)
    assert out[-1].state_after is None and not out[-1].out_of_order


@pytest.mark.parametrize("seq", [
    ["UPDATING_SOURCE", "UPDATING_SOURCE_FAILED"],
    ["UPDATING_SOURCE", "UPDATING_SOURCE_COMPLETE", "BUILDING", "BUILDING_FAILED"],
    OK_SEQ[:5] + ["BENCHMARKING_FAILED"],
])
def test_failed_build_publishes_once(spark, seq):
    out = fold(spark, seq)
    assert sum(r.publish for r in out) == 1 and out[-1].publish


def test_run_on_after_failure_publishes_twice_out_of_order(spark):
    seq = ["UPDATING_SOURCE", "UPDATING_SOURCE_COMPLETE", "BUILDING", "BUILDING_FAILED",
           "BENCHMARKING", "BENCHMARKING_COMPLETE"]
    out = fold(spark, seq)
    pubs = [r for r in out if r.publish]
    assert len(pubs) == 2 and [r.out_of_order for r in pubs] == [False, True]
    # the removed build is re-created by the update event
    assert out[4].state_before is None and out[4].state_after == "BENCHMARKING"


def test_wrong_predecessor_is_ignored(spark):
    out = fold(spark, ["UPDATING_SOURCE", "BUILDING_COMPLETE", "UPDATING_SOURCE_COMPLETE"])
    assert out[1].accepted is False and out[1].state_after == "UPDATING_SOURCE"
    assert out[2].state_after == "UPDATING_SOURCE_COMPLETE"


def test_dispatched_request_then_events(spark):
    rows = [("r", "b", T0, 0, None, True)] + [
        ("r", "b", T0 + dt.timedelta(seconds=i + 1), i + 1, s, False) for i, s in enumerate(OK_SEQ)]
    df = spark.createDataFrame(rows, "ref string, id string, ts timestamp, seq long, build_state string, req boolean")
    out = builds.build_state_fold(df, ["ref", "id"], "ts", "seq", dispatched="req").orderBy("seq").collect()
    assert out[0].state_after == "REQUESTED" and out[0].accepted
    assert out[1].state_before == "REQUESTED" and out[1].accepted
    assert out[-1].publish and out[-1].state_after is None


def test_state_class_and_prev(spark):
    df = spark.createDataFrame([("REQUESTED",), ("BUILDING",), ("BUILDING_FAILED",),
                                ("BENCHMARKING_COMPLETE",), ("BOGUS",)], "s string")
    got = [(r[0], r[1]) for r in df.select(state_class("s"), prev_state("s")).collect()]
    assert got == [("NONE", "REQUESTING"), ("UPDATE", "UPDATING_SOURCE_COMPLETE"),
                   ("FAILURE", "BUILDING"), ("SUCCESS", "BENCHMARKING"), ("NONE", None)]


def dispatch_rows(spark, seq, ts=None):
    ts = ts or list(range(len(seq)))
    rows = [("ref", T0 + dt.timedelta(seconds=t), i, k) for i, (k, t) in enumerate(zip(seq, ts))]
    df = spark.createDataFrame(rows, "ref string, ts timestamp, seq long, kind string")
    out = builds.dispatch(df, ["ref"], F.col("kind") == "R", F.col("kind") == "C", "ts", "seq")
    return {r.seq: (r.action, r.dispatched_at) for r in out.collect()}


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_dispatch_goldens(spark):
    # R1 R2 R3 C C -> R1 at R1, R3 at the first C, R2 dropped
    assert dispatch_rows(spark, "RRRCC") == {0: ("dispatch", at(0)), 1: ("drop", None),
                                             2: ("dispatch_backlog", at(3))}
    # R1 C R2 -> both sent on arrival
    assert dispatch_rows(spark, "RCR") == {0: ("dispatch", at(0)), 2: ("dispatch", at(2))}
    # R1 R2 -> R2 waits in the backlog
    assert dispatch_rows(spark, "RR") == {0: ("dispatch", at(0)), 1: ("backlog", None)}
    # C R1 -> R1 sent
    assert dispatch_rows(spark, "CR") == {1: ("dispatch", at(1))}
    # equal timestamps R2 = R3 -> the earlier-arrived R2 stays
    assert dispatch_rows(spark, "RRRC", [0, 1, 1, 2]) == {
        0: ("dispatch", at(0)), 1: ("dispatch_backlog", at(2)), 2: ("drop", None)}


def simulate_dispatch(kinds):
    busy, pend, out = False, None, {}
    for i, k in enumerate(kinds):
        if k == "R":
            if not busy:
                out[i] = "dispatch"
                busy = True
            else:
                if pend is not None:
                    out[pend] = "drop"
                pend = i
        elif k == "C":
            if pend is not None:
                out[pend] = "dispatch_backlog"
                pend = None
            else:
                busy = False
    if pend is not None:
        out[pend] = "backlog"
    return out


def test_dispatch_random_sequences(spark):
    rnd = random.Random(7)
    rows, expected = [], {}
    for key in range(60):
        kinds = "".join(rnd.choice("RRC.") for _ in range(rnd.randint(1, 40)))
        for s, a in simulate_dispatch(kinds).items():
            expected[(key, s)] = a
        rows += [(key, T0 + dt.timedelta(seconds=i), i, k) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "key int, ts timestamp, seq long, kind string")
    out = builds.dispatch(df, ["key"], F.col("kind") == "R", F.col("kind") == "C", "ts", "seq",
                          partitions=6)
    assert {(r.key, r.seq): r.action for r in out.collect()} == expected


def test_latest_per_key_tie_keeps_earlier(spark):
    df = spark.createDataFrame([("a", T0, 1, "x"), ("a", T0, 2, "y"), ("a", at(-5), 3, "z"),
                                ("b", at(1), 4, "w")], "ref string, ts timestamp, seq long, v string")
    got = {r.ref: r.v for r in builds.latest_per_key(df, ["ref"], "ts", "seq").collect()}
    assert got == {"a": "x", "b": "w"}


def test_phase_durations_default_minus_one(spark):
    rows = [("b", at(0), "UPDATING_SOURCE"), ("b", at(2), "UPDATING_SOURCE_COMPLETE"),
            ("b", at(3), "BUILDING"), ("b", at(4), "BUILDING_FAILED")]
    df = spark.createDataFrame(rows, "id string, ts timestamp, build_state string")
    r = builds.phase_durations(df, ["id"]).collect()[0]
    assert (r.updateSourceTime, r.compilationTime, r.benchmarkTime) == (2000, 1000, -1)


def test_phase_durations_pair_each_end_with_the_start_before_it(spark):
    rows = [("b", at(0), "BUILDING"), ("b", at(4), "BUILDING_FAILED"), ("b", at(9), "BUILDING"),
            ("c", at(5), "BUILDING"), ("c", at(3), "BUILDING_COMPLETE"), (None, at(1), "BUILDING"),
            (None, at(2), "BUILDING_COMPLETE")]
    df = spark.createDataFrame(rows, "id string, ts timestamp, build_state string")
    got = {r.id: r.compilationTime for r in builds.phase_durations(df, ["id"]).collect()}
    assert got == {"b": 4000, "c": -1, None: 1000}


def test_stream_fold_matches_batch_and_survives_restart(spark, tmp_path):
    rnd = random.Random(3)
    states = OK_SEQ + ["BUILDING_FAILED", "UPDATING_SOURCE_FAILED", "REQUESTED"]
    rows = [(f"r{rnd.randint(0, 4)}", f"b{rnd.randint(0, 6)}", T0 + dt.timedelta(seconds=i), i,
             rnd.choice(states)) for i in range(600)]
    schema = "ref string, id string, ts timestamp, seq long, build_state string"
    df = spark.createDataFrame(rows, schema)
    batch = builds.build_state_fold(df, ["ref", "id"], "ts", "seq").toPandas()
    src = tmp_path / "src"
    # two arrivals: the second run restarts from the checkpoint
    spark.createDataFrame(rows[:300], schema).write.parquet(str(src / "part1"))
    folded = jobs.fold_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True)
                              .parquet(str(src)), ["ref"], "id", "ts", "seq", "build_state")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    jobs.run_available_now(folded, out, ck)
    spark.createDataFrame(rows[300:], schema).write.parquet(str(src / "part2"))
    folded = jobs.fold_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True)
                              .parquet(str(src)), ["ref"], "id", "ts", "seq", "build_state")
    jobs.run_available_now(folded, out, ck)
    stream = jobs.read_batches(spark, out).toPandas()
    cols = ["seq", "state_before", "state_after", "accepted", "publish", "out_of_order"]
    a = batch[cols].sort_values("seq").reset_index(drop=True)
    b = stream[cols].sort_values("seq").reset_index(drop=True)
    pd.testing.assert_frame_equal(a.astype(object).where(a.notna(), None),
                                  b.astype(object).where(b.notna(), None), check_dtype=False)


def test_dispatch_null_key_is_a_group(spark):
    rows = [(None, T0 + dt.timedelta(seconds=i), i, k) for i, k in enumerate("RRRC")]
    df = spark.createDataFrame(rows, "ref string, ts timestamp, seq long, kind string")
    out = builds.dispatch(df, ["ref"], F.col("kind") == "R", F.col("kind") == "C", "ts", "seq")
    assert {r.seq: r.action for r in out.collect()} == {0: "dispatch", 1: "drop", 2: "dispatch_backlog"}
