"""Streaming state: two keyed steps, timers, re-delivered messages, snapshots."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchtide.operators import builds
from benchtide.plans.builds import delivered_once
from benchtide.schemas import BUILD_STATES
from benchtide.streaming import jobs, processors

T0 = dt.datetime(2021, 6, 1, tzinfo=dt.timezone.utc)
EVENTS = "ref string, id string, ts timestamp_ntz, seq long, build_state string, sent boolean, arrived timestamp"
COLUMNS = ["ref", "id", "seq", "state_before", "state_after", "accepted", "publish", "out_of_order"]


def event(ref, bid, minutes, seq, state, arrived=None):
    at = T0 + dt.timedelta(minutes=minutes)
    return (ref, bid, at.replace(tzinfo=None), seq, state, state == "REQUESTED",
            T0 + dt.timedelta(minutes=minutes if arrived is None else arrived))


class Feed:
    """A folder that gets one file per delivery, read as a stream."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def deliver(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{self.folder}/src/{self.n:03d}")

    def stream(self):
        return (self.spark.readStream.schema(EVENTS).option("recursiveFileLookup", True)
                .option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/src"))

    def run(self, out):
        jobs.run_available_now(out, f"{self.folder}/out", f"{self.folder}/ck")
        return jobs.read_batches(self.spark, f"{self.folder}/out")

    def state(self, operator=0, variable="build"):
        return jobs.read_state(self.spark, f"{self.folder}/ck", variable, operator)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def random_events(rnd, n):
    """A ref with most of the builds, null ids, unknown states, equal times."""
    return [event("hot" if rnd.random() < .7 else rnd.choice(["a", None]), rnd.choice([*map(str, range(12)), None, "None"]),
                  i // 2, i, rnd.choice(BUILD_STATES + ["SOMETHING", None])) for i in range(n)]


def test_walk_composes_maps():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        codes, state = rnd.integers(0, len(processors._MAPS), n), int(rnd.integers(0, 12))
        before, after = processors.walk(codes, state)
        for i, c in enumerate(codes):
            assert before[i] == state
            state = processors._MAPS[c][state]
            assert after[i] == state


def test_fold_and_live_counts_equal_batch_across_restarts(spark, feed):
    rows = random_events(random.Random(1), 300)
    for lo, hi in ((0, 90), (90, 180)):
        feed.deliver(rows[lo:hi])
    make = lambda: jobs.fold_stream(feed.stream(), ["ref"], "id", dispatched="sent")
    feed.run(make())
    feed.deliver(rows[180:])        # a restart from the checkpoint
    got = feed.run(make())
    batch = builds.build_state_fold(spark.createDataFrame(rows, EVENTS), ["ref", "id"], dispatched="sent")
    plain = lambda df: sorted(map(repr, df.select(*COLUMNS).collect()))
    assert plain(got) == plain(batch)
    snapshot = builds.inflight_snapshot(batch, ["ref", "id"])
    now = jobs.stream_snapshot(spark, f"{feed.folder}/ck", "id")
    assert sorted(map(repr, now.select("ref", "id", "state").collect())) == sorted(map(repr, snapshot.collect()))
    counts = {r.ref: r.builds for r in builds.inflight_counts(now, ["ref"]).collect()}
    live = {}
    for r in builds.live_counts(batch, ["ref"]).orderBy("seq").collect():
        live[r.ref] = r.live
    assert counts == {k: v for k, v in live.items() if v}


def test_builds_of_one_ref_are_spread_over_tasks(spark, feed):
    feed.deliver([event("hot", str(i), i, i, "BUILDING") for i in range(60)])
    out = jobs.fold_stream(feed.stream(), ["ref"], "id").withColumn("task", F.spark_partition_id())
    assert feed.run(out).select("task").distinct().count() > 1


def test_live_counts_as_a_second_step(spark, feed):
    rows = random_events(random.Random(2), 200)
    feed.deliver(rows[:110])
    feed.deliver(rows[110:])
    fold = jobs.fold_stream(feed.stream(), ["ref"], "id", dispatched="sent")
    got = feed.run(jobs.live_stream(fold, ["ref"]))
    batch = builds.build_state_fold(spark.createDataFrame(rows, EVENTS), ["ref", "id"], dispatched="sent")
    pick = lambda df: sorted(map(repr, df.select("ref", "id", "seq", "state_after", "live").collect()))
    assert pick(got) == pick(builds.live_counts(batch, ["ref"]))


def test_state_ends(spark, feed):
    """Ten deliveries of new builds, an hour apart: some finish, some never."""
    sizes = []
    for hour in range(10):
        feed.deliver([event("main", f"{hour}-{k}", 60 * hour + k, 100 * hour + 2 * k + j, s)
                      for k in range(4) for j, s in enumerate(["UPDATING_SOURCE", "UPDATING_SOURCE_FAILED"][:1 + k % 2])])
        if hour in (4, 9):
            fold = jobs.fold_stream(feed.stream().withWatermark("arrived", "1 second"), ["ref"], "id",
                                    clock="arrived", retention="90 minutes")
            got = feed.run(jobs.live_stream(fold, ["ref"]))
            sizes.append(feed.state(operator=1).count())
    assert sizes[0] == sizes[1] and sizes[0] <= 12       # flat: the last builds only
    ended = [r for r in got.collect() if r.expired]
    assert {r.id for r in ended} == {f"{h}-{k}" for h in range(8) for k in (0, 2)}
    assert all(r.state_before == "UPDATING_SOURCE" and r.state_after is None for r in ended)
    # the live count follows: the last four unfinished builds remain
    assert feed.state(operator=0, variable="live").first().n == 4


def test_finals_after_the_end_of_a_record(spark, feed):
    feed.deliver([event("r", "A", 0, 1, "BUILDING"), event("r", "A", 1, 2, "BUILDING_FAILED")])
    feed.deliver([event("r", "other", 300, 3, "BUILDING")])
    # A's record has ended; its final comes again, and B's comes on time
    feed.deliver([event("r", "A", 1, 4, "BUILDING_FAILED", arrived=400), event("r", "B", 400, 5, "BUILDING_FAILED")])
    fold = jobs.fold_stream(feed.stream().withWatermark("arrived", "1 second"), ["ref"], "id",
                            clock="arrived", retention="60 minutes")
    flags = {r.seq: (r.publish, r.out_of_order) for r in feed.run(fold).where("not expired").collect()}
    assert flags == {1: (False, False), 2: (True, False), 3: (False, False), 4: (True, True), 5: (True, False)}


def test_a_message_delivered_twice_counts_once(spark, feed):
    first = [event("r", "A", 0, 1, "BUILDING"), event("r", "A", 1, 2, "BUILDING_FAILED"), event("r", "B", 2, 3, "BUILDING")]
    feed.deliver(first + first[1:2])
    feed.deliver(first[:2] + [event("r", "B", 3, 4, "BUILDING_FAILED")])
    once = delivered_once(feed.stream(), "seq", "1 hour")
    got = feed.run(jobs.fold_stream(once, ["ref"], "id", clock="arrived", retention="1 day"))
    assert sorted((r.seq, r.accepted, r.out_of_order) for r in got.collect()) == [
        (1, True, False), (2, True, False), (3, True, False), (4, True, False)]


def test_orchestrator_frees_a_ref_whose_build_never_ends(spark, tmp_path):
    schema = "ref string, id string, ts timestamp_ntz, seq long, kind string, build_state string, arrived timestamp"
    def row(bid, minutes, seq, kind, state=None):
        at = T0 + dt.timedelta(minutes=minutes)
        return ("main", bid, at.replace(tzinfo=None), seq, kind, state, at)
    parts = [[row("A", 0, 1, "request"), row("A", 1, 2, "state", "UPDATING_SOURCE"), row("B", 2, 3, "request")],
             [("x", "Z", dt.datetime(2021, 6, 1, 5), 4, "request", None, T0 + dt.timedelta(hours=5))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "src" / str(i)))
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "src")).withWatermark("arrived", "1 second"))
    out = jobs.orchestrate_stream(stream, ["ref"], "id", "kind", clock="arrived", retention="2 hours")
    jobs.run_available_now(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = jobs.read_batches(spark, str(tmp_path / "out")).where("kind = 'request'").collect()
    assert sorted((r.id, r.action) for r in got) == [("A", "dispatch"), ("B", "dispatch_backlog"), ("Z", "dispatch")]
    kept = jobs.read_state(spark, str(tmp_path / "ck"), "builds").collect()
    assert sorted((r.ref, r[1]) for r in kept) == [("main", "sB"), ("x", "sZ")]
    assert {(r.ref, r.n) for r in jobs.read_state(spark, str(tmp_path / "ck"), "live").collect()} == {("main", 1), ("x", 1)}
