"""Streaming chain: build-response queue -> fold -> publish -> results."""

import datetime as dt

from pyspark.sql import functions as F

from benchtide.plans import builds as plan
from benchtide.sinks.files import write_queue
from benchtide.sinks.history import read_history

T0 = dt.datetime(2021, 6, 1, 10, 0)
SCHEMA = ("id string, timeStamp timestamp_ntz, buildState string, "
          "buildRequest struct<id:string,timeStamp:timestamp_ntz,repository:string,ref:string,commit:string,author:string>, "
          "buildStats struct<updateSourceTime:bigint,compilationTime:bigint,benchmarkTime:bigint>, "
          "buildDetails array<struct<type:string,detailCompression:string,detailEncoding:string,detail:string>>")


def responses(build, commit, states, start, stats):
    req = (build, T0, "org/repo", "refs/heads/main", commit, "me")
    out = []
    for i, s in enumerate(states):
        last = i == len(states) - 1
        out.append((f"{build}-{i}", T0 + dt.timedelta(seconds=start + 2 * i), s, req,
                    stats if last else None, []))
    return out


def test_response_queue_to_results_history(spark, tmp_path):
    a = responses("A", "abcdef1", ["UPDATING_SOURCE", "UPDATING_SOURCE_COMPLETE", "BUILDING",
                                   "BUILDING_COMPLETE", "BENCHMARKING", "BENCHMARKING_COMPLETE"],
                  0, (1234, 4321, 54321))
    b = responses("B", "1a2b3c4", ["UPDATING_SOURCE", "UPDATING_SOURCE_COMPLETE", "BUILDING",
                                   "BUILDING_FAILED"], 1, (100, -1, -1))
    queue = str(tmp_path / "queue")
    # two arrivals so the fold carries state across micro-batches
    write_queue(spark.createDataFrame(a[:3] + b[:2], SCHEMA).coalesce(1), queue, "build_response")
    write_queue(spark.createDataFrame(a[3:] + b[2:], SCHEMA).coalesce(1), queue, "build_response")
    (tmp_path / "queue" / "bad.txt").write_text('not json\n{"id":"x","buildState":"BUILDING"}\n')

    history, pub, ck = str(tmp_path / "history"), str(tmp_path / "pub"), str(tmp_path / "ck")
    for _ in range(2):   # the second run finds nothing new: no duplicates
        plan.run_results_history(spark, queue, history, pub, ck, max_files_per_trigger=1)
    rows = sorted((r.commit, r.task, r.time) for r in read_history(spark, history).collect())
    assert rows == sorted([("abcdef1", "Update Source", 1234), ("abcdef1", "Compile Source", 4321),
                           ("abcdef1", "Benchmark 1", 54321), ("1a2b3c4", "Update Source", 100),
                           ("1a2b3c4", "Compile Source", -1), ("1a2b3c4", "Benchmark 1", -1)])
    outcomes = spark.read.parquet(pub).select("build_id", "publishState", "out_of_order").collect()
    assert sorted(tuple(r) for r in outcomes) == [("A", "COMPLETE", False), ("B", "COMPLETE", False)]

    # a second job over the same queue adds its own runs and replaces none
    plan.run_results_history(spark, queue, history, pub, str(tmp_path / "ck2"))
    again = sorted((r.commit, r.task, r.time) for r in read_history(spark, history).collect())
    assert again == sorted(rows + rows)

    plan.run_dead_letters(spark, queue, str(tmp_path / "dead"), str(tmp_path / "ck-dead"))
    dead = spark.read.json(str(tmp_path / "dead")).select("reason").collect()
    assert sorted(r.reason for r in dead) == ["invalid JSON", "missing field timeStamp"]


def test_orchestrator_latest_wins(spark, tmp_path):
    from benchtide.streaming import jobs

    def at(s):
        return T0 + dt.timedelta(seconds=s)
    script = [("request", "A", None), ("state", "A", "UPDATING_SOURCE"),
              ("request", "B", None), ("request", "C", None),
              ("state", "A", "UPDATING_SOURCE_COMPLETE"), ("state", "A", "BUILDING"),
              ("state", "A", "BUILDING_FAILED"),
              ("request", "D", None), ("state", "C", "UPDATING_SOURCE"),
              ("state", "C", "UPDATING_SOURCE_FAILED"), ("request", "E", None)]
    rows = [("main", bid, at(i), i, kind, st) for i, (kind, bid, st) in enumerate(script)]
    schema = "ref string, id string, ts timestamp_ntz, seq long, kind string, build_state string"
    src = tmp_path / "src"
    spark.createDataFrame(rows[:6], schema).coalesce(1).write.parquet(str(src / "p1"))
    spark.createDataFrame(rows[6:], schema).coalesce(1).write.parquet(str(src / "p2"))
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).parquet(str(src)))
    out = jobs.orchestrate_stream(stream, ["ref"], "id", "kind")
    jobs.run_available_now(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = jobs.read_batches(spark, str(tmp_path / "out")).toPandas()
    req = {r.id: (r.action, r.dispatched_at) for r in got[got.kind == "request"].itertuples()}
    # D is live (REQUESTED) when E arrives, so E is still waiting: no row yet
    assert set(req) == {"A", "B", "C", "D"}
    assert req["A"] == ("dispatch", at(0)) and req["B"][0] == "drop"
    assert req["C"] == ("dispatch_backlog", at(6)) and req["D"] == ("dispatch_backlog", at(9))
    fold = got[got.kind == "state"].sort_values("seq")
    # C was recorded as REQUESTED when sent, so its first update is accepted
    c_first = fold[(fold.id == "C")].iloc[0]
    assert c_first.state_before == "REQUESTED" and bool(c_first.accepted)
    assert list(fold.publish) == [False, False, False, True, False, True]


def test_intake_stream(spark, tmp_path):
    import json as _json
    import os
    import time

    from benchtide.plans.intake import run_intake_stream
    from benchtide.streaming import jobs

    src = tmp_path / "bodies"
    src.mkdir()

    def payload(ref, after):
        return _json.dumps({"ref": ref, "before": "b" * 40, "after": after,
                            "repository": {"full_name": "org/repo"}, "pusher": {"name": "p"},
                            "sender": {"login": "s"}})
    bodies = [("1.json", payload("refs/heads/main", "c1")), ("2.json", payload("refs/heads/main", "c2")),
              ("3.json", "<not-json/>"), ("4.json", payload("refs/tags/v1", "c3")),
              ("5.json", payload("refs/heads/dev", "c4"))]
    for i, (name, text) in enumerate(bodies):
        path = src / name
        path.write_text(text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    run_intake_stream(spark, str(src), str(tmp_path / "dec"), str(tmp_path / "dead"),
                      str(tmp_path / "ck"), ref_patterns=["refs/heads/.*"])
    dec = jobs.read_batches(spark, str(tmp_path / "dec")).collect()
    got = sorted((r.ref, r.id.rsplit("/", 1)[-1], r.action) for r in dec)
    # main: the first request is sent, the second waits (no row yet); dev: sent
    assert got == [("refs/heads/dev", "5.json", "dispatch"), ("refs/heads/main", "1.json", "dispatch")]
    dead = spark.read.json(str(tmp_path / "dead")).collect()
    assert [(r.queue, r.reason) for r in dead] == [("webhook", "INVALID_JSON")]


def test_intake_stream_frees_a_ref_when_its_build_ends(spark, tmp_path):
    """The second push of a ref is sent once the first build has ended."""
    import json as _json
    import os

    from benchtide.plans.intake import run_intake_stream
    from benchtide.streaming import jobs

    src, queue = tmp_path / "bodies", tmp_path / "responses"
    src.mkdir()
    queue.mkdir()

    def push(name, second):
        path = src / name
        path.write_text(_json.dumps({
            "ref": "refs/heads/main", "before": "b" * 40, "after": name, "repository": {"full_name": "org/repo"},
            "pusher": {"name": "p"}, "sender": {"login": "s"}}))
        os.utime(path, (1_700_000_000 + second, 1_700_000_000 + second))

    push("1.json", 0)
    push("2.json", 1)

    def run():
        run_intake_stream(spark, str(src), str(tmp_path / "dec"), str(tmp_path / "dead"), str(tmp_path / "ck"),
                          responses=str(queue))
        rows = jobs.read_batches(spark, str(tmp_path / "dec")).where("kind = 'request'").collect()
        return sorted((r.id.rsplit("/", 1)[-1], r.action, r.id) for r in rows)

    ((name, action, first),) = run()
    assert (name, action) == ("1.json", "dispatch")
    states = ["UPDATING_SOURCE", "UPDATING_SOURCE_FAILED"]
    request = {"id": first, "timeStamp": "2023-11-14T22:13:20Z[UTC]", "repository": "org/repo",
               "ref": "refs/heads/main", "commit": "c", "author": "p"}
    (queue / "a.jsonl").write_text("".join(_json.dumps(
        {"id": f"m{i}", "timeStamp": f"2023-11-14T22:14:0{i}Z[UTC]", "buildState": s, "buildRequest": request}) + "\n"
        for i, s in enumerate(states)))
    assert [r[:2] for r in run()] == [("1.json", "dispatch"), ("2.json", "dispatch_backlog")]
