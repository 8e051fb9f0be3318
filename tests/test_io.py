"""Sources and sinks: payload files, queues, results history, chart points,
log files and changed assets."""

import datetime as dt
import json

from pyspark.sql import functions as F

from benchtide.operators import results
from benchtide.sinks import files as sinks
from benchtide.sinks.assets import changed_assets
from benchtide.sinks.deadletter import decode_messages
from benchtide.sources import files as sources

T = dt.datetime(2021, 6, 1, 10, 0)


def test_payload_source_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "ref": "refs/heads/main"\n}\n')
    (tmp_path / "b.json").write_text("<not-json/>")
    got = sorted(r.body for r in sources.read_payloads(spark, str(tmp_path)).collect())
    assert got == ["<not-json/>", '{\n "ref": "refs/heads/main"\n}\n']


def test_queue_roundtrip(spark, tmp_path):
    req = spark.createDataFrame([("r1", T, "repo", "refs/heads/main", "abc", "me")],
                                "id string, timeStamp timestamp_ntz, repository string, ref string,"
                                " commit string, author string")
    sinks.write_queue(req, str(tmp_path / "q"), "build_request")
    raw = sources.read_queue(spark, str(tmp_path / "q"))
    assert json.loads(raw.collect()[0].value)["timeStamp"] == "2021-06-01T10:00Z[UTC]"
    ok, dead = decode_messages(raw, "value", "build_request", "q")
    r = ok.collect()[0]
    assert (r.id, r.commit, dead.count()) == ("r1", "abc", 0)


def test_results_history_append_and_read(spark, tmp_path):
    pub = spark.createDataFrame([("abcdef1", T, (1234, 4321, 54321)), ("x", T, None)],
                                "commit string, date timestamp_ntz, "
                                "buildStats struct<updateSourceTime:bigint,compilationTime:bigint,benchmarkTime:bigint>")
    rows = results.results_rows(pub)
    path = str(tmp_path / "history")
    sinks.write_results(rows, path)
    sinks.write_results(rows, path)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "history").glob("part-*.csv")))
    assert raw.startswith(b"task,commit,date,time\r\n") and b"2021-06-01T10:00:00.000+0000" in raw
    back = sources.read_results(spark, path)
    got = sorted((r.task, r.time) for r in back.collect())
    assert got == sorted([("Update Source", 1234), ("Compile Source", 4321), ("Benchmark 1", 54321)] * 2)
    assert back.select(F.max("date")).collect()[0][0].replace(tzinfo=None) == T
    states = {r.commit: r.publishState for r in results.publish_state(pub).collect()}
    assert states == {"abcdef1": "COMPLETE", "x": "FAILED"}


def test_unpivot_keeps_not_measured(spark):
    df = spark.createDataFrame([("c", T, 100, -1, -1)], "commit string, date timestamp_ntz, "
                               "updateSourceTime bigint, compilationTime bigint, benchmarkTime bigint")
    got = [(r.task, r.time) for r in results.unpivot_timings(df, ["commit", "date"]).collect()]
    assert got == [("Update Source", 100), ("Compile Source", -1), ("Benchmark 1", -1)]


def test_chart_points_source(spark, tmp_path):
    pts = [{"task": "Compile", "commit": "abcdef1", "date": "2000-01-01T10:00:00.000Z", "time": 1100}]
    (tmp_path / "points.json").write_text(json.dumps(pts))
    r = sources.read_chart_points(spark, str(tmp_path / "points.json")).collect()[0]
    assert (r.task, r.time) == ("Compile", 1100.0)
    assert r.date.replace(tzinfo=None) == dt.datetime(2000, 1, 1, 10)


def test_log_files_skip_empty_and_parse_names(spark, tmp_path):
    (tmp_path / "b1.build.stdout.20210601100000.log").write_bytes(b"compiling\n")
    (tmp_path / "b1.build.stderr.20210601100000.log").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"ignored")
    rows = sources.read_log_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.build_id, r.phase, r.stream, bytes(r.content)) == ("b1", "build", "stdout", b"compiling\n")


def test_changed_assets(spark):
    shipped = spark.createDataFrame([("a.html", "A2"), ("b.js", "B"), ("c.css", "C")], "name string, content string")
    current = spark.createDataFrame([("a.html", "A1"), ("b.js", "B")], "name string, content string")
    got = sorted((r.name, r.change) for r in changed_assets(shipped, current).collect())
    assert got == [("a.html", "changed"), ("c.css", "new")]


def test_payload_source_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"ref": "refs/heads/main"}')
    (src / "b.json").write_text("[1,\n2]")
    stream = sources.read_payloads(spark, str(src), stream=True)
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ['[1,\n2]', '{"ref": "refs/heads/main"}']


def test_queue_sink_stream_and_outcome_split(spark, tmp_path):
    from benchtide.operators.states import publish_outcome_counts, split_publish_outcomes

    schema = "id string, timeStamp timestamp_ntz, repository string, ref string, commit string, author string"
    spark.createDataFrame([("r1", T, "repo", "refs/heads/main", "abc", "me"),
                           ("r2", T, "repo", "refs/heads/dev", "def", "me")], schema) \
        .write.parquet(str(tmp_path / "src"))
    q = sinks.write_queue_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "src")),
                                 str(tmp_path / "q"), "build_request", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    ok, dead = decode_messages(sources.read_queue(spark, str(tmp_path / "q")), "value",
                               "build_request", "q")
    assert sorted(r.id for r in ok.collect()) == ["r1", "r2"] and dead.count() == 0
    resp = spark.createDataFrame([("a", "COMPLETE"), ("b", "FAILED"), ("c", None)],
                                 "id string, publishState string")
    done, other = split_publish_outcomes(resp)
    assert (done.count(), other.count()) == (1, 2)
    assert {r.outcome: r.n for r in publish_outcome_counts(resp).collect()} == {"COMPLETE": 1, "OTHER": 2}
