"""The results history: committed runs, killed appends, compaction, pruning."""

import datetime as dt

from pyspark.sql import functions as F

from benchtide.sinks import history

D0 = dt.datetime(2024, 3, 1, 12)


def rows(spark, n, tag, days=3):
    return spark.createDataFrame([("Update Source", f"{tag}{i}", D0 + dt.timedelta(days=i % days), i) for i in range(n)],
                                 "task string, commit string, date timestamp, time long")


def commits(spark, path):
    return sorted(r["commit"] for r in history.read_history(spark, path).collect())


def test_only_committed_runs_are_seen(spark, tmp_path):
    path = str(tmp_path / "h")
    assert history.read_history(spark, path).count() == 0
    history.write_run(rows(spark, 4, "killed"), path, "one")
    assert commits(spark, path) == []
    history.append_results(rows(spark, 3, "a"), path, "one")
    history.append_results(rows(spark, 2, "b"), path, "two")
    history.append_results(rows(spark, 3, "a"), path, "one")        # replayed
    history.write_run(rows(spark, 4, "killed"), path, "three")
    assert commits(spark, path) == ["a0", "a1", "a2", "b0", "b1"]
    text = next((tmp_path / "h" / "data" / "run=two" / "day=2024-03-01").glob("*.csv")).read_bytes()
    assert text.startswith(b"task,commit,date,time\r\n") and text.endswith(b"\r\n")


def test_compaction_replaces_runs_at_once(spark, tmp_path):
    path = str(tmp_path / "h")
    for i in range(5):
        history.append_results(rows(spark, 6, f"r{i}-").repartition(4), path)
    before = commits(spark, path)
    run = history.compact_history(spark, path)
    assert commits(spark, path) == before and len(before) == 30
    assert [r.run for r in history.committed_runs(spark, path).collect()] == [run]
    files = list((tmp_path / "h" / "data" / f"run={run}").rglob("*.csv"))
    assert len(files) == 3      # one a day
    assert history.compact_history(spark, path) is None
    history.append_results(rows(spark, 1, "late"), path)
    history.compact_history(spark, path, remove=True)
    assert commits(spark, path) == sorted(before + ["late0"])
    assert len(list((tmp_path / "h" / "data").glob("run=*"))) == 6      # five of the first round, and the last


def test_a_day_reads_its_own_folders(spark, tmp_path, capsys):
    path = str(tmp_path / "h")
    history.append_results(rows(spark, 9, "a"), path)
    day = history.read_history(spark, path).where(F.col("day") == F.lit(dt.date(2024, 3, 2)))
    day.explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out
    assert sorted(r["commit"] for r in day.collect()) == ["a1", "a4", "a7"]
