"""The results history as committed appends (B-2, A-3).

An append writes its rows, in the history's CSV form, to a folder of its own
with one sub-folder per day, ``data/run=<run>/day=<yyyy-MM-dd>``, and then puts
its manifest ``commits/<run>.json`` in place by a rename.  Rows without a
manifest are invisible, so an append that was killed leaves nothing; the same
run written again (a replayed micro-batch) replaces its own folder only.  A
compaction is an append whose manifest names the runs that it replaces, so one
rename makes the new files visible and the old ones invisible.  A filter on
``day`` reads the folders of those days alone.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.functions.times import CSV_DATE_FORMAT
from benchtide.schemas import BENCHMARK_RESULT

_MANIFEST = "run string, replaces array<string>"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, history: str, run: str, replaces: list[str]) -> None:
    target, system = _path(spark, f"{history}/commits/{run}.json")
    draft, _ = _path(spark, f"{history}/commits/.{run}.{uuid.uuid4().hex}")
    system.mkdirs(target.getParent())
    out = system.create(draft, True)
    out.write(bytearray(json.dumps({"run": run, "replaces": replaces}).encode()))
    out.close()
    if not system.rename(draft, target):
        system.delete(draft, False)
        if not system.exists(target):
            raise RuntimeError(f"could not commit {run}")


def write_run(rows: DataFrame, history: str, run: str) -> None:
    """The rows of a run, not yet visible.  Each day's rows come in few files,
    however the input is cut; a day that is too large for a file is cut in
    several."""
    if not re.fullmatch(r"[\w-]+", run):
        raise ValueError(f"not a run name: {run!r}")
    typed = rows.select("task", "commit", F.col("date").cast("timestamp").alias("date"),
                        F.col("time").cast("long").alias("time"), F.to_date("date").alias("day"))
    (typed.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").option("header", True)
     .option("lineSep", "\r\n").option("timestampFormat", CSV_DATE_FORMAT).csv(f"{history.rstrip('/')}/data/run={run}"))


def append_results(rows: DataFrame, history: str, run: str | None = None,
                   replaces: list[str] | None = None) -> str:
    """Append ``task, commit, date, time`` rows as one committed run.  ``run``
    names it (letters, digits, ``-``, ``_``); by default a new name."""
    run = run or uuid.uuid4().hex
    write_run(rows, history, run)
    _commit(rows.sparkSession, history.rstrip("/"), run, replaces or [])
    return run


def committed_runs(spark: SparkSession, history: str) -> DataFrame:
    """(run): the committed runs that no other committed run replaces."""
    target, system = _path(spark, f"{history.rstrip('/')}/commits")
    if not system.exists(target):
        return spark.createDataFrame([], "run string")
    commits = spark.read.schema(_MANIFEST).json(f"{history.rstrip('/')}/commits")
    gone = commits.select(F.explode("replaces").alias("run"))
    return commits.select("run").join(gone, "run", "left_anti")


def read_history(spark: SparkSession, history: str) -> DataFrame:
    """A-3: the rows of all committed runs, with their ``day``.  A filter on
    ``day`` prunes folders; runs are joined by name, the manifests' side being
    one small row per run."""
    history = history.rstrip("/")
    target, system = _path(spark, f"{history}/data")
    if not system.exists(target):
        return spark.createDataFrame([], BENCHMARK_RESULT).withColumn("day", F.to_date("date"))
    schema = BENCHMARK_RESULT.simpleString()[len("struct<"):-1].replace(":", " ")
    rows = (spark.read.schema(f"{schema}, day date, run string").option("header", True)
            .option("timestampFormat", CSV_DATE_FORMAT).csv(f"{history}/data"))
    return rows.join(committed_runs(spark, history), "run", "left_semi").drop("run")


def compact_history(spark: SparkSession, history: str, remove: bool = False) -> str | None:
    """Write the committed rows again as one run with few files a day, which
    replaces the runs there were; with ``remove``, the replaced folders go (no
    reader may be in the middle of them).  Returns the new run."""
    runs = [r["run"] for r in committed_runs(spark, history).collect()]     # one row per append
    if len(runs) < 2:
        return None
    run = append_results(read_history(spark, history).drop("day"), history, replaces=runs)
    for old in runs if remove else []:
        target, system = _path(spark, f"{history.rstrip('/')}/data/run={old}")
        system.delete(target, True)
    return run
