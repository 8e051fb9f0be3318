"""Build timings -> results history rows (E-3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.schemas import RESULT_TASKS

# build_stats field feeding each results-history task, in write order
STATS_TASKS = dict(zip(RESULT_TASKS, ["updateSourceTime", "compilationTime", "benchmarkTime"]))


def unpivot_timings(df: DataFrame, ids: Sequence[str], tasks: Mapping[str, str] | None = None,
                    task: str = "task", time: str = "time") -> DataFrame:
    """E-3: one row per (build, task) with its timing; ``-1`` (not measured)
    rows are kept.  ``tasks`` maps task name -> timing column, in order."""
    tasks = dict(tasks or STATS_TASKS)
    return df.unpivot(list(ids), [F.col(c).alias(name) for name, c in tasks.items()],
                      task, time)


def results_rows(publish: DataFrame, commit: str = "commit", date: str = "date",
                 stats: str = "buildStats") -> DataFrame:
    """Publish requests that carry stats -> results history rows
    ``(task, commit, date, time)``; requests without stats produce none."""
    flat = publish.filter(F.col(stats).isNotNull()).select(
        F.col(commit).alias("commit"), F.col(date).alias("date"),
        *[F.col(f"{stats}.{c}").alias(c) for c in STATS_TASKS.values()])
    return unpivot_timings(flat, ["commit", "date"]).select("task", "commit", "date", "time")


def publish_state(publish: DataFrame, stats: str = "buildStats") -> DataFrame:
    """B-3: COMPLETE when the request carried stats (rows were appended),
    FAILED otherwise."""
    return publish.withColumn(
        "publishState", F.when(F.col(stats).isNull(), "FAILED").otherwise("COMPLETE"))
