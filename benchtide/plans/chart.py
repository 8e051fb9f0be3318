"""Build timings -> results history -> indexed chart series.

D-6 phase timings per build -> E-3 unpivot into ``(task, commit, date,
time)`` rows -> C-9 index day -> D-1 lookup -> E-2 re-base -> E-1 order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.operators import builds, results, series


def build_results(state_log: DataFrame, build_keys: Sequence[str], ts: str = "ts",
                  state: str = "build_state") -> DataFrame:
    """State log -> results rows: one build per ``build_keys``, its commit
    label the keys joined with ``@``, its date the last event time."""
    timings = builds.phase_durations(state_log, build_keys, ts, state, finished="date")
    labelled = timings.withColumn(
        "commit", F.concat_ws("@", *[F.col(k).cast("string") for k in build_keys]))
    return results.unpivot_timings(labelled, ["commit", "date"]).select(
        "task", "commit", "date", "time")


def results_series(rows: DataFrame, index_date, match: str = "day") -> DataFrame:
    """Results rows -> re-based series per task, ordered."""
    return series.indexed_series(rows, index_date, match=match)
