"""Indexed time series per task: the data behind the results chart.

points(task, commit, date, time) --index-day filter--> index rows
  --lookup by task, default time 0--> re-based ``indexed_time`` per point,
ordered per task, plus axis extents and ordinal domains.
Column names are parameters so any similarly shaped table works.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.operators.joins import lookup_join
from benchtide.operators.scan import keyed_row_number


def _as_ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.date, dt.datetime)):
        return F.lit(value).cast("timestamp")
    return F.to_timestamp(F.lit(value))


def index_day_filter(points: DataFrame, index_date, date: str = "date",
                     match: str = "day") -> DataFrame:
    """C-9: keep the points of the index day.

    ``match="day"`` compares the calendar day.  ``match="weekday"`` keeps what
    the chart expression literally says: same year, same month and same day
    of the week.
    """
    d = _as_ts(index_date)
    c = F.col(date)
    dtype = points.schema[date].dataType
    # half-open ranges on the raw column fold to literals, so the parquet
    # scan gets them as pushed filters (row groups outside are skipped)
    if match == "day":
        day = F.to_date(d)
        cond = (c >= day.cast(dtype)) & (c < F.date_add(day, 1).cast(dtype))
    elif match == "weekday":
        month = F.trunc(F.to_date(d), "month")
        cond = ((c >= month.cast(dtype)) & (c < F.add_months(month, 1).cast(dtype))
                & (F.dayofweek(c) == F.dayofweek(d)))
    else:
        raise ValueError(f"unknown match mode {match!r}")
    return points.filter(cond)


def non_null_points(points: DataFrame, date: str = "date") -> DataFrame:
    """C-10: keep points that have a date."""
    return points.filter(F.col(date).isNotNull())


def clamp_index_date(points: DataFrame, index_date, date: str = "date",
                     name: str = "index_date") -> DataFrame:
    """C-11: the index date clamped into the x-axis range (one row)."""
    return clamp_index_dates(points, {name: index_date}, date)


def clamp_index_dates(points: DataFrame, dates: dict, date: str = "date") -> DataFrame:
    """C-11 for several candidate dates from one extent aggregate (one row,
    one column per name)."""
    dtype = points.schema[date].dataType
    ext = points.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return ext.select(*[F.greatest(F.least(_as_ts(d).cast(dtype), F.col("_hi")), F.col("_lo")).alias(n)
                        for n, d in dates.items()])


def index_rows(points: DataFrame, index_date, task: str = "task", commit: str = "commit",
               date: str = "date", time: str = "time", match: str = "day",
               name: str = "index_time") -> DataFrame:
    """One index row per task: the last point of the index day.

    "Last" is the latest ``date``, then the greatest ``commit``; the max of a
    struct is a partial (map-side) aggregate, so a hot task costs nothing.
    """
    day = index_day_filter(points, index_date, date, match)
    best = F.max(F.struct(F.col(date).alias("d"), F.col(commit).alias("c"),
                          F.col(time).alias("t")))
    return day.groupBy(task).agg(best.alias("_best")).select(
        task, F.col("_best.t").alias(name))


def lookup_index(points: DataFrame, index: DataFrame, task: str = "task",
                 index_time: str = "index_time", default=0) -> DataFrame:
    """D-1: each point gets its task's index time; no match -> ``default``."""
    dtype = index.schema[index_time].dataType
    joined = lookup_join(points, index, [task], "left")
    return joined.withColumn(
        index_time, F.coalesce(F.col(index_time), F.lit(default).cast(dtype)))


def rebase(df: DataFrame, time: str = "time", index_time: str = "index_time",
           name: str = "indexed_time") -> DataFrame:
    """E-2: ``(time - index) / index`` when the index time is positive, else 0."""
    it = F.col(index_time)
    value = F.when(it > 0, (F.col(time) - it) / it).otherwise(F.lit(0.0))
    return df.withColumn(name, value.cast("double"))


def series_order(df: DataFrame, task: str = "task", date: str = "date",
                 commit: str = "commit", name: str = "point_order") -> DataFrame:
    """E-1: position of each point inside its task's series (by date, commit)."""
    return keyed_row_number(df, [task], [date, commit], name=name)


def indexed_series(points: DataFrame, index_date, task: str = "task", commit: str = "commit",
                   date: str = "date", time: str = "time", match: str = "day",
                   order: bool = True) -> DataFrame:
    """C-9 -> D-1 -> E-2 -> E-1: the re-based series of every task."""
    index = index_rows(points, index_date, task, commit, date, time, match)
    out = rebase(lookup_index(points, index, task), time)
    if order:
        out = series_order(out, task, date, commit)
    return out


def axis_extents(df: DataFrame, date: str = "date", value: str = "indexed_time") -> DataFrame:
    """D-3: x extent of the dates; y extent of the values widened to include 0."""
    return df.agg(
        F.min(date).alias("date_min"), F.max(date).alias("date_max"),
        F.least(F.min(value), F.lit(0.0)).alias("value_min"),
        F.greatest(F.max(value), F.lit(0.0)).alias("value_max"))


def ordinal_domains(points: DataFrame, task: str = "task", commit: str = "commit",
                    date: str = "date") -> DataFrame:
    """D-4: distinct tasks and distinct commits, numbered in first-seen order.

    Points are seen in ``(date, commit)`` order.  Returns
    ``(domain, value, position)`` with ``value`` as text.
    """
    seen = F.struct(F.col(date).alias("d"), F.col(commit).alias("c"))

    def firsts(col: str, domain: str) -> DataFrame:
        return (points.groupBy(col).agg(F.min(seen).alias("_first"))
                .select(F.lit(domain).alias("domain"),
                        F.col(col).cast("string").alias("value"),
                        F.col("_first.d").alias("_fd"), F.col("_first.c").alias("_fc")))

    both = firsts(task, "task").unionByName(firsts(commit, "commit"))
    ranked = keyed_row_number(both, ["domain"], ["_fd", "_fc", "value"], name="position")
    return ranked.select("domain", "value", "position")
