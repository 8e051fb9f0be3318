"""Indexed series on the chart's own sample points (fixed values)."""

import datetime as dt

import pytest

from benchtide.operators import series

# fixed values: the chart specification's sample points (task, commit, date, time)
SAMPLE = [
    ("Update Source", "abcdef1", "2000-01-01T10:00:00", 64),
    ("Compile", "abcdef1", "2000-01-01T10:00:00", 1100),
    ("Benchmark 1", "abcdef1", "2000-01-01T10:00:00", 3000),
    ("Benchmark 2", "abcdef1", "2000-01-01T10:00:00", 6000),
    ("Update Source", "abab123", "2000-01-02T12:07:00", 68),
    ("Compile", "abab123", "2000-01-02T12:07:00", 1110),
    ("Benchmark 1", "abab123", "2000-01-02T12:07:00", 3500),
    ("Benchmark 2", "abab123", "2000-01-02T12:07:00", 5900),
    ("Update Source", "1a2b3c4", "2000-01-02T14:19:00", 67),
    ("Compile", "1a2b3c4", "2000-01-02T14:19:00", 1120),
    ("Benchmark 1", "1a2b3c4", "2000-01-02T14:19:00", 4000),
    ("Benchmark 2", "1a2b3c4", "2000-01-02T14:19:00", 5800),
    ("Update Source", "12b3c45", "2000-01-02T20:15:00", 55),
    ("Compile", "12b3c45", "2000-01-02T20:15:00", 1130),
    ("Benchmark 1", "12b3c45", "2000-01-02T20:15:00", 3100),
    ("Benchmark 2", "12b3c45", "2000-01-02T20:15:00", 5800),
    ("Update Source", "543abcd", "2000-01-03T07:21:00", 48),
    ("Compile", "543abcd", "2000-01-03T07:21:00", 910),
    ("Benchmark 1", "543abcd", "2000-01-03T07:21:00", 2900),
    ("Benchmark 2", "543abcd", "2000-01-03T07:21:00", 5600),
]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(t, c, dt.datetime.fromisoformat(d), float(v)) for t, c, d, v in SAMPLE]
    return spark.createDataFrame(rows, "task string, commit string, date timestamp_ntz, time double")


def test_rebased_against_last_point_of_index_day(points):
    out = series.indexed_series(points, dt.datetime(2000, 1, 2))
    got = {(r.task, r.commit): (r.index_time, round(r.indexed_time, 6)) for r in out.collect()}
    assert got[("Update Source", "abcdef1")] == (55.0, 0.163636)
    assert got[("Compile", "abcdef1")] == (1130.0, -0.026549)
    assert got[("Benchmark 1", "abcdef1")] == (3100.0, -0.032258)
    assert got[("Benchmark 2", "abcdef1")] == (5800.0, 0.034483)


def test_no_index_rows_gives_zero(points):
    out = series.indexed_series(points, dt.datetime(2000, 1, 4)).collect()
    assert {r.indexed_time for r in out} == {0.0} and {r.index_time for r in out} == {0.0}


def test_series_order(points):
    out = series.indexed_series(points, dt.datetime(2000, 1, 2)).filter("task = 'Compile'")
    assert [r.commit for r in out.orderBy("point_order").collect()] == [
        "abcdef1", "abab123", "1a2b3c4", "12b3c45", "543abcd"]


def test_weekday_mode_keeps_same_weekday_of_month(points):
    # 2000-01-09 is a Sunday like 2000-01-02: the literal expression matches 01-02
    day = series.index_day_filter(points, dt.datetime(2000, 1, 9), match="weekday")
    assert day.count() == 12
    assert series.index_day_filter(points, dt.datetime(2000, 1, 9)).count() == 0


def test_extents_clamp_domains(points):
    ser = series.indexed_series(points, dt.datetime(2000, 1, 2), order=False)
    e = series.axis_extents(ser).collect()[0]
    assert e.date_min == dt.datetime(2000, 1, 1, 10) and e.value_min < 0 < e.value_max
    c = series.clamp_index_date(points, dt.datetime(2000, 2, 1)).collect()[0][0]
    assert c == dt.datetime(2000, 1, 3, 7, 21)
    doms = series.ordinal_domains(points).orderBy("domain", "position").collect()
    assert [r.value for r in doms if r.domain == "task"] == [
        "Benchmark 1", "Benchmark 2", "Compile", "Update Source"]
    assert [r.value for r in doms if r.domain == "commit"] == [
        "abcdef1", "abab123", "1a2b3c4", "12b3c45", "543abcd"]
