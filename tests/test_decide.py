"""Latest-wins dispatch against a plain simulation, cut into many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from benchtide.operators import builds


def simulate(rows):
    """rows: (key, ts, seq, kind); returns {(key, seq): (action, at)}."""
    out = {}
    for key in {r[0] for r in rows}:
        busy, wait = False, None
        for _, ts, seq, kind in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if kind == "R":
                if not busy:
                    out[key, seq], busy = ("dispatch", ts), True
                elif wait is None or ts > wait[0]:
                    if wait:
                        out[key, wait[1]] = ("drop", None)
                    wait = (ts, seq)
                else:
                    out[key, seq] = ("drop", None)
            elif kind == "C":
                if wait:
                    out[key, wait[1]] = ("dispatch_backlog", ts)
                busy, wait = wait is not None, None
        if wait:
            out[key, wait[1]] = ("backlog", None)
    return out


@pytest.mark.parametrize("seed,keys,kinds,times,parts", [
    (1, ["hot"], "RRC.", 4000, 16),             # one key over all ranges
    (2, ["hot"] * 6 + ["a", "b", None], "RRRC", 40, 13),    # many equal times
    (3, ["hot"], "RRRRRRRRRRRRRRRC.......", 60, 29),        # open requests over many ranges
    (4, list(range(300)), "RRC.", 300, 7),      # many keys in a range
    (5, ["hot", "x"], "C.", 50, 5), (6, ["hot"], "R", 3, 11), (7, ["hot", "x"], "RC", 2, 12)])
def test_dispatch_in_ranges(spark, seed, keys, kinds, times, parts):
    rnd = random.Random(seed)
    rows = [(k, rnd.randrange(times), i, rnd.choice(kinds)) for i, k in enumerate(rnd.choices(keys, k=1500))]
    kind = "int" if isinstance(keys[0], int) else "string"
    df = spark.createDataFrame(rows, f"key {kind}, ts int, seq int, kind string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rnd.choice([1, 3, 17]))
    try:
        out = builds.dispatch(df, ["key"], F.col("kind") == "R", F.col("kind") == "C", "ts", "seq", partitions=parts)
        got = {(r.key, r.seq): (r.action, r.dispatched_at) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == simulate(rows)


def test_one_exchange_of_the_rows(spark, capsys):
    """The rows are shuffled once; what follows reads the written table and a
    summary of one row per range."""
    df = spark.createDataFrame([("a", 1, 1, "R"), ("a", 2, 2, "R")], "key string, ts int, seq int, kind string")
    out = builds.dispatch(df, ["key"], F.col("kind") == "R", F.col("kind") == "C", "ts", "seq")
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan
    assert sorted((r.seq, r.action) for r in out.collect()) == [(1, "dispatch"), (2, "backlog")]


def test_two_keys_and_no_rows(spark):
    schema = "a string, b int, ts timestamp, seq bigint, kind string"
    empty = spark.createDataFrame([], schema)
    assert builds.dispatch(empty, ["a", "b"], F.col("kind") == "R", F.col("kind") == "C").count() == 0
