"""Driver contract: entry, query keys and oracle keys."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"task", "commit", "date", "time", "index_time", "indexed_time", "point_order"} == set(df.columns)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
@pytest.mark.parametrize("key", ["indexed_series", "state_fold", "dispatch_latest", "payload_verdict",
                                 "log_lines", "build_results_series"])
def test_query_matches_oracle_small(spark, key):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["orders", "events", "documents", "lineitem", "nation", "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = E.queries()[key](spark, SMOKE)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in res.description]
    exp = sorted(tuple(str(dict(zip(names, row))[c]) for c in cols) for row in res.fetchall())
    assert sorted(names) == cols
    assert got == exp
