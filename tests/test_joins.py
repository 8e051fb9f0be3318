"""Lookup join: the same rows whatever its plan; other kinds are refused."""

import pytest
from pyspark.sql import functions as F

from benchtide.operators.joins import lookup_join
from benchtide.operators.scan import keyed_scan


def test_same_rows_broadcast_or_shuffled(spark):
    left = spark.range(5000).select((F.col("id") % 3).alias("task"), F.col("id").alias("v"),
                                    F.create_map(F.lit("k"), F.col("id")).alias("m"))
    right = spark.createDataFrame([(0, 10.0), (1, 11.0)], "task long, t double")
    a = lookup_join(left, right, ["task"]).orderBy("v").collect()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = lookup_join(left, right, ["task"]).orderBy("v").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert a == b and len(b) == 5000
    assert sum(1 for r in b if r.t is None) == len([v for v in range(5000) if v % 3 == 2])


def test_other_joins_refused(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        lookup_join(df, df, ["id"], how="full")


def test_persisted_input_same_result(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("seq"),
                                  (F.col("id") % 5 == 0).alias("fl"))
    a = keyed_scan(df, ["k"], ["seq"], flag=F.col("fl"), state_col=None, partitions=6)
    b = keyed_scan(df, ["k"], ["seq"], flag=F.col("fl"), state_col=None, partitions=6,
                   persist_input=True)
    assert sorted(a.collect()) == sorted(b.collect())
