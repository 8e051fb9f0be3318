"""Running sums over range-sorted rows, balanced whatever the keys' sizes.

Rows are range-partitioned on ``(keys, order)``, so a key that holds a third of
all rows is cut into many chunks, and written once with the number of their
chunk.  The totals of the chunks (at most one row per chunk and key) give each
chunk its offset; the sums inside a chunk are a window over that chunk alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchtide.llm.common import stage

CHUNK = "_chunk"
Sums = Mapping[str, Column]


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` written once, range-partitioned on keys and order, with the
    number of each row's range as ``_chunk``."""
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order)
    return stage(ranged.withColumn(CHUNK, F.spark_partition_id()), name)


def chunk_offsets(rows: DataFrame, keys: Sequence[str], sums: Sums) -> DataFrame:
    """Per chunk and key: each sum over the key's earlier chunks."""
    per = rows.groupBy(CHUNK, *keys).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    return per.select(CHUNK, *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def attach(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], order: Sequence[Column],
           sums: Sums) -> DataFrame:
    """``rows`` with the columns of their chunk in ``offsets``; the columns of
    ``sums`` then are sums over all earlier rows of the key."""
    named = offsets.select(F.col(CHUNK).alias("_oc"), *[F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)],
                           *[c for c in offsets.columns if c != CHUNK and c not in keys])
    cond = [rows[CHUNK] == named["_oc"]] + [
        rows[k].eqNullSafe(named[f"_ok{i}"]) for i, k in enumerate(keys)]
    joined = rows.join(named, cond).drop("_oc", *[f"_ok{i}" for i in range(len(keys))])
    inside = (Window.partitionBy(CHUNK, *keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumns({
        n: F.col(n) + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).drop(CHUNK)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sums,
                 name: str = "prefix") -> DataFrame:
    """``df`` with, for each (column, value) of ``sums``, the sum of the value
    over the key's rows that come earlier in ``order`` (a total order, up to
    rows that are wholly equal)."""
    rows = chunked(df, keys, order, name)
    return attach(rows, chunk_offsets(rows, keys, sums), keys, order, sums)
