"""Lookup join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a (de-duplicated) lookup side onto ``left``.

    The plan is Spark's: it broadcasts the lookup side when its measured size
    in bytes is below ``spark.sql.autoBroadcastJoinThreshold``, and otherwise
    splits the shuffled partitions of a hot key of ``left`` at run time
    (``spark.sql.adaptive.skewJoin``).  Only joins that keep each left row's
    place are offered.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a lookup join is 'left' or 'inner', not {how!r}")
    return left.join(right, list(keys), how)
