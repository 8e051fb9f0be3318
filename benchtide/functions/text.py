"""List / map text forms and enum parsing (F-5, F-6, F-7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def list_text(arr) -> Column:
    """F-5: ``a, b, c``."""
    return F.array_join(_c(arr), ", ")


def map_text(m) -> Column:
    """F-6: ``k1 -> v1, k2 -> v2`` with entries sorted by key (hash-map order
    is unspecified, sorting makes it deterministic)."""
    entries = F.array_sort(F.map_entries(_c(m)))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(" -> "),
                                                e["value"].cast("string"))), ", ")


def map_from_pairs(keys, values) -> Column:
    """F-6: map from parallel arrays; a repeated key keeps its last value
    (needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``)."""
    return F.map_from_arrays(_c(keys), _c(values))


def enum_value(col, names: Sequence[str]) -> Column:
    """F-7: the value when it is exactly one of ``names``, else null."""
    c = _c(col)
    return F.when(c.isin(list(names)), c)


def enum_error(col, names: Sequence[str], enum: str) -> Column:
    """F-7: error text for a value that is not one of ``names`` (null if ok)."""
    c = _c(col)
    return F.when(~c.isin(list(names)) | c.isNull(),
                  F.concat(F.lit(f"No enum constant {enum}."), F.coalesce(c, F.lit("null"))))
