"""Keep expensive computed columns from being evaluated twice.

Spark pushes a filter below the projection that computed the filtered
column by substituting the column's expression into the condition; it does
not weigh cost.  For a JSON verdict that means parsing every payload once in
the filter and again in the projection (and one stage of generated code
twice as large).  Passing the computed columns through a one-element
``inline`` makes them outputs of a generator, which filters on them cannot
be pushed through, so each expression runs once.  Deterministic and
row-for-row identical; used only where a filter follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same rows and columns; filters on ``cols`` stay above the
    expressions that computed them.  Only ``cols`` go through the generator
    (other columns pass alongside untouched), so keep them small."""
    cols = list(cols)
    rest = [c for c in df.columns if c not in cols]
    fenced = df.select(*rest, F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))
    return fenced.select(*df.columns)
