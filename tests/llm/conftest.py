import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from benchtide.llm.common import prepare  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows."""
    prepare(spark)

    def make(rows, **more):
        full = [(i, t, None, "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "a text without an id"), (4, "word " * 40000),
       (5, "repeated row"), (5, "repeated row"), (6, "\x00 odd   chars é 漢字 \U0001f600")]
