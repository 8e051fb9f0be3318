"""Build-state predicates and lookups as column expressions (C-6, C-7, C-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.schemas import (BUILD_STATES, FAILURE_STATES, FINAL_STATES,
                               FINAL_SUCCESS_STATES, PREV_STATE, UPDATE_SUCCESS_STATES)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def state_class(state) -> Column:
    """C-6: UPDATE / SUCCESS / FAILURE, or NONE for the request states."""
    s = _c(state)
    return (F.when(s.isin(UPDATE_SUCCESS_STATES), "UPDATE")
            .when(s.isin(FINAL_SUCCESS_STATES), "SUCCESS")
            .when(s.isin(FAILURE_STATES), "FAILURE")
            .otherwise("NONE"))


def is_final(state) -> Column:
    return _c(state).isin(FINAL_STATES)


def prev_state(state) -> Column:
    """C-7: the state that must precede ``state`` (null for the first one)."""
    pairs = []
    for s in BUILD_STATES:
        pairs += [F.lit(s), F.lit(PREV_STATE[s])]
    return F.try_element_at(F.create_map(*pairs), _c(state))


def state_index(state) -> Column:
    """1-based position in the declared state order, null when unknown."""
    pos = F.array_position(F.array(*[F.lit(s) for s in BUILD_STATES]), _c(state))
    return F.when(pos > 0, pos).cast("int")


def split_publish_outcomes(responses: DataFrame, state: str = "publishState"):
    """C-8: (completed, other) publish responses."""
    done = F.col(state) == "COMPLETE"
    return responses.filter(done), responses.filter(~done | F.col(state).isNull())


def publish_outcome_counts(responses: DataFrame, state: str = "publishState") -> DataFrame:
    """C-8: number of responses per outcome (partial aggregate)."""
    outcome = F.when(F.col(state) == "COMPLETE", "COMPLETE").otherwise("OTHER")
    return responses.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
