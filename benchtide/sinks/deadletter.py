"""Dead-letter split (B-4): good rows continue, bad rows are kept with the
queue name, the raw content and the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.functions.records import decode_records
from benchtide.operators.fence import computed_once


def split_dead_letters(df: DataFrame, reason: str, content: str, queue: str):
    """``(good, dead)`` by a reason column (null = good).  The reason is
    fenced so neither filter re-evaluates the expression behind it."""
    df = computed_once(df, [reason])
    good = df.filter(F.col(reason).isNull()).drop(reason)
    dead = df.filter(F.col(reason).isNotNull()).select(
        F.lit(queue).alias("queue"), F.col(content).alias("content"), F.col(reason).alias("reason"))
    return good, dead


def decode_messages(df: DataFrame, text: str, record: str, queue: str):
    """Decode a queue of JSON text messages into ``record`` rows.

    Returns ``(records, dead)``: the decoded struct's fields as columns, and
    the undecodable messages with their reason.
    """
    parsed = decode_records(df.select(F.col(text).alias("_content")), "_content", record,
                            "_record", "_error")
    # both outputs filter on the error: decode once
    parsed = computed_once(parsed, ["_record", "_error"])
    good = parsed.filter(F.col("_error").isNull()).select("_record.*")
    dead = parsed.filter(F.col("_error").isNotNull()).select(
        F.lit(queue).alias("queue"), F.col("_content").alias("content"),
        F.col("_error").alias("reason"))
    return good, dead
