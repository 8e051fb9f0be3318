"""File sinks: message queue as JSON lines (B-1) and the append-only
results history CSV (B-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.functions.records import record_json
from benchtide.functions.times import CSV_DATE_FORMAT


def to_messages(df: DataFrame, record: str) -> DataFrame:
    """B-1: rows of a record type -> one JSON text ``value`` per message."""
    return df.select(record_json(record).alias("value"))


def write_queue(df: DataFrame, path: str, record: str) -> None:
    """B-1 (batch): append messages to a JSON-lines queue folder."""
    to_messages(df, record).write.mode("append").text(path)


def write_queue_stream(df: DataFrame, path: str, record: str, checkpoint: str):
    """B-1 (stream): messages to a JSON-lines queue folder through the file
    sink (exactly-once via its commit log).  Returns the started query."""
    return (to_messages(df, record).writeStream.format("text").option("path", path)
            .option("checkpointLocation", checkpoint).start())


def write_kafka_queue_stream(df: DataFrame, bootstrap_servers: str, topic: str, record: str,
                             checkpoint: str):
    """B-1 on Kafka: messages as record values (at-least-once; consumers
    de-duplicate on the message id).  Needs the Spark Kafka connector."""
    return (to_messages(df, record).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


def write_results(rows: DataFrame, path: str, mode: str = "append") -> None:
    """B-2: append results rows ``task,commit,date,time`` with a header and
    CRLF line ends; each append adds part files to the history folder
    (``mode="overwrite"`` for an idempotent per-batch folder)."""
    (rows.select("task", "commit", F.col("date").cast("timestamp").alias("date"),
                 F.col("time").cast("long").alias("time"))
     .write.mode(mode).option("header", True).option("lineSep", "\r\n")
     .option("timestampFormat", CSV_DATE_FORMAT).csv(path))
