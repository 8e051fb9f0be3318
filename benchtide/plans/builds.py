"""Build-response queue -> publish requests -> results history, as
streaming queries (SURVEY 3.2 and 3.3).

queue (A-2) -> F-2 decode (bad -> B-4 dead-letter folder) -> each response
once -> J-1 keyed fold on (ref, build) -> J-3 publish requests -> E-3 results
rows -> B-2 history, each micro-batch one committed append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.functions.records import decode_records
from benchtide.operators.fence import computed_once
from benchtide.operators.states import state_index
from benchtide.operators.results import publish_state, results_rows
from benchtide.sinks.history import append_results
from benchtide.sources.files import read_queue
from benchtide.streaming import jobs


def decoded_responses(spark: SparkSession, queue: str, stream: bool = True,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Build-response messages with ``record`` / ``error`` columns."""
    raw = read_queue(spark, queue, stream=stream, max_files_per_trigger=max_files_per_trigger, arrival=True)
    # callers filter on the error: decode once
    return computed_once(decode_records(raw, "value", "build_response"), ["record", "error"])


def state_events(decoded: DataFrame) -> DataFrame:
    """Good responses flattened for the fold: ref, build id, time, state,
    plus what a publish request needs (commit, stats).  Events of one time
    are ordered by state, then by a hash of the message id."""
    r = F.col("record")
    rank = state_index(r["buildState"]).cast("bigint")
    seq = F.shiftleft(rank, 58).bitwiseOR(F.xxhash64(r["id"]).bitwiseAND(F.lit((1 << 58) - 1)))
    return decoded.filter(F.col("error").isNull()).select(
        r["buildRequest"]["ref"].alias("ref"), r["buildRequest"]["id"].alias("build_id"),
        r["timeStamp"].cast("timestamp_ntz").alias("ts"),
        seq.alias("seq"), r["buildState"].alias("build_state"),
        r["id"].alias("response_id"), r["buildRequest"]["commit"].alias("commit"),
        r["buildStats"].alias("buildStats"), "arrived")


def delivered_once(events: DataFrame, message_id: str, window: str, clock: str = "arrived") -> DataFrame:
    """J-3 ahead of the fold: a message that is delivered again within
    ``window`` of its first arrival is left out, in the same micro-batch or a
    later one, so it changes neither the builds nor what is published.  The
    ids are state that ends with the window; no earlier output is read."""
    return events.withWatermark(clock, window).dropDuplicatesWithinWatermark([message_id])


def run_dead_letters(spark: SparkSession, queue: str, out: str, checkpoint: str) -> None:
    """B-4 for the response queue: undecodable messages with their reason."""
    bad = decoded_responses(spark, queue).filter(F.col("error").isNotNull()).select(
        F.lit("build-responses").alias("queue"), F.col("value").alias("content"),
        F.col("error").alias("reason"))
    jobs.run_available_now(bad, out, checkpoint, fmt="json")


def run_results_history(spark: SparkSession, queue: str, history: str, publish_out: str,
                        checkpoint: str, max_files_per_trigger: int | None = None,
                        redelivery: str = "7 days", retention: str = "30 days") -> None:
    """Fold the response stream and turn every publish request into results
    rows (one committed append to ``history`` a micro-batch) and a publish
    outcome (``publish_out``).  Runs are named by the query and the batch, so a
    replayed batch replaces itself, and a new checkpoint replaces nothing.
    ``redelivery`` is how long after its arrival a response may come again,
    ``retention`` how long a build is remembered after its last response."""
    src = decoded_responses(spark, queue, max_files_per_trigger=max_files_per_trigger)
    events = delivered_once(state_events(src), "response_id", redelivery)
    folded = jobs.fold_stream(events, ["ref"], "build_id", "ts", "seq", "build_state",
                              clock="arrived", retention=retention)

    def write(batch: DataFrame, batch_id: int) -> None:
        pubs = jobs.publish_stream(batch).select(
            "ref", "build_id", "response_id", "commit", F.col("ts").alias("date"),
            "buildStats", "out_of_order").persist()
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_results(results_rows(pubs), history, f"{query}-{batch_id}")
        (publish_state(pubs).drop("buildStats").write.mode("overwrite")
         .parquet(f"{publish_out.rstrip('/')}/query={query}/batch_id={batch_id}"))
        pubs.unpersist()

    q = (folded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
