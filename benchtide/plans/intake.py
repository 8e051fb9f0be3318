"""Webhook request log -> dispatched build requests.

A-1 bodies -> C-2 verdict (bad -> B-4 dead letters) -> C-1 fields -> C-4 ref
filter -> C-5 build request -> J-2 dispatch.  The request ``id`` and receive
time come from the data; the only shuffle is on the dispatch key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.operators import builds, webhook
from benchtide.operators.fence import computed_once
from benchtide.schemas import FINAL_STATES
from benchtide.sinks.deadletter import split_dead_letters


def intake(requests: DataFrame, body: str = "body", id_col: str = "id",
           received: str = "received_at", seq: str = "seq",
           ref_patterns: Sequence[str] = (), mode: str = "latest",
           keys: Sequence[str] = ("ref",), state_events: DataFrame | None = None,
           state: str = "build_state"):
    """Returns ``(decisions, dead_letters)``.

    ``state_events`` (``keys``, ``timeStamp``, ``seq`` and ``state``) are the
    build-state events of the same time; a final one frees its key, and the
    request waiting there is sent.

    ``decisions`` has one row per admitted build request with its dispatch
    ``action`` / ``dispatched_at``; ``dead_letters`` holds the rejected
    bodies with their verdict.
    """
    checked = webhook.classify_payloads(requests, body, "_verdict")
    # the dead-letter split and the ref filter read these: compute them once
    checked = computed_once(checked, ["_verdict", *webhook.PAYLOAD_FIELDS])
    reason = F.when(F.col("_verdict") != webhook.OK, F.col("_verdict"))
    good, dead = split_dead_letters(checked.withColumn("_reason", reason).drop("_verdict"),
                                    "_reason", body, "webhook")
    push = good.select(
        F.col(id_col).alias("id"), F.col(received).alias("timeStamp"), F.col(seq).alias("seq"),
        "ref", "before", "after", "repository", "pusher", "sender")
    push = webhook.ref_filter(push, "ref", list(ref_patterns))
    req = webhook.push_to_request(push, carry=["seq"])
    rows = req.withColumn("_final", F.lit(False))
    if state_events is not None:
        ended = state_events.where(F.col(state).isin(FINAL_STATES)).select(
            *keys, F.col("timeStamp").cast(req.schema["timeStamp"].dataType).alias("timeStamp"),
            F.col("seq").cast("bigint").alias("seq"), F.lit(True).alias("_final"))
        rows = rows.withColumn("seq", F.col("seq").cast("bigint")).unionByName(ended, allowMissingColumns=True)
    # the requests come out of JSON parsing: keep them for the scan's passes
    decisions = builds.dispatch(rows, list(keys), ~F.col("_final"), F.col("_final"),
                                ts="timeStamp", seq="seq", mode=mode, persist_input=True)
    return decisions.drop("_final"), dead


def run_intake_stream(spark, payload_dir: str, decisions_out: str, dead_out: str,
                      checkpoint: str, ref_patterns: Sequence[str] = (), mode: str = "latest",
                      max_files_per_trigger: int | None = None, responses: str | None = None) -> None:
    """SURVEY 3.1 as streams: webhook body files (A-1) -> C-2 verdict with
    dead letters (B-4) -> C-1 -> C-4 -> C-5 -> J-2 keyed dispatch per ref.

    ``responses`` is the folder of the build-response queue (A-2): its state
    events join the requests of their ref, so that a final one frees the ref
    (J-1 and J-2 together).

    A request's id is its file path and its receive time the file's
    modification time (the order the bodies arrived in).  Runs with
    ``availableNow`` and per-batch idempotent sinks; returns when done.
    """
    from benchtide.sources.files import read_payloads
    from benchtide.streaming import jobs

    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    bodies = reader.text(payload_dir, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("id"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"))
    checked = computed_once(webhook.classify_payloads(bodies, "body", "_verdict"),
                            ["_verdict", *webhook.PAYLOAD_FIELDS])
    reason = F.when(F.col("_verdict") != webhook.OK, F.col("_verdict"))
    good, dead = split_dead_letters(checked.withColumn("_reason", reason).drop("_verdict"),
                                    "_reason", "body", "webhook")
    push = webhook.ref_filter(good.select(
        "id", F.col("received_at").alias("timeStamp"), F.xxhash64("id").alias("seq"),
        "ref", "before", "after", "repository", "pusher", "sender"), "ref", list(ref_patterns))
    req = webhook.push_to_request(push, carry=["seq"]).withColumn("kind", F.lit("request")) \
        .withColumn("build_state", F.lit(None).cast("string"))
    rows = req.select("ref", "id", "timeStamp", "seq", "kind", "build_state")
    if responses is not None:
        from benchtide.plans.builds import decoded_responses, state_events

        events = state_events(decoded_responses(spark, responses, max_files_per_trigger=max_files_per_trigger))
        rows = rows.unionByName(events.select(
            "ref", F.col("build_id").alias("id"), F.col("ts").alias("timeStamp"), "seq",
            F.lit("state").alias("kind"), "build_state"))
    decided = jobs.orchestrate_stream(rows, ["ref"], "id", "kind", ts="timeStamp", seq="seq", mode=mode)
    jobs.run_available_now(dead, dead_out, f"{checkpoint.rstrip('/')}/dead", fmt="json")
    jobs.run_available_now(decided, decisions_out, f"{checkpoint.rstrip('/')}/decisions")
