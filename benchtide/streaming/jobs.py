"""Structured Streaming jobs for the build bookkeeping.

Sources are unbounded tables (a JSON-lines / parquet folder, or Kafka);
state lives in the state store (RocksDB provider) and is checkpointed, so a
restarted query resumes where it stopped.  Sinks are idempotent per
micro-batch: each batch overwrites its own ``batch_id=N`` folder, so a
replayed batch after a failure rewrites the same rows instead of adding
duplicates (J-3's at-least-once publish becomes effectively exactly-once).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchtide.operators import builds
from benchtide.session import checkpoint_dir
from benchtide.streaming.processors import (BuildFoldProcessor, DispatchProcessor, LiveCountProcessor,
                                             OrchestratorProcessor)

FOLD_OUTPUT = [
    T.StructField("state_before", T.StringType()),
    T.StructField("state_after", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("publish", T.BooleanType()),
    T.StructField("out_of_order", T.BooleanType()),
]


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's output and checkpoint, under the
    shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def _millis(interval: str | None) -> int | None:
    """Length of an interval text such as '7 days'."""
    if interval is None:
        return None
    amount, unit = interval.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * seconds * 1000


def fold_stream(events: DataFrame, key_cols: Sequence[str], id_col: str, ts: str = "ts",
                seq: str = "seq", state: str = "build_state", keep_tombstones: bool = True,
                dispatched: str | None = None, clock: str | None = None,
                retention: str | None = None) -> DataFrame:
    """J-1 on a stream: one trace row per event (same columns as the batch
    ``build_state_fold``), one state entry per ``(key_cols, id_col)``.
    ``dispatched`` names a boolean column whose rows are dispatched requests.

    ``keep_tombstones=False`` deletes finished builds from state at once (a
    repeated final event is then only flagged ``out_of_order`` while its build
    is recorded).  ``retention`` (such as '7 days') lets state end by timers on
    ``clock``, a timestamp column that the caller has given a watermark: see
    ``BuildFoldProcessor``; a boolean ``expired`` is added.  Spark leaves out
    rows whose clock is older than the watermark, so the clock should be the
    arrival (``arrived`` of ``read_queue``), by which no row is late."""
    fields = [T.StructField(f.name, f.dataType, True) for f in events.schema.fields] + FOLD_OUTPUT
    keys = [*key_cols, id_col]
    if retention is None:
        proc = BuildFoldProcessor(keys, ts, seq, state, keep_tombstones, dispatched)
        return events.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=proc, outputStructType=T.StructType(fields), outputMode="Append",
            timeMode="None")
    if clock is None:
        raise ValueError("a retention needs the clock column that has the watermark")
    fields.append(T.StructField("expired", T.BooleanType()))
    proc = BuildFoldProcessor(keys, ts, seq, state, keep_tombstones, dispatched, clock, _millis(retention),
                              [f.name for f in fields])
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="EventTime", eventTimeColumnName=clock)


def live_stream(fold: DataFrame, key_cols: Sequence[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """How many builds of each key are live, after every beginning or end of
    one (``live``).  The second step behind ``fold_stream``: its rows are only
    those two events of each build."""
    rows = fold.where(builds.live_step() != 0)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
                          + [T.StructField("live", T.LongType())])
    return rows.groupBy(*key_cols).transformWithStateInPandas(
        statefulProcessor=LiveCountProcessor(ts, seq), outputStructType=schema,
        outputMode="Append", timeMode="None")


def read_state(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """A state variable of a stream's last finished batch, from its checkpoint:
    the grouping key's columns and the value's (of a map: key and value)."""
    state = (spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator)
             .option("stateVarName", variable).load())
    parts = [c for c in ("key", "user_map_key", "value", "user_map_value") if c in state.columns]
    return state.select(*[f"{c}.*" for c in parts])


def stream_snapshot(spark: SparkSession, checkpoint: str, id_col: str, fold_operator: int = 0) -> DataFrame:
    """D-7 on a running stream: the builds that its fold has recorded, with
    their state, read from the state store beside the stream."""
    rows = read_state(spark, checkpoint, "build", fold_operator).where(F.col("state") > 0)
    keys = [c for c in rows.columns if c not in ("state", "finals", "due", id_col)]
    return rows.select(*keys, id_col, builds.state_name(F.col("state")).alias("state"))


def dispatch_stream(events: DataFrame, key_cols: Sequence[str], kind: str, ts: str = "ts",
                    seq: str = "seq") -> DataFrame:
    """J-2 latest-wins on a stream; ``kind`` is 'request' / 'completion' / other."""
    fields = [events.schema[k] for k in key_cols] + [
        T.StructField(seq, T.LongType()), T.StructField(ts, T.TimestampNTZType()),
        T.StructField("action", T.StringType()), T.StructField("dispatched_at", T.TimestampNTZType())]
    proc = DispatchProcessor(list(key_cols), ts, seq, kind)
    return events.groupBy(*key_cols).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="None")


def orchestrate_stream(events: DataFrame, key_cols: Sequence[str], id_col: str, kind: str,
                       ts: str = "ts", seq: str = "seq", state: str = "build_state",
                       mode: str = "latest", clock: str | None = None,
                       retention: str | None = None) -> DataFrame:
    """J-1 + J-2 in one keyed processor (see ``OrchestratorProcessor``).
    ``retention`` and ``clock`` let builds be forgotten, as in ``fold_stream``."""
    if retention is not None and clock is None:
        raise ValueError("a retention needs the clock column that has the watermark")
    fields = [events.schema[k] for k in key_cols] + [
        T.StructField(id_col, T.StringType()), T.StructField(ts, T.TimestampNTZType()),
        T.StructField(seq, T.LongType()), T.StructField(kind, T.StringType()),
        T.StructField(state, T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("dispatched_at", T.TimestampNTZType())] + FOLD_OUTPUT
    proc = OrchestratorProcessor(list(key_cols), id_col, ts, seq, kind, state, mode, clock, _millis(retention))
    return events.groupBy(*key_cols).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=T.StructType(fields), outputMode="Append",
        timeMode="None" if retention is None else "EventTime")


def batch_folder_writer(path: str, fmt: str = "parquet", dedupe: Sequence[str] | None = None):
    """foreachBatch function: write each micro-batch to ``path/batch_id=N``
    (overwrite), optionally de-duplicated on ``dedupe`` within the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.dropDuplicates(list(dedupe)) if dedupe else batch
        out.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")

    return write


def run_available_now(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                      dedupe: Sequence[str] | None = None) -> None:
    """Process everything available, idempotently, then stop."""
    q = (stream.writeStream.foreachBatch(batch_folder_writer(path, fmt, dedupe))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def publish_stream(fold: DataFrame) -> DataFrame:
    """J-3: the publish requests of a folded stream (every final event)."""
    return fold.filter(F.col("publish"))


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back a ``batch_id=N`` sink folder without the partition column."""
    return spark.read.format(fmt).load(path).drop("batch_id")
