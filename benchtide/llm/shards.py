"""Training-order materialisation (operator 6).

Texts become token ids, cut into sequences of ``SEQUENCE`` ids; a keyed
Feistel permutation with cycle-walking gives every sequence a slot in
``0..n-1``, and slot ranges are written as shards of fixed-stride records:

    slot (8 bytes) | number of ids (2) | ids (2 each, zero-padded) | newline

all little-endian; record ``r`` of shard ``s`` has slot ``s * per_shard + r``
and starts at byte ``r * stride``.  Shards are plain files of Spark's text
writer (one file in each ``shard=`` folder), so any file system Spark knows
will do.

Slots are dense, so their ranges are exact without sampling: a task of a range
partition writes ``SHARDS_PER_TASK`` neighbouring shards.  Shards are written in
rounds, each a range of slots, and a finished round leaves a mark
``_ranges/<first>-<last>`` under the path.  ``materialise`` on the same path
goes on after the marked rounds: it takes the token sequences that the first
call wrote beside the path (``<path>-sequences``), and a round that was cut
short replaces its own shards, so every sequence stands in the shards once.
Every round reads the sequences again, as a permutation scatters its range over
all of them; more rounds need less scratch disk, fewer rounds less reading.

Defined cases: a null or empty text is its end mark alone; repeated rows and
repeated or null ids are written row by row; a very long text runs over as many
sequences as it needs; a sequence may hold several documents, whose ids and
places are listed with it; the last sequence of a task may be shorter and is
padded; only the id and text columns are read, so other columns may have any
name; an empty table writes no shard.  Vocabularies of more than 65,536 ids
raise an error, as an id has two bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.llm.common import mix, release, remove_at_exit, text_of
from benchtide.llm.tokens import default_path, merged, tokenizer
from benchtide.session import checkpoint_dir

SEQUENCE = 512
PER_SHARD = 4096
KEY = 20240613
FEISTEL_ROUNDS = 4
WRITE_ROUNDS = 3
SHARDS_PER_TASK = 4


def stride(sequence: int) -> int:
    return 10 + 2 * sequence + 1


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of ``0..n-1`` applied to ``index``: a balanced
    Feistel network over the next power of four, repeated on the values that
    fall outside until all are inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = mix(np.uint64(key) + np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64)
                   * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = SEQUENCE, tokenizer_path: str | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token sequences: ids (uint16 bytes) and the documents they hold."""
    if not 0 < length < 1 << 16:
        raise ValueError("a sequence has 1 to 65535 ids")
    path = tokenizer_path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        encoder = tokenizer(path)
        if encoder.largest_id >= 1 << 16:
            raise ValueError(f"the vocabulary of {path} has ids of more than two bytes")
        flat, names, sizes, starts = np.empty(0, np.uint16), None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in merged(batches):
            got = encoder.documents(batch.column(1))
            names = batch.column(0) if names is None else pa.concat_arrays([names, batch.column(0)])
            flat = np.concatenate([flat, *[g.astype(np.uint16) for g in got]])
            sizes = np.concatenate([sizes, [len(g) for g in got]]).astype(np.int64)
            starts = np.concatenate([starts, np.zeros(len(got), np.int64)])
            whole = len(flat) // length * length
            rows, names, sizes, starts = _deal(names, sizes, starts, length, whole)
            if whole:
                yield _sequence_batch(flat[:whole], np.arange(0, whole + 1, length), rows)
            flat = flat[whole:]
        if len(flat):
            rows, *_ = _deal(names, sizes, starts, length, length)
            yield _sequence_batch(flat, np.array([0, len(flat)]), rows)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        cut, f"ids binary, docs array<struct<doc_id:{kind},start:bigint,length:bigint>>")


def _deal(names: pa.Array, sizes: np.ndarray, starts: np.ndarray, length: int, whole: int):
    """Lists the documents of each sequence of the first ``whole`` ids, and what
    is left of the documents: their names, sizes and starts.  ``starts`` tells
    how many ids of a document stand in earlier sequences."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # a part begins where a document or a sequence begins
    edge = np.union1d(bounds[:-1], np.arange(0, bounds[-1] + 1, length))
    edge = edge[edge < bounds[-1]]
    size = np.diff(np.concatenate([edge, bounds[-1:]]))
    doc = np.searchsorted(bounds, edge, "right") - 1
    start = starts[doc] + edge - bounds[doc]
    k = int(np.searchsorted(edge, whole))
    rows = pa.ListArray.from_arrays(
        pa.array(np.append(np.searchsorted(edge[:k], np.arange(0, min(whole, bounds[-1]), length)), k), pa.int32()),
        pa.StructArray.from_arrays([names.take(pa.array(doc[:k])), pa.array(start[:k]), pa.array(size[:k])],
                                   ["doc_id", "start", "length"]))
    return rows, names.take(pa.array(doc[k:])), size[k:], start[k:]


def _sequence_batch(ids: np.ndarray, bounds: np.ndarray, rows: pa.Array) -> pa.RecordBatch:
    packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
    return pa.RecordBatch.from_arrays([packed, rows], names=["ids", "docs"])


def write_sequences(seqs: DataFrame, path: str) -> None:
    seqs.withColumn("uid", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path, compression="zstd")


def number(spark: SparkSession, path: str, key: int = KEY) -> tuple[DataFrame, int]:
    """The sequences written to ``path``, each row with its slot; and their
    number.  Rows are numbered by the written table's partitions: one count per
    partition comes to the driver."""
    rows = spark.read.parquet(path)
    part = F.shiftright("uid", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part"))
                   .agg((F.max("uid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n")).collect())
    parts = np.array([p for p, _ in sizes], np.int64)
    before = np.cumsum([0] + [n for _, n in sizes])
    n = int(before[-1])

    @F.arrow_udf("bigint")
    def slot(uids: pa.Array) -> pa.Array:
        uid = uids.to_numpy()
        index = before[np.searchsorted(parts, uid >> 33)] + (uid & ((1 << 33) - 1))
        return pa.array(feistel(index, n, key), pa.int64())

    return rows.withColumn("slot", slot("uid")).drop("uid"), n


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, content: str) -> None:
    """A small file, there as a whole or not at all."""
    target, system = _file(spark, path)
    draft, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    if not system.rename(draft, target):
        system.delete(draft, False)
        if not system.exists(target):
            raise RuntimeError(f"could not write {path}")


def _get(spark: SparkSession, path: str) -> str | None:
    target, system = _file(spark, path)
    if not system.exists(target):
        return None
    content = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(content, "UTF-8")
    finally:
        content.close()


def ranges(n: int, per_shard: int = PER_SHARD, rounds: int = WRITE_ROUNDS) -> list[tuple[int, int]]:
    """The rounds as (first, last) shards."""
    n_shards = -(-n // per_shard)
    per_round = max(1, -(-n_shards // rounds))
    return [(lo, min(n_shards, lo + per_round) - 1) for lo in range(0, n_shards, per_round)]


def write_range(numbered: DataFrame, path: str, first: int, last: int, length: int = SEQUENCE,
                per_shard: int = PER_SHARD) -> None:
    """Writes the shards ``first`` to ``last``, replacing what is there of them."""
    width = 10 + 2 * length

    @F.arrow_udf("binary")
    def record(slots: pa.Array, ids: pa.Array) -> pa.Array:
        ids, m = ids.cast(pa.binary()), len(ids)
        out = np.zeros((m, width), np.uint8)
        if m:
            bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + m + 1]
            body = np.frombuffer(ids.buffers()[2], np.uint8)
            size = np.diff(bounds)
            out[:, :8] = slots.to_numpy().astype("<i8").view(np.uint8).reshape(m, 8)
            out[:, 8:10] = (size // 2).astype("<u2").view(np.uint8).reshape(m, 2)
            if (size == 2 * length).all():
                out[:, 10:] = body[bounds[0]:bounds[-1]].reshape(m, -1)
            else:
                for i in range(m):
                    out[i, 10:10 + size[i]] = body[bounds[i]:bounds[i + 1]]
        return pa.Array.from_buffers(pa.binary(), m, [
            None, pa.py_buffer((np.arange(m + 1) * width).astype(np.int32)), pa.py_buffer(out)])

    tasks = -(-(last - first + 1) // SHARDS_PER_TASK)
    shard = F.floor(F.col("slot") / per_shard).cast("bigint")
    (numbered.select("slot", "ids", shard.alias("shard"))
     .where(F.col("shard").between(first, last))
     .repartitionById(tasks, F.floor((F.col("shard") - first) / SHARDS_PER_TASK).cast("int"))
     .sortWithinPartitions("shard", "slot")
     .select(record("slot", "ids").cast("string").alias("value"), "shard")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").text(path))


def write_shards(numbered: DataFrame, n: int, path: str, length: int = SEQUENCE,
                 per_shard: int = PER_SHARD, rounds: int = WRITE_ROUNDS) -> None:
    """Writes the shards under ``path``, one range of slots after the other,
    but for those whose mark says that they are finished."""
    spark = numbered.sparkSession
    for first, last in ranges(n, per_shard, rounds):
        mark = f"{path}/_ranges/{first}-{last}"
        if _get(spark, mark) is None:
            write_range(numbered, path, first, last, length, per_shard)
            _put(spark, mark, str(n))
            release(spark)


def _records(content: pa.Scalar, length: int):
    """Slots, numbers of ids and ids (rows of ``length``) of one shard."""
    raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride(length))
    return (raw[:, :8].copy().view("<i8")[:, 0], raw[:, 8:10].copy().view("<u2")[:, 0],
            raw[:, 10:10 + 2 * length].copy().view("<u2"))


def _shards(spark: SparkSession, path: str, length: int, last: pa.DataType, name: str, of) -> DataFrame:
    def records(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                slots, sizes, ids = _records(content, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slots), shard, np.int64)),
                     pa.array(np.arange(len(slots), dtype=np.int64) * stride(length)), pa.array(slots),
                     pa.array(sizes.astype(np.int32)), pa.array(of(ids, sizes), last)],
                    names=["shard", "at", "slot", "n_tokens", name])

    kind = {pa.binary(): "binary", pa.int64(): "bigint"}[last]
    files = (spark.read.format("binaryFile").load(path)
             .select(F.col("shard").cast("bigint").alias("shard"), "content"))
    return files.mapInArrow(records, f"shard bigint, at bigint, slot bigint, n_tokens int, {name} {kind}")


def read_shards(spark: SparkSession, path: str, length: int = SEQUENCE) -> DataFrame:
    """Every record of the shards under ``path``: shard, at, slot, n_tokens, ids."""
    return _shards(spark, path, length, pa.binary(), "ids",
                   lambda ids, sizes: [r[:k].tobytes() for r, k in zip(ids, sizes)])


def shard_digests(spark: SparkSession, path: str, length: int = SEQUENCE) -> DataFrame:
    """As ``read_shards``, with the crc32 of the ids as 32-bit ones in their place."""
    return _shards(spark, path, length, pa.int64(), "ids_crc32",
                   lambda ids, sizes: [zlib.crc32(r[:k]) for r, k in zip(ids.astype("<u4"), sizes)])


def materialise(docs: DataFrame, path: str | None = None, key: int = KEY,
                tokenizer_path: str | None = None, length: int = SEQUENCE, per_shard: int = PER_SHARD,
                rounds: int = WRITE_ROUNDS) -> DataFrame:
    """Writes the shards of ``docs`` and returns one row per sequence as read
    back from them: slot, shard, at (byte), n_tokens, ids_crc32 and docs (the
    documents in it, each with its start there and length).  With a ``path``
    that an earlier call began, goes on after its finished rounds; its sequences
    are then those of that call, and other settings raise an error."""
    spark = docs.sparkSession
    if path is None:
        path = f"{checkpoint_dir(spark)}/token-shards-{uuid.uuid4().hex}"
        remove_at_exit(spark, path)
        remove_at_exit(spark, f"{path}-sequences")
    settings = json.dumps({"key": key, "tokenizer": tokenizer_path, "length": length, "per_shard": per_shard,
                           "rounds": rounds})
    begun = _get(spark, f"{path}/_settings")
    if begun is None:
        write_sequences(sequences(docs, length, tokenizer_path), f"{path}-sequences")
        _put(spark, f"{path}/_settings", settings)
    elif begun != settings:
        raise ValueError(f"{path} was begun with {begun}")
    numbered, n = number(spark, f"{path}-sequences", key)
    if not n:
        return numbered.select("slot", F.lit(0).cast("bigint").alias("shard"),
                               F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("n_tokens"),
                               F.lit(0).cast("bigint").alias("ids_crc32"), "docs")
    write_shards(numbered, n, path, length, per_shard, rounds)
    return shard_digests(spark, path, length).join(numbered.select("slot", "docs"), "slot").select(
        "slot", "shard", "at", "n_tokens", "ids_crc32", "docs")
