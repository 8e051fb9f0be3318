"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.session import checkpoint_dir

# words of the contracts: runs without ASCII white space
WORD = re.compile(r"[^\x20\x09-\x0d]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"

# texts are handed to Python in batches of at most this many rows
ARROW_ROWS = 256

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so a Python worker holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear_staged() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it back: cuts the lineage and survives lost executors.  The table is
    removed by ``unstage`` or when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder of results that nobody named when the application ends."""
    _STAGED.append((spark, path))


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later step reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished steps:
    the driver's Python must let go of their plans first, which its gateway
    does about once a second."""
    import gc
    import time

    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(texts: list[str], max_chars: int):
    """(first, last) ranges of ``texts`` holding about ``max_chars`` together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > max_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
