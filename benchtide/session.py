"""Session settings the operators rely on.

``configure`` only sets SQL options that are runtime-settable; ``build_session``
is a convenience for tests, benchmarks and local runs.
"""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession

# SQL options every operator assumes (all runtime-settable).
SQL_CONF = {
    # timestamps are UTC everywhere (messages carry Z / [UTC])
    "spark.sql.session.timeZone": "UTC",
    # base64 text must be one line, as the message codec writes it
    "spark.sql.chunkBase64String.enabled": "false",
    # building a map keeps the last duplicate key
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # payload kind checks parse JSON into VARIANT; duplicates must not null it
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # transformWithState keeps its state in RocksDB
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

STATE_STORE_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


# what opening a file counts for when files are dealt to tasks: Spark's 4 MB
# make a task of every 32 small files, this one of about 2,000
OPEN_COST, SMALL_OPEN_COST = "spark.sql.files.openCostInBytes", 64 << 10

_SHIPPED: set[str] = set()
_OPEN_COST: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``benchtide`` importable in the Python workers: zip the package
    once per application and add it with ``addPyFile`` (the same as
    ``--py-files``), since UDFs and processors refer to its functions."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="benchtide-pyfiles-"), "benchtide.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    # the transformWithState Python runner does not see addPyFile includes:
    # send the package's functions and processor classes by value as well
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["benchtide"])
    _SHIPPED.add(sc.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL options the library depends on and ship the
    package to the Python workers."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    own = _OPEN_COST.pop(spark.sparkContext.applicationId, None)
    if own is not None:
        spark.conf.set(OPEN_COST, own)
    ship_package(spark)
    return spark


def many_files(spark: SparkSession) -> None:
    """For folders of many small files: many of them to a task, in the scans
    that run until the next ``configure``, which puts the old setting back."""
    _OPEN_COST.setdefault(spark.sparkContext.applicationId, spark.conf.get(OPEN_COST))
    spark.conf.set(OPEN_COST, str(SMALL_OPEN_COST))


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "benchtide", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (UI off, RocksDB state store)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE_PROVIDER)
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be configured (a shared file system path). Only a
    local-mode session without one gets a fresh scratch folder, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so lineage can be cut safely")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="benchtide-ckpt-"))
    return sc.getCheckpointDir()
