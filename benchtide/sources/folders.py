"""Folders of any number of files, listed and read by the tasks.

Spark's file sources list every file on the driver and hold it there once for
each reader, some hundred bytes to a kilobyte a file.  Here a folder's files
are rows: tasks list them, one level of folders after the other, and tasks read
them, so the driver holds neither names nor sizes.  What counts as a file is as
in Spark's readers: names that begin with ``.`` or ``_`` (without ``=``) and
empty files are passed over, sub-folders are looked into.
"""

from __future__ import annotations

import os
import posixpath
import urllib.parse

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.session import SMALL_OPEN_COST, checkpoint_dir

# rows and bytes that a task hands on at a time
_ROWS, _BYTES = 4096, 8 << 20
# a Java URI keeps these as they are
_PLAIN = "/-_.!~'()*,;:$&+=@"


def _system(root: str):
    """The file system of a qualified folder, and the folder's path in it."""
    from pyarrow import fs

    scheme, _, rest = root.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    return fs.FileSystem.from_uri(root)


def qualified(spark: SparkSession, folder: str) -> str | None:
    """``folder`` as a whole URI if tasks can list it: a folder (no file, no
    pattern) of a file system that pyarrow opens.  Else None: Spark's own
    readers are for the others."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(conf)
    try:
        if not system.getFileStatus(target).isDirectory():
            return None
    except Exception:  # nothing of that name: a pattern, or Spark says that it is not there
        return None
    root = system.makeQualified(target).toString()
    try:
        _system(root)
    except Exception:
        return None
    return root


def _entries(system, root: str, folder: str):
    """(name below root, size or None for a folder) of one folder's entries."""
    from pyarrow import fs

    at = posixpath.join(root, folder) if folder else root
    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(at) as found:  # one entry at a time, however many there are
                for x in found:
                    try:
                        size = None if x.is_dir() else x.stat().st_size if x.is_file() else 0
                    except FileNotFoundError:
                        continue
                    yield posixpath.join(folder, x.name), size
        except FileNotFoundError:
            if not folder:  # the root was there: this machine does not see it
                raise
    else:
        for x in system.get_file_info(fs.FileSelector(at, allow_not_found=bool(folder))):
            if x.type in (fs.FileType.File, fs.FileType.Directory):
                yield posixpath.join(folder, x.base_name), x.size if x.is_file else None


def _passed_over(name: str, folder: bool) -> bool:
    last = posixpath.basename(name)
    if folder and last.startswith(("_metadata", "_common_metadata")):
        return False
    return last.startswith(".") or last.startswith("_") and "=" not in last or last.endswith("._COPYING_")


def _walk(system, root: str, folder: str, deep: bool):
    for name, size in _entries(system, root, folder):
        if _passed_over(name, size is None):
            continue
        if size is None and deep:
            yield from _walk(system, root, name, deep)
        elif size != 0:
            yield name, size


def _listed(root: str, deep: bool):
    """Files pass; a folder gives its entries, with ``deep`` all files below."""

    def run(batches):
        system, path = _system(root)
        for batch in batches:
            sizes = batch.column(1)
            yield batch.filter(sizes.is_valid())
            names, found = [], []
            for folder in batch.column(0).filter(sizes.is_null()).to_pylist():
                for name, size in _walk(system, path, folder, deep):
                    names.append(name)
                    found.append(size)
                    if len(names) >= _ROWS:
                        yield _files(names, found)
                        names, found = [], []
            yield _files(names, found)

    return run


def _files(names: list, sizes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(name below ``root``, size) of the files below a ``qualified`` folder
    whose last name fits ``glob``, as they are now.  The list is written to
    ``spark.checkpoint.dir`` in as many partitions as Spark's readers would
    make, so that files can be read where their names are."""
    checkpoint_dir(spark)
    schema = "name string, size bigint"
    tasks = 4 * spark.sparkContext.defaultParallelism
    found = spark.createDataFrame(spark.sparkContext.parallelize([("", None)], 1), schema)
    for deep in (False, False, True):
        found = found.mapInArrow(_listed(root, deep), schema)
        found = found if deep else found.repartition(tasks, "name")
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    found = found.where(F.substring_index("name", "/", -1).rlike(rf"(?s)\A(?:{pattern})\z"))
    found = found.persist(StorageLevel.DISK_ONLY)
    try:
        whole = found.agg(F.coalesce(F.sum(F.col("size") + SMALL_OPEN_COST), F.lit(0)).alias("bytes")).first()["bytes"]
        most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes"))
        least = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)
        split = min(most, max(SMALL_OPEN_COST, whole // least))
        return found.repartition(max(1, -(-whole // split)), "name").checkpoint()
    finally:
        found.unpersist()


def file_uri(root_uri: str, name: str) -> str:
    """The URI of a file as ``_metadata.file_path`` gives it."""
    return f"{root_uri}/" + "".join(
        c if ord(c) > 127 and c.isprintable() else urllib.parse.quote(c, safe=_PLAIN) for c in name)


def read_files(spark: SparkSession, files: DataFrame, root: str, missing: bool = False) -> DataFrame:
    """(path, name, content) of listed ``files``: ``path`` is the file's URI.
    A task holds a few MB at a time, or one file if that is larger.  With
    ``missing``, files that are gone by now are passed over."""
    uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().toString().rstrip("/")

    def run(batches):
        system, path = _system(root)
        for batch in batches:
            names, bodies, held = [], [], 0
            for name in batch.column(0).to_pylist():
                try:
                    with system.open_input_file(posixpath.join(path, name)) as file:
                        body = file.read()
                except FileNotFoundError:
                    if missing:
                        continue
                    raise
                if names and (held + len(body) > _BYTES or len(names) >= _ROWS):
                    yield _contents(uri, names, bodies)
                    names, bodies, held = [], [], 0
                names.append(name)
                bodies.append(body)
                held += len(body)
            yield _contents(uri, names, bodies)

    return files.select("name").mapInArrow(run, "path string, name string, content binary")


def _contents(uri: str, names: list, bodies: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([file_uri(uri, n) for n in names], pa.string()), pa.array(names, pa.string()),
         pa.array(bodies, pa.binary())], ["path", "name", "content"])
