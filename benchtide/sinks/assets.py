"""Changed-asset sync (B-5): ship an asset only when the target lacks it or
holds different bytes (SHA-256), and copy it there."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchtide.session import many_files
from benchtide.sources.folders import list_files, qualified, read_files


def changed_assets(shipped: DataFrame, current: DataFrame, name: str = "name",
                   content: str = "content") -> DataFrame:
    """Rows of ``shipped`` to copy, with ``change`` = new | changed and the
    new hash.  Both sides are hashed in the JVM and joined on the name
    (sort-merge on large catalogues; AQE broadcasts a small side)."""
    new = shipped.select(F.col(name).alias("name"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    old = current.select(F.col(name).alias("name"),
                         F.sha2(F.col(content).cast("binary"), 256).alias("_old"))
    j = new.join(old, "name", "left")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("sha256"), "changed")
    return j.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        "name", "change", "sha256")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Each row's ``content`` as the file ``name`` (a path below ``folder``, a
    URI that all executors reach), written by the tasks that hold the rows.
    A file is written under a name of its own and renamed into place, so a task
    that runs twice leaves the same file and a lost one leaves none half
    written.  Null contents give empty files, written where there is none.  Returns the lazy (name, bytes)
    of the files; an action on it does the writing."""

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
            else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            names, sizes = [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = [p for p in (path or "").split("/") if p]
                if not parts or ".." in parts:
                    raise ValueError(f"not a path below the folder: {path!r}")
                target = posixpath.join(root, *parts)
                body = data.as_buffer() or b""
                # Spark's readers pass over empty files, so these come here again
                if not len(body) and system.get_file_info(target).size == 0:
                    continue
                draft = posixpath.join(posixpath.dirname(target), f".{parts[-1]}.{uuid.uuid4().hex}")
                if posixpath.dirname(target) not in made:
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    made.add(posixpath.dirname(target))
                with system.open_output_stream(draft) as out:
                    out.write(body)
                system.move(draft, target)
                names.append(path)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())],
                                             ["name", "bytes"])

    rows = files.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(write, "name string, bytes bigint")


def make_folder(spark, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def folder_files(spark, folder: str, glob: str = "*") -> DataFrame:
    """The files below ``folder`` as (name, content); drafts are left out.  The
    tasks list and read them (see ``sources.folders``); on a file system that
    pyarrow does not open, Spark lists them on the driver."""
    target = qualified(spark, folder)
    if target is not None:
        return read_files(spark, list_files(spark, target, glob), target).select("name", "content")
    many_files(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(folder))
    root = folder.split(":", 1)[-1].rstrip("/").replace("//", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:", ""), "/+", "/")
    return files.select(F.substring(path, F.lit(len(root) + 2), F.length(path)).alias("name"), "content")


def sync_assets(shipped: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """B-5 whole: make every shipped asset stand in ``folder`` as it was
    shipped, copying those that are new there or changed; how many."""
    spark = shipped.sparkSession
    make_folder(spark, folder)
    changes = changed_assets(shipped, folder_files(spark, folder), name, content)
    todo = shipped.join(changes.select(F.col("name").alias(name)), name, "left_semi")
    return write_files(todo, folder, name, content).count()
