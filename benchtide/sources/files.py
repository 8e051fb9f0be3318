"""File sources: raw payloads (A-1), JSON-lines message queues (A-2),
results history CSV (A-3), chart points JSON (A-4) and log files (A-5).

Each has a batch and, where it makes sense, a streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from benchtide.functions.times import CHART_DATE_FORMAT, CSV_DATE_FORMAT
from benchtide.operators.logs import parse_log_name
from benchtide.schemas import BENCHMARK_RESULT, CHART_POINT
from benchtide.session import many_files
from benchtide.sources.folders import list_files, qualified, read_files

# log files up to this size are read whole, many by a task
WHOLE_FILE = 4 << 20
# what Spark's text reader unpacks (the reader of whole files does not)
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
_LATIN = "ISO-8859-1"  # one character a byte: any bytes come back as they were


def read_payloads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A-1: one request body per file, as ``body`` with its ``source`` path."""
    reader = spark.readStream if stream else spark.read
    if not stream:
        many_files(spark)
    df = reader.text(path, wholetext=True)
    return df.select(F.col("value").alias("body"),
                     F.col("_metadata.file_path").alias("source"))


def read_queue(spark: SparkSession, path: str, stream: bool = False,
               max_files_per_trigger: int | None = None, arrival: bool = False) -> DataFrame:
    """A-2: a queue stored as JSON-lines text files; one message per line in
    ``value``.  Arrival order is the message's own ``(timeStamp, id)``;
    ``arrival`` adds the time its file was written as ``arrived``."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(path)
    if arrival:
        lines = lines.select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    return lines.filter(F.length("value") > 0)


def read_kafka_queue(spark: SparkSession, bootstrap_servers: str, topic: str,
                     stream: bool = True, starting_offsets: str = "earliest") -> DataFrame:
    """A-2 on Kafka: one message per record as ``value`` text, with the
    topic partition and offset as arrival order, and the broker's time as
    ``arrived``.  Needs the Spark Kafka connector on the cluster's classpath."""
    reader = spark.readStream if stream else spark.read
    df = (reader.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
          .option("subscribe", topic).option("startingOffsets", starting_offsets).load())
    return df.select(F.col("value").cast("string").alias("value"), "partition", "offset",
                     F.col("timestamp").alias("arrived"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A-3: results history ``task,commit,date,time`` with a header line."""
    df = (spark.read.schema(BENCHMARK_RESULT).option("header", True)
          .option("timestampFormat", CSV_DATE_FORMAT).option("recursiveFileLookup", True).csv(path))
    return df


def read_chart_points(spark: SparkSession, path: str) -> DataFrame:
    """A-4: chart points JSON; ``time`` as a number and ``date`` parsed (null
    where it can't be: C-10 drops such points)."""
    df = spark.read.schema(CHART_POINT).option("multiLine", True).json(path)
    return df.select("task", "commit",
                     F.try_to_timestamp("date", F.lit(CHART_DATE_FORMAT)).alias("date"),
                     F.col("time").cast("double").alias("time"))


def read_log_files(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """A-5: log files as bytes with build id, phase, stream and start stamp
    taken from the name; missing or empty files are skipped."""
    many_files(spark)
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(path))
    df = df.filter(F.col("length") > 0)
    cols = parse_log_name("path")
    return df.select("path", "length", "content", *[c.alias(n) for n, c in cols.items()])


def read_log_lines(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """A-5 for log files of any size: one row per line, numbered from 1 in its
    file, with what the file's name tells.  Files up to ``WHOLE_FILE`` are read
    whole, many by a task, and numbered where they are read.  A larger (or
    packed) file is cut into byte ranges (``spark.sql.files.maxPartitionBytes``),
    each read by its own task; a line's number is its place in its range plus
    the lines of the ranges before, one small row per range.  Lines end at a
    newline, also where the file does not; a byte order mark is no text; empty
    files give no rows, files that vanish are passed over.  The files of a folder
    are listed and read by the tasks (see ``folders``; larger and packed ones by
    Spark's text reader), those of a pattern, or of a file system that pyarrow
    does not open, by Spark, which holds their list on the driver."""
    many_files(spark)

    def reader():
        return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
                .option("ignoreMissingFiles", True))

    range_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    limit = min(WHOLE_FILE, range_bytes)
    root = qualified(spark, path)
    if root is not None:
        listed = list_files(spark, root, glob)
        whole = (F.col("size") <= limit) & ~F.col("name").rlike(_PACKED)
        lines = _whole_lines(read_files(spark, listed.where(whole), root, missing=True))
        # these names alone come to the driver, as their ranges would
        large = [f"{root.rstrip('/')}/{r.name}" for r in listed.where(~whole).select("name").collect()]
        if large:
            # the paths are names, no patterns
            text = reader().option("__globPaths__", "false").option("lineSep", "\n").text(large)
            lines = lines.unionByName(_range_lines(text))
        return lines
    whole = ((F.col("_metadata.file_size") <= limit)
             & ~F.col("_metadata.file_path").rlike(_PACKED))
    files = reader().format("binaryFile").load(path)
    lines = _whole_lines(files.where(whole).select(F.col("_metadata.file_path").alias("path"), "content"))
    # only the sizes of the listed files are looked at
    if files.where(~whole).select("path").limit(1).collect():
        lines = lines.unionByName(_range_lines(reader().option("lineSep", "\n").text(path).where(~whole)))
    return lines


def _whole_lines(files: DataFrame) -> DataFrame:
    """The lines of files read whole, (path, content); names are parsed once a file."""
    mark = F.lit(b"\xef\xbb\xbf")
    content = F.when(F.startswith("content", mark), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    parts = files.select("path", F.split(F.decode(content, _LATIN), "\n", -1).alias("parts"))
    cols = parse_log_name("path")
    names = [c.alias(n) for n, c in cols.items()]
    # after the last newline there is no line
    parts = parts.select("path", *names, F.when(F.element_at("parts", -1) == "", F.slice("parts", 1, F.size("parts") - 1))
                         .otherwise(F.col("parts")).alias("parts"))
    return parts.select("path", *cols, F.posexplode("parts").alias("at", "line")).select(
        "path", *cols, (F.col("at").cast("bigint") + 1).alias("line_no"),
        F.encode("line", _LATIN).cast("string").alias("line"))


def _range_lines(text: DataFrame) -> DataFrame:
    """The lines of files read in byte ranges."""
    lines = text.select(F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    ranges = lines.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    cols = parse_log_name("path")
    return lines.join(ranges, ["path", "_start"]).select(
        "path", *[c.alias(n) for n, c in cols.items()],
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")
