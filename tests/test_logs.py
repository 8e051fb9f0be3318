"""Logs in pieces, log files in byte ranges, assets copied into place."""

import gzip
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from benchtide import registry
from benchtide.functions.codec import b64_encode
from benchtide.operators import logs
from benchtide.session import configure
from benchtide.sinks import assets
from benchtide.sinks.assets import folder_files, sync_assets, write_files
from benchtide.sources import files
from benchtide.sources.files import read_log_lines

DETAILS = "id string, buildDetails array<struct<type:string,detailCompression:string,detailEncoding:string,detail:string>>"


def details(spark, items):
    """items: (id, [(compression, encoding, bytes or text)])."""
    df = spark.createDataFrame([(i, [("STDOUT_LOG", c, e, d if isinstance(d, str) else None) for c, e, d in ds],
                                 [d if not isinstance(d, str) else None for _, _, d in ds]) for i, ds in items],
                               DETAILS + ", raw array<binary>")
    packed = F.zip_with("buildDetails", "raw", lambda d, b: F.when(b.isNull(), d).otherwise(
        d.withField("detail", b64_encode(b))))
    return df.select("id", packed.alias("buildDetails"))


def frame(data):
    return zstandard.ZstdCompressor().compress(data)


def test_lines_in_pieces_equal_the_whole_decode(spark, monkeypatch):
    rnd = random.Random(3)
    text = "\n".join("é" * rnd.randrange(90) for _ in range(3000)).encode()
    repeated = b"the same line\n" * 200000
    items = [("whole", [("ZSTD", "BASE64", frame(text)), ("NONE", "BASE64", text), ("NONE", "NONE", "a\n\nb\n")]),
             ("frames", [("ZSTD", "BASE64", frame(text) + frame(repeated) + frame(b""))]),
             ("empty", [("NONE", "NONE", ""), ("ZSTD", "BASE64", frame(b""))]), ("none", [])]
    df = details(spark, items)
    want = logs.log_lines(logs.decode_details(df).where("content is not null").drop("error"))
    cols = ["id", "detail_no", "type", "line_no", "line"]
    got = logs.detail_lines(df)
    assert got.where("error is not null").count() == 0
    both = [x.withColumn("line_no", F.col("line_no").cast("long")).select(*cols).groupBy(*cols).count().select(F.sum("count"), F.bit_xor(F.xxhash64(*cols, "count"))).first()
            for x in (got, want)]
    assert both[0] == both[1] and both[0][0] > 200000


def test_unreadable_details_give_their_reason(spark):
    good = frame(b"x" * 9000)
    df = details(spark, [("cut", [("ZSTD", "BASE64", good[:-3])]), ("junk", [("ZSTD", "BASE64", b"junk")]),
                         ("nothing", [("ZSTD", "BASE64", "")]), ("base64", [("ZSTD", "BASE64", "?not base64?")]),
                         ("tail", [("ZSTD", "BASE64", good + b"xx")])])
    got = {r.id: (r.line_no, r.line, r.error) for r in logs.detail_lines(df).collect()}
    assert got == {"cut": (None, None, "truncated zstd frame"), "junk": (None, None, "not zstd data"),
                   "nothing": (None, None, "empty zstd data"), "base64": (None, None, "bad base64"),
                   "tail": (None, None, "not zstd data")}
    whole = {r.id: r.error for r in logs.decode_details(df).collect()}
    assert whole == {i: e for i, (_, _, e) in got.items()}


def test_pieces_are_bounded():
    """A frame of one repeated byte grows most: 128 KiB from four bytes."""
    data = frame(b"\0" * (400 << 20))
    sizes = [len(p) for p in logs._pieces(memoryview(data), "ZSTD", "NONE")]
    assert sum(sizes) == 400 << 20 and max(sizes) <= 33 << 20
    lists = list(logs._lines(iter([b"a\n" * 100000, b"b", b"c\n", b"d"])))
    assert max(map(len, lists)) <= 8192 + 1 and sum(map(len, lists)) == 100002
    assert lists[-1][-2:] == [b"bc", b"d"]


def test_a_large_log_file_is_read_by_many_tasks(spark, tmp_path):
    rnd = random.Random(5)
    lines = ["x" * rnd.randrange(200) for _ in range(20000)]
    (tmp_path / "b1.build.stdout.20240102030405.log").write_text("\n".join(lines))
    (tmp_path / "b2.benchmark.stderr.20240102030406.log").write_text("one\r\ntwo\n")
    (tmp_path / "b3.build.stderr.20240102030406.log").write_text("")
    (tmp_path / "notes.txt").write_text("not a log")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        df = read_log_lines(spark, str(tmp_path))
        got = df.collect()
        parts = spark.read.text(str(tmp_path / "b1*"), lineSep="\n").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 10
    by = {b: [r.line for r in sorted((r for r in got if r.build_id == b), key=lambda r: r.line_no)] for b in ("b1", "b2")}
    assert by == {"b1": lines, "b2": ["one\r", "two"]} and len(got) == 20002
    assert sorted(r.line_no for r in got if r.build_id == "b1") == list(range(1, 20001))
    assert {(r.phase, r.stream) for r in got} == {("build", "stdout"), ("benchmark", "stderr")}


def test_small_log_files_are_read_whole_and_once(spark, tmp_path, monkeypatch):
    """The same rows whole and in ranges, of any bytes; whole files need no
    shuffle, and a task reads many of them."""
    bodies = [b"one\r\ntwo\n", b"no end", b"\n", b"\n\na\n\n", b"", b"\xef\xbb\xbfmarked\nb", b"\xef\xbb\xbf",
              b"bad \xff\xfe bytes\n\xc3", "é 漢字 \U0001f600\n\x00\u2028x\x85y".encode(), b"\xef\xbb\xbf\nz"]
    (tmp_path / "deep").mkdir()
    for i in range(600):
        (tmp_path / ("deep" if i % 2 else ".") / f"b{i}.build.stdout.20240102030405.log").write_bytes(bodies[i % len(bodies)])
    (tmp_path / "z.build.stdout.20240102030405.log.gz").write_bytes(gzip.compress(b"packed\nlines\n"))

    def rows(glob):
        df = read_log_lines(spark, str(tmp_path), glob)
        return df, sorted(map(tuple, df.withColumn("line", F.col("line").cast("binary")).collect()))

    df, whole = rows("*.log")
    assert df.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    both = rows("*")[1]
    assert {bytes(r[-1]) for r in both} - {bytes(r[-1]) for r in whole} == {b"packed", b"lines"}
    monkeypatch.setattr(files, "WHOLE_FILE", -1)
    assert rows("*.log")[1] == whole and rows("*")[1] == both and len(whole) == 60 * 16
    configure(spark)
    assert "65536" not in spark.conf.get("spark.sql.files.openCostInBytes")


def test_folder_files_reads_many_small_files_in_a_task(spark, tmp_path):
    for i in range(900):
        (tmp_path / f"{i}.txt").write_text(str(i))
    got = folder_files(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
    assert {r.name: bytes(r.content) for r in got.collect()} == {f"{i}.txt": str(i).encode() for i in range(900)}


ODD_NAMES = ["a b", "50%", "50%25", "x#1", "q?", "[b]", "{c,d}", "k=v", "_k=v", "é漢", "a\u00a0b", "p+q;r,s@u!", "~'()*&$",
             "q\"<>^`|\\", "_passed over", ".passed over", "in.COPYING_", "in._COPYING_", "line\nend"]


def by_tasks_and_by_spark(monkeypatch, read):
    """The rows that ``read`` gives when tasks list the files, and when Spark does."""
    rows = [sorted(map(tuple, read().collect()))]
    with monkeypatch.context() as m:
        m.setattr(files, "qualified", lambda *_: None)
        m.setattr(assets, "qualified", lambda *_: None)
        rows.append(sorted(map(tuple, read().collect())))
    return rows


@pytest.mark.parametrize("glob", ["*.log", "*", "[!a]*.{log,txt}", "b?.*"])
def test_files_listed_by_tasks_are_those_that_spark_lists(spark, tmp_path, monkeypatch, glob):
    root = tmp_path / "the 100% root"
    for i, name in enumerate(ODD_NAMES):
        for folder in (".", "one/two/three/four", name):
            (root / folder).mkdir(parents=True, exist_ok=True)
            (root / folder / f"{name}.build.stdout.20240102030405.log").write_text(f"{i}\n{folder}")
    for name in ("_metadata/b1.log", "_metadata.log", "b2.txt", "empty.log", "b3.log/inside.log"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("" if name == "empty.log" else name)
    (root / "b4.log").symlink_to(root / "b2.txt")
    (root / "nothing inside").mkdir()

    def lines():
        return read_log_lines(spark, str(root), glob).withColumn("started", F.col("started").cast("string"))

    for whole_file in (files.WHOLE_FILE, 30):
        monkeypatch.setattr(files, "WHOLE_FILE", whole_file)
        got, want = by_tasks_and_by_spark(monkeypatch, lines)
        assert got == want and got
    got, want = by_tasks_and_by_spark(monkeypatch, lambda: folder_files(spark, f"file:{root}/", glob))
    assert got == want and got


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    """Spark's readers of files hold every file on the driver, so none is made;
    what came to the driver of 3,000 files is the sum of their sizes."""
    for i in range(3000):
        (tmp_path / f"{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 7}" / f"{i}.build.stdout.20240102030405.log").write_text(f"{i}\n")

    def leaves(df):
        return df._jdf.queryExecution().analyzed().collectLeaves().toString()

    lines, held = read_log_lines(spark, str(tmp_path)), folder_files(spark, str(tmp_path))
    for df in (lines, held):
        assert "LogicalRDD" in leaves(df) and "Relation [" not in leaves(df)
        assert df.inputFiles() == []
    assert lines.count() == held.count() == 3000
    with monkeypatch.context() as m:
        m.setattr(assets, "qualified", lambda *_: None)
        assert len(folder_files(spark, str(tmp_path)).inputFiles()) == 3000


def test_files_that_go_between_listing_and_reading(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.build.stdout.20240102030405.log").write_text("a")
    lines, held = read_log_lines(spark, str(tmp_path)), folder_files(spark, str(tmp_path))
    (tmp_path / "3.build.stdout.20240102030405.log").unlink()
    assert lines.count() == 4
    with pytest.raises(Exception, match="FileNotFoundError"):
        held.collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        folder_files(spark, str(tmp_path / "none"))


def test_payload_files_are_written_by_many_tasks(spark, tmp_path):
    rows = [(i, f"s{i}") for i in range(1, 400)] + [(400, None)]
    supplier = spark.createDataFrame(rows, "s_suppkey bigint, s_name string").coalesce(1)
    supplier.write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.s_suppkey: r for r in registry.q_payload_files(spark, str(tmp_path)).collect()}
    assert len(got) == 400 and got[400].n_chars == 0
    assert [got[i].verdict for i in (4, 5, 6)] == ["OK", "INVALID_JSON", "INVALID_PAYLOAD"] and got[4].ref == "s4"
    supplier.limit(0).write.parquet(str(tmp_path / "none" / "supplier.parquet"))
    assert registry.q_payload_files(spark, str(tmp_path / "none")).count() == 0
    tasks = registry.payload_bodies(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count()
    assert tasks.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sync_copies_what_changed_and_nothing_twice(spark, tmp_path):
    folder = str(tmp_path / "target")
    shipped = spark.createDataFrame([("a.html", bytearray(b"1")), ("js/b.js", bytearray(b"2" * 100000)), ("c", None)],
                                    "name string, content binary")
    assert [sync_assets(shipped, folder) for _ in range(2)] == [3, 0]
    newer = spark.createDataFrame([("a.html", bytearray(b"9")), ("js/b.js", bytearray(b"2" * 100000))],
                                  "name string, content binary")
    assert [sync_assets(newer, folder) for _ in range(2)] == [1, 0]
    held = {r.name: bytes(r.content) for r in folder_files(spark, folder).collect()}
    assert held == {"a.html": b"9", "js/b.js": b"2" * 100000}       # readers pass over empty files
    assert (tmp_path / "target" / "c").read_bytes() == b""
    left = [p for p in (tmp_path / "target").rglob(".*") if not p.name.endswith(".crc")]
    assert left == []


def test_a_file_name_must_stay_below_the_folder(spark, tmp_path):
    bad = spark.createDataFrame([("../x", b"1")], "name string, content binary")
    with pytest.raises(Exception, match="not a path below"):
        write_files(bad, str(tmp_path)).collect()
