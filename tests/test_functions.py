"""Codecs, text forms, timestamps and record JSON (reference goldens)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from benchtide.functions import codec, records, text, times
from benchtide.operators import logs
from benchtide.sinks.deadletter import decode_messages

# fixed values: detail texts of the reference's serialisation tests
OUT_DETAIL = "KLUv/SQIQQAAb3V0LWRhdGG8ODXG"
ERR_DETAIL = "KLUv/SQIQQAAZXJyLWRhdGG6rq6w"


def test_zstd_base64_goldens_decode(spark):
    df = spark.createDataFrame([(OUT_DETAIL,), (ERR_DETAIL,)], "d string")
    got = [r[0] for r in df.select(codec.decode_detail("d", "ZSTD", "BASE64").cast("string")).collect()]
    assert got == ["out-data", "err-data"]


def test_detail_roundtrip_and_plain_exception(spark):
    df = spark.createDataFrame([("line one\nline two",)], "t string")
    packed = df.select(F.array(logs.log_detail(F.col("t")),
                               logs.log_detail(F.col("t"), "EXCEPTION_MESSAGE")).alias("buildDetails"))
    rows = logs.decode_details(packed).orderBy("detail_no").collect()
    assert [r.content.decode() for r in rows] == ["line one\nline two"] * 2
    assert [r.type for r in rows] == ["STDOUT_LOG", "EXCEPTION_MESSAGE"]
    lines = logs.log_lines(logs.decode_details(packed).filter("detail_no = 0")).collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "line one"), (2, "line two")]


def test_base64_single_line(spark):
    df = spark.createDataFrame([(bytes(range(200)),)], "b binary")
    enc = df.select(codec.b64_encode("b")).collect()[0][0]
    assert len(enc) == 268 and "\n" not in enc
    assert df.select(codec.b64_decode(codec.b64_encode("b"))).collect()[0][0] == bytes(range(200))


def test_list_and_map_text(spark):
    df = spark.createDataFrame([(["elem1", "elem2", "elem3"], {"key2": "value2", "key1": "value1",
                                                               "key3": "value3"})],
                               "a array<string>, m map<string,string>")
    r = df.select(text.list_text("a"), text.map_text("m")).collect()[0]
    assert r[0] == "elem1, elem2, elem3"
    assert r[1] == "key1 -> value1, key2 -> value2, key3 -> value3"


def test_map_keeps_last_duplicate(spark):
    df = spark.createDataFrame([(["k", "k"], ["v1", "v2"])], "k array<string>, v array<string>")
    assert df.select(text.map_from_pairs("k", "v")).collect()[0][0] == {"k": "v2"}


def test_enum(spark):
    df = spark.createDataFrame([("ZSTD",), ("LZ4",)], "c string")
    got = df.select(text.enum_value("c", ["NONE", "ZSTD"]),
                    text.enum_error("c", ["NONE", "ZSTD"], "Compression")).collect()
    assert [tuple(r) for r in got] == [("ZSTD", None), (None, "No enum constant Compression.LZ4")]


def test_zoned_text_forms(spark):
    vals = [dt.datetime(2021, 6, 1, 10, 0), dt.datetime(2021, 6, 1, 10, 0, 5),
            dt.datetime(2021, 6, 1, 10, 0, 0, 123000), dt.datetime(2021, 6, 1, 10, 0, 0, 123456)]
    df = spark.createDataFrame([(v,) for v in vals], "t timestamp_ntz")
    got = [r[0] for r in df.select(times.zoned_text("t")).collect()]
    assert got == ["2021-06-01T10:00Z[UTC]", "2021-06-01T10:00:05Z[UTC]",
                   "2021-06-01T10:00:00.123Z[UTC]", "2021-06-01T10:00:00.123456Z[UTC]"]


def test_parse_zoned_forms(spark):
    texts = ["2021-06-01T10:00Z[UTC]", "2021-06-01T10:00:00.123Z[UTC]",
             "2021-06-01T11:00:00+01:00[Europe/London]", "2021-06-01T10:00:00.123456789Z", "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(times.parse_zoned("s").cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2021, 6, 1, 10, 0), dt.datetime(2021, 6, 1, 10, 0, 0, 123000),
                   dt.datetime(2021, 6, 1, 10, 0), dt.datetime(2021, 6, 1, 10, 0, 0, 123456), None]


def test_csv_and_log_formats(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 2, 20, 15, 0, 5000),)], "t timestamp_ntz")
    r = df.select(times.csv_date_text("t"), times.log_stamp("t"), times.label_text("t"),
                  times.percent_text(F.lit(0.163636))).collect()[0]
    assert tuple(r) == ("2000-01-02T20:15:00.005+0000", "20000102201500", "02 Jan 2000", "16%")


def test_record_json_order_and_omission(spark):
    schema = ("id string, timeStamp timestamp_ntz, buildState string, "
              "buildRequest struct<id:string,timeStamp:timestamp_ntz,repository:string,ref:string,commit:string,author:string>, "
              "buildStats struct<updateSourceTime:bigint,compilationTime:bigint,benchmarkTime:bigint>, "
              "buildDetails array<struct<type:string,detailCompression:string,detailEncoding:string,detail:string>>")
    t = dt.datetime(2021, 6, 1, 10, 0)
    req = ("r1", t, "repo", "refs/heads/main", "abc", "me")
    df = spark.createDataFrame([("x1", t, "BUILDING", req, None, [])], schema)
    out = json.loads(df.select(records.record_json("build_response")).collect()[0][0])
    assert list(out) == ["id", "timeStamp", "buildState", "buildRequest"]
    assert out["timeStamp"] == "2021-06-01T10:00Z[UTC]"
    assert list(out["buildRequest"]) == ["id", "timeStamp", "repository", "ref", "commit", "author"]


def test_decode_record_negatives_to_dead_letters(spark):
    good = ('{"id":"r1","timeStamp":"2021-06-01T10:00Z[UTC]","repository":"repo",'
            '"ref":"refs/heads/main","commit":"abc","author":"me","extra":{"x":1}}')
    texts = [good, "not json", "[1,2]", '{"id":"r1"}',
             good.replace("2021-06-01T10:00Z[UTC]", "yesterday")]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    ok, dead = decode_messages(df, "value", "build_request", "build-requests")
    rows = ok.collect()
    assert len(rows) == 1 and rows[0].ref == "refs/heads/main"
    reasons = sorted(r.reason for r in dead.collect())
    assert reasons == ["bad timestamp timeStamp", "invalid JSON", "missing field timeStamp",
                       "not a JSON object"]


def test_decode_enum_check(spark):
    msg = ('{"id":"p","timeStamp":"2021-06-01T10:00Z[UTC]","publishState":"MAYBE",'
           '"buildRequest":{"id":"r","timeStamp":"2021-06-01T10:00Z[UTC]","repository":"a",'
           '"ref":"b","commit":"c","author":"d"}}')
    df = spark.createDataFrame([(msg,)], "value string")
    _, dead = decode_messages(df, "value", "publish_response", "publish-responses")
    assert dead.collect()[0].reason == "unknown publishState MAYBE"


def test_byte_slice(spark):
    df = spark.createDataFrame([(b"0123456789",)], "b binary")
    assert df.select(codec.byte_slice("b", 2, 3)).collect()[0][0] == b"234"


def test_decode_rejects_wrong_kinds(spark):
    base = {"id": "r1", "timeStamp": "2021-06-01T10:00Z[UTC]", "repository": "repo",
            "ref": "refs/heads/main", "commit": "abc", "author": "me"}
    texts = [json.dumps(dict(base, ref={"x": 1})), json.dumps(dict(base, commit=5)),
             json.dumps(dict(base, author=None)), json.dumps(base)]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    ok, dead = decode_messages(df, "value", "build_request", "q")
    assert sorted(r.reason for r in dead.collect()) == [
        "missing field author", "wrong kind for commit", "wrong kind for ref"]
    assert ok.count() == 1
    stats = spark.createDataFrame([('{"updateSourceTime": 1, "compilationTime": 2, "benchmarkTime": "3"}',)],
                                  "value string")
    _, dead = decode_messages(stats, "value", "build_stats", "q")
    assert [r.reason for r in dead.collect()] == ["wrong kind for benchmarkTime"]


def test_decode_rejects_wrong_nested_kinds(spark):
    req = {"id": "r", "timeStamp": "2021-06-01T10:00Z[UTC]", "repository": "a", "ref": "b",
           "commit": "c", "author": "d"}
    base = {"id": "x", "timeStamp": "2021-06-01T10:00Z[UTC]", "buildState": "BUILDING",
            "buildRequest": req}
    texts = [json.dumps(base), json.dumps(dict(base, buildRequest="r")),
             json.dumps(dict(base, buildDetails={"type": "STDOUT_LOG"})),
             json.dumps(dict(base, buildStats=[1, 2, 3])), json.dumps(dict(base, buildStats=None))]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    ok, dead = decode_messages(df, "value", "build_response", "q")
    assert sorted(r.reason for r in dead.collect()) == [
        "wrong kind for buildDetails", "wrong kind for buildRequest", "wrong kind for buildStats"]
    assert ok.count() == 2


def test_decode_rejects_nested_problems_with_their_path(spark):
    stamp = "2021-06-01T10:00Z[UTC]"
    req = {"id": "r", "timeStamp": stamp, "repository": "a", "ref": "b", "commit": "c", "author": "d"}
    detail = {"type": "STDOUT_LOG", "detailCompression": "NONE", "detailEncoding": "NONE", "detail": "x"}
    base = {"id": "x", "timeStamp": stamp, "buildState": "BUILDING", "buildRequest": req, "buildDetails": [detail]}
    texts = [dict(base, buildRequest={"id": "q"}), dict(base, buildRequest=dict(req, ref=5)),
             dict(base, buildRequest=dict(req, timeStamp="zzz")),
             dict(base, buildDetails=[detail, dict(detail, detailEncoding="ROT13")]),
             dict(base, buildDetails=[detail, 5]), base]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts], "value string")
    ok, dead = decode_messages(df, "value", "build_response", "q")
    assert sorted(r.reason for r in dead.collect()) == sorted([
        "missing field buildRequest.timeStamp", "wrong kind for buildRequest.ref",
        "bad timestamp buildRequest.timeStamp", "unknown buildDetails.detailEncoding ROT13",
        "wrong kind for buildDetails"])
    assert ok.count() == 1
    outer = {"id": "p", "timeStamp": stamp, "buildResponse": dict(base, buildRequest=dict(req, author=None))}
    _, dead = decode_messages(spark.createDataFrame([(json.dumps(outer),)], "value string"), "value",
                              "publish_request", "q")
    assert dead.collect()[0].reason == "missing field buildResponse.buildRequest.author"


def test_zstd_all_frames_or_an_error(spark):
    import zstandard

    z = zstandard.ZstdCompressor().compress
    big = z(bytes(range(256)) * 2000)
    cases = [z(b"one\n") + z(b"two\n"), big[:-5], b"junk", z(b"ok") + b"junk"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b binary")
    got = [tuple(r.d) for r in df.select("i", codec.zstd_decode("b").alias("d")).orderBy("i").collect()]
    assert got[0] == (b"one\ntwo\n", None) and got[1] == (None, "truncated zstd frame")
    assert got[2] == (None, "not zstd data") and got[3][0] is None and got[3][1]


def test_unreadable_details_are_dead_letters(spark):
    schema = ("id int, buildDetails array<struct<type:string,detailCompression:string,"
              "detailEncoding:string,detail:string>>")
    df = spark.createDataFrame([(1, [("STDOUT_LOG", "ZSTD", "BASE64", "anVuaw=="),
                                     ("EXCEPTION_MESSAGE", "NONE", "NONE", "boom")])], schema)
    good, dead = logs.split_details(df)
    assert [bytes(r.content) for r in good.collect()] == [b"boom"]
    assert [(r.content, r.reason) for r in dead.collect()] == [("anVuaw==", "not zstd data")]


def test_odd_log_name_and_date_are_null(spark):
    df = spark.createDataFrame([("x/b1.build.stdout.20210601100000.log",), ("x/notes.log",),
                                ("x/b1.build.stdout.99999999999999.log",)], "path string")
    rows = df.select(*[c.alias(n) for n, c in logs.parse_log_name("path").items()]).collect()
    assert rows[0].build_id == "b1" and rows[0].started is not None
    assert tuple(rows[1]) == (None, None, None, None) and rows[2].started is None
