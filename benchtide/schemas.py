"""Record schemas and the fixed enumerations of the message model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference model for results to match).
# Build states in declaration order, each with the state that must precede it.
BUILD_STATES = [
    "REQUESTING",
    "REQUESTED",
    "UPDATING_SOURCE",
    "UPDATING_SOURCE_FAILED",
    "UPDATING_SOURCE_COMPLETE",
    "BUILDING",
    "BUILDING_FAILED",
    "BUILDING_COMPLETE",
    "BENCHMARKING",
    "BENCHMARKING_FAILED",
    "BENCHMARKING_COMPLETE",
]
PREV_STATE = {
    "REQUESTING": None,
    "REQUESTED": "REQUESTING",
    "UPDATING_SOURCE": "REQUESTED",
    "UPDATING_SOURCE_FAILED": "UPDATING_SOURCE",
    "UPDATING_SOURCE_COMPLETE": "UPDATING_SOURCE",
    "BUILDING": "UPDATING_SOURCE_COMPLETE",
    "BUILDING_FAILED": "BUILDING",
    "BUILDING_COMPLETE": "BUILDING",
    "BENCHMARKING": "BUILDING_COMPLETE",
    "BENCHMARKING_FAILED": "BENCHMARKING",
    "BENCHMARKING_COMPLETE": "BENCHMARKING",
}
UPDATE_SUCCESS_STATES = [
    "UPDATING_SOURCE",
    "UPDATING_SOURCE_COMPLETE",
    "BUILDING",
    "BUILDING_COMPLETE",
    "BENCHMARKING",
]
FAILURE_STATES = ["UPDATING_SOURCE_FAILED", "BUILDING_FAILED", "BENCHMARKING_FAILED"]
FINAL_SUCCESS_STATES = ["BENCHMARKING_COMPLETE"]
PUBLISH_STATES = ["COMPLETE", "FAILED"]
DETAIL_TYPES = ["STDOUT_LOG", "STDERR_LOG", "EXCEPTION_MESSAGE"]
COMPRESSIONS = ["NONE", "ZSTD"]
ENCODINGS = ["NONE", "BASE64"]
# Result-history task names, in the order the three rows are written.
RESULT_TASKS = ["Update Source", "Compile Source", "Benchmark 1"]
# Value of a timing that was never measured.
NOT_MEASURED = -1
# Request admission (HTTP) statuses, first match wins in this order.
STATUS_METHOD_NOT_ALLOWED = 405
STATUS_NOT_FOUND = 404
STATUS_UNSUPPORTED_MEDIA_TYPE = 415
STATUS_BAD_REQUEST = 400
STATUS_UNPROCESSABLE = 422
STATUS_UNAVAILABLE = 503
STATUS_ACCEPTED = 202
WEBHOOK_PATH = "/cb"
JSON_CONTENT_TYPE = "application/json"
# ---------------------------------------------------------------------------

FINAL_STATES = FAILURE_STATES + FINAL_SUCCESS_STATES

PUSH_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timeStamp", T.TimestampType()),
    T.StructField("ref", T.StringType()),
    T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType()),
    T.StructField("repository", T.StringType()),
    T.StructField("pusher", T.StringType()),
    T.StructField("sender", T.StringType()),
])

BUILD_REQUEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timeStamp", T.TimestampType()),
    T.StructField("repository", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("author", T.StringType()),
])

BUILD_STATS = T.StructType([
    T.StructField("updateSourceTime", T.LongType()),
    T.StructField("compilationTime", T.LongType()),
    T.StructField("benchmarkTime", T.LongType()),
])

BUILD_DETAIL = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("detailCompression", T.StringType()),
    T.StructField("detailEncoding", T.StringType()),
    T.StructField("detail", T.StringType()),
])

BUILD_RESPONSE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timeStamp", T.TimestampType()),
    T.StructField("buildState", T.StringType()),
    T.StructField("buildRequest", BUILD_REQUEST),
    T.StructField("buildStats", BUILD_STATS),
    T.StructField("buildDetails", T.ArrayType(BUILD_DETAIL)),
])

PUBLISH_REQUEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timeStamp", T.TimestampType()),
    T.StructField("buildResponse", BUILD_RESPONSE),
])

PUBLISH_RESPONSE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timeStamp", T.TimestampType()),
    T.StructField("publishState", T.StringType()),
    T.StructField("buildRequest", BUILD_REQUEST),
])

BENCHMARK_RESULT = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("time", T.LongType()),
])

CHART_POINT = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("time", T.DoubleType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("downstream_ok", T.BooleanType()),
])

# Record name -> (schema, required top-level fields) for JSON decoding.
RECORDS = {
    "push_event": (PUSH_EVENT, ["id", "timeStamp", "ref", "before", "after",
                                "repository", "pusher", "sender"]),
    "build_request": (BUILD_REQUEST, ["id", "timeStamp", "repository", "ref",
                                      "commit", "author"]),
    "build_stats": (BUILD_STATS, ["updateSourceTime", "compilationTime",
                                  "benchmarkTime"]),
    "build_detail": (BUILD_DETAIL, ["type", "detailCompression",
                                    "detailEncoding", "detail"]),
    "build_response": (BUILD_RESPONSE, ["id", "timeStamp", "buildState",
                                        "buildRequest"]),
    "publish_request": (PUBLISH_REQUEST, ["id", "timeStamp", "buildResponse"]),
    "publish_response": (PUBLISH_RESPONSE, ["id", "timeStamp", "publishState",
                                            "buildRequest"]),
}

# Enum-valued fields per record, checked by the decoder.
RECORD_ENUMS = {
    "build_response": {"buildState": BUILD_STATES},
    "publish_response": {"publishState": PUBLISH_STATES},
    "build_detail": {"type": DETAIL_TYPES, "detailCompression": COMPRESSIONS,
                     "detailEncoding": ENCODINGS},
}
