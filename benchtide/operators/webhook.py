"""Webhook intake: payload fields (C-1), payload verdict (C-2), request
admission status (C-3), ref filter (C-4) and push event -> build request (C-5).

All work on a text column; the JSON is parsed in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.schemas import (JSON_CONTENT_TYPE, STATUS_ACCEPTED, STATUS_BAD_REQUEST,
                               STATUS_METHOD_NOT_ALLOWED, STATUS_NOT_FOUND,
                               STATUS_UNAVAILABLE, STATUS_UNPROCESSABLE,
                               STATUS_UNSUPPORTED_MEDIA_TYPE, WEBHOOK_PATH)

# push payload field -> JSON path of the value that is kept
PAYLOAD_FIELDS = {
    "ref": "$.ref",
    "before": "$.before",
    "after": "$.after",
    "repository": "$.repository.full_name",
    "pusher": "$.pusher.name",
    "sender": "$.sender.login",
}

OK, INVALID_JSON, INVALID_PAYLOAD = "OK", "INVALID_JSON", "INVALID_PAYLOAD"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# text that only the lenient JSON reader would take is not JSON here
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_NESTED = sorted({path.split(".")[1] for path in PAYLOAD_FIELDS.values() if path.count(".") == 2})
_NESTED_SCHEMA = "struct<" + ",".join(f"{name}:map<string,variant>" for name in _NESTED) + ">"


def _first_string(entries: Column, key: str) -> Column:
    """Value of the first entry of that key holding a JSON string."""
    held = F.filter(entries, lambda e: (e["key"] == key) & (F.schema_of_variant(e["value"]) == "STRING"))
    return F.try_variant_get(F.get(held, F.lit(0))["value"], "$", "string")


def extract_push_fields(df: DataFrame, text: str) -> DataFrame:
    """C-1: add the six summary columns.  Only JSON *string* values count (a
    number or object in that place is passed over), and of several the first.
    The text is read once as a map of all top-level entries, which tells value
    and kind of each repeated key, and once for the entries of the objects
    inside; of a repeated object the last counts."""
    return _push_fields(df, text).drop("_bt_top")


def _push_fields(df: DataFrame, text: str) -> DataFrame:
    staged = df.withColumns({
        "_bt_top": F.map_entries(F.from_json(F.col(text), "map<string,variant>", _STRICT)),
        "_bt_sub": F.from_json(F.col(text), _NESTED_SCHEMA, _STRICT)})
    fields = []
    for name, path in PAYLOAD_FIELDS.items():
        *outer, key = path.split(".")[1:]
        entries = F.map_entries(F.col("_bt_sub")[outer[0]]) if outer else F.col("_bt_top")
        fields.append(_first_string(entries, key).alias(name))
    return staged.select("*", *fields).drop("_bt_sub")


def classify_payloads(df: DataFrame, text: str, verdict: str = "verdict",
                      keep_fields: bool = True) -> DataFrame:
    """C-1 + C-2: the six fields, then ``verdict``: OK, INVALID_JSON (null,
    empty or unparseable text) or INVALID_PAYLOAD (not an object, or a field
    missing, not a string, or empty).  Text that is no object is parsed once
    more, to tell the two apart."""
    c, top = F.col(text), F.col("_bt_top")
    complete = reduce(lambda a, b: a & b,
                      [F.coalesce(F.col(n) != "", F.lit(False)) for n in PAYLOAD_FIELDS])
    value = (F.when(top.isNotNull(), F.when(complete, F.lit(OK)).otherwise(F.lit(INVALID_PAYLOAD)))
             .when(c.isNull() | (F.trim(c) == "") | F.try_parse_json(c).isNull(), F.lit(INVALID_JSON))
             .otherwise(F.lit(INVALID_PAYLOAD)))
    out = _push_fields(df, text).withColumn(verdict, value).drop("_bt_top")
    return out if keep_fields else out.drop(*PAYLOAD_FIELDS)


def admit_requests(df: DataFrame, method: str = "method", uri: str = "uri",
                   content_type: str = "content_type", body: str = "body",
                   downstream_ok: str = "downstream_ok", status: str = "status") -> DataFrame:
    """C-3 over a request log: adds the HTTP ``status``; the first failing rule wins."""
    staged = classify_payloads(df, body, "_bt_verdict", keep_fields=False)
    verdict, b = F.col("_bt_verdict"), F.col(body)
    value = (F.when(F.coalesce(F.col(method) != "POST", F.lit(True)), STATUS_METHOD_NOT_ALLOWED)
             .when(F.coalesce(F.col(uri) != WEBHOOK_PATH, F.lit(True)), STATUS_NOT_FOUND)
             .when(F.coalesce(F.col(content_type) != JSON_CONTENT_TYPE, F.lit(True)),
                   STATUS_UNSUPPORTED_MEDIA_TYPE)
             .when(b.isNull() | (b == ""), STATUS_BAD_REQUEST)
             .when(verdict == INVALID_JSON, STATUS_BAD_REQUEST)
             .when(verdict == INVALID_PAYLOAD, STATUS_UNPROCESSABLE)
             .when(~F.coalesce(F.col(downstream_ok), F.lit(False)), STATUS_UNAVAILABLE)
             .otherwise(STATUS_ACCEPTED))
    return staged.withColumn(status, value).drop("_bt_verdict")


def validate_patterns(spark, patterns: Sequence[str]) -> None:
    """Fail fast on a pattern the JVM regex engine rejects."""
    if patterns:
        spark.range(1).select(*[F.lit("").rlike(p) for p in patterns]).collect()


# a literal prefix followed by ".*": matches exactly the values that start
# with the prefix and hold no line terminator after it (Java "." excludes them)
_PREFIX_PATTERN = re.compile(r"^([A-Za-z0-9_/\-]*)\.\*$")
_LINE_TERMINATORS = "[\n\r\u0085\u2028\u2029]"


def _one_pattern(r: Column, pattern: str) -> Column:
    m = _PREFIX_PATTERN.match(pattern)
    if m:
        # startswith reaches the parquet scan as a pushed filter
        return r.startswith(m.group(1)) & ~r.rlike(_LINE_TERMINATORS)
    return r.rlike(r"\A(?:" + pattern + r")\z")


def ref_matches(ref, patterns: Sequence[str]) -> Column:
    """C-4: true when no patterns are given or any pattern matches all of ``ref``."""
    if not patterns:
        return F.lit(True)
    r = _c(ref)
    cond = reduce(lambda a, b: a | b, [_one_pattern(r, p) for p in patterns])
    prefixes = [_PREFIX_PATTERN.match(p) for p in patterns]
    if all(prefixes):
        # implied by cond, and on its own convertible to a parquet filter
        cond = reduce(lambda a, b: a | b, [r.startswith(m.group(1)) for m in prefixes]) & cond
    return cond


def ref_filter(df: DataFrame, ref: str, patterns: Sequence[str]) -> DataFrame:
    """C-4 as a filter (patterns are checked first)."""
    validate_patterns(df.sparkSession, patterns)
    # a null match drops the row, as false would; no coalesce, so prefix
    # patterns can still reach the scan
    return df.filter(ref_matches(ref, patterns))


def push_to_request(push: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """C-5: push event -> build request (id and timeStamp are carried over,
    plus any ``carry`` columns)."""
    return push.select("id", "timeStamp", "repository", "ref",
                       F.col("after").alias("commit"), F.col("sender").alias("author"), *carry)
