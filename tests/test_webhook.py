"""Payload parsing, verdicts and request admission (reference goldens)."""

import json

import pytest
from pyspark.sql import functions as F

from benchtide.operators import webhook

MIN_PAYLOAD = {
    "ref": "refs/heads/master",
    "before": "6113728f27ae82c7b1a177c8d03f9e96e0adf246",
    "after": "0" * 40,
    "repository": {"id": 1, "full_name": "Codertocat/Hello-World", "owner": {"name": "x"}},
    "pusher": {"name": "Codertocat", "email": "x@example.com"},
    "sender": {"login": "Other", "id": 2},
}


def verdicts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    return [r[0] for r in webhook.classify_payloads(df, "body").select("verdict").collect()]


def test_invalid_json(spark):
    assert verdicts(spark, [None, "", "<this-is-not-json/>", '{ "field": value }', '{"ref":"a"']) == [
        "INVALID_JSON"] * 5


def test_invalid_payload(spark):
    incomplete = dict(MIN_PAYLOAD)
    del incomplete["after"]
    numeric = dict(MIN_PAYLOAD, ref=5)
    empty = dict(MIN_PAYLOAD, pusher={"name": ""})
    texts = ['{"key" : "value"}', json.dumps(incomplete), json.dumps(numeric), json.dumps(empty),
             json.dumps([MIN_PAYLOAD])]
    assert verdicts(spark, texts) == ["INVALID_PAYLOAD"] * 5


def test_complete_payload_fields(spark):
    text = json.dumps(MIN_PAYLOAD, indent=2)
    df = spark.createDataFrame([(text,)], "body string")
    out = webhook.classify_payloads(df, "body", "v")
    r = out.collect()[0]
    assert r.v == "OK"
    assert (r.ref, r.before, r.after, r.repository, r.pusher, r.sender) == (
        "refs/heads/master", "6113728f27ae82c7b1a177c8d03f9e96e0adf246", "0" * 40,
        "Codertocat/Hello-World", "Codertocat", "Other")


def test_first_duplicate_wins(spark):
    text = '{"ref":"first","ref":"second","before":"b","after":"a","repository":{"full_name":"r"},' \
           '"pusher":{"name":"p"},"sender":{"login":"s"}}'
    df = spark.createDataFrame([(text,)], "body string")
    assert webhook.extract_push_fields(df, "body").collect()[0].ref == "first"


@pytest.mark.parametrize("ref,repository", [
    ('"ref":7,"ref":"r"', '{"full_name":1,"full_name":"x"}'),
    ('"ref":"r","ref":7', '{"full_name":"x","full_name":{"a":1}}'),
    ('"ref":null,"ref":"r","ref":"s"', '{"full_name":"x","full_name":"y"}'),
])
def test_kind_and_value_from_the_same_occurrence(spark, ref, repository):
    text = "{" + ref + ',"before":"b","after":"a","repository":' + repository + \
           ',"pusher":{"name":"p"},"sender":{"login":"s"}}'
    df = spark.createDataFrame([(text,)], "body string")
    got = webhook.classify_payloads(df, "body").collect()[0]
    assert (got.ref, got.repository, got.verdict) == ("r", "x", "OK")


def test_lenient_json_is_no_json(spark):
    assert verdicts(spark, ["{'ref':'r'}", '{"ref":NaN}', '{"repository":"x"}', '"s"']) == [
        "INVALID_JSON", "INVALID_JSON", "INVALID_PAYLOAD", "INVALID_PAYLOAD"]


@pytest.mark.parametrize("method,uri,ctype,body,ok,status", [
    ("GET", "/cb", "application/json", "{}", True, 405),
    ("HEAD", "/cb", "application/json", "{}", True, 405),
    ("PUT", "/cb", "application/json", "{}", True, 405),
    ("DELETE", "/cb", "application/json", "{}", True, 405),
    ("POST", "/other", "application/json", "{}", True, 404),
    ("POST", "/cb", None, "{}", True, 415),
    ("POST", "/cb", "application/json; charset=utf-8", "{}", True, 415),
    ("POST", "/cb", "application/json", "", True, 400),
    ("POST", "/cb", "application/json", "<this-is-not-json/>", True, 400),
    ("POST", "/cb", "application/json", '{"key":"value"}', True, 422),
    ("POST", "/cb", "application/json", json.dumps(MIN_PAYLOAD), False, 503),
    ("POST", "/cb", "application/json", json.dumps(MIN_PAYLOAD), True, 202),
])
def test_admission(spark, method, uri, ctype, body, ok, status):
    df = spark.createDataFrame([(method, uri, ctype, body, ok)],
                               "method string, uri string, content_type string, body string, ok boolean")
    got = webhook.admit_requests(df, "method", "uri", "content_type", "body", "ok").select("status").collect()[0][0]
    assert got == status


def test_ref_filter_full_match(spark):
    df = spark.createDataFrame([("refs/heads/master",), ("refs/heads/master-2",), ("refs/tags/v1",)],
                               "ref string")
    keep = webhook.ref_filter(df, "ref", ["refs/heads/master", "refs/tags/.*"])
    assert sorted(r.ref for r in keep.collect()) == ["refs/heads/master", "refs/tags/v1"]
    assert webhook.ref_filter(df, "ref", []).count() == 3


def test_bad_pattern_fails_fast(spark):
    df = spark.createDataFrame([("x",)], "ref string")
    with pytest.raises(Exception):
        webhook.ref_filter(df, "ref", ["[unclosed"])


def test_push_to_request(spark):
    df = spark.createDataFrame([("i", None, "r", "b", "a", "repo", "p", "s")],
                               "id string, timeStamp timestamp, ref string, before string, after string,"
                               " repository string, pusher string, sender string")
    r = webhook.push_to_request(df).collect()[0]
    assert (r.repository, r.ref, r.commit, r.author) == ("repo", "r", "a", "s")


def test_prefix_pattern_is_exact(spark):
    df = spark.createDataFrame([("refs/heads/a",), ("refs/heads/a\nb",), ("refs/tags/x",), ("refs/heads/",)],
                               "ref string")
    keep = sorted(r.ref for r in webhook.ref_filter(df, "ref", ["refs/heads/.*"]).collect())
    assert keep == ["refs/heads/", "refs/heads/a"]
