"""Parsing, validation, lateness and upserts on single records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import envelopes, event_time, upserts

GOOD = {
    "event_id": "e1", "tenant_id": "t", "event_type": "order.created", "event_timestamp": "2024-01-01T00:00:00Z", "source_service": "s", "payload_version": 1, "trace_id": "tr",
    "payload": {"order_id": "o", "customer_id": "c", "product_id": "p", "quantity": 2, "unit_price": 10.0},
}


def judged(spark, *values):
    return envelopes.validate(envelopes.parse(spark.createDataFrame([(v,) for v in values], "value string")))


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"source_service": None}, "missing_required_fields"),
        ({"event_timestamp": "not-a-timestamp"}, "invalid_event_timestamp"),
        ({"tenant_id": "  "}, "blank_tenant_id"),
        ({"event_type": "order.unknown"}, "unknown_event_type"),
        ({"payload_version": 99}, "unsupported_payload_version"),
        ({"payload": {"order_id": "o"}}, "missing_required_payload_fields"),
        ({"payload_version": 99, "payload": {}}, "unsupported_payload_version"),
    ],
)
def test_first_reason_wins(spark, change, reason):
    assert [r.reason for r in judged(spark, json.dumps(GOOD | change)).collect()] == [reason]


@pytest.mark.parametrize("text", ["{not valid json at all", None, "[1]", "", '"x"'])
def test_malformed_text_is_kept(spark, text):
    (r,) = judged(spark, text).collect()
    assert r.reason == "malformed_json" and r.raw_value == text


def test_identity_defaults_and_trim(spark):
    (r,) = judged(spark, json.dumps(GOOD | {"event_id": " e1 "})).collect()
    assert (r.event_id, r.correlation_id, r.idempotency_key) == ("e1", "tr", "e1")


@pytest.mark.parametrize(("seconds", "kind"), [(0, "on_time"), (60, "on_time"), (61, "late_accepted"), (600, "late_accepted"), (601, "late_rejected"), (-50, "on_time"), (None, None)])
def test_lateness(spark, seconds, kind):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, None if seconds is None else t + dt.timedelta(seconds=seconds))], "event_timestamp timestamp_ntz, ingested_at timestamp_ntz")
    assert event_time.classify(df, F.col("ingested_at")).first().lateness == kind


def test_tenants_share_no_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 1)], "tenant_id string, event_id string, n int")
    got = sorted((r.tenant_id, r.n, r.is_duplicate) for r in event_time.mark_duplicates(df, [F.col("n")]).collect())
    assert got == [("a", 1, False), ("a", 2, True), ("b", 1, False)]


def test_upserts_are_idempotent(spark):
    a = spark.createDataFrame([("k", 1, "old"), ("j", 1, "x")], "k string, v int, s string")
    b = spark.createDataFrame([("k", 2, "new")], "k string, v int, s string")
    once = upserts.upsert(a, b, ["k"], "v")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upserts.upsert(once, b, ["k"], "v").collect())) == [("j", 1, "x"), ("k", 2, "new")]
    c = spark.createDataFrame([("k", 9, "no"), ("n", 1, "yes"), (None, 1, "no")], "k string, v int, s string")
    assert sorted(r.k for r in upserts.insert_absent(a, c, ["k"]).collect()) == ["j", "k", "n"]


def test_keep_first_update_rest(spark):
    df = spark.createDataFrame([("k", "first", 1, 1), ("k", "second", 2, 2)], "k string, made string, n int, at int")
    assert [(r.made, r.n) for r in upserts.keep_first_update_rest(df, ["k"], ["made"], ["at"]).collect()] == [("first", 2)]


def test_partition_rewrite_leaves_others(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "p string, n int")
    upserts.spread_rewrite(df, str(tmp_path / "t"), ["p"])
    upserts.spread_rewrite(spark.createDataFrame([("a", 9)], "p string, n int"), str(tmp_path / "t"), ["p"])
    assert sorted((r.p, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 9), ("b", 2)]


def test_dead_letters_round_trip(spark):
    bad = judged(spark, json.dumps(GOOD | {"payload_version": 99}))
    letters = envelopes.inspect_dead_letters(envelopes.dead_letters(bad))
    (r,) = envelopes.replay(letters, F.lit("2024-02-01").cast("timestamp_ntz")).collect()
    assert r.causation_id == "e1" and r.event_id.startswith("replay_") and letters.first().reason == "unsupported_payload_version"
