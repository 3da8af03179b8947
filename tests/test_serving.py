"""Operators behind the serving and envelope queries, on cases with known answers."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eventloom.functions.jsontext import without_keys
from eventloom.governance import quality, registry, semantic
from eventloom.operators import envelopes, event_time, outbox, payloads, sessions, skew, upserts
from eventloom.plans.serving import window
from eventloom.tenancy import matches

T0 = dt.datetime(2018, 1, 1, 10, 0)
EVENT = "tenant_id string, event_id string, event_type string, domain string, event_timestamp timestamp, payload string, lateness string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def windowed(spark, *rows):
    data = [("t", f"e{i}", kind, {"order": "orders", "payment": "payments"}.get(kind.split(".")[0]), at(5), json.dumps(body) if body is not None else None, late) for i, (kind, body, late) in enumerate(rows)]
    return {r.domain: r for r in event_time.windowed(spark.createDataFrame(data, EVENT)).collect()}


def test_windows_count_an_order_where_it_is_created(spark):
    order = {"quantity": 2, "unit_price": 10.0}
    got = windowed(spark, ("order.created", order, "on_time"), ("order.updated", order, "late_accepted"), ("payment.captured", {"amount": 20.0}, "on_time"))
    o, p = got["orders"], got["payments"]
    assert (o.revenue, o.units_sold, o.order_count, o.event_count, o.late_accepted_count) == (20, 2, 1, 2, 1)
    assert (p.revenue, p.payment_success_count, p.units_sold) == (20, 1, 0)


def test_windows_count_authorized_payments_as_revenue_and_a_null_quantity_as_one(spark):
    got = windowed(spark, ("payment.authorized", {"amount": 7}, "on_time"), ("payment.captured", {"amount": 50}, "on_time"), ("payment.failed", {"amount": 30}, "on_time"), ("order.created", {"unit_price": 4}, "on_time"), ("order.created", None, "on_time"))
    p, o = got["payments"], got["orders"]
    assert (p.revenue, p.payment_success_count, p.payment_failure_count) == (57, 1, 1)
    assert (o.revenue, o.units_sold, o.order_count) == (4, 0, 2)


def test_long_form_lists_six_metrics_with_the_count_beside(spark):
    df = spark.createDataFrame([("t", "e", "order.created", "orders", at(5), '{"quantity":1,"unit_price":2}', "on_time")], EVENT)
    got = {r.metric_name: (r.metric_value, r.event_count) for r in event_time.melted(event_time.windowed(df)).collect()}
    assert got == {"revenue": (2.0, 1), "order_count": (1.0, 1), "units_sold": (1.0, 1), "payment_success_count": (0.0, 1), "payment_failure_count": (0.0, 1), "event_count": (1.0, 1)}


@pytest.mark.parametrize(
    ("domain", "payload", "want"),
    [
        ("orders", '{"order_id":"o","customer_id":"c","quantity":0,"unit_price":-5.0,"status":"created","channel":"web"}', ["product_id:missing", "quantity:range", "unit_price:range"]),
        ("orders", '{"order_id":"o","customer_id":"c","product_id":"p","quantity":"3","unit_price":"1.5","currency":"EURO"}', ["currency:length"]),
        ("orders", '{"order_id":"o","customer_id":7,"product_id":null,"quantity":1.5,"unit_price":1,"discount_amount":null}', ["customer_id:type", "discount_amount:null", "product_id:null", "quantity:type"]),
        ("payments", '{"payment_id":"p","order_id":"o","customer_id":"c","amount":1,"status":"ok","risk_score":1.5,"failure_code":null}', ["risk_score:range"]),
        ("products", '{"product_id":"p","sku":"s","name":"n","category":"c","price":1,"active":"TRUE","extra":1}', []),
        ("users", "nope", ["payload:type"]),
        ("users", None, ["payload:type"]),
        (None, '{"a":1}', None),
    ],
)
def test_payload_contract(spark, domain, payload, want):
    df = spark.createDataFrame([(domain, payload, "x")], "domain string, payload string, _p string").drop("_p")
    r = payloads.checked(df).first()
    assert r.violations == want and r.is_conforming == (None if want is None else not want)


def test_payload_defaults(spark):
    df = payloads.checked(spark.createDataFrame([("t", "e", at(1), "orders", '{"order_id":"o","customer_id":"c","product_id":"p","quantity":3,"unit_price":25}')], "tenant_id string, event_id string, event_timestamp timestamp, domain string, payload string"))
    r = payloads.with_defaults(df, "orders").first()
    assert (r.quantity, r.unit_price, r.discount_amount, r.currency, r.status, r.channel, r.region) == (3, 25.0, 0.0, "USD", "created", "web", None)


def test_dead_letters_keep_all_and_can_be_sent_again(spark):
    body = {"event_id": "e1", "tenant_id": "T", "event_type": "order.created", "event_timestamp": "2018-01-01T00:00:00Z", "source_service": "s", "payload_version": 99, "trace_id": "tr", "payload": {"order_id": "o", "n": {"a": [1, "x"]}}}
    records = spark.createDataFrame([(json.dumps(body), "orders.events", 3, 44), ("{oops", "users.events", 1, 5), (None, "users.events", 1, 6)], "value string, topic string, partition int, offset bigint")
    _, bad = envelopes.split(envelopes.validate(envelopes.parse(records)))
    letters = envelopes.dead_letters(bad, F.lit("2018-02-01").cast("timestamp_ntz"))
    by = {json.loads(r.value)["original_offset"]: (r.key, json.loads(r.value)) for r in letters.collect()}
    assert by[44][0] == "T" and by[5][0] == by[6][0] == "unknown"
    assert by[44][1] == {"original_event_id": "e1", "tenant_id": "T", "event_type": "order.created", "source_service": "s", "rejection_reason": "unsupported_payload_version", "original_topic": "orders.events", "original_partition": 3, "original_offset": 44, "raw_value": json.dumps(body), "dlq_written_at": "2018-02-01 00:00:00"}
    # the services' own shapes, and text of no known shape
    wrapped = [{"payload": {"message": json.dumps({"error": "boom", "failed_stage": "write", "original_event": body})}}, {"payload": {"message": "plain", "original_event": body}}]
    more = letters.unionByName(spark.createDataFrame([("k", json.dumps(w)) for w in wrapped] + [("k", "what")], "key string, value string"))
    seen = envelopes.inspect_dead_letters(more)
    assert sorted((r.reason, r.failed_stage or "") for r in seen.collect()) == sorted([("unsupported_payload_version", "stream"), ("malformed_json", "stream"), ("malformed_json", ""), ("boom", "write"), ("plain", ""), ("unknown", "")])
    assert envelopes.inspect_dead_letters(more, event_id="e1").count() == 3 and envelopes.inspect_dead_letters(more, limit=2).count() == 2
    sent = envelopes.replay(seen, F.lit("2018-03-01").cast("timestamp_ntz")).collect()
    assert len(sent) == 3
    for r in sent:
        new = json.loads(r.value)
        assert new["payload"] == body["payload"] and new["event_id"].startswith("replay_") and new["causation_id"] == "e1" and new["idempotency_key"] == new["event_id"]
        assert (new["event_timestamp"], new["payload_version"], new["trace_id"], new["correlation_id"], r.topic, r.key) == ("2018-03-01T00:00:00.000000Z", 99, "tr", "tr", "orders.events", "t:o")
    again = envelopes.validate(envelopes.parse(spark.createDataFrame([(r.value,) for r in sent], "value string")))
    assert {r.reason for r in again.collect()} == {"unsupported_payload_version"}


def test_merges(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", None, "y"), (None, 5, "z")], "k string, v int, s string")
    assert sorted(map(tuple, upserts.last(df, ["k"], ["v"]).collect()), key=str) == sorted([("a", 2, None), ("b", None, "y"), (None, 5, "z")], key=str)
    assert {tuple(r) for r in upserts.first(df, ["k"], ["v"]).collect()} >= {("a", 1, "x")}
    old, new = spark.createDataFrame([("a", 5), ("b", 5)], "k string, at int"), spark.createDataFrame([("a", 3), ("b", 9), ("c", 1)], "k string, at int")
    assert sorted(map(tuple, upserts.monotone(old, new, ["k"], "at").collect())) == [("a", 5), ("b", 9), ("c", 1)]
    sums = upserts.add(spark.createDataFrame([("a", 5, Decimal(1))], "k string, n bigint, m decimal(18,2)"), spark.createDataFrame([("a", None, Decimal(2)), ("c", 1, None)], "k string, n bigint, m decimal(18,2)"), ["k"], ["n", "m"])
    assert sorted(map(tuple, sums.collect())) == [("a", 5, Decimal("3.00")), ("c", 1, Decimal("0.00"))]
    current, fresh = spark.createDataFrame([("t", 1, "old"), ("t", 9, "old"), ("u", 1, "old"), (None, 1, "old")], "t string, d int, v string"), spark.createDataFrame([("t", 2, "new"), ("t", 9, "new")], "t string, d int, v string")
    got = upserts.replace_slice(current, fresh, (F.col("t") == "t") & (F.col("d") < 5))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("t", 2, "new"), ("t", 9, "old"), ("u", 1, "old"), (None, 1, "old")], key=str)
    kept = upserts.keep_first_update_rest(spark.createDataFrame([("o", "p1", "new", 1), ("o", "p2", "paid", 2)], "k string, p string, s string, v int"), ["k"], ["p"], ["v"]).first()
    assert (kept.p, kept.s, kept.v) == ("p1", "paid", 2)


def test_outbox_states(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    rows = spark.createDataFrame([(1, "pending", 0, at(-9), at(-9)), (2, "pending", 4, at(-8), at(-8)), (3, "pending", 0, at(-7), at(60)), (4, "published", 1, at(-6), at(-6)), (5, "pending", 0, at(-5), at(-5))], "outbox_id bigint, status string, attempts int, created_at timestamp_ntz, available_at timestamp_ntz").withColumns({"error_message": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp_ntz")})
    leased = outbox.lease(rows, 2, now)
    assert sorted(r.outbox_id for r in leased.filter("status = 'publishing'").collect()) == [1, 2]
    after = outbox.failed(outbox.published(leased, F.col("outbox_id") == 1, now), F.lit(True), 5, 30, now, "down")
    got = {r.outbox_id: (r.status, r.attempts, r.error_message) for r in after.collect()}
    assert got == {1: ("published", 1, None), 2: ("failed", 5, "down"), 3: ("pending", 0, None), 4: ("published", 1, None), 5: ("pending", 0, None)}
    with pytest.raises(ValueError):
        outbox.lease(rows, 0, now)


FIELDS = "domain_name string, payload_version int, field_name string, json_type string, is_required boolean"


def test_registry_is_idempotent_and_tells_what_breaks(spark):
    v1 = [("d", 1, "a", "string", True), ("d", 1, "b", "number", False), ("d", 1, "c", "string", True), ("d", 1, "g", "string", False)]
    v2 = [("d", 2, "a", "number", True), ("d", 2, "b", "number", True), ("d", 2, "c", "string", False), ("d", 2, "e", "string", True), ("d", 2, "f", "string", False)]
    fields = spark.createDataFrame(v1 + v2, FIELDS)
    got = sorted((r.version, r.field_name, r.problem) for r in registry.breaks(fields).collect())
    assert got == [(2, "a", "type_changed"), (2, "b", "newly_required"), (2, "c", "no_longer_required"), (2, "e", "newly_required"), (2, "g", "removed")]
    one = registry.register(spark.createDataFrame([], registry.VERSIONS), registry.offers(fields.filter("payload_version = 1")))
    two = registry.register(registry.register(one, registry.offers(fields)), registry.offers(fields))
    assert sorted((r.version, r.n_fields, r.is_latest) for r in two.collect()) == [(1, 4, False), (2, 5, True)]
    assert registry.breaks(fields.limit(0)).count() == 0


def test_quality(spark):
    df = spark.createDataFrame([("a", 1.5), (None, 0.5), ("z", None)], "s string, r double")
    tests = (quality.Test("m", "s", "not_null"), quality.Test("m", "s", "accepted", ("a", "b")), quality.Test("m", "r", "range", (0.0, 1.0)))
    assert sorted((r.test, r.n_failed, r.status) for r in quality.run_tests({"m": df}, tests).collect()) == [("accepted", 1, "failed"), ("not_null", 1, "failed"), ("range", 1, "failed")]
    with pytest.raises(ValueError):
        quality.contract_violations(df, quality.MetricContract("m", "q", ("absent",), ()))
    with pytest.raises(ValueError):
        semantic.measured(df, "s", "hour")


def test_small_helpers(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":"é"}}',), ("[1]",), (None,), ("x",)], "p string")
    assert [r[0] for r in df.select(without_keys("p", "a", "zz")).collect()] == ['{"b":{"c":"é"}}', "[1]", None, "x"]
    assert window("d") == "true" and window("d", end="2018-01-02") == "d <= date'2018-01-02'"
    assert df.filter(matches("p", None)).count() == 4 and df.filter(matches("p", "x")).count() == 1
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 7.0), ("c", None)], "k string, v double")
    got = skew.values_at(rows, ["k"], "v", {f"p{p}": lambda n, p=p: F.bround((n - 1) * p / F.lit(100.0)) + 1 for p in (0, 95, 100)}, coarse=10)
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 95.0, 100.0), ("b", 7.0, 7.0, 7.0)]
    assert skew.values_at(rows.limit(0), ["k"], "v", {"p": lambda n: n}, coarse=10).count() == 0


def test_previous_row_across_hours(spark):
    data = [("a", at(s), f"e{i}", 1) for i, s in enumerate((0, 10, 10, 3700, 11000))] + [(None, at(5), "x", 1), (None, at(7200), "y", 1), ("b", None, "z", 1)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, id string, previous int")
    got = {r.id: r.previous_at for r in sessions.previous(df, ["k"], "t", "id").collect()}
    assert got == {"e0": None, "e1": at(0), "e2": at(10), "e3": at(10), "e4": at(3700), "x": None, "y": at(5), "z": None}
