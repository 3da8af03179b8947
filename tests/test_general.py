"""Operators for late events, sessions, rolling totals, drift, orphans, change feeds and skew on small cases."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventloom.operators import changefeed, drift, late_counters, orphans, rolling, sessions, skew
from eventloom.operators.firsts import first_arrivals
from eventloom.session import cut_lineage
from eventloom.tenancy import allowed, scoped

T0 = dt.datetime(2018, 1, 1, 10, 0)
EVENTS = "event_id string, tenant_id string, event_type string, event_timestamp timestamp_ntz, source_service string, payload_version int, payload string, schema_ref string, ingested_at timestamp_ntz, landing_file string, period string, actor string"


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def event(id="e", tenant="t", ts=0, arrived=1, type="user.activity", payload=None, source="s", version=1, ref=None, file="f"):
    # period and actor are columns of the caller that clash with names the operators use
    return (id, tenant, type, at(ts), source, version, payload, ref, at(arrived), file, "x", "y")


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_arrivals_takes_earliest_copy_and_drops_unusable(spark):
    df = events(spark, event(arrived=9), event(tenant=" T ", arrived=3), event(id="n", ts=None), event(id="b", tenant=" "), event(id="z", tenant=None), event(id=None), event(id="u", arrived=None))
    got = rows(first_arrivals(df).filter("arrived_at is not null"), "tenant_id", "event_id", "arrived_at")
    assert got == [("t", "e", at(3))]
    assert first_arrivals(df.limit(0)).count() == 0


def test_late_counters_bounds(spark):
    # hour ends at 3600 s; the cut-off is 600 s after the event
    df = events(spark, event("a", ts=3500, arrived=3599), event("b", ts=3500, arrived=3600), event("c", ts=3500, arrived=4100), event("d", ts=3500, arrived=4101), event("c", ts=3500, arrived=9000), event("e", ts=3500, arrived=None), event("f", ts=3500, arrived=3600, source=None))
    r = late_counters.hourly(df).collect()
    assert [(x.n_in_time, x.n_corrections, x.n_rejected, x.n_accepted) for x in r] == [(1, 3, 1, 4)]


HOURLY = ("tenant_id", "period", "n_in_time", "n_corrections", "n_rejected")


def counted(spark, batches):
    counters, known = spark.createDataFrame([], late_counters.COUNTERS), spark.createDataFrame([], late_counters.ARRIVALS)
    seen = []
    for b in batches:
        counters, known = late_counters.advance(counters, known, b)
        counters, known = cut_lineage(counters), cut_lineage(known)
        seen.append(counters)
    return seen, known


def test_late_counters_in_any_order_with_copies_and_retries(spark):
    rnd = random.Random(1)
    data = [event(str(rnd.randrange(150)), tenant=rnd.choice("ab"), ts=None, arrived=rnd.choice([None, rnd.randrange(30000)]), source=rnd.choice(["x", "y", None])) for _ in range(400)]
    # copies of an event agree in their event time, but not in arrival, source or batch
    data = [(r[0], r[1], r[2], at(7 * (int(r[0]) * 17 % 2500) + (r[1] == "a")), *r[4:]) for r in data]
    df = events(spark, *data)
    want = rows(late_counters.hourly(df), *HOURLY)
    parts = [df.filter(F.pmod(F.xxhash64("event_id", "ingested_at"), F.lit(5)) == i) for i in range(5)]
    order = random.Random(1).sample([0, 1, 2, 3, 4, 1, 3], 7)
    seen, known = counted(spark, [parts[i] for i in order])
    assert rows(late_counters.totals(seen[-1]), *HOURLY) == want
    # snapshots delivered again or late don't matter to the merge
    assert rows(late_counters.totals(late_counters.merge(seen[3], seen[-1], seen[0], seen[-1])), *HOURLY) == want
    assert rows(late_counters.totals(late_counters.merge(late_counters.count(late_counters.least(known)))), *HOURLY) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_late_counters_on_landing_files_in_random_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/raw_events.parquet")
    parts = [df.filter(F.pmod(F.xxhash64("landing_file", "ingested_at"), F.lit(4)) == i) for i in range(4)]
    seen, _ = counted(spark, [parts[i] for i in (3, 1, 1, 0, 2)])
    assert rows(late_counters.totals(seen[-1]), *HOURLY) == rows(late_counters.hourly(df), *HOURLY)


def test_late_counters_closed_periods_stay(spark):
    a, b = events(spark, event("a", ts=10, arrived=20)), events(spark, event("a", ts=10, arrived=15), event("b", ts=50, arrived=9000), event("c", ts=7300, arrived=9000))
    (first,), known = counted(spark, [a])
    bound = F.lit(at(3600)).cast("timestamp_ntz")
    counters, known = late_counters.advance(first, known, b, closed_before=bound)
    assert rows(late_counters.totals(counters), "n_in_time", "n_rejected") == [(1, 0), (1, 0)]
    assert rows(late_counters.forget(known, bound), "event_id") == [("c",)]


def test_sessions_gap_is_inclusive_and_actor_falls_back(spark):
    u = '{"user_id":" U1 ","session_id":"s"}'
    df = events(
        spark,
        event("a", ts=0, payload=u),
        event("b", ts=1800, payload=u),
        event("c", ts=3601, payload=u),
        event("c", ts=3601, payload=u, arrived=99),
        event("d", ts=5, payload='{"user_id":null,"session_id":"S9"}'),
        event("g", ts=5, payload='{"user_id":"  ","session_id":""}'),
        event("h", ts=5, payload='{"user_id":"trunc'),
        event("i", ts=5, payload=None),
        event("j", ts=5, payload=u, type="order.created"),
        event("k", ts=5, payload=u, tenant=None),
    )
    got = rows(sessions.sessions(sessions.user_events(df)), "actor", "session_no", "first_event_id", "last_event_id", "duration_seconds", "n_events")
    assert got == [("anon:S9", 1, "d", "d", 0.0, 1), ("u1", 1, "a", "b", 1800.0, 2), ("u1", 2, "c", "c", 0.0, 1)]


def test_sessions_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("pq"), rnd.choice("xyz"), f"e{i:04d}", at(rnd.randrange(200_000))) for i in range(900)] + [("p", "x", f"t{i}", at(77)) for i in range(5)]
    df = spark.createDataFrame(data, "tenant_id string, actor string, event_id string, event_timestamp timestamp_ntz")
    want, groups = [], defaultdict(list)
    for t, a, i, s in data:
        groups[t, a].append((s, i))
    for key, es in groups.items():
        es.sort()
        run = [es[0]]
        for prev, e in zip(es, es[1:]):
            if (e[0] - prev[0]).total_seconds() > 1800:
                want.append((*key, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(e)
        want.append((*key, run[0][1], run[-1][1], len(run)))
    assert rows(sessions.sessions(df), "tenant_id", "actor", "first_event_id", "last_event_id", "n_events") == sorted(want)


def test_rolling_fills_days_and_takes_latest(spark):
    d = lambda n: dt.date(2018, 1, 1) + dt.timedelta(days=n)
    data = [("A ", d(0), Decimal(70), at(1)), ("a", d(0), Decimal(7), at(2)), ("a", d(0), Decimal(8), at(2)), ("a", d(40), None, at(1)), ("a", d(6), Decimal(-1), at(1)), (None, d(1), Decimal(1), at(1)), ("a", None, Decimal(1), at(1))]
    df = spark.createDataFrame(data, "tenant_id string, metric_date date, net_revenue decimal(18,2), updated_at timestamp_ntz")
    out = {r.day: r for r in rolling.trailing(rolling.daily_values(df)).collect()}
    assert len(out) == 41
    assert (out[d(6)].sum_7, out[d(7)].sum_7, out[d(29)].sum_30, out[d(30)].sum_30, out[d(40)].sum_30) == (7, -1, 7, -1, 0)
    assert out[d(6)].avg_7 == 1.0
    assert [r.day for r in rolling.collapses(rolling.trailing(rolling.daily_values(df))).collect()] == [d(29)]
    assert rolling.trailing(rolling.daily_values(df.limit(0))).count() == 0


def test_rolling_never_broadcasts_the_calendar(spark):
    """Two rows make a calendar of any length, which no estimate sees; days before 1970, gaps and ends of buckets included."""
    d = lambda n: dt.date(1969, 11, 1) + dt.timedelta(days=n)
    values = {"a": {n: 2**i for i, n in enumerate((0, 1, 29, 30, 58, 59, 60, 61, 88, 89, 90, 91, 118, 150, 400))}, "b": {-25_000: 3, 25_000: 5}, "c": {7: 9}}
    data = [(t, d(n), Decimal(v), at(1)) for t, days in values.items() for n, v in days.items()]
    df = spark.createDataFrame(data, "tenant_id string, metric_date date, net_revenue decimal(18,2), updated_at timestamp_ntz")
    rolled = rolling.trailing(rolling.daily_values(df))
    got = sorted((r.entity, r.day, int(r.sum_7), int(r.sum_30)) for r in rolled.collect())
    total = lambda days, n, width: sum(v for k, v in days.items() if n - width < k <= n)
    assert got == sorted((t, d(n), total(days, n, 7), total(days, n, 30)) for t, days in values.items() for n in range(min(days), max(days) + 1))
    assert "Broadcast" not in rolled._jdf.queryExecution().executedPlan().toString()


CONTRACT = [("users", 1, "action", "string", True), ("users", 1, "n", "number", False), ("users", 2, "action", "string", True), ("users", 2, "kind", "string", False), ("payments", 1, "amount", "number", True)]


def contract(spark):
    return spark.createDataFrame(CONTRACT, "domain_name string, payload_version int, field_name string, json_type string, is_required boolean")


@pytest.mark.parametrize(
    ("payload", "version", "ref", "want"),
    [
        ('{"action":"login","n":1}', 1, None, []),
        ('{"action":"login","n":null}', 1, "users/v1", []),
        ('{"action":"login","n":"1"}', 1, "urn:contract:users:1", [("n", "retyped")]),
        ('{"action":{"value":"x"}}', 1, "contracts/user-payload/v1.json", [("action", "retyped")]),
        ('{"n":1}', 1, None, [("action", "removed")]),
        ('{"verb":"login"}', 1, None, [("action", "renamed")]),
        ('{"userAction":"never seen"}', 1, None, [("action", "renamed")]),
        ('{"bucket":"gold"}', 1, None, [("action", "removed"), ("bucket", "added")]),
        ('{"kind":"login"}', 1, None, [("action", "removed"), ("kind", "added")]),
        ('{"action":"login","x":[1]}', 1, None, [("x", "added")]),
        ('{"x":1}', 9, "users/v9", [("payload_version", "unknown_version")]),
        ('{"x":1}', None, None, [("payload_version", "unknown_version")]),
        ('{"action":"login"}', 1, "users/v2", [("schema_ref", "ref_mismatch")]),
        ('{"action":"login"}', 1, "order/v1", [("schema_ref", "ref_mismatch")]),
        ('{"action":"login"}', 1, "something else", []),
        ('[1]', 1, "users/v2", []),
        ("{'action':'x'}", 1, "users/v2", []),
        (None, 1, "users/v2", []),
    ],
)
def test_drift_changes(spark, payload, version, ref, want):
    df = events(spark, event("seen", payload='{"action":"login"}', file="ok"), event(payload=payload, version=version, ref=ref, file="f"))
    got = drift.changes(df, contract(spark))
    assert rows(got.filter("landing_file = 'f'"), "field_name", "change") == want


def test_drift_table_reports_failed_casts(spark):
    df = events(spark, event("a", payload='{"action":"x","n":"abc"}'), event("b", payload='{"n":2.5}'), event("c", payload="nope"), event("d", payload=None))
    got = {r.event_id: r for r in drift.typed_table(df, contract(spark)).collect()}
    assert got["a"].failed_casts == ["n"] and got["a"].f_action == "x"
    assert got["b"].f_n == 2.5 and got["b"].failed_casts == []
    assert not got["c"].is_object and not got["d"].is_object
    assert drift.changes(df.limit(0), contract(spark)).count() == 0


def test_orphans_open_resolve_reopen(spark):
    child = spark.createDataFrame([("t", "o1", " K1 ", at(5), "x"), ("t", "o2", "k1", at(20), "x"), ("t", "o3", None, at(5), "x"), ("t", "o4", " ", at(5), "x"), ("u", "o5", "k1", at(99), "x"), ("t", "o1", "k1", at(30), "x"), ("t", "o6", "k9", at(1), "x"), ("t", "o6", "k9", at(1), "x")], "tenant_id string, order_id string, product_id string, event_timestamp timestamp_ntz, relation string")
    parent = spark.createDataFrame([("T", "k1", at(10)), ("t", "k1", at(50)), ("t", "k2", None)], "tenant_id string, product_id string, created_at timestamp_ntz")
    refs = orphans.references(child, "orders", "order_id", "product_id")
    came = orphans.arrivals(parent, "orders", "product_id")
    state, log = orphans.advance(None, None, refs, came)
    assert rows(orphans.unborn(state), "tenant_id", "child_id") == [("t", "o1"), ("t", "o6"), ("u", "o5")]
    change = lambda key, s: spark.createDataFrame([("orders", "t", key, at(s))], "relation string, tenant_id string, ref_key string, at timestamp_ntz")
    after, _ = orphans.advance(state, log, refs.limit(0), change("k9", 70), change("k1", 60))
    assert sorted((r.child_id, r.open_since) for r in orphans.waiting(after).collect()) == [("o1", at(60)), ("o1", at(60)), ("o2", at(60)), ("o5", at(99))]
    assert [(r.n_opened, r.n_resolved, r.n_reopened, r.n_open) for r in orphans.open_counts(after).collect()] == [(5, 2, 1, 4)]


PARENT = "relation string, tenant_id string, ref_key string, at timestamp_ntz"
CHILD = "relation string, tenant_id string, ref_key string, child_id string, ref_at timestamp_ntz"


def test_orphans_of_parents_deleted_later_or_before(spark):
    refs = spark.createDataFrame([("o", "t", "k", c, at(s)) for c, s in (("early", 5), ("alive", 20), ("after", 70), ("again", 90))] + [("o", "t", "none", "x", at(1))], CHILD)
    came = spark.createDataFrame([("o", "t", "k", at(s)) for s in (10, 15, 80)], PARENT)
    went = spark.createDataFrame([("o", "t", "k", at(s)) for s in (3, 60, 80, 100)] + [("o", "t", "none", at(9))], PARENT)
    state, _ = orphans.advance(None, None, refs, came, went)
    got = {r.child_id: [(s.kind, s.at) for s in r.steps] for r in state.collect()}
    end = [("resolved", at(80)), ("reopened", at(100))]
    assert got == {
        "x": [("opened", at(1))],
        "early": [("opened", at(5)), ("resolved", at(10)), ("reopened", at(60)), *end],
        "alive": [("opened", at(60)), *end],
        "after": [("opened", at(70)), *end],
        "again": [("opened", at(100))],
    }


def test_orphans_of_a_deleted_parent_from_its_deletion_on(spark):
    """Created on the 1st, deleted on the 10th, references on the 5th and the 20th."""
    day = lambda n: dt.datetime(2018, 1, n)
    refs = spark.createDataFrame([("o", "t", "k", "a", day(5)), ("o", "t", "k", "b", day(20))], CHILD)
    state, _ = orphans.advance(None, None, refs, spark.createDataFrame([("o", "t", "k", day(1))], PARENT), spark.createDataFrame([("o", "t", "k", day(10))], PARENT))
    assert sorted((r.child_id, r.open_since) for r in orphans.waiting(state).collect()) == [("a", day(10)), ("b", day(20))]


def test_orphans_batches_in_any_order_give_the_state_of_one(spark):
    rnd = random.Random(4)
    key = lambda: ("o", rnd.choice("tu"), rnd.choice("abc"))
    refs = spark.createDataFrame([(*key(), f"c{i}", at(rnd.randrange(100))) for i in range(60)], CHILD)
    came = spark.createDataFrame([(*key(), at(rnd.randrange(100))) for _ in range(12)], PARENT)
    went = spark.createDataFrame([(*key(), at(rnd.randrange(100))) for _ in range(12)], PARENT)
    plain = lambda df: sorted((r.tenant_id, r.ref_key, r.child_id, r.ref_at, tuple((s.kind, s.at) for s in r.steps)) for r in df.collect())
    want = plain(orphans.advance(None, None, refs, came, went)[0])
    split = lambda df, i: df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == i)
    state = log = None
    for i in (1, 2, 1, 0):
        state, log = orphans.advance(state, log, split(refs, i), split(came, i), split(went, i))
        state, log = cut_lineage(state), cut_lineage(log)
    assert plain(state) == want
    assert plain(orphans.advance(state, log, refs)[0]) == want
    assert plain(orphans.advance(None, None, refs)[0]) == sorted((*r[1:4], r[4], (("opened", r[4]),)) for r in refs.collect())
    assert orphans.advance(None, None, refs.limit(0), came, went)[0].count() == 0


FEED = "change_no bigint, tenant_id string, product_id string, event_id string, op string, sku string, name string, category string, price decimal(14,2), inventory_delta int, active boolean, changed_at timestamp_ntz"


def test_changefeed_against_plain_replay(spark):
    rnd = random.Random(3)
    day = 86400
    data = []
    for i in range(600):
        data.append((i, rnd.choice(["t", " T"]), rnd.choice("abc"), f"e{i}", rnd.choice(["insert", "U", "c", "update", "DELETE", "d", "what"]), rnd.choice([None, "s1", "s2"]), None, "cat", None, rnd.choice([None, -9, -3, 0, 2, 7]), True, at(rnd.randrange(5 * day) // 3600 * 3600)))
    data += [rnd.choice(data) for _ in range(60)]
    rnd.shuffle(data)
    state, seen = {}, set()
    for r in sorted(data, key=lambda r: (r[11], r[3])):
        key, op = r[2], r[4].lower()
        if r[3] in seen or op == "what":
            continue
        seen.add(r[3])
        if op in ("d", "delete"):
            state.pop(key, None)
        else:
            old = state.get(key, {"n": 0, "sku": None})
            state[key] = {"n": max(old["n"] + (r[9] or 0), 0), "sku": r[5] or old["sku"], "e": r[3], "at": r[11]}
    cols = ("product_id", "inventory_on_hand", "sku", "last_event_id", "updated_at")
    feed = spark.createDataFrame(data, FEED)
    want = sorted((k, v["n"], v["sku"], v["e"], v["at"]) for k, v in state.items())
    assert rows(changefeed.replay(feed), *cols) == want
    assert rows(changefeed.replay(feed, "hour"), *cols) == want
    # batches in the wrong order, one twice, repeats of a change in several of them
    log, parts = spark.createDataFrame([], changefeed.LOG), spark.createDataFrame([], changefeed.SUMMARIES)
    for i in (2, 1, 2, 0):
        log, parts = changefeed.advance(log, parts, feed.filter(F.pmod(F.xxhash64("change_no", "changed_at"), F.lit(3)) == i))
        log, parts = cut_lineage(log), cut_lineage(parts)
    assert rows(changefeed.fold(parts), *cols) == want


def test_changefeed_earlier_copy_replaces_an_applied_one(spark):
    one = lambda no, s, delta: spark.createDataFrame([(no, "t", "p", "e", "u", None, None, None, None, delta, None, at(s))], FEED)
    log, parts = changefeed.advance(spark.createDataFrame([], changefeed.LOG), spark.createDataFrame([], changefeed.SUMMARIES), one(5, 90000, 3))
    log, parts = changefeed.advance(log, parts, one(9, 10, 4))
    assert rows(changefeed.fold(parts), "inventory_on_hand", "updated_at", "n_applied") == [(4, at(10), 1)]
    assert rows(changefeed.fold(changefeed.advance(log, parts, one(7, 90000, 3))[1]), "inventory_on_hand", "n_applied") == [(4, 1)]


def test_changefeed_empty_and_stale(spark):
    empty = changefeed.replay(spark.createDataFrame([], FEED))
    stored = spark.createDataFrame([("t", "a", 1, None), ("t", "b", 0, "e1")], "tenant_id string, product_id string, inventory_on_hand int, last_event_id string")
    rebuilt = spark.createDataFrame([("t", "a", 1, None), ("t", "c", 0, "e9")], "tenant_id string, product_id string, inventory_on_hand bigint, last_event_id string")
    assert empty.count() == 0
    assert rows(changefeed.stale(stored, rebuilt), "product_id") == [("b",), ("c",)]


@pytest.mark.parametrize("coarse", [1, 10, 1000])
def test_percentile_rows_with_ties(spark, coarse):
    rnd = random.Random(7)
    data = [(k, "d", rnd.choice([-5, 0, 0, 0, rnd.randrange(100)]), f"id{rnd.randrange(10**6):06d}") for k in "ab" for _ in range(rnd.choice([1, 20, 300]))] + [("hot", "d", 3, f"same-prefix-{i:04d}") for i in range(500)]
    df = spark.createDataFrame(data + [("n", "d", None, "x"), ("n", "d", 1, None)], "tenant_id string, event_date string, delay bigint, event_id string")
    groups = defaultdict(list)
    for k, d, v, i in data:
        groups[k].append((v, i))
    want = sorted((k, *sorted(g)[-(-95 * len(g) // 100) - 1]) for k, g in groups.items())
    got = skew.at_percentile(df, ["tenant_id", "event_date"], "delay", "event_id", 95, coarse)
    assert rows(got.distinct(), "tenant_id", "delay", "event_id") == want


def test_weighted_modes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 2), ("a", None), ("b", None)], "k string, v int")
    got = rows(skew.distinct_and_mode(skew.weighted(df, ["k"], "v"), ["k"], "v"), "k", "n_rows", "n_distinct", "mode")
    assert got == [("a", 5, 2, 1), ("b", 1, 0, None)]


def test_tenant_scope_fails_closed(spark):
    df = spark.createDataFrame([("a",), ("B ",), (None,)], "tenant_id string")
    assert scoped(df, None).count() == scoped(df, " ").count() == 0
    assert scoped(df, "b").count() == 1 and allowed(df, []).count() == 3 and allowed(df, ["A"]).count() == 1
