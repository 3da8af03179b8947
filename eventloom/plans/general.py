"""Queries p1 to p7, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timeparts import day_text, hour_text, micros
from eventloom.operators import changefeed, drift, late_counters, orphans, rolling, sessions, skew
from eventloom.operators.firsts import first_arrivals
from eventloom.session import cut_lineage
from eventloom.sources.tables import table


def p1_hourly(spark: SparkSession, d: str) -> DataFrame:
    hours = late_counters.hourly(table(spark, d, "raw_events"))
    return hours.select("tenant_id", hour_text(F.col("period")).alias("metric_hour"), "n_in_time", "n_corrections", "n_rejected", "n_accepted")


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """p1_hourly from three batches of landing files that come in the wrong order, one of them twice; copies of an event lie in several."""
    events = table(spark, d, "raw_events")
    counters, known = (spark.createDataFrame([], schema) for schema in (late_counters.COUNTERS, late_counters.ARRIVALS))
    for i in (2, 0, 2, 1):
        counters, known = late_counters.advance(counters, known, events.filter(F.pmod(F.xxhash64("landing_file"), F.lit(3)) == i))
        counters = cut_lineage(counters)  # known is a log of what each batch changed, and that is written already
    hours = late_counters.totals(counters)
    return hours.select("tenant_id", hour_text(F.col("period")).alias("metric_hour"), "n_in_time", "n_corrections", "n_rejected", "n_accepted")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hours = late_counters.hourly(table(spark, d, "raw_events"))
    return hours.filter("n_corrections > 0").select("tenant_id", hour_text(F.col("period")).alias("metric_hour"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(sessions.user_events(table(spark, d, "raw_events")))


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("tenant_id", "actor", "first_event_id", "last_event_id")


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling.trailing(rolling.daily_values(table(spark, d, "tenant_metrics_daily")))
    return rolled.select(F.col("entity").alias("tenant_id"), F.col("day").alias("metric_date"), "sum_7", "sum_30", "avg_7", "avg_30")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rolled = rolling.trailing(rolling.daily_values(table(spark, d, "tenant_metrics_daily")))
    return rolling.collapses(rolled).select(F.col("entity").alias("tenant_id"), day_text(F.col("day")).alias("metric_date"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_events"), table(spark, d, "payload_fields")).select("landing_file", "field_name", "change")


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    typed = drift.typed_table(table(spark, d, "raw_events"), table(spark, d, "payload_fields"))
    return typed.withColumn("failed_casts", F.array_join("failed_casts", "|"))


def p4_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    typed = drift.typed_table(table(spark, d, "raw_events"), table(spark, d, "payload_fields"))
    return typed.select("event_type", F.explode("failed_casts").alias("field_name")).groupBy("event_type", "field_name").agg(F.count("*").alias("n_failed"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(references, arrivals of their parents as stored)."""
    orders, payments = table(spark, d, "processed_orders"), table(spark, d, "processed_payments")
    refs = orphans.references(orders, "processed_orders", "order_id", "product_id").unionByName(orphans.references(payments, "processed_payments", "payment_id", "order_id"))
    came = orphans.arrivals(table(spark, d, "tenant_products"), "processed_orders", "product_id").unionByName(orphans.arrivals(orders, "processed_payments", "order_id"))
    return refs, came


def _product_lives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletions) of products in the change feed, as parents' arrivals and deletions."""
    feed = table(spark, d, "product_changes")
    named = lambda ops: orphans.arrivals(feed.filter(F.lower(F.trim("op")).isin(*ops)), "processed_orders", "product_id", "changed_at")
    return named(changefeed.UPSERTS), named(changefeed.DELETES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    refs, came = _references(spark, d)
    state, _ = orphans.advance(None, None, refs, came)
    return orphans.unborn(state).select(F.col("relation").alias("child_table"), "tenant_id", "child_id")


def _by_day(state: DataFrame) -> DataFrame:
    return orphans.open_counts(state).select(F.col("relation").alias("child_table"), day_text(F.col("period")).alias("period"), "n_opened", "n_resolved", "n_reopened", "n_open")


def p5_open_by_day(spark: SparkSession, d: str) -> DataFrame:
    refs, came = _references(spark, d)
    made, went = _product_lives(spark, d)
    state, _ = orphans.advance(None, None, refs, came.unionByName(made), went)
    return _by_day(state)


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """p5_open_by_day from three batches that come in the wrong order, one of them twice."""
    refs, came = _references(spark, d)
    made, went = _product_lives(spark, d)
    came = came.unionByName(made)
    part = lambda df, i: df.filter(F.pmod(F.xxhash64("tenant_id", "ref_key", "ref_at" if "ref_at" in df.columns else "at"), F.lit(3)) == i)
    state = log = None
    for i in (2, 0, 2, 1):
        state, log = orphans.advance(state, log, part(refs, i), part(came, i), part(went, i))
        state, log = cut_lineage(state), cut_lineage(log)
    return _by_day(state)


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.replay(table(spark, d, "product_changes")).select("tenant_id", "product_id", "inventory_on_hand", "last_event_id", "updated_at")


def p6_incremental(spark: SparkSession, d: str) -> DataFrame:
    """p6_state from three batches of changes that come in the wrong order, one of them twice."""
    feed = table(spark, d, "product_changes")
    log, parts = (spark.createDataFrame([], schema) for schema in (changefeed.LOG, changefeed.SUMMARIES))
    for i in (2, 0, 2, 1):
        log, parts = changefeed.advance(log, parts, feed.filter(F.pmod("change_no", F.lit(3)) == i))
        log, parts = cut_lineage(log), cut_lineage(parts)
    return changefeed.fold(parts).select("tenant_id", "product_id", "inventory_on_hand", "last_event_id", "updated_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.stale(table(spark, d, "tenant_products"), changefeed.replay(table(spark, d, "product_changes")))


def _delays(spark: SparkSession, d: str) -> DataFrame:
    once = first_arrivals(table(spark, d, "raw_events")).filter("arrived_at is not null")
    return once.select("tenant_id", day_text(F.col("event_timestamp")).alias("event_date"), "event_id", (micros(F.col("arrived_at")) - micros(F.col("event_timestamp"))).alias("delay"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.at_percentile(_delays(spark, d), ["tenant_id", "event_date"], "delay", "event_id", 95, coarse=1_000_000).select("tenant_id", "event_date", "event_id")


def p7_delay_modes(spark: SparkSession, d: str) -> DataFrame:
    """Per tenant and day: events, distinct whole-second delays, and the most frequent of them."""
    rows = _delays(spark, d).withColumn("delay_s", F.floor(F.col("delay") / 1_000_000).cast("bigint"))
    keys = ["tenant_id", "event_date"]
    return skew.distinct_and_mode(skew.weighted(rows, keys, "delay_s"), keys, "delay_s").select(*keys, "n_rows", "n_distinct", F.col("mode").alias("mode_delay_s"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hourly, p1_incremental, p2_found, p2_sessions, p3_found, p3_rolling, p4_found, p4_table, p4_failed_casts, p5_found, p5_open_by_day, p5_incremental, p6_found, p6_state, p6_incremental, p7_found, p7_delay_modes)}

_ONCE = """
once AS (SELECT lower(trim(tenant_id)) AS tenant_id, event_id, min(event_timestamp) AS ts, min(ingested_at) AS arrived,
  arg_min(source_service, ingested_at) AS src FROM raw_events
  WHERE trim(tenant_id) <> '' AND event_id IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY 1, 2)"""
_LATE = "arrived >= date_trunc('hour', ts) + INTERVAL 1 HOUR"
_HOURLY = f"""WITH {_ONCE}, hours AS (SELECT tenant_id, strftime(ts, '%Y-%m-%d %H:00:00') AS metric_hour,
  count(*) FILTER (NOT {_LATE}) AS n_in_time,
  count(*) FILTER ({_LATE} AND arrived - ts <= INTERVAL 600 SECOND) AS n_corrections,
  count(*) FILTER ({_LATE} AND arrived - ts > INTERVAL 600 SECOND) AS n_rejected
  FROM once WHERE arrived IS NOT NULL GROUP BY 1, 2)"""
_SESSIONS = """WITH acts AS (SELECT lower(trim(tenant_id)) AS tenant_id, event_id, event_timestamp AS ts, ingested_at,
    CASE WHEN json_valid(payload) THEN nullif(lower(trim(payload ->> '$.user_id')), '') END AS u,
    CASE WHEN json_valid(payload) AND trim(payload ->> '$.session_id') <> '' THEN payload ->> '$.session_id' END AS s
    FROM raw_events WHERE event_type LIKE 'user.%' AND trim(tenant_id) <> '' AND event_id IS NOT NULL AND event_timestamp IS NOT NULL),
  once AS (SELECT tenant_id, event_id, min(ts) AS ts, arg_min(coalesce(u, 'anon:' || s), ingested_at) AS actor
    FROM acts GROUP BY 1, 2),
  flagged AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
    FROM once WHERE actor IS NOT NULL WINDOW w AS (PARTITION BY tenant_id, actor ORDER BY ts, event_id)),
  numbered AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY tenant_id, actor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM flagged),
  sess AS (SELECT tenant_id, actor, CAST(session_no AS BIGINT) AS session_no, first(event_id ORDER BY ts, event_id) AS first_event_id,
    last(event_id ORDER BY ts, event_id) AS last_event_id, min(ts) AS started_at, max(ts) AS ended_at,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration_seconds, count(*) AS n_events
    FROM numbered GROUP BY tenant_id, actor, session_no)"""
_ROLLED = """WITH latest AS (SELECT lower(trim(tenant_id)) AS tenant_id, metric_date AS day,
    CAST(coalesce(first(net_revenue ORDER BY updated_at DESC NULLS LAST, net_revenue DESC NULLS LAST), 0) AS DECIMAL(28,2)) AS v
    FROM tenant_metrics_daily WHERE trim(tenant_id) <> '' AND metric_date IS NOT NULL GROUP BY 1, 2),
  spans AS (SELECT tenant_id, min(day) AS f, max(day) AS l FROM latest GROUP BY 1),
  days AS (SELECT tenant_id, f, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
  filled AS (SELECT tenant_id, f, day, coalesce(v, 0) AS v FROM days LEFT JOIN latest USING (tenant_id, day)),
  rolled AS (SELECT tenant_id, f, day, CAST(sum(v) OVER (PARTITION BY tenant_id ORDER BY day ROWS 6 PRECEDING) AS DECIMAL(28,2)) AS sum_7,
    CAST(sum(v) OVER (PARTITION BY tenant_id ORDER BY day ROWS 29 PRECEDING) AS DECIMAL(28,2)) AS sum_30 FROM filled)"""
_REBUILT = """WITH RECURSIVE c AS (SELECT lower(trim(tenant_id)) AS tenant_id, lower(trim(product_id)) AS product_id, event_id, min(changed_at) AS moment,
    arg_min(lower(trim(op)) IN ('d', 'delete', 'remove'), change_no) AS gone, arg_min(coalesce(inventory_delta, 0), change_no) AS delta
    FROM product_changes GROUP BY 1, 2, 3),
  epochs AS (SELECT *, sum(gone::INT) OVER (PARTITION BY tenant_id, product_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM c),
  last_epoch AS (SELECT tenant_id, product_id, list(delta ORDER BY moment, event_id) FILTER (NOT gone) AS deltas,
    last(event_id ORDER BY moment, event_id) AS last_event_id, max(moment) AS updated_at
    FROM epochs e WHERE epoch = (SELECT max(epoch) FROM epochs x WHERE x.tenant_id = e.tenant_id AND x.product_id = e.product_id) GROUP BY 1, 2),
  rebuilt AS (SELECT tenant_id, product_id, CAST(list_reduce(list_prepend(0::BIGINT, deltas::BIGINT[]), lambda a, x: greatest(a + x, 0)) AS BIGINT) AS inventory_on_hand,
    last_event_id, updated_at FROM last_epoch WHERE deltas IS NOT NULL)"""
_ORPHANS = """WITH prod AS (SELECT lower(trim(tenant_id)) AS t, lower(trim(product_id)) AS k, min(created_at) AS since FROM tenant_products GROUP BY 1, 2),
  ord AS (SELECT lower(trim(tenant_id)) AS t, lower(trim(order_id)) AS k, min(created_at) AS since FROM processed_orders GROUP BY 1, 2),
  refs AS (SELECT 'processed_orders' AS child_table, lower(trim(tenant_id)) AS tenant_id, lower(trim(product_id)) AS k, order_id AS child_id, event_timestamp AS ref_at FROM processed_orders
    UNION ALL SELECT 'processed_payments', lower(trim(tenant_id)), lower(trim(order_id)), payment_id, event_timestamp FROM processed_payments),
  judged AS (SELECT refs.*, CASE WHEN child_table = 'processed_orders' THEN prod.since ELSE ord.since END AS since
    FROM refs LEFT JOIN prod ON child_table = 'processed_orders' AND prod.t = tenant_id AND prod.k = refs.k
    LEFT JOIN ord ON child_table = 'processed_payments' AND ord.t = tenant_id AND ord.k = refs.k
    WHERE refs.k <> '' AND tenant_id <> '' AND child_id IS NOT NULL AND ref_at IS NOT NULL),
  orphan AS (SELECT * FROM judged WHERE since IS NULL OR since > ref_at)"""
# a product is alive at a moment if the last of its changes up to then isn't a deletion; a change of that is a step of every reference it concerns
_BY_DAY = """WITH log AS (SELECT 'processed_orders' AS rel, lower(trim(tenant_id)) AS t, lower(trim(product_id)) AS k, created_at AS moment, 1 AS up FROM tenant_products
    UNION ALL SELECT 'processed_payments', lower(trim(tenant_id)), lower(trim(order_id)), created_at, 1 FROM processed_orders
    UNION ALL SELECT 'processed_orders', lower(trim(tenant_id)), lower(trim(product_id)), changed_at, CASE WHEN lower(trim(op)) IN ('d', 'delete', 'remove') THEN 0 ELSE 1 END FROM product_changes
      WHERE lower(trim(op)) IN ('d', 'delete', 'remove', 'i', 'insert', 'c', 'create', 'u', 'update', 'upsert')),
  settled AS (SELECT rel, t, k, moment, max(up) AS up FROM log WHERE t <> '' AND k <> '' AND moment IS NOT NULL GROUP BY ALL),
  turns AS (SELECT * FROM settled QUALIFY up IS DISTINCT FROM coalesce(lag(up) OVER (PARTITION BY rel, t, k ORDER BY moment), 0)),
  refs AS (SELECT DISTINCT 'processed_orders' AS rel, lower(trim(tenant_id)) AS t, lower(trim(product_id)) AS k, order_id AS child, event_timestamp AS ref_at FROM processed_orders
    UNION SELECT 'processed_payments', lower(trim(tenant_id)), lower(trim(order_id)), payment_id, event_timestamp FROM processed_payments),
  judged AS (SELECT *, coalesce((SELECT arg_max(up, moment) FROM turns x WHERE x.rel = refs.rel AND x.t = refs.t AND x.k = refs.k AND x.moment <= ref_at), 0) AS up0
    FROM refs WHERE t <> '' AND k <> '' AND child IS NOT NULL AND ref_at IS NOT NULL),
  later AS (SELECT j.rel, x.moment, x.up, row_number() OVER (PARTITION BY j.rel, j.t, j.k, child, ref_at ORDER BY x.moment) = 1 AND up0 = 1 AS fresh
    FROM judged j JOIN turns x ON x.rel = j.rel AND x.t = j.t AND x.k = j.k AND x.moment > ref_at),
  steps AS (SELECT rel, ref_at AS moment, 'o' AS kind FROM judged WHERE up0 = 0 UNION ALL SELECT rel, moment, CASE WHEN up = 1 THEN 'r' WHEN fresh THEN 'o' ELSE 'b' END FROM later),
  per AS (SELECT rel AS child_table, strftime(moment, '%Y-%m-%d') AS period, count(*) FILTER (kind = 'o') AS n_opened, count(*) FILTER (kind = 'r') AS n_resolved, count(*) FILTER (kind = 'b') AS n_reopened FROM steps GROUP BY ALL)
  SELECT *, CAST(sum(n_opened - n_resolved + n_reopened) OVER (PARTITION BY child_table ORDER BY period) AS BIGINT) AS n_open FROM per"""
_DELAYS = f"""WITH {_ONCE}, delays AS (SELECT tenant_id, strftime(ts, '%Y-%m-%d') AS event_date, event_id, epoch_us(arrived) - epoch_us(ts) AS delay FROM once WHERE arrived IS NOT NULL)"""

_KEYS = """j AS (SELECT landing_file, CASE split_part(event_type, '.', 1) WHEN 'order' THEN 'orders' WHEN 'payment' THEN 'payments' WHEN 'user' THEN 'users'
    WHEN 'product' THEN 'products' WHEN 'system' THEN 'system' END AS d, payload_version AS v, event_type, schema_ref AS ref, payload::JSON AS p, row_number() OVER () AS rid
    FROM raw_events WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  kv AS (SELECT landing_file, rid, d, v, event_type, unnest(json_keys(p)) AS k, p FROM j),
  f AS (SELECT landing_file, rid, d, v, event_type, k, json_extract_string(p, '$."' || k || '"') AS s, CASE json_type(p, '$."' || k || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM kv)"""
_TEXTS = "action category channel currency customer_id device_kind failure_code fulfillment_status marketing_campaign_id message name order_id page payment_id payment_method plan product_id referrer region service_name session_id sku status user_id".split()
_NUMBERS = "amount cache_hit_rate discount_amount duration_seconds error_count inventory_delta kafka_lag latency_ms price quantity risk_score tax_amount throughput_per_minute unit_price".split()
# a value is there unless it is absent or null; one that can't be read as its column's type is a failed cast
_TABLE = f"""WITH j AS (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS p FROM raw_events)
  SELECT event_id, tenant_id, event_type, payload_version, landing_file, p IS NOT NULL AS is_object, {", ".join(f"p ->> '{n}' AS f_{n}" for n in _TEXTS)}, {", ".join(f"try_cast(p ->> '{n}' AS DOUBLE) AS f_{n}" for n in _NUMBERS)},
  try_cast(p ->> 'active' AS BOOLEAN) AS f_active, coalesce(array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN p ->> '{n}' IS NOT NULL AND try_cast(p ->> '{n}' AS DOUBLE) IS NULL THEN '{n}' END" for n in _NUMBERS)},
  CASE WHEN p ->> 'active' IS NOT NULL AND try_cast(p ->> 'active' AS BOOLEAN) IS NULL THEN 'active' END], lambda x: x IS NOT NULL)), '|'), '') AS failed_casts FROM j"""
_DRIFT = f"""WITH {_KEYS}, c AS (SELECT domain_name AS d, payload_version AS v, field_name AS k, json_type AS kind, is_required AS req FROM payload_fields),
  known AS (SELECT DISTINCT d, v FROM c),
  sig AS (SELECT *, CASE kind WHEN 'string' THEN 's:' || regexp_replace(lower(s), '[0-9]+', '#', 'g') WHEN 'number' THEN CASE WHEN s SIMILAR TO '.*[.eE].*' THEN 'n:dec' ELSE 'n:int' END WHEN 'boolean' THEN 'b' END AS g FROM f),
  seen AS (SELECT DISTINCT sig.d, sig.k, g FROM sig JOIN (SELECT DISTINCT d, k, kind FROM c WHERE req) r ON r.d = sig.d AND r.k = sig.k AND r.kind = sig.kind),
  gone AS (SELECT j.landing_file, j.rid, j.d, j.v, c.k, c.kind FROM j JOIN c ON c.d = j.d AND c.v = j.v AND c.req LEFT JOIN f ON f.rid = j.rid AND f.k = c.k WHERE f.rid IS NULL),
  extra AS (SELECT sig.* FROM sig JOIN known USING (d, v) LEFT JOIN c ON c.d = sig.d AND c.v = sig.v AND c.k = sig.k WHERE c.d IS NULL),
  ren AS (SELECT g.rid, g.landing_file, g.k AS m, e.k AS x,
    row_number() OVER (PARTITION BY g.rid ORDER BY (s.d IS NOT NULL)::INT * 2 + (len(list_filter(string_split(g.k, '_'), lambda w: length(w) >= 3 AND contains(lower(regexp_replace(e.k, '[^A-Za-z]', '', 'g')), w))) > 0)::INT DESC, g.k, e.k) AS rn
    FROM gone g JOIN extra e ON e.rid = g.rid AND e.kind = g.kind LEFT JOIN seen s ON s.d = g.d AND s.k = g.k AND s.g = e.g
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.d = e.d AND c.k = e.k)
      AND (s.d IS NOT NULL OR len(list_filter(string_split(g.k, '_'), lambda w: length(w) >= 3 AND contains(lower(regexp_replace(e.k, '[^A-Za-z]', '', 'g')), w))) > 0)),
  r1 AS (SELECT * FROM ren WHERE rn = 1),
  refs AS (SELECT landing_file, d, v, CASE WHEN dd LIKE '%s' THEN dd ELSE dd || 's' END AS rd, rv FROM (SELECT landing_file, d, v,
     regexp_extract(ref, '(contracts/|urn:contract:|^)([a-z]+)(-payload/v|:|/v)([0-9]+)', 2) AS dd, regexp_extract(ref, '(contracts/|urn:contract:|^)([a-z]+)(-payload/v|:|/v)([0-9]+)', 4) AS rv FROM j WHERE ref IS NOT NULL)),
  out AS (SELECT landing_file, m AS field_name, 'renamed' AS change FROM r1
    UNION SELECT gone.landing_file, gone.k, 'removed' FROM gone LEFT JOIN r1 ON r1.rid = gone.rid AND r1.m = gone.k WHERE r1.rid IS NULL
    UNION SELECT extra.landing_file, extra.k, 'added' FROM extra LEFT JOIN r1 ON r1.rid = extra.rid AND r1.x = extra.k WHERE r1.rid IS NULL
    UNION SELECT f.landing_file, f.k, 'retyped' FROM f JOIN c ON c.d = f.d AND c.v = f.v AND c.k = f.k AND c.kind <> f.kind AND f.kind <> 'null'
    UNION SELECT j.landing_file, 'payload_version', 'unknown_version' FROM j LEFT JOIN known USING (d, v) WHERE known.d IS NULL
    UNION SELECT landing_file, 'schema_ref', 'ref_mismatch' FROM refs WHERE replace(rd, 'systems', 'system') <> d OR rv <> v::VARCHAR)"""

ORACLE = {
    "p1_hourly": f"{_HOURLY} SELECT *, n_in_time + n_corrections AS n_accepted FROM hours",
    "p1_incremental": f"{_HOURLY} SELECT *, n_in_time + n_corrections AS n_accepted FROM hours",
    "p1_found": f"{_HOURLY} SELECT tenant_id, metric_hour FROM hours WHERE n_corrections > 0",
    "p2_sessions": f"{_SESSIONS} SELECT * FROM sess",
    "p2_found": f"{_SESSIONS} SELECT tenant_id, actor, first_event_id, last_event_id FROM sess",
    "p3_rolling": f"{_ROLLED} SELECT tenant_id, day AS metric_date, sum_7, sum_30, sum_7::DOUBLE / 7 AS avg_7, sum_30::DOUBLE / 30 AS avg_30 FROM rolled",
    "p3_found": f"{_ROLLED} SELECT tenant_id, strftime(day, '%Y-%m-%d') AS metric_date FROM rolled WHERE day - f >= 29 AND sum_7 * 120 < sum_30 * 7",
    "p4_found": f"{_DRIFT} SELECT DISTINCT * FROM out",
    "p4_table": _TABLE,
    "p4_failed_casts": f"""WITH {_KEYS}, c AS (SELECT DISTINCT field_name AS k, json_type AS want FROM payload_fields)
      SELECT event_type, k AS field_name, count(*) AS n_failed FROM f JOIN c USING (k) WHERE kind <> 'null' AND CASE want
        WHEN 'number' THEN kind IN ('array', 'object') OR (kind = 'string' AND try_cast(s AS DOUBLE) IS NULL)
        WHEN 'boolean' THEN kind IN ('array', 'object') OR (kind = 'string' AND try_cast(s AS BOOLEAN) IS NULL) ELSE FALSE END GROUP BY 1, 2""",
    "p5_found": f"{_ORPHANS} SELECT DISTINCT child_table, tenant_id, child_id FROM orphan",
    "p5_open_by_day": _BY_DAY,
    "p5_incremental": _BY_DAY,
    "p6_state": f"{_REBUILT} SELECT * FROM rebuilt",
    "p6_incremental": f"{_REBUILT} SELECT * FROM rebuilt",
    "p6_found": f"""{_REBUILT} SELECT coalesce(s.tenant_id, r.tenant_id) AS tenant_id, coalesce(s.product_id, r.product_id) AS product_id
      FROM (SELECT lower(trim(tenant_id)) AS tenant_id, lower(trim(product_id)) AS product_id, inventory_on_hand AS n, last_event_id AS e FROM tenant_products) s
      FULL JOIN rebuilt r ON r.tenant_id = s.tenant_id AND r.product_id = s.product_id
      WHERE s.tenant_id IS NULL OR r.tenant_id IS NULL OR s.n IS DISTINCT FROM r.inventory_on_hand OR s.e IS DISTINCT FROM r.last_event_id""",
    "p7_found": f"""{_DELAYS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_date ORDER BY delay, event_id) AS rn, count(*) OVER (PARTITION BY tenant_id, event_date) AS n FROM delays)
      SELECT tenant_id, event_date, event_id FROM ranked WHERE rn = (95 * n + 99) // 100""",
    "p7_delay_modes": f"""{_DELAYS}, w AS (SELECT tenant_id, event_date, CAST(floor(delay / 1000000.0) AS BIGINT) AS s, count(*) AS n FROM delays GROUP BY 1, 2, 3)
      SELECT tenant_id, event_date, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, first(s ORDER BY n DESC, s) AS mode_delay_s FROM w GROUP BY 1, 2""",
}
