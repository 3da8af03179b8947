"""What the serving queries are held against, stated on its own in DuckDB's SQL.

Nothing here is taken from the queries or the operators: constants are spelt out, keyed
tables are settled by correlated picks rather than by aggregates, and figures per day
come from one long list of events where the queries join three aggregates.
"""

from __future__ import annotations

# events of a domain once, as their first copy has them; a payload that is no JSON has no fields
_EV = """ev AS (SELECT lower(trim(tenant_id)) AS tenant_id, event_id, event_type, event_timestamp, ingested_at, landing_file, CASE WHEN json_valid(payload) THEN payload::JSON END AS p
  FROM raw_events WHERE trim(tenant_id) <> '' AND event_id IS NOT NULL AND event_timestamp IS NOT NULL)"""


def _domain(name: str, prefix: str, key: str) -> str:
    return f"{name} AS (SELECT DISTINCT ON (tenant_id, event_id) * FROM ev WHERE starts_with(event_type, '{prefix}') AND p ->> '{key}' IS NOT NULL ORDER BY tenant_id, event_id, ingested_at, landing_file)"


_ORD = (
    _EV + ", " + _domain("oe0", "order.", "order_id") + """, oe AS (SELECT *, q * u AS gross, greatest(q * u - coalesce(try_cast(p ->> 'discount_amount' AS DECIMAL(18,2)), 0), 0) AS net0
  FROM (SELECT *, try_cast(p ->> 'quantity' AS BIGINT) AS q, try_cast(p ->> 'unit_price' AS DECIMAL(18,2)) AS u FROM oe0)),
  o AS (SELECT *, CASE WHEN gross IS NOT NULL THEN CAST(net0 AS DECIMAL(18,2)) END AS net FROM oe)"""
)
_USR = _EV + ", " + _domain("ue", "user.", "user_id") + ", s AS (SELECT *, p ->> 'user_id' AS user_id, coalesce(nullif(p ->> 'session_id', ''), 'sessionless:' || (p ->> 'user_id')) AS session_id FROM ue)"
_SYS = _EV + ", " + _domain("h", "system.", "service_name")
# an order keeps what its first write says it is; what later writes may change is the last one's
_ORDERS = """fo AS (SELECT tenant_id, order_id, arg_min(event_id, (updated_at, event_id)) AS event_id FROM processed_orders GROUP BY 1, 2),
  lo AS (SELECT tenant_id, order_id, arg_max(event_id, (updated_at, event_id)) AS event_id FROM processed_orders GROUP BY 1, 2),
  orders_now AS (SELECT a.tenant_id, a.order_id, a.event_id, a.customer_id, a.product_id, a.currency, a.created_at, b.quantity, b.unit_price, b.discount_amount, b.gross_revenue, b.net_revenue, b.status, b.channel, b.marketing_campaign_id, b.region, b.event_timestamp, b.updated_at
    FROM (SELECT DISTINCT ON (p.tenant_id, p.order_id) p.* FROM processed_orders p JOIN fo USING (tenant_id, order_id, event_id) ORDER BY p.tenant_id, p.order_id, p.updated_at) a
    JOIN (SELECT DISTINCT ON (p.tenant_id, p.order_id) p.* FROM processed_orders p JOIN lo USING (tenant_id, order_id, event_id) ORDER BY p.tenant_id, p.order_id, p.updated_at DESC) b USING (tenant_id, order_id))"""
_PAYMENTS = """payments_now AS (SELECT tenant_id, payment_id, first(event_id ORDER BY updated_at, event_id) AS event_id, first(order_id ORDER BY updated_at, event_id) AS order_id, first(customer_id ORDER BY updated_at, event_id) AS customer_id,
    first(amount ORDER BY updated_at, event_id) AS amount, first(currency ORDER BY updated_at, event_id) AS currency, first(payment_method ORDER BY updated_at, event_id) AS payment_method, first(created_at ORDER BY updated_at, event_id) AS created_at,
    last(status ORDER BY updated_at, event_id) AS status, last(failure_code ORDER BY updated_at, event_id) AS failure_code, last(risk_score ORDER BY updated_at, event_id) AS risk_score, last(event_timestamp ORDER BY updated_at, event_id) AS event_timestamp, max(updated_at) AS updated_at
    FROM processed_payments GROUP BY 1, 2)"""
_DAYS = "dm AS (SELECT * FROM tenant_metrics_daily QUALIFY row_number() OVER (PARTITION BY tenant_id, metric_date ORDER BY updated_at DESC, net_revenue DESC NULLS LAST) = 1)"
# one row per fact, whatever it is a fact of
_LONG = f"""{_ORDERS}, {_PAYMENTS}, {_USR},
  facts AS (SELECT tenant_id, event_timestamp::DATE AS day, 'o' AS kind, gross_revenue AS gross, net_revenue AS net, quantity AS units, CASE WHEN marketing_campaign_id IS NOT NULL THEN net_revenue ELSE 0 END AS attr, NULL AS st, NULL AS usr, FALSE AS fresh, FALSE AS churn FROM orders_now
    UNION ALL SELECT tenant_id, event_timestamp::DATE, 'p', 0, 0, 0, 0, status, NULL, FALSE, FALSE FROM payments_now
    UNION ALL SELECT tenant_id, event_timestamp::DATE, 'u', 0, 0, 0, 0, NULL, user_id, event_type = 'user.signed_up' OR coalesce(p ->> 'action' = 'signed_up', FALSE), event_type = 'user.churn_signal' OR coalesce(p ->> 'action' IN ('churn_signal', 'cancel_intent'), FALSE) FROM s),
  byday AS (SELECT tenant_id, day AS metric_date, CAST(sum(gross) AS DECIMAL(18,2)) AS gross_revenue, CAST(sum(net) AS DECIMAL(18,2)) AS net_revenue, count(*) FILTER (kind = 'o') AS order_count, CAST(sum(units) AS BIGINT) AS units_sold,
    count(DISTINCT usr) FILTER (fresh) AS new_users, count(DISTINCT usr) AS active_users, count(*) FILTER (churn) AS churn_signal_count, count(*) FILTER (st = 'authorized' OR st = 'captured') AS payment_success_count, count(*) FILTER (st = 'failed') AS payment_failure_count,
    CAST(sum(attr) AS DECIMAL(18,2)) AS attributed_revenue, count(*) AS events_processed, count(*) FILTER (kind = 'p') AS n_pay FROM facts GROUP BY 1, 2)"""
_BYDAY = "tenant_id, metric_date, gross_revenue, net_revenue, order_count, units_sold, new_users, active_users, churn_signal_count, payment_success_count, payment_failure_count, attributed_revenue, events_processed"
_SPINE = f"""{_LONG}, spine AS (SELECT tenant_id, CAST(unnest(range(min(metric_date)::TIMESTAMP, max(metric_date)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS metric_date FROM byday GROUP BY 1),
  full_days AS (SELECT tenant_id, metric_date, coalesce(gross_revenue, 0) AS gross_revenue, coalesce(net_revenue, 0) AS net_revenue, coalesce(order_count, 0) AS order_count, coalesce(units_sold, 0) AS units_sold, coalesce(new_users, 0) AS new_users, coalesce(active_users, 0) AS active_users,
    coalesce(churn_signal_count, 0) AS churn_signal_count, coalesce(payment_success_count, 0) AS payment_success_count, coalesce(payment_failure_count, 0) AS payment_failure_count, coalesce(attributed_revenue, 0) AS attributed_revenue, coalesce(events_processed, 0) AS events_processed
    FROM spine LEFT JOIN byday USING (tenant_id, metric_date))"""
_DELTAS = f"""{_EV}, one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY ingested_at, landing_file) = 1),
  vals AS (SELECT *, starts_with(event_type, 'order.') AS is_order, CASE WHEN starts_with(event_type, 'order.') THEN try_cast(p ->> 'quantity' AS BIGINT) END AS q, CASE WHEN starts_with(event_type, 'order.') THEN try_cast(p ->> 'unit_price' AS DECIMAL(18,2)) END AS u FROM one),
  d AS (SELECT *, coalesce(q * u, 0) AS g, CASE WHEN q * u IS NULL THEN 0 ELSE greatest(q * u - coalesce(try_cast(p ->> 'discount_amount' AS DECIMAL(18,2)), 0), 0) END AS n FROM vals)"""
_DELTA_SUMS = """CAST(sum(g) AS DECIMAL(18,2)) AS gross_revenue, CAST(sum(n) AS DECIMAL(18,2)) AS net_revenue, count(*) FILTER (is_order) AS order_count, CAST(sum(coalesce(q, 0)) AS BIGINT) AS units_sold, count(*) FILTER (event_type = 'user.signed_up') AS new_users,
  count(*) FILTER (event_type = 'user.signed_up' OR event_type = 'user.activity') AS active_users, count(*) FILTER (event_type = 'user.churn_signal') AS churn_signal_count, count(*) FILTER (event_type = 'payment.captured' OR event_type = 'payment.authorized') AS payment_success_count,
  count(*) FILTER (event_type = 'payment.failed') AS payment_failure_count, CAST(sum(CASE WHEN is_order AND p ->> 'marketing_campaign_id' IS NOT NULL THEN n ELSE 0 END) AS DECIMAL(18,2)) AS attributed_revenue, count(*) AS events_processed"""
_RUNS = "runs AS (SELECT landing_file AS run_id, string_split(landing_file, '/')[2] AS pipeline, CASE WHEN bool_or(payload IS NULL) THEN 'degraded' ELSE 'succeeded' END AS status, count(*) AS records_processed, min(ingested_at) AS started_at, max(ingested_at) AS finished_at FROM raw_events GROUP BY 1)"
_PRODUCT = """named AS (SELECT o.*, lower(trim(o.product_id)) AS pid, (SELECT any_value(name) FROM tenant_products t WHERE t.tenant_id = o.tenant_id AND t.product_id = lower(trim(o.product_id))) AS pname,
    (SELECT any_value(category) FROM tenant_products t WHERE t.tenant_id = o.tenant_id AND t.product_id = lower(trim(o.product_id))) AS cat FROM orders_now o)"""
_RECON_R = f"""{_LONG}, {_DAYS}, rr AS (SELECT dm.tenant_id, dm.metric_date, CAST(coalesce(dm.net_revenue, 0) - coalesce(b.net_revenue, 0) AS DECIMAL(18,2)) AS revenue_delta, coalesce(dm.order_count, 0) - coalesce(b.order_count, 0) AS order_count_delta,
    coalesce(dm.units_sold, 0) - coalesce(b.units_sold, 0) AS units_sold_delta FROM dm LEFT JOIN byday b USING (tenant_id, metric_date)),
  rv AS (SELECT *, CASE WHEN revenue_delta BETWEEN -0.01 AND 0.01 AND order_count_delta = 0 AND units_sold_delta = 0 THEN 'passed' ELSE 'failed' END AS status FROM rr),
  pr AS (SELECT dm.tenant_id, dm.metric_date, coalesce(dm.payment_success_count, 0) - coalesce(b.payment_success_count, 0) AS success_delta, coalesce(dm.payment_failure_count, 0) - coalesce(b.payment_failure_count, 0) AS failure_delta FROM dm LEFT JOIN byday b USING (tenant_id, metric_date)),
  pv AS (SELECT *, CASE WHEN abs(success_delta) + abs(failure_delta) = 0 THEN 'passed' ELSE 'failed' END AS status FROM pr),
  ar AS (SELECT dm.tenant_id, dm.metric_date, coalesce(dm.new_users, 0) - coalesce(b.new_users, 0) AS new_users_delta, coalesce(dm.active_users, 0) - coalesce(b.active_users, 0) AS active_users_delta, coalesce(dm.churn_signal_count, 0) - coalesce(b.churn_signal_count, 0) AS churn_signal_count_delta FROM dm LEFT JOIN byday b USING (tenant_id, metric_date)),
  av AS (SELECT *, CASE WHEN abs(new_users_delta) + abs(active_users_delta) + abs(churn_signal_count_delta) = 0 THEN 'passed' ELSE 'failed' END AS status FROM ar)"""
_SUMMARY = "SELECT tenant_id, metric_date, count(*) AS checks_run, count(*) FILTER (status = 'passed') AS passed_checks, count(*) FILTER (status = 'failed') AS failed_checks, greatest(max(revenue_delta), -min(revenue_delta)) AS max_abs_revenue_delta, greatest(max(order_count_delta), -min(order_count_delta)) AS max_abs_order_count_delta, greatest(max(units_sold_delta), -min(units_sold_delta)) AS max_abs_units_sold_delta FROM rv"
_FCT = f"""{_PAYMENTS}, {_DAYS}, obs AS (SELECT tenant_id, event_timestamp::DATE AS metric_date, sum((status IN ('captured', 'authorized'))::INT) AS ok, sum((status = 'failed')::INT) AS bad FROM payments_now GROUP BY 1, 2),
  fct AS (SELECT tenant_id, metric_date, gross_revenue, net_revenue, order_count, units_sold, new_users, active_users, churn_signal_count, payment_success_count, payment_failure_count, CAST(coalesce(ok, 0) AS BIGINT) AS observed_successful_payments, CAST(coalesce(bad, 0) AS BIGINT) AS observed_failed_payments,
    marketing_attributed_revenue, CASE WHEN order_count <> 0 THEN net_revenue::DOUBLE / order_count END AS average_order_value, CASE WHEN payment_success_count + payment_failure_count <> 0 THEN payment_failure_count::DOUBLE / (payment_success_count + payment_failure_count) END AS payment_failure_rate,
    CASE WHEN active_users <> 0 THEN churn_signal_count::DOUBLE / active_users END AS churn_signal_rate, events_processed, updated_at FROM dm LEFT JOIN obs USING (tenant_id, metric_date))"""


def _bad(model: str, column: str, test: str, source: str, where: str) -> str:
    return f"SELECT '{model}' AS model, '{column}' AS column_name, '{test}' AS test, (SELECT count(*) FROM {source} WHERE {where}) AS n_failed"


_TESTS = " UNION ALL ".join(
    [_bad("stg_orders", c, "not_null", "processed_orders", f"{c} IS NULL") for c in ("tenant_id", "order_id", "net_revenue")]
    + [_bad("stg_payments", c, "not_null", "processed_payments", f"{c} IS NULL") for c in ("tenant_id", "payment_id")]
    + [_bad("stg_payments", "status", "accepted", "processed_payments", "status NOT IN ('authorized', 'captured', 'failed', 'refunded', 'pending')")]
    + [_bad("fct_tenant_daily", c, "not_null", "fct", f"{c} IS NULL") for c in ("tenant_id", "metric_date", "net_revenue")]
    + [_bad("fct_tenant_daily", "payment_failure_rate", "range", "fct", "payment_failure_rate NOT BETWEEN 0 AND 1")]
)
_RULES = {
    "revenue": (("metric_date", "gross_revenue", "net_revenue", "order_count", "units_sold", "average_order_value"), ("gross_revenue", "net_revenue", "order_count", "units_sold", "average_order_value")),
    "customers": (("metric_date", "new_users", "active_users"), ("new_users", "active_users")),
    "churn": (("metric_date", "churn_signal_count"), ("churn_signal_count",)),
    "retention": (("metric_date", "active_users", "churn_signal_count", "estimated_retention_rate"), ("active_users", "churn_signal_count", "estimated_retention_rate")),
}
_CONTRACT = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{c}' AS field_name, '{rule}' AS rule, (SELECT count(*) FROM rated WHERE {c} {'IS NULL' if rule == 'required' else '< 0'}) AS n_failed"
    for m, sides in _RULES.items()
    for rule, side in zip(("required", "non_negative"), sides)
    for c in side
)
_KEPT = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {n} AS retention_days, count(*) FILTER ({c} IS NULL OR {c} >= TIMESTAMP '2018-07-15' - INTERVAL {n} DAY) AS n_kept, count(*) FILTER ({c} < TIMESTAMP '2018-07-15' - INTERVAL {n} DAY) AS n_expired FROM {t}"
    for t, c, n in (("raw_events", "ingested_at", 180), ("processed_orders", "created_at", 365), ("processed_payments", "created_at", 90), ("product_changes", "ingested_at", 120))
)
_GRAINS = " UNION ALL ".join(
    f"""SELECT '{g}' AS grain, tenant_id, CAST(date_trunc('{g}', metric_date) AS DATE) AS period, CAST(sum(net_revenue) AS DECIMAL(18,2)) AS net_revenue, CAST(sum(gross_revenue) AS DECIMAL(18,2)) AS gross_revenue, CAST(sum(order_count) AS BIGINT) AS order_count, CAST(sum(active_users) AS BIGINT) AS active_users,
    CAST(sum(payment_failure_count) AS BIGINT) AS payment_failure_count, CASE WHEN sum(order_count) <> 0 THEN CAST(sum(net_revenue) AS DECIMAL(18,2))::DOUBLE / CAST(sum(order_count) AS BIGINT) END AS average_order_value FROM dm GROUP BY 2, 3"""
    for g in ("day", "week", "month")
)

ORACLE = {
    "tenant_dim": "SELECT tenant_id, tenant_name, plan, region, is_active, config, created_at, updated_at FROM tenant_config",
    "order_revenue": f"WITH {_ORD} SELECT tenant_id, event_id, q AS quantity, u AS unit_price, coalesce(try_cast(p ->> 'discount_amount' AS DECIMAL(18,2)), 0) AS discount_amount, CAST(gross AS DECIMAL(18,2)) AS gross_revenue, net AS net_revenue FROM o",
    "batch_daily_revenue": f"WITH {_ORD} SELECT tenant_id, event_timestamp::DATE AS metric_date, CAST(sum(gross) AS DECIMAL(18,2)) AS gross_revenue, CAST(sum(net) AS DECIMAL(18,2)) AS net_revenue, count(*) AS order_count, CAST(sum(q) AS BIGINT) AS units_sold, CAST(sum(CASE WHEN p ->> 'marketing_campaign_id' IS NOT NULL THEN net ELSE 0 END) AS DECIMAL(18,2)) AS attributed_revenue, count(*) AS events_processed, 0 AS new_users, 0 AS active_users, 0 AS churn_signal_count, 0 AS payment_success_count, 0 AS payment_failure_count FROM o GROUP BY 1, 2",
    "stg_orders": "SELECT * EXCLUDE (event_id, created_at, updated_at), event_timestamp::DATE AS order_date FROM processed_orders",
    "stg_payments": "SELECT * EXCLUDE (event_id, created_at, updated_at), event_timestamp::DATE AS payment_date FROM processed_payments",
    "stg_sessions": f"WITH {_USR} SELECT tenant_id, user_id, session_id, p ->> 'action' AS action, p ->> 'page' AS page, p ->> 'referrer' AS referrer, coalesce(try_cast(p ->> 'duration_seconds' AS BIGINT), 0) AS duration_seconds, p ->> 'plan' AS plan, p ->> 'marketing_campaign_id' AS marketing_campaign_id, event_timestamp, event_timestamp::DATE AS activity_date FROM s",
    "processed_orders": f"WITH {_ORD} SELECT tenant_id, event_id, p ->> 'order_id' AS order_id, p ->> 'customer_id' AS customer_id, p ->> 'product_id' AS product_id, q AS quantity, u AS unit_price, coalesce(try_cast(p ->> 'discount_amount' AS DECIMAL(18,2)), 0) AS discount_amount, CAST(gross AS DECIMAL(18,2)) AS gross_revenue, net AS net_revenue, coalesce(p ->> 'currency', 'USD') AS currency, coalesce(p ->> 'status', 'created') AS status, coalesce(p ->> 'channel', 'unknown') AS channel, p ->> 'marketing_campaign_id' AS marketing_campaign_id, p ->> 'region' AS region, event_timestamp FROM o",
    "processed_payments": f"WITH {_EV}, {_domain('pe', 'payment.', 'payment_id')} SELECT tenant_id, event_id, p ->> 'payment_id' AS payment_id, p ->> 'order_id' AS order_id, p ->> 'customer_id' AS customer_id, try_cast(p ->> 'amount' AS DECIMAL(18,2)) AS amount, coalesce(p ->> 'currency', 'USD') AS currency, p ->> 'status' AS status, coalesce(p ->> 'payment_method', 'unknown') AS payment_method, p ->> 'failure_code' AS failure_code, try_cast(p ->> 'risk_score' AS DECIMAL(5,4)) AS risk_score, event_timestamp FROM pe",
    "processed_sessions": f"WITH {_USR} SELECT tenant_id, event_id, user_id, session_id, p ->> 'action' AS action, p ->> 'page' AS page, p ->> 'referrer' AS referrer, coalesce(try_cast(p ->> 'duration_seconds' AS BIGINT), 0) AS duration_seconds, p ->> 'plan' AS plan, p ->> 'marketing_campaign_id' AS marketing_campaign_id, event_timestamp FROM s",
    "product_rows": f"WITH {_EV}, {_domain('pe', 'product.', 'product_id')} SELECT tenant_id, event_id, p ->> 'product_id' AS product_id, p ->> 'sku' AS sku, p ->> 'name' AS name, p ->> 'category' AS category, try_cast(p ->> 'price' AS DECIMAL(18,2)) AS price, coalesce(try_cast(p ->> 'inventory_delta' AS BIGINT), 0) AS inventory_delta, coalesce(try_cast(p ->> 'active' AS BOOLEAN), TRUE) AS active, event_timestamp FROM pe",
    "health_rows": f"WITH {_SYS} SELECT tenant_id, event_id, p ->> 'service_name' AS service_name, p ->> 'status' AS status, try_cast(p ->> 'latency_ms' AS DOUBLE) AS latency_ms, coalesce(try_cast(p ->> 'error_count' AS BIGINT), 0) AS error_count, try_cast(p ->> 'throughput_per_minute' AS DOUBLE) AS throughput_per_minute, try_cast(p ->> 'kafka_lag' AS BIGINT) AS kafka_lag, try_cast(p ->> 'cache_hit_rate' AS DOUBLE) AS cache_hit_rate, p ->> 'message' AS message, event_timestamp FROM h",
    "session_summary": f"WITH {_USR} SELECT tenant_id, user_id, session_id, min(event_timestamp) AS session_start_at, max(event_timestamp) AS session_end_at, count(*) AS event_count, CAST(sum(coalesce(try_cast(p ->> 'duration_seconds' AS BIGINT), 0)) AS BIGINT) AS engaged_seconds, coalesce(string_agg(DISTINCT p ->> 'page', '|' ORDER BY p ->> 'page'), '') AS pages_seen FROM s GROUP BY 1, 2, 3",
    "session_gaps": f"WITH {_USR} SELECT tenant_id, event_id, lag(event_timestamp) OVER w AS previous_at, (epoch_us(event_timestamp) // 1000000 - epoch_us(lag(event_timestamp) OVER w) // 1000000) / 60.0::DOUBLE AS minutes_since_previous FROM s WINDOW w AS (PARTITION BY tenant_id, user_id, session_id ORDER BY event_timestamp, event_id)",
    "date_spine": "SELECT tenant_id, CAST(unnest(generate_series(min(metric_date)::TIMESTAMP, max(metric_date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM tenant_metrics_daily GROUP BY tenant_id",
    "inline_values": "SELECT tenant_id, CASE status WHEN 'authorized' THEN 'open' WHEN 'failed' THEN 'failed' ELSE 'settled' END AS kind, count(*) AS n FROM processed_payments WHERE status IN ('authorized', 'captured', 'refunded', 'failed') GROUP BY 1, 2",
    "backfill_daily": f"WITH {_SPINE} SELECT * FROM full_days",
    "daily_full_outer": f"WITH {_LONG} SELECT {_BYDAY} FROM byday",
    "hourly_rollup": f"WITH {_DELTAS} SELECT tenant_id, date_trunc('hour', event_timestamp) AS metric_hour, {_DELTA_SUMS} FROM d GROUP BY 1, 2",
    "incremental_daily": f"WITH {_DELTAS} SELECT tenant_id, event_timestamp::DATE AS metric_date, {_DELTA_SUMS} FROM d GROUP BY 1, 2",
    "slice_recompute": f"""WITH {_SPINE}, {_DAYS}, sl AS (SELECT tenant_id, metric_date, net_revenue, order_count, units_sold, payment_success_count, payment_failure_count, active_users FROM dm WHERE NOT (tenant_id = 'larkspur-goods' AND metric_date BETWEEN DATE '2018-01-08' AND DATE '2018-01-19')
      UNION ALL SELECT tenant_id, metric_date, net_revenue, order_count, units_sold, payment_success_count, payment_failure_count, active_users FROM full_days WHERE tenant_id = 'larkspur-goods' AND metric_date >= DATE '2018-01-08' AND metric_date < DATE '2018-01-20') SELECT * FROM sl""",
    "active_tenant_view": f"WITH {_DAYS} SELECT dm.tenant_id, c.tenant_name, c.plan, metric_date, net_revenue, order_count, active_users, churn_signal_count, payment_success_count, payment_failure_count, events_processed FROM dm, tenant_config c WHERE c.tenant_id = dm.tenant_id AND c.is_active = TRUE",
    "fct_tenant_daily": f"WITH {_FCT} SELECT * FROM fct",
    "fct_product_performance": f"WITH {_ORDERS}, {_PRODUCT} SELECT tenant_id, pid AS product_id, coalesce(pname, pid) AS product_name, coalesce(cat, 'unknown') AS category, event_timestamp::DATE AS order_date, count(*) AS order_count, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(net_revenue) AS DECIMAL(18,2)) AS net_revenue, CASE WHEN sum(quantity) <> 0 THEN CAST(sum(net_revenue) AS DECIMAL(18,2))::DOUBLE / CAST(sum(quantity) AS BIGINT) END AS revenue_per_unit FROM named GROUP BY 1, 2, 3, 4, 5",
    "metric_revenue": f"WITH {_DAYS}, mine AS (SELECT *, row_number() OVER (ORDER BY metric_date DESC) AS k FROM dm WHERE tenant_id = 'larkspur-goods') SELECT metric_date, gross_revenue, net_revenue, order_count, units_sold, CASE WHEN order_count <> 0 THEN net_revenue::DOUBLE / order_count END AS average_order_value FROM mine WHERE k BETWEEN 6 AND 35",
    "metric_window": f"WITH {_DAYS} SELECT tenant_id, metric_date, gross_revenue, net_revenue, order_count FROM dm WHERE metric_date >= DATE '2018-01-05' AND metric_date < DATE '2018-01-26'",
    "metric_customers": f"WITH {_DAYS} SELECT m.tenant_id, m.metric_date, m.new_users, m.active_users, (SELECT CAST(sum(x.new_users) AS BIGINT) FROM dm x WHERE x.tenant_id = m.tenant_id AND x.metric_date <= m.metric_date) AS cumulative_customers, m.churn_signal_count FROM dm m",
    "metric_churn": f"WITH {_DAYS} SELECT tenant_id, metric_date, churn_signal_count, active_users, CASE WHEN active_users <> 0 THEN churn_signal_count::DOUBLE / active_users END AS churn_signal_rate FROM dm",
    "metric_retention": f"WITH {_DAYS} SELECT tenant_id, metric_date, active_users, churn_signal_count, CASE WHEN coalesce(active_users, 0) = 0 OR churn_signal_count IS NULL THEN 1.0::DOUBLE WHEN churn_signal_count > active_users THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - churn_signal_count::DOUBLE / active_users END AS estimated_retention_rate FROM dm",
    "metric_marketing_roi": f"WITH {_ORDERS} SELECT tenant_id, CASE WHEN marketing_campaign_id IS NULL THEN 'unattributed' ELSE marketing_campaign_id END AS marketing_campaign_id, count(*) AS orders, CAST(sum(net_revenue) AS DECIMAL(18,2)) AS attributed_revenue, CAST(sum(net_revenue) AS DECIMAL(18,2))::DOUBLE / count(*) AS revenue_per_order FROM orders_now GROUP BY 1, 2",
    "metric_product_performance": f"WITH {_ORDERS}, {_PRODUCT} SELECT tenant_id, pid AS product_id, coalesce(any_value(pname), pid) AS product_name, coalesce(any_value(cat), 'unknown') AS category, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(net_revenue) AS DECIMAL(18,2)) AS net_revenue, CASE WHEN sum(quantity) <> 0 THEN CAST(sum(net_revenue) AS DECIMAL(18,2))::DOUBLE / CAST(sum(quantity) AS BIGINT) END AS revenue_per_unit FROM named GROUP BY tenant_id, pid",
    "metric_payment_success": f"WITH {_DAYS} SELECT tenant_id, metric_date, payment_success_count, payment_failure_count, payment_success_count + payment_failure_count AS payment_attempt_count, CASE WHEN payment_success_count + payment_failure_count > 0 THEN payment_success_count::DOUBLE / (payment_success_count + payment_failure_count) END AS payment_success_rate FROM dm",
    "metric_event_throughput": f"WITH {_DAYS} SELECT m.tenant_id, m.metric_date, m.events_processed, (SELECT count(*) FROM raw_events r WHERE lower(trim(r.tenant_id)) = m.tenant_id AND r.event_timestamp::DATE = m.metric_date) AS raw_event_count, m.order_count, m.payment_success_count, m.payment_failure_count, m.updated_at FROM dm m",
    "metric_health_inputs": f"WITH {_DAYS}, w AS (SELECT tenant_id, list(dm ORDER BY metric_date DESC)[:7] AS xs FROM dm GROUP BY 1), x AS (SELECT tenant_id, unnest(xs) AS r FROM w) SELECT tenant_id, CAST(sum(r.events_processed) AS BIGINT) AS events_processed, CAST(sum(r.payment_success_count) AS BIGINT) AS payment_successes, CAST(sum(r.payment_failure_count) AS BIGINT) AS payment_failures, count(*) AS n_days, CAST(sum(r.churn_signal_count::BIGINT * 1000000 // r.active_users) FILTER (r.active_users > 0) AS BIGINT) AS churn_ppm_sum, count(*) FILTER (r.active_users > 0) AS n_rated FROM x GROUP BY 1",
    "alerts_top5": f"WITH {_SYS} SELECT tenant_id, event_id, p ->> 'service_name' AS service_name, p ->> 'status' AS status, event_timestamp FROM h WHERE event_type = 'system.alert' QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY event_timestamp DESC, event_id) <= 5",
    "alerts_recent": f"WITH {_SYS}, a AS (SELECT *, row_number() OVER (ORDER BY event_timestamp DESC, event_id) AS k FROM h WHERE event_type = 'system.alert' AND tenant_id = 'larkspur-goods') SELECT event_id, p ->> 'service_name' AS service_name, p ->> 'status' AS status, p ->> 'message' AS message, event_timestamp FROM a WHERE k > 2 AND k <= 22",
    "latest_service_health": f"WITH {_SYS} SELECT DISTINCT ON (tenant_id, p ->> 'service_name') tenant_id, p ->> 'service_name' AS service_name, p ->> 'status' AS status, try_cast(p ->> 'latency_ms' AS DOUBLE) AS latency_ms, coalesce(try_cast(p ->> 'error_count' AS BIGINT), 0) AS error_count, try_cast(p ->> 'throughput_per_minute' AS DOUBLE) AS throughput_per_minute, try_cast(p ->> 'kafka_lag' AS BIGINT) AS kafka_lag, try_cast(p ->> 'cache_hit_rate' AS DOUBLE) AS cache_hit_rate, event_timestamp FROM h ORDER BY tenant_id, p ->> 'service_name', event_timestamp DESC, event_id DESC",
    "system_status": f"WITH {_SYS} SELECT p ->> 'service_name' AS service_name, p ->> 'status' AS status, count(*) AS n, count(DISTINCT tenant_id) AS n_tenants, max(event_timestamp) AS latest FROM h GROUP BY 1, 2",
    "latest_run_per_pipeline": f"WITH {_RUNS} SELECT DISTINCT ON (pipeline) pipeline, run_id, status, records_processed, finished_at FROM runs ORDER BY pipeline, finished_at DESC, run_id DESC",
    "ops_pipelines": f"WITH {_RUNS} SELECT 'landing:' || pipeline AS pipeline_name, run_id, status, records_processed, started_at, finished_at FROM runs QUALIFY row_number() OVER (ORDER BY started_at DESC, run_id) <= 10",
    "ops_recent": f"WITH {_ORDERS} SELECT tenant_id, order_id, event_id, status, updated_at FROM orders_now QUALIFY row_number() OVER (ORDER BY updated_at DESC, tenant_id, order_id) <= 50",
    "ops_incidents": f"WITH {_SYS} SELECT tenant_id, event_id, p ->> 'service_name' AS service_name, p ->> 'status' AS status, p ->> 'message' AS message, event_timestamp FROM h WHERE event_type = 'system.alert' QUALIFY row_number() OVER (ORDER BY event_timestamp DESC, event_id, tenant_id) <= 10",
    "ops_inbox": "SELECT 'rejected' AS status, count(*) AS event_count, max(ingested_at) AS latest_received FROM raw_events WHERE coalesce(trim(tenant_id), '') = '' HAVING count(*) > 0 UNION ALL SELECT CASE WHEN event_timestamp IS NULL THEN 'pending' ELSE 'processed' END, count(*), max(ingested_at) FROM raw_events WHERE coalesce(trim(tenant_id), '') <> '' GROUP BY 1",
    "status_counts": f"WITH {_PAYMENTS} SELECT status, count(*) AS event_count, max(updated_at) AS latest_update FROM payments_now GROUP BY 1",
    "dashboard": f"WITH {_DAYS} SELECT c.plan, c.region, count(DISTINCT c.tenant_id) AS tenants, CAST(sum(net_revenue) AS DECIMAL(18,2)) AS net_revenue, CAST(sum(order_count) AS BIGINT) AS orders FROM tenant_config c JOIN dm USING (tenant_id) GROUP BY 1, 2",
    "dashboard_metrics": f"WITH {_DAYS} SELECT m.tenant_id, m.metric_date, m.net_revenue, m.order_count, m.active_users, m.payment_success_count, m.payment_failure_count, m.events_processed FROM dm m WHERE (SELECT count(*) FROM dm x WHERE x.tenant_id = m.tenant_id AND x.metric_date > m.metric_date) < 14",
    "products_list": "WITH x AS (SELECT *, row_number() OVER (ORDER BY product_id) AS k FROM tenant_products WHERE tenant_id = 'larkspur-goods') SELECT product_id, sku, name, category, price, inventory_on_hand, active FROM x WHERE k BETWEEN 3 AND 12",
    "users_list": f"WITH {_USR}, x AS (SELECT user_id, min(event_timestamp) AS first_seen, count(*) AS n_events, row_number() OVER (ORDER BY user_id) AS k FROM s WHERE tenant_id = 'larkspur-goods' GROUP BY 1) SELECT user_id, first_seen, n_events FROM x WHERE k BETWEEN 4 AND 13",
    "tenant_row_counts": "SELECT tenant_id, src, count(*) AS n FROM (SELECT tenant_id, 'orders' AS src FROM processed_orders UNION ALL SELECT tenant_id, 'payments' FROM processed_payments UNION ALL SELECT tenant_id, 'products' FROM tenant_products UNION ALL SELECT tenant_id, 'daily' FROM tenant_metrics_daily) GROUP BY 1, 2",
    "serving_freshness": "SELECT src, max(u) AS latest, (epoch_us(TIMESTAMP '2018-02-10') - epoch_us(max(u))) / 1000000.0::DOUBLE AS staleness_seconds FROM (SELECT 'orders' AS src, updated_at AS u FROM processed_orders UNION ALL SELECT 'payments', updated_at FROM processed_payments UNION ALL SELECT 'daily', updated_at FROM tenant_metrics_daily) GROUP BY 1",
    "recon_revenue": f"WITH {_RECON_R} SELECT * FROM rv",
    "recon_payment": f"WITH {_RECON_R} SELECT * FROM pv",
    "recon_activity": f"WITH {_RECON_R} SELECT * FROM av",
    "recon_run_all": f"WITH {_RECON_R}, c AS (SELECT 'r' AS k, tenant_id, status FROM rv UNION ALL SELECT 'p', tenant_id, status FROM pv UNION ALL SELECT 'a', tenant_id, status FROM av) SELECT tenant_id, count(*) AS checks_run, count(*) FILTER (k = 'r' AND status = 'failed') AS revenue_failed, count(*) FILTER (k = 'p' AND status = 'failed') AS payment_failed, count(*) FILTER (k = 'a' AND status = 'failed') AS activity_failed, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'passed' END AS status FROM c GROUP BY 1",
    "ops_reconciliation": f"WITH {_RECON_R} SELECT tenant_id, metric_date, status, revenue_delta, order_count_delta, units_sold_delta FROM rv WHERE tenant_id = 'larkspur-goods' QUALIFY row_number() OVER (ORDER BY metric_date DESC) <= 10",
    "recon_recent": f"WITH {_RECON_R}, c AS (SELECT metric_date, status FROM rv UNION ALL SELECT metric_date, status FROM pv UNION ALL SELECT metric_date, status FROM av) SELECT coalesce(sum((status <> 'passed')::INT), 0)::BIGINT AS failures, count(*) AS total FROM c WHERE metric_date = DATE '2018-01-27'",
    "ops_lineage": "SELECT tenant_id, event_id, causation_id, event_timestamp FROM (SELECT DISTINCT tenant_id, event_id, causation_id, event_timestamp FROM raw_events WHERE causation_id IS NOT NULL) QUALIFY row_number() OVER (ORDER BY event_timestamp DESC NULLS LAST, event_id, tenant_id) <= 10",
    "lineage_edges": "WITH e AS (SELECT DISTINCT lower(trim(tenant_id)) AS t, event_id, event_type FROM raw_events WHERE trim(tenant_id) <> '') SELECT c.event_type AS cause_type, r.event_type, count(*) AS n FROM (SELECT DISTINCT lower(trim(tenant_id)) AS t, event_id, event_type, causation_id FROM raw_events WHERE causation_id IS NOT NULL) r, e c WHERE c.t = r.t AND c.event_id = r.causation_id GROUP BY 1, 2",
    "recon_two_path": f"""WITH {_PAYMENTS}, {_DAYS}, mart AS (SELECT tenant_id, event_timestamp::DATE AS metric_date, count(*) FILTER (status IN ('authorized', 'captured')) AS ok, count(*) FILTER (status = 'failed') AS bad FROM payments_now GROUP BY 1, 2),
      keys AS (SELECT tenant_id, metric_date FROM mart UNION SELECT tenant_id, metric_date FROM dm),
      v AS (SELECT k.*, 'payment_success_count' AS metric_name, CAST(dm.payment_success_count AS BIGINT) AS s, ok AS m FROM keys k LEFT JOIN dm USING (tenant_id, metric_date) LEFT JOIN mart USING (tenant_id, metric_date)
        UNION ALL SELECT k.*, 'payment_failure_count', CAST(dm.payment_failure_count AS BIGINT), bad FROM keys k LEFT JOIN dm USING (tenant_id, metric_date) LEFT JOIN mart USING (tenant_id, metric_date))
      SELECT tenant_id, metric_date, metric_name, s AS serving_value, m AS mart_value, CASE WHEN s > m THEN s - m WHEN m > s THEN m - s ELSE 0 END AS absolute_difference, CASE WHEN s = m THEN 'MATCH' WHEN s <> m THEN 'FAIL' WHEN s IS NULL THEN 'MISSING_IN_SERVING' ELSE 'MISSING_IN_MART' END AS status FROM v""",
    "reconciliation_summary": f"WITH {_RECON_R} {_SUMMARY} GROUP BY 1, 2",
    "reconciliation_summary_tenant": f"WITH {_RECON_R} {_SUMMARY} WHERE tenant_id = 'larkspur-goods' GROUP BY 1, 2",
    "dq_duplicates": "SELECT tenant_id, count(*) - count(DISTINCT event_id) AS n_duplicates FROM processed_orders GROUP BY 1 HAVING count(*) > count(DISTINCT event_id)",
    "dq_freshness": "SELECT lower(trim(tenant_id)) AS tenant_id, (epoch_us(TIMESTAMP '2018-02-10') - epoch_us(max(event_timestamp))) / 60000000.0::DOUBLE AS minutes, CASE WHEN max(event_timestamp) IS NULL THEN 'warning' WHEN max(event_timestamp) >= TIMESTAMP '2018-01-27' THEN 'passed' ELSE 'failed' END AS status FROM raw_events WHERE trim(tenant_id) <> '' GROUP BY 1",
    "dq_violations": """WITH t AS (SELECT DISTINCT lower(trim(tenant_id)) AS tenant_id FROM raw_events WHERE trim(tenant_id) <> '' UNION SELECT tenant_id FROM processed_orders UNION SELECT tenant_id FROM processed_payments UNION SELECT tenant_id FROM tenant_metrics_daily)
      SELECT tenant_id, (SELECT count(*) FROM raw_events r WHERE lower(trim(r.tenant_id)) = t.tenant_id AND (event_id IS NULL OR event_type IS NULL OR payload IS NULL)) AS n_missing_fields,
      (SELECT count(*) FROM processed_orders o WHERE o.tenant_id = t.tenant_id AND (gross_revenue < 0 OR net_revenue < 0 OR unit_price < 0 OR quantity < 1)) AS n_bad_orders,
      (SELECT count(*) FROM processed_payments p WHERE p.tenant_id = t.tenant_id AND status <> 'authorized' AND status <> 'captured' AND status <> 'failed') AS n_bad_payment_status,
      (SELECT count(*) FROM tenant_metrics_daily m WHERE m.tenant_id = t.tenant_id AND least(gross_revenue, net_revenue, order_count, payment_success_count, payment_failure_count) < 0) AS n_bad_metrics FROM t""",
    "dq_orphan_products": "SELECT o.tenant_id, count(*) AS n FROM processed_orders o WHERE NOT EXISTS (SELECT 1 FROM tenant_products t WHERE t.tenant_id = o.tenant_id AND t.product_id = lower(trim(o.product_id))) GROUP BY 1",
    "dq_volume_anomaly": """WITH d AS (SELECT lower(trim(tenant_id)) AS tenant_id, event_timestamp::DATE AS day FROM raw_events WHERE trim(tenant_id) <> '' AND event_timestamp::DATE BETWEEN DATE '2018-01-12' AND DATE '2018-01-20'),
      v AS (SELECT tenant_id, count(*) FILTER (day = DATE '2018-01-20') AS today_count, nullif(count(*) FILTER (day < DATE '2018-01-20'), 0) AS before_total, count(DISTINCT day) FILTER (day < DATE '2018-01-20') AS before_days FROM d GROUP BY 1)
      SELECT tenant_id, today_count, before_total, before_days, CASE WHEN today_count / (before_total / before_days) >= 0.4 AND today_count / (before_total / before_days) <= 2.5 THEN 'passed' ELSE 'warning' END AS status FROM v""",
    "orders_upsert": f"WITH {_ORDERS} SELECT * FROM orders_now",
    "payments_upsert": f"WITH {_PAYMENTS} SELECT * FROM payments_now",
    "sessions_dedup": f"WITH {_USR} SELECT tenant_id, event_id, ingested_at, landing_file FROM s",
    "users_upsert": f"WITH {_USR} SELECT tenant_id, user_id, min(event_timestamp) AS first_seen, CAST(list(p ->> 'page' ORDER BY event_timestamp, event_id)[1] AS VARCHAR) AS first_page, max(event_timestamp) AS last_seen, list(p ->> 'plan' ORDER BY event_timestamp, event_id)[-1] AS plan, list(p ->> 'action' ORDER BY event_timestamp, event_id)[-1] AS action FROM s GROUP BY 1, 2",
    "pipeline_watermarks": "SELECT string_split(landing_file, '/')[2] AS pipeline, max(ingested_at) AS position FROM raw_events GROUP BY 1",
    "outbox_lease": """WITH r AS (SELECT change_no, ingested_at, change_no % 4 AS tries, row_number() OVER (ORDER BY ingested_at, change_no) AS k FROM product_changes),
      x AS (SELECT *, k <= 100 AND ingested_at <= TIMESTAMP '2018-01-10' AS got FROM r)
      SELECT change_no AS outbox_id, CASE WHEN NOT got THEN 'pending' WHEN change_no % 2 = 0 THEN 'published' WHEN tries + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CAST(tries + got::INT AS INT) AS attempts,
      CASE WHEN got AND change_no % 2 = 1 THEN TIMESTAMP '2018-01-10 00:01:00' ELSE ingested_at END AS available_at, CASE WHEN got AND change_no % 2 = 1 THEN 'unreachable' END AS error_message, CASE WHEN got AND change_no % 2 = 0 THEN TIMESTAMP '2018-01-10' END AS published_at FROM x""",
    "retention": "SELECT event_id, tenant_id, event_timestamp, ingested_at FROM raw_events WHERE NOT ingested_at < TIMESTAMP '2018-01-20'",
    "retention_plan": _KEPT,
    "erasure": f"WITH {_USR} SELECT tenant_id, event_id, user_id, p ->> 'action' AS action, p ->> 'page' AS page, p ->> 'referrer' AS referrer, p ->> 'marketing_campaign_id' AS marketing_campaign_id FROM s WHERE tenant_id <> 'larkspur-goods' OR user_id <> 'usr-0000005' UNION ALL SELECT tenant_id, event_id, 'erased:' || sha256('usr-0000005'), p ->> 'action', NULL, NULL, NULL FROM s WHERE tenant_id = 'larkspur-goods' AND user_id = 'usr-0000005'",
    "erasure_payloads": """WITH r AS (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS p, coalesce(lower(trim(tenant_id)) = 'larkspur-goods' AND contains(payload, 'usr-0000005'), FALSE) AS mine FROM raw_events)
      SELECT event_id, landing_file, ingested_at, CAST(CASE WHEN mine THEN len(list_filter(json_keys(p), lambda k: k NOT IN ('page', 'referrer', 'email'))) ELSE len(json_keys(p)) END AS INT) AS n_keys, CASE WHEN NOT mine THEN p ->> 'page' END AS page, p ->> 'user_id' AS user_id FROM r""",
    "payment_ts_clamp": "SELECT tenant_id, event_id, payment_id, CASE WHEN (event_timestamp + INTERVAL 2 MINUTE) > event_timestamp::DATE + INTERVAL '23 hours 59 minutes 59 seconds' THEN event_timestamp::DATE + INTERVAL '23 hours 59 minutes 59 seconds' ELSE event_timestamp + INTERVAL 2 MINUTE END AS clamped_at FROM processed_payments",
    "nth_product": "WITH l AS (SELECT tenant_id, list(product_id ORDER BY product_id) AS xs FROM tenant_products GROUP BY 1) SELECT tenant_id, CAST(len(xs) AS BIGINT) AS n, xs[1 + len(xs) % 3] AS product_id FROM l WHERE len(xs) >= 1 + len(xs) % 3",
    "schema_drift_columns": "SELECT domain_name AS domain, field_name, CASE WHEN bool_or(payload_version = 2) THEN 'only_new' ELSE 'only_old' END AS side FROM payload_fields WHERE payload_version IN (1, 2) GROUP BY 1, 2 HAVING count(DISTINCT payload_version) = 1",
    "schema_versions": "WITH v AS (SELECT domain_name AS subject, payload_version, sha256(string_agg(DISTINCT field_name || ':' || json_type || ':' || is_required::VARCHAR, ',' ORDER BY field_name || ':' || json_type || ':' || is_required::VARCHAR)) AS fingerprint, count(DISTINCT field_name || ':' || json_type || ':' || is_required::VARCHAR) AS n_fields FROM payload_fields GROUP BY 1, 2), f AS (SELECT subject, fingerprint, min(payload_version) AS v0, max(n_fields) AS n_fields FROM v GROUP BY 1, 2) SELECT subject, CAST(dense_rank() OVER (PARTITION BY subject ORDER BY v0) AS INT) AS version, fingerprint, n_fields, v0 = max(v0) OVER (PARTITION BY subject) AS is_latest FROM f",
    "schema_breaks": """WITH a AS (SELECT * FROM payload_fields), v AS (SELECT DISTINCT domain_name AS dn, payload_version AS v FROM a), n AS (SELECT x.dn, x.v, (SELECT max(y.v) FROM v y WHERE y.dn = x.dn AND y.v < x.v) AS b FROM v x)
      SELECT dn AS subject, v AS version, o.field_name, CASE WHEN c.field_name IS NULL THEN 'removed' WHEN c.json_type <> o.json_type THEN 'type_changed' WHEN c.is_required AND NOT o.is_required THEN 'newly_required' ELSE 'no_longer_required' END AS problem
      FROM n JOIN a o ON o.domain_name = dn AND o.payload_version = b LEFT JOIN a c ON c.domain_name = dn AND c.payload_version = v AND c.field_name = o.field_name WHERE c.field_name IS NULL OR c.json_type <> o.json_type OR c.is_required <> o.is_required
      UNION ALL SELECT dn, v, c.field_name, 'newly_required' FROM n JOIN a c ON c.domain_name = dn AND c.payload_version = v AND c.is_required WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a o WHERE o.domain_name = dn AND o.payload_version = b AND o.field_name = c.field_name)""",
    "semantic_metrics": f"WITH {_DAYS} {_GRAINS}",
    "data_tests": f"WITH {_FCT}, t AS ({_TESTS}) SELECT *, CASE n_failed WHEN 0 THEN 'passed' ELSE 'failed' END AS status FROM t",
    "metric_contract": f"WITH {_DAYS}, rated AS (SELECT *, CASE WHEN order_count <> 0 THEN net_revenue::DOUBLE / order_count END AS average_order_value, CASE WHEN coalesce(active_users, 0) = 0 THEN 1 ELSE greatest(0, 1 - churn_signal_count / active_users) END AS estimated_retention_rate FROM dm) {_CONTRACT}",
    "tenants_in_both": "SELECT DISTINCT m.tenant_id FROM tenant_metrics_daily m WHERE EXISTS (SELECT 1 FROM tenant_config c WHERE c.tenant_id = m.tenant_id)",
    "lineage_orphans": "WITH e AS (SELECT DISTINCT lower(trim(tenant_id)) AS tenant_id, event_id, causation_id FROM raw_events WHERE trim(tenant_id) <> '') SELECT tenant_id, causation_id, count(*) AS n FROM e r WHERE causation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e x WHERE x.tenant_id = r.tenant_id AND x.event_id = r.causation_id) GROUP BY 1, 2",
    "lateral_series": "WITH RECURSIVE u AS (SELECT tenant_id, quantity, 1 AS unit_no FROM processed_orders WHERE quantity > 0 UNION ALL SELECT tenant_id, quantity, unit_no + 1 FROM u WHERE unit_no < quantity) SELECT tenant_id, unit_no, count(*) AS n FROM u GROUP BY 1, 2",
    "latency_percentiles": f"WITH {_SYS}, l AS (SELECT p ->> 'service_name' AS service_name, list_sort(list(try_cast(p ->> 'latency_ms' AS DOUBLE))) AS xs FROM h WHERE try_cast(p ->> 'latency_ms' AS DOUBLE) IS NOT NULL GROUP BY 1) SELECT service_name, "
    + ", ".join(f"xs[CAST(round_even((len(xs) - 1) * {p} / 100.0, 0) AS INT) + 1] AS p{p}" for p in (50, 95, 99))
    + " FROM l",
}
