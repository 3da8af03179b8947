"""Serving, mart, reconciliation and quality queries as Spark SQL over tables and typed views.

A query names its tables and views in braces; they are DataFrames, so scans are pruned
and filters pushed as for any other plan. Money is decimal and ratios are plain
doubles, so that results don't depend on the order of addition. The SQL each is held
against is written on its own in :mod:`eventloom.plans.serving_checks`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.jsontext import object_map, without_keys
from eventloom.functions.once import once
from eventloom.governance import quality, registry, semantic
from eventloom.operators import outbox, sessions, skew, upserts
from eventloom.plans import views
from eventloom.sources.tables import table
from eventloom.tenancy import key_of, matches

#: Moments at which a query that depends on the present is asked.
AS_OF = "timestamp_ntz'2018-02-10 00:00:00'"
TODAY = "date'2018-01-20'"
TENANT = "larkspur-goods"
#: Whose data an erasure request names.
SUBJECT = "usr-0000005"

# daily facts recomputed from orders, payments and user activity
_FACTS = """od AS (SELECT tenant_id, to_date(event_timestamp) AS d, sum(gross_revenue) AS gross_revenue, sum(net_revenue) AS net_revenue, count(*) AS order_count, sum(quantity) AS units_sold,
    sum(if(marketing_campaign_id IS NOT NULL, net_revenue, 0)) AS attributed_revenue FROM {orders} o GROUP BY ALL),
  pd AS (SELECT tenant_id, to_date(event_timestamp) AS d, count_if(status IN ('authorized', 'captured')) AS payment_success_count, count_if(status = 'failed') AS payment_failure_count, count(*) AS n FROM {payments} p GROUP BY ALL),
  ud AS (SELECT tenant_id, to_date(event_timestamp) AS d, count(DISTINCT CASE WHEN event_type = 'user.signed_up' OR action = 'signed_up' THEN user_id END) AS new_users, count(DISTINCT user_id) AS active_users,
    count_if(event_type = 'user.churn_signal' OR action IN ('churn_signal', 'cancel_intent')) AS churn_signal_count, count(*) AS n FROM {sessions} s GROUP BY ALL)"""
_DAY_ROW = """{t}.tenant_id, {t}.d AS metric_date, cast(coalesce(gross_revenue, 0) AS decimal(18,2)) AS gross_revenue, cast(coalesce(net_revenue, 0) AS decimal(18,2)) AS net_revenue, coalesce(order_count, 0) AS order_count,
    coalesce(units_sold, 0) AS units_sold, coalesce(new_users, 0) AS new_users, coalesce(active_users, 0) AS active_users, coalesce(churn_signal_count, 0) AS churn_signal_count, coalesce(payment_success_count, 0) AS payment_success_count,
    coalesce(payment_failure_count, 0) AS payment_failure_count, cast(coalesce(attributed_revenue, 0) AS decimal(18,2)) AS attributed_revenue, coalesce(order_count, 0) + coalesce(pd.n, 0) + coalesce(ud.n, 0) AS events_processed"""
_SUMS = ", ".join(f"cast(sum({m}) AS decimal(18,2)) AS {m}" if m.endswith("revenue") else f"sum({m}) AS {m}" for m in views.MEASURES)
_MISS = "CASE WHEN {s} IS NULL THEN 'MISSING_IN_SERVING' WHEN {m} IS NULL THEN 'MISSING_IN_MART' WHEN {s} = {m} THEN 'MATCH' ELSE 'FAIL' END"

SQL = {
    "tenant_dim": "SELECT tenant_id, tenant_name, plan, region, is_active, config, created_at, updated_at FROM {tenant_config}",
    "order_revenue": "SELECT tenant_id, event_id, quantity, unit_price, discount_amount, gross_revenue, net_revenue FROM {order_events} e",
    "batch_daily_revenue": """SELECT tenant_id, to_date(event_timestamp) AS metric_date, cast(sum(gross_revenue) AS decimal(18,2)) AS gross_revenue, cast(sum(net_revenue) AS decimal(18,2)) AS net_revenue, count(*) AS order_count,
      sum(quantity) AS units_sold, cast(sum(if(marketing_campaign_id IS NOT NULL, net_revenue, 0)) AS decimal(18,2)) AS attributed_revenue, count(*) AS events_processed,
      0 AS new_users, 0 AS active_users, 0 AS churn_signal_count, 0 AS payment_success_count, 0 AS payment_failure_count FROM {order_events} e GROUP BY tenant_id, to_date(event_timestamp)""",
    "stg_orders": "SELECT tenant_id, order_id, customer_id, product_id, quantity, unit_price, discount_amount, gross_revenue, net_revenue, currency, status, channel, marketing_campaign_id, region, event_timestamp, to_date(event_timestamp) AS order_date FROM {processed_orders}",
    "stg_payments": "SELECT tenant_id, payment_id, order_id, customer_id, amount, currency, status, payment_method, failure_code, risk_score, event_timestamp, to_date(event_timestamp) AS payment_date FROM {processed_payments}",
    "stg_sessions": "SELECT tenant_id, user_id, session_id, action, page, referrer, duration_seconds, plan, marketing_campaign_id, event_timestamp, to_date(event_timestamp) AS activity_date FROM {sessions} s",
    "processed_orders": "SELECT tenant_id, event_id, order_id, customer_id, product_id, quantity, unit_price, discount_amount, gross_revenue, net_revenue, currency, status, channel, marketing_campaign_id, region, event_timestamp FROM {order_events} e",
    "processed_payments": "SELECT tenant_id, event_id, payment_id, order_id, customer_id, amount, currency, status, payment_method, failure_code, risk_score, event_timestamp FROM {payment_events} e",
    "processed_sessions": "SELECT tenant_id, event_id, user_id, session_id, action, page, referrer, duration_seconds, plan, marketing_campaign_id, event_timestamp FROM {sessions} s",
    "product_rows": "SELECT tenant_id, event_id, product_id, sku, name, category, price, inventory_delta, active, event_timestamp FROM {product_events} e",
    "health_rows": "SELECT tenant_id, event_id, service_name, status, latency_ms, error_count, throughput_per_minute, kafka_lag, cache_hit_rate, message, event_timestamp FROM {health} h",
    "session_summary": """SELECT tenant_id, user_id, session_id, min(event_timestamp) AS session_start_at, max(event_timestamp) AS session_end_at, count(*) AS event_count, sum(duration_seconds) AS engaged_seconds,
      array_join(sort_array(collect_set(page)), '|') AS pages_seen FROM {sessions} s GROUP BY tenant_id, user_id, session_id""",
    "date_spine": "SELECT tenant_id, explode(sequence(min(metric_date), max(metric_date), interval 1 day)) AS day FROM {tenant_metrics_daily} GROUP BY tenant_id",
    "inline_values": "SELECT p.tenant_id, k.kind, count(*) AS n FROM {processed_payments} p JOIN (VALUES ('authorized', 'open'), ('captured', 'settled'), ('refunded', 'settled'), ('failed', 'failed')) AS k(status, kind) ON k.status = p.status GROUP BY p.tenant_id, k.kind",
    "backfill_daily": f"""WITH {_FACTS}, spans AS (SELECT tenant_id, min(d) AS a, max(d) AS b FROM (SELECT tenant_id, d FROM od UNION ALL SELECT tenant_id, d FROM pd UNION ALL SELECT tenant_id, d FROM ud) GROUP BY tenant_id),
      spine AS (SELECT tenant_id, explode(sequence(a, b, interval 1 day)) AS d FROM spans)
      SELECT {_DAY_ROW.replace("{t}", "spine")} FROM spine LEFT JOIN od USING (tenant_id, d) LEFT JOIN pd USING (tenant_id, d) LEFT JOIN ud USING (tenant_id, d)""",
    "daily_full_outer": f"WITH {_FACTS}, every AS (SELECT * FROM od FULL OUTER JOIN (SELECT tenant_id, d, payment_success_count, payment_failure_count, n AS pn FROM pd) USING (tenant_id, d) FULL OUTER JOIN (SELECT tenant_id, d, new_users, active_users, churn_signal_count, n AS un FROM ud) USING (tenant_id, d)) SELECT "
    + _DAY_ROW.replace("{t}", "every").replace("pd.n", "pn").replace("ud.n", "un")
    + " FROM every",
    "hourly_rollup": f"SELECT tenant_id, cast(date_trunc('hour', event_timestamp) AS timestamp_ntz) AS metric_hour, {_SUMS} FROM {{deltas}} e GROUP BY tenant_id, date_trunc('hour', event_timestamp)",
    "active_tenant_view": "SELECT m.tenant_id, tenant_name, plan, metric_date, net_revenue, order_count, active_users, churn_signal_count, payment_success_count, payment_failure_count, events_processed FROM {daily} m JOIN {tenant_config} c ON c.tenant_id = m.tenant_id WHERE c.is_active",
    "fct_tenant_daily": """WITH pays AS (SELECT tenant_id, to_date(event_timestamp) AS d, count_if(status IN ('captured', 'authorized')) AS ok, count_if(status = 'failed') AS bad FROM {payments} p GROUP BY ALL)
      SELECT m.tenant_id, m.metric_date, gross_revenue, net_revenue, order_count, units_sold, new_users, active_users, churn_signal_count, payment_success_count, payment_failure_count, coalesce(ok, 0) AS observed_successful_payments,
      coalesce(bad, 0) AS observed_failed_payments, marketing_attributed_revenue, cast(net_revenue AS double) / nullif(order_count, 0) AS average_order_value, payment_failure_count / nullif(payment_success_count + payment_failure_count, 0) AS payment_failure_rate,
      churn_signal_count / nullif(active_users, 0) AS churn_signal_rate, events_processed, updated_at FROM {daily} m LEFT JOIN pays ON pays.tenant_id = m.tenant_id AND pays.d = m.metric_date""",
    "fct_product_performance": """SELECT o.tenant_id, lower(trim(o.product_id)) AS product_id, coalesce(p.name, lower(trim(o.product_id))) AS product_name, coalesce(p.category, 'unknown') AS category, to_date(o.event_timestamp) AS order_date, count(*) AS order_count,
      sum(quantity) AS units_sold, cast(sum(net_revenue) AS decimal(18,2)) AS net_revenue, cast(sum(net_revenue) AS double) / nullif(sum(quantity), 0) AS revenue_per_unit
      FROM {orders} o LEFT JOIN {tenant_products} p ON p.tenant_id = o.tenant_id AND p.product_id = lower(trim(o.product_id)) GROUP BY ALL""",
    "metric_revenue": f"SELECT metric_date, gross_revenue, net_revenue, order_count, units_sold, cast(net_revenue AS double) / nullif(order_count, 0) AS average_order_value FROM {{daily}} m WHERE tenant_id = '{TENANT}' ORDER BY metric_date DESC LIMIT 30 OFFSET 5",
    "metric_window": f"SELECT tenant_id, metric_date, gross_revenue, net_revenue, order_count FROM {{daily}} m WHERE {{window}}",
    "metric_customers": "SELECT tenant_id, metric_date, new_users, active_users, sum(new_users) OVER (PARTITION BY tenant_id ORDER BY metric_date) AS cumulative_customers, churn_signal_count FROM {daily} m",
    "metric_churn": "SELECT tenant_id, metric_date, churn_signal_count, active_users, churn_signal_count / nullif(active_users, 0) AS churn_signal_rate FROM {daily} m",
    "metric_retention": "SELECT tenant_id, metric_date, active_users, churn_signal_count, greatest(0D, 1D - coalesce(churn_signal_count / nullif(active_users, 0), 0D)) AS estimated_retention_rate FROM {daily} m",
    "metric_marketing_roi": "SELECT tenant_id, coalesce(marketing_campaign_id, 'unattributed') AS marketing_campaign_id, count(*) AS orders, cast(sum(net_revenue) AS decimal(18,2)) AS attributed_revenue, cast(sum(net_revenue) AS double) / count(*) AS revenue_per_order FROM {orders} o GROUP BY 1, 2",
    "metric_product_performance": """SELECT o.tenant_id, lower(trim(o.product_id)) AS product_id, coalesce(p.name, lower(trim(o.product_id))) AS product_name, coalesce(p.category, 'unknown') AS category, count(*) AS orders, sum(quantity) AS units_sold,
      cast(sum(net_revenue) AS decimal(18,2)) AS net_revenue, cast(sum(net_revenue) AS double) / nullif(sum(quantity), 0) AS revenue_per_unit
      FROM {orders} o LEFT JOIN {tenant_products} p ON p.tenant_id = o.tenant_id AND p.product_id = lower(trim(o.product_id)) GROUP BY ALL""",
    "metric_payment_success": "SELECT tenant_id, metric_date, payment_success_count, payment_failure_count, payment_success_count + payment_failure_count AS payment_attempt_count, payment_success_count / nullif(payment_success_count + payment_failure_count, 0) AS payment_success_rate FROM {daily} m",
    "metric_event_throughput": """WITH e AS (SELECT lower(trim(tenant_id)) AS tenant_id, to_date(event_timestamp) AS d, count(*) AS n FROM {raw_events} WHERE event_timestamp IS NOT NULL GROUP BY ALL)
      SELECT m.tenant_id, metric_date, events_processed, coalesce(n, 0) AS raw_event_count, order_count, payment_success_count, payment_failure_count, updated_at FROM {daily} m LEFT JOIN e ON e.tenant_id = m.tenant_id AND e.d = m.metric_date""",
    "metric_health_inputs": """SELECT tenant_id, sum(events_processed) AS events_processed, sum(payment_success_count) AS payment_successes, sum(payment_failure_count) AS payment_failures, count(*) AS n_days,
      sum(churn_signal_count * 1000000L div active_users) FILTER (WHERE active_users > 0) AS churn_ppm_sum, count_if(active_users > 0) AS n_rated
      FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY metric_date DESC) AS k FROM {daily} m) WHERE k <= 7 GROUP BY tenant_id""",
    "alerts_top5": "SELECT tenant_id, event_id, service_name, status, event_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY event_timestamp DESC, event_id) AS k FROM {health} h WHERE event_type = 'system.alert') WHERE k <= 5",
    "alerts_recent": f"SELECT event_id, service_name, status, message, event_timestamp FROM {{health}} h WHERE tenant_id = '{TENANT}' AND event_type = 'system.alert' ORDER BY event_timestamp DESC, event_id LIMIT 20 OFFSET 2",
    "latest_service_health": "SELECT tenant_id, service_name, r.* FROM (SELECT tenant_id, service_name, max_by(struct(status, latency_ms, error_count, throughput_per_minute, kafka_lag, cache_hit_rate, event_timestamp), struct(event_timestamp, event_id)) AS r FROM {health} h GROUP BY 1, 2)",
    "system_status": "SELECT service_name, status, count(*) AS n, count(DISTINCT tenant_id) AS n_tenants, max(event_timestamp) AS latest FROM {health} h GROUP BY service_name, status",
    "latest_run_per_pipeline": "SELECT substring(pipeline_name, length('landing:') + 1) AS pipeline, r.* FROM (SELECT pipeline_name, max_by(struct(run_id, status, records_processed, finished_at), struct(finished_at, run_id)) AS r FROM {runs} r WHERE pipeline_name LIKE 'landing:%' GROUP BY 1)",
    "ops_pipelines": "SELECT pipeline_name, run_id, status, records_processed, started_at, finished_at FROM {runs} r ORDER BY started_at DESC, run_id LIMIT 10",
    "ops_recent": "SELECT tenant_id, order_id, event_id, status, updated_at FROM {orders} o ORDER BY updated_at DESC, tenant_id, order_id LIMIT 50",
    "ops_incidents": "SELECT tenant_id, event_id, service_name, status, message, event_timestamp FROM {health} h WHERE event_type = 'system.alert' ORDER BY event_timestamp DESC, event_id, tenant_id LIMIT 10",
    "ops_inbox": "SELECT CASE WHEN tenant_id IS NULL OR trim(tenant_id) = '' THEN 'rejected' WHEN event_timestamp IS NULL THEN 'pending' ELSE 'processed' END AS status, count(*) AS event_count, max(ingested_at) AS latest_received FROM {raw_events} GROUP BY 1",
    "status_counts": "SELECT status, count(*) AS event_count, max(updated_at) AS latest_update FROM {payments} p GROUP BY status",
    "dashboard": "SELECT plan, region, count(DISTINCT m.tenant_id) AS tenants, cast(sum(net_revenue) AS decimal(18,2)) AS net_revenue, sum(order_count) AS orders FROM {daily} m JOIN {tenant_config} c ON c.tenant_id = m.tenant_id GROUP BY plan, region",
    "dashboard_metrics": "SELECT tenant_id, metric_date, net_revenue, order_count, active_users, payment_success_count, payment_failure_count, events_processed FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY metric_date DESC) AS k FROM {daily} m) WHERE k <= 14",
    "products_list": f"SELECT product_id, sku, name, category, price, inventory_on_hand, active FROM {{tenant_products}} WHERE tenant_id = '{TENANT}' ORDER BY product_id LIMIT 10 OFFSET 2",
    "users_list": f"SELECT user_id, min(event_timestamp) AS first_seen, count(*) AS n_events FROM {{sessions}} s WHERE tenant_id = '{TENANT}' GROUP BY user_id ORDER BY user_id LIMIT 10 OFFSET 3",
    "tenant_row_counts": """SELECT tenant_id, 'orders' AS src, count(*) AS n FROM {processed_orders} GROUP BY 1 UNION ALL SELECT tenant_id, 'payments', count(*) FROM {processed_payments} GROUP BY 1 UNION ALL SELECT tenant_id, 'products', count(*) FROM {tenant_products} GROUP BY 1
      UNION ALL SELECT tenant_id, 'daily', count(*) FROM {tenant_metrics_daily} GROUP BY 1""",
    "serving_freshness": f"SELECT src, latest, (unix_micros(cast({AS_OF} AS timestamp)) - unix_micros(cast(latest AS timestamp))) / 1000000D AS staleness_seconds FROM (SELECT 'orders' AS src, max(updated_at) AS latest FROM {{processed_orders}} UNION ALL SELECT 'payments', max(updated_at) FROM {{processed_payments}} UNION ALL SELECT 'daily', max(updated_at) FROM {{tenant_metrics_daily}})",
    "recon_revenue": f"""WITH {_FACTS} SELECT m.tenant_id, m.metric_date, cast(coalesce(m.net_revenue, 0) - coalesce(od.net_revenue, 0) AS decimal(18,2)) AS revenue_delta, coalesce(m.order_count, 0) - coalesce(od.order_count, 0) AS order_count_delta,
      coalesce(m.units_sold, 0) - coalesce(od.units_sold, 0) AS units_sold_delta, if(abs(coalesce(m.net_revenue, 0) - coalesce(od.net_revenue, 0)) > 0.01 OR coalesce(m.order_count, 0) <> coalesce(od.order_count, 0) OR coalesce(m.units_sold, 0) <> coalesce(od.units_sold, 0), 'failed', 'passed') AS status
      FROM {{daily}} m LEFT JOIN od ON od.tenant_id = m.tenant_id AND od.d = m.metric_date""",
    "recon_payment": f"""WITH {_FACTS}, x AS (SELECT m.tenant_id, m.metric_date, coalesce(m.payment_success_count, 0) - coalesce(pd.payment_success_count, 0) AS success_delta, coalesce(m.payment_failure_count, 0) - coalesce(pd.payment_failure_count, 0) AS failure_delta
      FROM {{daily}} m LEFT JOIN pd ON pd.tenant_id = m.tenant_id AND pd.d = m.metric_date) SELECT *, if(success_delta <> 0 OR failure_delta <> 0, 'failed', 'passed') AS status FROM x""",
    "recon_activity": f"""WITH {_FACTS}, x AS (SELECT m.tenant_id, m.metric_date, coalesce(m.new_users, 0) - coalesce(ud.new_users, 0) AS new_users_delta, coalesce(m.active_users, 0) - coalesce(ud.active_users, 0) AS active_users_delta,
      coalesce(m.churn_signal_count, 0) - coalesce(ud.churn_signal_count, 0) AS churn_signal_count_delta FROM {{daily}} m LEFT JOIN ud ON ud.tenant_id = m.tenant_id AND ud.d = m.metric_date)
      SELECT *, if(new_users_delta <> 0 OR active_users_delta <> 0 OR churn_signal_count_delta <> 0, 'failed', 'passed') AS status FROM x""",
    "recon_two_path": f"""WITH {_FACTS}, both AS (SELECT coalesce(m.tenant_id, pd.tenant_id) AS tenant_id, coalesce(m.metric_date, pd.d) AS metric_date, m.payment_success_count AS s1, pd.payment_success_count AS m1, m.payment_failure_count AS s2, pd.payment_failure_count AS m2
      FROM {{daily}} m FULL OUTER JOIN pd ON pd.tenant_id = m.tenant_id AND pd.d = m.metric_date)
      SELECT tenant_id, metric_date, metric_name, cast(serving AS bigint) AS serving_value, mart AS mart_value, coalesce(abs(serving - mart), 0) AS absolute_difference, {_MISS.format(s="serving", m="mart")} AS status
      FROM both LATERAL VIEW stack(2, 'payment_success_count', cast(s1 AS bigint), m1, 'payment_failure_count', cast(s2 AS bigint), m2) AS metric_name, serving, mart""",
    "dq_duplicates": "SELECT tenant_id, sum(n - 1) AS n_duplicates FROM (SELECT tenant_id, event_id, count(*) AS n FROM {processed_orders} GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY tenant_id",
    "dq_freshness": f"""SELECT tenant_id, minutes, CASE WHEN minutes IS NULL THEN 'warning' WHEN minutes <= 14 * 1440 THEN 'passed' ELSE 'failed' END AS status
      FROM (SELECT lower(trim(tenant_id)) AS tenant_id, (unix_micros(cast({AS_OF} AS timestamp)) - unix_micros(cast(max(event_timestamp) AS timestamp))) / 60000000D AS minutes FROM {{raw_events}} WHERE trim(tenant_id) <> '' GROUP BY 1)""",
    "dq_violations": """SELECT tenant_id, sum(a) AS n_missing_fields, sum(b) AS n_bad_orders, sum(c) AS n_bad_payment_status, sum(e) AS n_bad_metrics FROM (
      SELECT lower(trim(tenant_id)) AS tenant_id, count_if(event_id IS NULL OR event_type IS NULL OR payload IS NULL) AS a, 0L AS b, 0L AS c, 0L AS e FROM {raw_events} WHERE trim(tenant_id) <> '' GROUP BY 1
      UNION ALL SELECT tenant_id, 0, count_if(gross_revenue < 0 OR net_revenue < 0 OR unit_price < 0 OR quantity < 1), 0, 0 FROM {processed_orders} GROUP BY 1
      UNION ALL SELECT tenant_id, 0, 0, count_if(status NOT IN ('authorized', 'captured', 'failed')), 0 FROM {processed_payments} GROUP BY 1
      UNION ALL SELECT tenant_id, 0, 0, 0, count_if(gross_revenue < 0 OR net_revenue < 0 OR order_count < 0 OR payment_success_count < 0 OR payment_failure_count < 0) FROM {tenant_metrics_daily} GROUP BY 1) GROUP BY tenant_id""",
    "dq_orphan_products": "SELECT o.tenant_id, count(*) AS n FROM {processed_orders} o LEFT ANTI JOIN {tenant_products} t ON t.tenant_id = o.tenant_id AND t.product_id = lower(trim(o.product_id)) GROUP BY o.tenant_id",
    "dq_volume_anomaly": f"""WITH v AS (SELECT lower(trim(tenant_id)) AS tenant_id, to_date(event_timestamp) AS d, count(*) AS n FROM {{raw_events}} WHERE trim(tenant_id) <> '' AND event_timestamp >= date_sub({TODAY}, 8) AND event_timestamp < date_add({TODAY}, 1) GROUP BY ALL)
      SELECT tenant_id, coalesce(max(n) FILTER (WHERE d = {TODAY}), 0) AS today_count, sum(n) FILTER (WHERE d < {TODAY}) AS before_total, count_if(d < {TODAY}) AS before_days,
      if(coalesce(max(n) FILTER (WHERE d = {TODAY}), 0) * count_if(d < {TODAY}) * 10 BETWEEN sum(n) FILTER (WHERE d < {TODAY}) * 4 AND sum(n) FILTER (WHERE d < {TODAY}) * 25, 'passed', 'warning') AS status FROM v GROUP BY tenant_id""",
    "orders_upsert": "SELECT tenant_id, order_id, event_id, customer_id, product_id, quantity, unit_price, discount_amount, gross_revenue, net_revenue, currency, status, channel, marketing_campaign_id, region, event_timestamp, created_at, updated_at FROM {orders} o",
    "payments_upsert": "SELECT tenant_id, payment_id, event_id, order_id, customer_id, amount, currency, status, payment_method, failure_code, risk_score, event_timestamp, created_at, updated_at FROM {payments} p",
    "sessions_dedup": "SELECT tenant_id, event_id, ingested_at, landing_file FROM {sessions} s",
    "retention": "SELECT event_id, tenant_id, event_timestamp, ingested_at FROM {raw_events} WHERE ingested_at >= timestamp_ntz'2018-01-20 00:00:00'",
    "payment_ts_clamp": "SELECT tenant_id, event_id, payment_id, cast(least(event_timestamp + interval 2 minutes, date_trunc('day', event_timestamp) + interval 86399 seconds) AS timestamp_ntz) AS clamped_at FROM {processed_payments}",
    "nth_product": "SELECT tenant_id, n, product_id FROM (SELECT tenant_id, product_id, row_number() OVER (PARTITION BY tenant_id ORDER BY product_id) AS k, count(*) OVER (PARTITION BY tenant_id) AS n FROM {tenant_products}) WHERE k = 1 + n % 3",
    "schema_drift_columns": "SELECT domain, field_name, if(old IS NULL, 'only_new', 'only_old') AS side FROM (SELECT domain_name AS domain, field_name, 1 AS old FROM {payload_fields} WHERE payload_version = 1) FULL OUTER JOIN (SELECT domain_name AS domain, field_name, 1 AS new FROM {payload_fields} WHERE payload_version = 2) USING (domain, field_name) WHERE old IS NULL OR new IS NULL",
    "tenants_in_both": "SELECT tenant_id FROM {tenant_metrics_daily} INTERSECT SELECT tenant_id FROM {tenant_config}",
    "lineage_edges": """WITH e AS (SELECT lower(trim(tenant_id)) AS tenant_id, event_id, event_type, causation_id FROM {raw_events} WHERE trim(tenant_id) <> ''), x AS (SELECT DISTINCT tenant_id, event_id, event_type FROM e)
      SELECT x.event_type AS cause_type, r.event_type, count(*) AS n FROM (SELECT DISTINCT tenant_id, event_id, event_type, causation_id FROM e WHERE causation_id IS NOT NULL) r JOIN x ON x.tenant_id = r.tenant_id AND x.event_id = r.causation_id GROUP BY ALL""",
    "ops_lineage": "SELECT tenant_id, event_id, causation_id, event_timestamp FROM {raw_events} WHERE causation_id IS NOT NULL GROUP BY ALL ORDER BY event_timestamp DESC NULLS LAST, event_id, tenant_id LIMIT 10",
    "lineage_orphans": """WITH e AS (SELECT lower(trim(tenant_id)) AS tenant_id, event_id, causation_id FROM {raw_events} WHERE trim(tenant_id) <> '')
      SELECT tenant_id, causation_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, event_id, causation_id FROM e WHERE causation_id IS NOT NULL) r LEFT ANTI JOIN e x ON x.tenant_id = r.tenant_id AND x.event_id = r.causation_id GROUP BY tenant_id, causation_id""",
}
_NAMES = re.compile(r"\{(\w+)\}")


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    return views.VIEWS[name](spark, d) if name in views.VIEWS else table(spark, d, name)


def _query(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    # a query named as a table that it reads (processed_orders) reads the view of it
    def run(spark: SparkSession, d: str) -> DataFrame:
        sql = text.replace("{window}", window("metric_date", "2018-01-05", "2018-01-25"))
        return spark.sql(sql, **{n: _source(spark, d, n) for n in set(_NAMES.findall(sql))})

    run.__name__ = name
    return run


def window(column: str, start: str | None = None, end: str | None = None) -> str:
    """A predicate on dates, inclusive at both ends; an end that isn't given is open."""
    parts = [f"{column} {op} date'{day}'" for op, day in ((">=", start), ("<=", end)) if day]
    return " AND ".join(parts) or "true"


def incremental_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily figures by two additive batches: what arrived up to a moment, then the rest."""
    every = views.deltas(spark, d)
    day = lambda df: df.groupBy("tenant_id", F.to_date("event_timestamp").alias("metric_date")).agg(*[F.sum(m).cast("decimal(18,2)" if m.endswith("revenue") else "bigint").alias(m) for m in views.MEASURES])
    before = F.col("ingested_at") < F.lit("2018-01-12").cast("timestamp_ntz")
    return upserts.add(day(every.filter(before)), day(every.filter(~before)), ["tenant_id", "metric_date"], list(views.MEASURES))


def slice_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Stored daily metrics in which a tenant's stretch of days is deleted and computed anew."""
    cols = ["tenant_id", "metric_date", "net_revenue", "order_count", "units_sold", "payment_success_count", "payment_failure_count", "active_users"]
    typed = lambda df: df.select("tenant_id", "metric_date", F.col("net_revenue").cast("decimal(18,2)"), *[F.col(c).cast("bigint") for c in cols[3:]])
    inside = (F.col("tenant_id") == TENANT) & F.col("metric_date").between("2018-01-08", "2018-01-19")
    return upserts.replace_slice(typed(views.daily(spark, d)), typed(QUERIES["backfill_daily"](spark, d)), inside)


def pipeline_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Per pipeline the last file, advanced by runs in two batches of which the second is older."""
    runs = views.runs(spark, d).select(F.split_part("pipeline_name", F.lit(":"), F.lit(2)).alias("pipeline"), F.col("finished_at").alias("position"), "run_id")
    none = runs.limit(0)
    half = lambda i: runs.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == i)
    marks = upserts.monotone(none, upserts.last(half(1), ["pipeline"], ["position", "run_id"]), ["pipeline"], "position")
    return upserts.monotone(marks, upserts.last(half(0), ["pipeline"], ["position", "run_id"]), ["pipeline"], "position").orderBy("pipeline").select("pipeline", "position")


def outbox_lease(spark: SparkSession, d: str) -> DataFrame:
    """Changes as an outbox: a hundred pending ones are leased, then half of them published and half failed; the states after that."""
    feed = table(spark, d, "product_changes")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = feed.select(F.col("change_no").alias("outbox_id"), F.lit("pending").alias("status"), (F.col("change_no") % 4).cast("int").alias("attempts"), F.col("ingested_at").alias("created_at"), F.col("ingested_at").alias("available_at"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp_ntz").alias("published_at"))
    now = at("2018-01-10 00:00:00")
    leased = outbox.lease(rows, 100, now)
    done = outbox.published(leased, F.col("outbox_id") % 2 == 0, now)
    return outbox.failed(done, F.col("outbox_id") % 2 == 1, 3, 60, now, "unreachable").select("outbox_id", "status", "attempts", "available_at", "error_message", "published_at")


def erasure(spark: SparkSession, d: str) -> DataFrame:
    """User activity with one subject of one tenant erased: id hashed, page, referrer and campaign null; all other rows as they are."""
    rows = views.sessions(spark, d)
    mine = (F.col("tenant_id") == TENANT) & (F.col("user_id") == SUBJECT)
    blank = lambda c: F.when(~mine, F.col(c)).alias(c)
    hashed = F.when(mine, F.concat(F.lit("erased:"), F.sha2("user_id", 256))).otherwise(F.col("user_id")).alias("user_id")
    return rows.select("tenant_id", "event_id", hashed, "action", blank("page"), blank("referrer"), blank("marketing_campaign_id"))


def erasure_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Raw events; where one of the tenant mentions the subject, its payload loses the named keys."""
    mine = (key_of("tenant_id") == TENANT) & F.contains("payload", F.lit(SUBJECT))
    rows = table(spark, d, "raw_events").select("event_id", "landing_file", "ingested_at", F.when(mine, without_keys("payload", "page", "referrer", "email")).otherwise(F.col("payload")).alias("payload"))
    rows = once(rows, _p=object_map("payload"))
    return rows.select("event_id", "landing_file", "ingested_at", F.size(F.map_keys("_p")).alias("n_keys"), views.field("page").alias("page"), views.field("user_id").alias("user_id"))


#: table, the column that tells a row's age, and days to keep.
RETENTION = (("raw_events", "ingested_at", 180), ("processed_orders", "created_at", 365), ("processed_payments", "created_at", 90), ("product_changes", "ingested_at", 120))


def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    """Of each table under a policy how many rows are kept and how many have expired, as of a day half a year on."""
    def one(name: str, column: str, days: int) -> DataFrame:
        expired = F.col(column) < F.expr(f"timestamp_ntz'2018-07-15 00:00:00' - interval {days} days")
        return table(spark, d, name).select(F.coalesce(expired, F.lit(False)).alias("x")).agg(F.lit(name).alias("table_name"), F.lit(days).alias("retention_days"), F.count_if(~F.col("x")).alias("n_kept"), F.count_if("x").alias("n_expired"))

    parts = [one(*p) for p in RETENTION]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def users_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One row per tenant and user: first_seen and first page as first written, plan and action as last written."""
    s = views.sessions(spark, d).select("tenant_id", "user_id", "event_id", F.col("event_timestamp").alias("first_seen"), F.col("event_timestamp").alias("last_seen"), "page", "plan", "action")
    merged = upserts.keep_first_update_rest(s, ["tenant_id", "user_id"], ["first_seen", "page"], ["last_seen", "event_id"])
    return merged.select("tenant_id", "user_id", "first_seen", F.col("page").alias("first_page"), "last_seen", "plan", "action")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """The three reconciliations' outcomes: (check, tenant_id, metric_date, status)."""
    parts = [QUERIES[q](spark, d).select(F.lit(q.removeprefix("recon_")).alias("check"), "tenant_id", "metric_date", "status") for q in ("recon_revenue", "recon_payment", "recon_activity")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recon_run_all(spark: SparkSession, d: str) -> DataFrame:
    """Per tenant the failed checks of each kind, and failed as a whole if any is."""
    n = lambda k: F.count_if((F.col("check") == k) & (F.col("status") == "failed")).alias(f"{k}_failed")
    per = _checks(spark, d).groupBy("tenant_id").agg(F.count("*").alias("checks_run"), n("revenue"), n("payment"), n("activity"))
    return per.withColumn("status", F.when(F.col("revenue_failed") + F.col("payment_failed") + F.col("activity_failed") > 0, "failed").otherwise("passed"))


def ops_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest outcomes of one tenant's revenue reconciliation."""
    r = QUERIES["recon_revenue"](spark, d).filter(matches("tenant_id", TENANT))
    return r.orderBy(F.col("metric_date").desc()).limit(10).select("tenant_id", "metric_date", "status", "revenue_delta", "order_count_delta", "units_sold_delta")


def recon_recent(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the last day before a moment: how many failed, how many ran."""
    recent = _checks(spark, d).filter((F.col("metric_date") >= "2018-01-27") & (F.col("metric_date") < "2018-01-28"))
    return recent.agg(F.count_if(F.col("status") == "failed").alias("failures"), F.count("*").alias("total"))


def reconciliation_summary(spark: SparkSession, d: str, tenant: str | None = None) -> DataFrame:
    """Per tenant and day since a month before the last: checks run, passed and failed, and the greatest deltas; of one tenant if it is named."""
    r = QUERIES["recon_revenue"](spark, d).filter(matches("tenant_id", tenant))
    passed = F.col("status") == "passed"
    return r.groupBy("tenant_id", "metric_date").agg(
        F.count("*").alias("checks_run"), F.count_if(passed).alias("passed_checks"), F.count_if(~passed).alias("failed_checks"), F.max(F.abs("revenue_delta")).alias("max_abs_revenue_delta"),
        F.max(F.abs("order_count_delta")).alias("max_abs_order_count_delta"), F.max(F.abs("units_sold_delta")).alias("max_abs_units_sold_delta"),
    )


def reconciliation_summary_tenant(spark: SparkSession, d: str) -> DataFrame:
    return reconciliation_summary(spark, d, TENANT)


def semantic_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The registered measures and the ratio built on them, by day, week and month."""
    m = views.daily(spark, d)
    parts = [semantic.measured(m, "metric_date", grain) for grain in ("day", "week", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def data_tests(spark: SparkSession, d: str) -> DataFrame:
    """Failing rows per declared test: not null, accepted values, range."""
    return quality.run_tests({"stg_orders": QUERIES["stg_orders"](spark, d), "stg_payments": QUERIES["stg_payments"](spark, d), "fct_tenant_daily": QUERIES["fct_tenant_daily"](spark, d)}, quality.TESTS)


def metric_contract(spark: SparkSession, d: str) -> DataFrame:
    """Per metric and field: rows in which a required field is null or a non-negative one is negative."""
    parts = [quality.contract_violations(QUERIES[c.query](spark, d), c) for c in quality.METRIC_CONTRACTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    """The registry after every domain's contracts were registered, and registered again without effect."""
    offered = registry.offers(table(spark, d, "payload_fields"))
    once_ = registry.register(spark.createDataFrame([], registry.VERSIONS), offered)
    return registry.register(once_, offered).select("subject", "version", "fingerprint", "n_fields", "is_latest")


def schema_breaks(spark: SparkSession, d: str) -> DataFrame:
    """What breaks between consecutive versions of a domain's contract, if read backward."""
    return registry.breaks(table(spark, d, "payload_fields"))


def lateral_series(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed_orders").filter("quantity > 0").select("tenant_id", "event_id", F.explode(F.expr("sequence(1, quantity)")).alias("unit_no"))
    return rows.groupBy("tenant_id", "unit_no").agg(F.count("*").alias("n"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of service latency, the index rounded half to even."""
    nearest = lambda p: lambda n: F.bround((n - 1) * p / F.lit(100.0)) + 1
    return skew.values_at(views.health(spark, d), ["service_name"], "latency_ms", {f"p{p}": nearest(p) for p in (50, 95, 99)}, coarse=10)


def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Of each user event the one before it in its session, and the minutes between their seconds."""
    s = sessions.previous(views.sessions(spark, d), ["tenant_id", "user_id", "session_id"], "event_timestamp", "event_id")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return s.select("tenant_id", "event_id", "previous_at", ((seconds("event_timestamp") - seconds("previous_at")) / F.lit(60.0)).alias("minutes_since_previous"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n, s) for n, s in SQL.items()}
QUERIES |= {
    f.__name__: f
    for f in (
        incremental_daily, slice_recompute, pipeline_watermarks, outbox_lease, erasure, erasure_payloads, retention_plan, users_upsert, recon_run_all, ops_reconciliation, recon_recent, reconciliation_summary, reconciliation_summary_tenant, semantic_metrics, data_tests,
        metric_contract, schema_versions, schema_breaks, lateral_series, latency_percentiles, session_gaps,
    )
}

from eventloom.plans.serving_checks import ORACLE  # noqa: E402, F401
