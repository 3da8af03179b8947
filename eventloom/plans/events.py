"""Queries over event envelopes: parsing to dead letters, lateness, windows, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.jsontext import object_map
from eventloom.functions.once import once
from eventloom.functions.timeparts import micros
from eventloom.operators import envelopes, event_time, payloads, sessions, upserts
from eventloom.sources.tables import table
from eventloom.tenancy import allowed, key_of, scoped

TENANT = "larkspur-goods"


def envelope_text(events: DataFrame) -> Column:
    """The JSON text of a stored event, its payload spliced in as it is."""
    head = [F.col(c) for c in ("event_id", "tenant_id", "event_type", "source_service", "payload_version", "trace_id", "correlation_id", "idempotency_key", "causation_id", "schema_ref")]
    text = F.to_json(F.struct(*head, F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp")))
    return F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))


def received(spark: SparkSession, d: str) -> DataFrame:
    """Raw records as a broker would hand them over: topic, partition and offset stand for the landing file's domain and number and the time of arrival."""
    ev = table(spark, d, "raw_events")
    topic = F.concat(F.split_part("landing_file", F.lit("/"), F.lit(2)), F.lit(".events"))
    number = F.regexp_extract("landing_file", r"(\d+)\.jsonl$", 1).try_cast("int")
    return ev.select(envelope_text(ev).alias("value"), "ingested_at", "landing_file", topic.alias("topic"), number.alias("partition"), micros(F.col("ingested_at")).alias("offset"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return envelopes.validate(envelopes.parse(received(spark, d)))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored events with normalised tenant and domain, for operators behind the parser."""
    ev = table(spark, d, "raw_events")
    return ev.withColumn("tenant_id", key_of("tenant_id")).withColumn("domain", envelopes.domain()).filter("tenant_id is not null and event_timestamp is not null and domain is not null")


def raw_events_lookback(spark, d):
    return table(spark, d, "raw_events").filter("event_timestamp >= timestamp_ntz'2018-01-15' and event_type in ('order.created', 'order.updated')").select("event_id", "tenant_id", "event_type", "event_timestamp")


def parsed_events(spark, d):
    p = envelopes.parse(received(spark, d)).filter("not is_malformed")
    return p.select("event_id", "tenant_id", "event_type", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "payload_version", "correlation_id", "idempotency_key")


def validation_reasons(spark, d):
    return _validated(spark, d).groupBy("domain", "reason").agg(F.count("*").alias("n"))


def valid_invalid_counts(spark, d):
    valid, invalid = envelopes.split(_validated(spark, d))
    return valid.groupBy(F.lit("valid").alias("status")).agg(F.count("*").alias("n")).unionByName(invalid.groupBy(F.lit("invalid").alias("status")).agg(F.count("*").alias("n")))


def domain_counts(spark, d):
    return table(spark, d, "raw_events").groupBy(envelopes.domain().alias("domain")).agg(F.count("*").alias("n"))


def tenant_filter(spark, d):
    ev = allowed(table(spark, d, "raw_events"), [TENANT, "Quillmere "])
    return ev.groupBy(key_of("tenant_id").alias("tenant_id")).agg(F.count("*").alias("n"))


def tenant_scope(spark, d):
    return scoped(table(spark, d, "raw_events"), TENANT).groupBy("event_type").agg(F.count("*").alias("n"))


def normalized_events(spark, d):
    ev = table(spark, d, "raw_events").filter("event_timestamp is not null")
    return ev.groupBy(key_of("tenant_id").alias("tenant_id"), F.date_format("event_timestamp", "yyyy-MM-dd").alias("event_date"), F.split_part("event_type", F.lit("."), F.lit(1)).alias("domain_prefix")).agg(F.count("*").alias("n"))


def idempotent_ids(spark, d):
    ev = table(spark, d, "raw_events")
    return ev.select("event_id", "landing_file", "ingested_at", envelopes.idempotent_id(F.col("tenant_id"), F.col("event_type"), F.col("source_service"), F.col("event_id")).alias("idem_id"))


def event_routing(spark, d):
    ev = table(spark, d, "raw_events").filter("payload is not null and tenant_id is not null")
    ev = ev.filter(object_map("payload").isNotNull())
    return ev.select("event_id", "ingested_at", F.concat(envelopes.domain(), F.lit(".events")).alias("topic"), envelopes.partition_key().alias("partition_key"))


_WRITTEN = "2018-02-09 00:00:00"


def _letters(spark, d):
    _, invalid = envelopes.split(_validated(spark, d))
    return envelopes.dead_letters(invalid, F.lit(_WRITTEN).cast("timestamp_ntz"))


def dlq_payload(spark, d):
    """Every dead letter, its ten fields read back from the JSON it holds."""
    fields = "original_event_id string, tenant_id string, event_type string, source_service string, rejection_reason string, original_topic string, original_partition int, original_offset bigint, raw_value string, dlq_written_at string"
    return once(_letters(spark, d), _v=F.from_json("value", fields)).select("key", *[F.col(f"_v.{f.split()[0]}").alias(f.split()[0]) for f in fields.split(", ") if not f.startswith("raw_value")], (F.length("_v.raw_value") > 0).alias("has_original"))


def dlq_inspect(spark, d):
    """Dead letters read as records; of each reason how many there are and how many hold a readable original."""
    letters = once(envelopes.inspect_dead_letters(_letters(spark, d)), _ok=object_map("original").isNotNull())
    return letters.groupBy("reason", "failed_stage").agg(F.count("*").alias("n"), F.count_if("_ok").alias("n_readable"))


def dlq_inspect_one(spark, d):
    """The letters of one event."""
    found = envelopes.inspect_dead_letters(_letters(spark, d), event_id=F.lit(_REJECTED))
    return found.select("key", "reason", F.get_json_object("original", "$.event_id").alias("event_id"))


#: An event that occurs in the small tables and is rejected there; in others there may be no such letter.
_REJECTED = "oev-00360d7cd399e75990ab"


def dlq_replay(spark, d):
    """Every dead letter with a readable envelope, as it would be sent again; the sent JSON is read back."""
    out = envelopes.replay(envelopes.inspect_dead_letters(_letters(spark, d)), F.lit("2018-02-01 00:00:00").cast("timestamp_ntz"))
    read = once(out.select("topic", "value"), _e=F.from_json("value", ", ".join(f"{n} string" for n in envelopes.REQUIRED + envelopes.OPTIONAL)), _p=F.from_json(F.get_json_object("value", "$.payload"), "map<string,string>", {"allowSingleQuotes": "false"}))
    keys = F.array_join(F.array_sort(F.map_keys("_p")), "|")
    text = [F.col(f"_e.{n}").alias(n) for n in ("event_id", "causation_id", "idempotency_key", "tenant_id", "event_type", "source_service", "trace_id", "correlation_id", "schema_ref", "event_timestamp")]
    return read.select("topic", *text, F.col("_e.payload_version").cast("int").alias("payload_version"), keys.alias("payload_keys"))


def payload_contract(spark, d):
    """Each event's violations of its domain's contract, joined by bars."""
    out = payloads.checked(table(spark, d, "raw_events").withColumn("domain", envelopes.domain()))
    return out.select("event_id", "landing_file", "ingested_at", "domain", F.array_join("violations", "|").alias("violations"))


def payload_orders(spark, d):
    """Conforming order payloads, typed, defaults filled in."""
    ev = payloads.checked(_stored(spark, d).filter("domain = 'orders'"))
    return payloads.with_defaults(ev, "orders").drop("event_timestamp").groupBy("tenant_id", "currency", "status", "channel").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum(F.col("unit_price").cast("decimal(18,2)")).cast("decimal(18,2)").alias("prices"), F.sum(F.col("discount_amount").cast("decimal(18,2)")).cast("decimal(18,2)").alias("discounts"))


def _classified(spark, d):
    return event_time.classify(_stored(spark, d), F.col("ingested_at"))


def lateness_classes(spark, d):
    return _classified(spark, d).groupBy("tenant_id", "domain", "lateness").agg(F.count("*").alias("n"))


def lateness_split(spark, d):
    kept, late = event_time.split_late(_classified(spark, d))
    n = lambda df, side: df.groupBy(F.lit(side).alias("side")).agg(F.count("*").alias("n"))
    return n(kept, "kept").unionByName(n(late, "rejected"))


def dlq_union(spark, d):
    _, invalid = envelopes.split(_validated(spark, d))
    _, late = event_time.split_late(_classified(spark, d))
    late = late.select("event_id", "event_type", F.lit("event_time_watermark_exceeded").alias("reason"), "lateness_seconds")
    both = invalid.select("event_id", "event_type", "reason").unionByName(late, allowMissingColumns=True)
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.count("lateness_seconds").alias("n_late"))


def dlq_reason_counts(spark, d):
    return _validated(spark, d).filter("not is_valid").groupBy("reason").agg(F.count("*").alias("n"))


def late_event_audit(spark, d):
    rows = _classified(spark, d).filter("lateness like 'late%'").select("tenant_id", "event_id", "lateness", "ingested_at", "lateness_seconds")
    return upserts.first(rows, ["tenant_id", "event_id", "lateness"], ["ingested_at", "lateness_seconds"]).select("tenant_id", "event_id", "lateness", "ingested_at")


def late_event_summary(spark, d):
    return late_event_audit(spark, d).groupBy("lateness").agg(F.count("*").alias("n"), F.max("ingested_at").alias("latest"))


def batch_duplicates(spark, d):
    marked = event_time.mark_duplicates(_stored(spark, d), [F.col("ingested_at"), F.col("landing_file")])
    return marked.filter("is_duplicate").groupBy("tenant_id").agg(F.count("*").alias("n_duplicates"))


def raw_dedup(spark, d):
    return upserts.first(_stored(spark, d).select("tenant_id", "event_id", "ingested_at", "landing_file"), ["tenant_id", "event_id"], ["ingested_at", "landing_file"])


def compacted_events(spark, d):
    rows = _stored(spark, d).select("tenant_id", "event_id", "event_timestamp", "domain", "ingested_at", "landing_file")
    kept = upserts.first(rows, ["tenant_id", "event_id"], ["ingested_at", "landing_file"])
    return kept.groupBy("tenant_id", F.date_format("event_timestamp", "yyyy-MM-dd").alias("event_date"), "domain").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event_id"))


def enriched_events(spark, d):
    out = event_time.enrich(_stored(spark, d), table(spark, d, "tenant_config"))
    return out.groupBy("dim_plan", "dim_region", "tenant_missing").agg(F.count("*").alias("n"))


def _countable(spark, d):
    """Events that windows count: each once, at its first copy, unless that came beyond the lateness cut-off."""
    rows = _stored(spark, d).select("tenant_id", "event_id", "event_type", "domain", "event_timestamp", "ingested_at", "landing_file", F.when(F.col("domain").isin("orders", "payments"), F.col("payload")).alias("payload"))
    kept, _ = event_time.split_late(event_time.classify(upserts.first(rows, ["tenant_id", "event_id"], ["ingested_at", "landing_file"]), F.col("ingested_at")))
    return kept


def window_metrics(spark, d):
    return _ntz(event_time.windowed(_countable(spark, d), "5 minutes"))


def sliding_metrics(spark, d):
    return _ntz(event_time.windowed(_countable(spark, d), "30 minutes", "15 minutes"))


def window_metrics_long(spark, d):
    return _ntz(event_time.melted(event_time.windowed(_countable(spark, d), "1 hour")))


def session_windows(spark, d):
    """Stretches of user activity per tenant, ended by half an hour without any; built from hourly fragments, so that a busy tenant is many tasks."""
    ev = _stored(spark, d).filter("domain = 'users'").select("tenant_id", F.lit("").alias("actor"), "event_id", "event_timestamp")
    out = sessions.sessions(ev)
    return out.select("tenant_id", F.col("started_at").alias("session_start"), (F.col("ended_at") + F.expr("interval 30 minutes")).alias("session_end"), F.col("n_events").alias("n"))


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def upsert_latest(spark, d):
    """Hourly counts written in two batches, the second correcting the first."""
    counts = lambda df, version: df.groupBy("tenant_id", F.date_trunc("hour", "event_timestamp").cast("timestamp_ntz").alias("metric_hour")).agg(F.count("*").alias("n")).withColumn("batch_id", F.lit(version))
    ev = _stored(spark, d)
    return upserts.upsert(counts(ev.filter("ingested_at < timestamp_ntz'2018-01-10'"), 1), counts(ev, 2), ["tenant_id", "metric_hour"], "batch_id")


def insert_if_absent(spark, d):
    first = raw_dedup(spark, d).filter("ingested_at < timestamp_ntz'2018-01-10'").select("tenant_id", "event_id")
    rest = _stored(spark, d).select("tenant_id", "event_id")
    return upserts.insert_absent(first, rest, ["tenant_id", "event_id"]).groupBy("tenant_id").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        raw_events_lookback, parsed_events, validation_reasons, valid_invalid_counts, domain_counts, tenant_filter, tenant_scope, normalized_events, idempotent_ids, event_routing, dlq_payload, dlq_inspect, dlq_inspect_one, dlq_replay, payload_contract, payload_orders,
        dlq_union, dlq_reason_counts, lateness_classes, lateness_split, late_event_audit, late_event_summary, batch_duplicates, raw_dedup, compacted_events, enriched_events, window_metrics, sliding_metrics,
        window_metrics_long, session_windows, upsert_latest, insert_if_absent,
    )
}

# what the queries are held against is spelt out here, not built from the operators' constants
_DOMAIN = """CASE WHEN event_type IN ('order.created', 'order.updated') THEN 'orders' WHEN event_type IN ('payment.authorized', 'payment.captured', 'payment.failed') THEN 'payments'
  WHEN event_type IN ('user.activity', 'user.signed_up', 'user.churn_signal') THEN 'users' WHEN event_type IN ('product.upserted', 'product.inventory_changed') THEN 'products' WHEN event_type IN ('system.health', 'system.alert') THEN 'system' END"""
_GONE = """(domain = 'orders' AND (payload ->> '$.order_id' IS NULL OR payload ->> '$.customer_id' IS NULL OR payload ->> '$.product_id' IS NULL OR payload ->> '$.quantity' IS NULL OR payload ->> '$.unit_price' IS NULL))
  OR (domain = 'payments' AND (payload ->> '$.payment_id' IS NULL OR payload ->> '$.order_id' IS NULL OR payload ->> '$.customer_id' IS NULL OR payload ->> '$.amount' IS NULL OR payload ->> '$.status' IS NULL))
  OR (domain = 'users' AND (payload ->> '$.user_id' IS NULL OR payload ->> '$.action' IS NULL))
  OR (domain = 'products' AND (payload ->> '$.product_id' IS NULL OR payload ->> '$.sku' IS NULL OR payload ->> '$.name' IS NULL OR payload ->> '$.category' IS NULL OR payload ->> '$.price' IS NULL))
  OR (domain = 'system' AND (payload ->> '$.service_name' IS NULL OR payload ->> '$.status' IS NULL))"""
_KEYCASE = "CASE domain WHEN 'orders' THEN payload ->> '$.order_id' WHEN 'payments' THEN payload ->> '$.payment_id' WHEN 'users' THEN payload ->> '$.user_id' WHEN 'products' THEN payload ->> '$.product_id' WHEN 'system' THEN payload ->> '$.service_name' END"
_PARSED = f"""ev AS (SELECT *, {_DOMAIN} AS domain, payload IS NOT NULL AND NOT json_valid(payload) AS bad FROM raw_events),
  reasons AS (SELECT *, CASE WHEN bad THEN 'malformed_json'
    WHEN event_id IS NULL OR tenant_id IS NULL OR event_type IS NULL OR event_timestamp IS NULL OR source_service IS NULL OR payload_version IS NULL OR trace_id IS NULL OR payload IS NULL THEN 'missing_required_fields'
    WHEN trim(tenant_id) = '' THEN 'blank_tenant_id' WHEN domain IS NULL THEN 'unknown_event_type' WHEN payload_version NOT IN (1, 2) THEN 'unsupported_payload_version'
    WHEN {_GONE} THEN 'missing_required_payload_fields' END AS reason FROM ev)"""
_STORED = f"st AS (SELECT * EXCLUDE (tenant_id), lower(trim(tenant_id)) AS tenant_id, {_DOMAIN} AS domain FROM raw_events WHERE trim(tenant_id) <> '' AND event_timestamp IS NOT NULL AND {_DOMAIN} IS NOT NULL)"
_CLASSES = f"{_STORED}, cl AS (SELECT *, (epoch_us(ingested_at) - epoch_us(event_timestamp)) / 1000000.0 AS late, CASE WHEN ingested_at IS NULL THEN NULL WHEN epoch_us(ingested_at) - epoch_us(event_timestamp) <= 60000000 THEN 'on_time' WHEN epoch_us(ingested_at) - epoch_us(event_timestamp) <= 600000000 THEN 'late_accepted' ELSE 'late_rejected' END AS lateness FROM st)"
_DEDUP = "dd AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY ingested_at, landing_file) = 1)"
_WIN = """count(*) AS event_count, CAST(sum(CASE event_type WHEN 'order.created' THEN coalesce(CAST(u * coalesce(q, 1) AS DECIMAL(18,2)), 0) WHEN 'payment.captured' THEN coalesce(amt, 0) WHEN 'payment.authorized' THEN coalesce(amt, 0) ELSE 0 END) AS DECIMAL(18,2)) AS revenue,
    count(*) FILTER (event_type = 'order.created') AS order_count, CAST(sum(CASE WHEN event_type = 'order.created' THEN coalesce(q, 0) ELSE 0 END) AS BIGINT) AS units_sold,
    count(*) FILTER (event_type = 'payment.captured') AS payment_success_count, count(*) FILTER (event_type = 'payment.failed') AS payment_failure_count, count(*) FILTER (late_us > 60000000) AS late_accepted_count"""
_WSRC = """firsts AS (SELECT DISTINCT ON (tenant_id, event_id) *, epoch_us(ingested_at) - epoch_us(event_timestamp) AS late_us, CASE WHEN json_valid(payload) THEN payload END AS p FROM st ORDER BY tenant_id, event_id, ingested_at, landing_file),
  src AS (SELECT *, try_cast(p ->> '$.quantity' AS BIGINT) AS q, try_cast(p ->> '$.unit_price' AS DECIMAL(18,2)) AS u, try_cast(p ->> '$.amount' AS DECIMAL(18,2)) AS amt FROM firsts WHERE late_us <= 600000000)"""
_LONG = " UNION ALL ".join(f"SELECT tenant_id, domain, window_start, window_end, event_count, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value FROM wide" for m in ("revenue", "order_count", "units_sold", "payment_success_count", "payment_failure_count", "event_count"))


def _rule(domain: str, name: str, kind: str, need: str, *ranges: str) -> str:
    """The first rule a field breaks: absent, null, of another type, outside a range."""
    v, k = f"j ->> '{name}'", f"json_type(j, '$.{name}')"
    number = f"try_cast({v} AS DOUBLE)"
    right = {"string": f"{k} = 'VARCHAR'", "number": f"{k} NOT IN ('BOOLEAN', 'ARRAY', 'OBJECT') AND {number} IS NOT NULL", "integer": f"{k} NOT IN ('BOOLEAN', 'ARRAY', 'OBJECT') AND {number} = floor({number})", "boolean": f"{k} = 'BOOLEAN' OR lower({v}) IN ('true', 'false')"}[kind]
    absent = f"WHEN {k} IS NULL THEN {repr('missing') if need == 'must' else 'NULL'} WHEN {k} = 'NULL' THEN {'NULL' if need == 'may' else repr('null')}"
    tests = " ".join(f"WHEN {r.replace('@', number).replace('#', v)} THEN '{'length' if '#' in r else 'range'}'" for r in ranges)
    return f"SELECT rid, '{name}:' || CASE {absent} WHEN NOT coalesce({right}, FALSE) THEN 'type' {tests} END AS problem FROM judged WHERE domain = '{domain}'"


_FIELDS = (
    [_rule("orders", n, "string", "must") for n in ("order_id", "customer_id", "product_id")] + [_rule("orders", "quantity", "integer", "must", "@ < 1"), _rule("orders", "unit_price", "number", "must", "@ < 0"), _rule("orders", "discount_amount", "number", "default", "@ < 0"), _rule("orders", "currency", "string", "default", "length(#) <> 3")]
    + [_rule("orders", n, "string", "default") for n in ("status", "channel")] + [_rule("orders", n, "string", "may") for n in ("marketing_campaign_id", "region")]
    + [_rule("payments", n, "string", "must") for n in ("payment_id", "order_id", "customer_id", "status")] + [_rule("payments", "amount", "number", "must", "@ < 0"), _rule("payments", "currency", "string", "default", "length(#) <> 3"), _rule("payments", "payment_method", "string", "default"), _rule("payments", "failure_code", "string", "may"), _rule("payments", "risk_score", "number", "may", "@ < 0", "@ > 1")]
    + [_rule("users", n, "string", "must") for n in ("user_id", "action")] + [_rule("users", n, "string", "may") for n in ("session_id", "page", "referrer", "plan", "marketing_campaign_id")] + [_rule("users", "duration_seconds", "integer", "default", "@ < 0")]
    + [_rule("products", n, "string", "must") for n in ("product_id", "sku", "name", "category")] + [_rule("products", "price", "number", "must", "@ < 0"), _rule("products", "inventory_delta", "integer", "default"), _rule("products", "active", "boolean", "default")]
    + [_rule("system", n, "string", "must") for n in ("service_name", "status")] + [_rule("system", "latency_ms", "number", "may", "@ < 0"), _rule("system", "error_count", "integer", "default", "@ < 0"), _rule("system", "throughput_per_minute", "number", "may", "@ < 0"), _rule("system", "kafka_lag", "integer", "may", "@ < 0"), _rule("system", "cache_hit_rate", "number", "may", "@ < 0", "@ > 1"), _rule("system", "message", "string", "may")]
)
_JUDGED = f"""every AS (SELECT *, row_number() OVER () AS rid, {_DOMAIN} AS domain FROM raw_events), judged AS (SELECT *, payload::JSON AS j FROM every WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
  found AS (SELECT rid, string_agg(problem, '|' ORDER BY problem) AS v FROM ({" UNION ALL ".join(_FIELDS)}) WHERE problem IS NOT NULL GROUP BY 1),
  told AS (SELECT e.*, CASE WHEN domain IS NULL THEN NULL WHEN g.rid IS NULL THEN 'payload:type' ELSE coalesce(found.v, '') END AS violations FROM every e LEFT JOIN (SELECT rid FROM judged) g USING (rid) LEFT JOIN found USING (rid))"""

ORACLE = {
    "raw_events_lookback": "SELECT event_id, tenant_id, event_type, event_timestamp FROM raw_events WHERE event_timestamp >= TIMESTAMP '2018-01-15' AND event_type IN ('order.created', 'order.updated')",
    "parsed_events": f"WITH {_PARSED} SELECT trim(event_id) AS event_id, trim(tenant_id) AS tenant_id, event_type, event_timestamp, payload_version, coalesce(correlation_id, trace_id) AS correlation_id, coalesce(idempotency_key, event_id) AS idempotency_key FROM ev WHERE NOT bad",
    "validation_reasons": f"WITH {_PARSED} SELECT CASE WHEN NOT bad THEN domain END AS domain, reason, count(*) AS n FROM reasons GROUP BY 1, 2",
    "valid_invalid_counts": f"WITH {_PARSED} SELECT CASE WHEN reason IS NULL THEN 'valid' ELSE 'invalid' END AS status, count(*) AS n FROM reasons GROUP BY 1",
    "domain_counts": f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM raw_events GROUP BY 1",
    "tenant_filter": f"SELECT lower(trim(tenant_id)) AS tenant_id, count(*) AS n FROM raw_events WHERE lower(trim(tenant_id)) IN ('{TENANT}', 'quillmere') GROUP BY 1",
    "tenant_scope": f"SELECT event_type, count(*) AS n FROM raw_events WHERE lower(trim(tenant_id)) = '{TENANT}' GROUP BY 1",
    "normalized_events": "SELECT nullif(lower(trim(tenant_id)), '') AS tenant_id, strftime(event_timestamp, '%Y-%m-%d') AS event_date, split_part(event_type, '.', 1) AS domain_prefix, count(*) AS n FROM raw_events WHERE event_timestamp IS NOT NULL GROUP BY 1, 2, 3",
    "idempotent_ids": "SELECT event_id, landing_file, ingested_at, 'idem_' || substring(sha256(concat_ws('|', tenant_id, event_type, source_service, event_id)), 1, 32) AS idem_id FROM raw_events",
    "event_routing": f"WITH ev AS (SELECT *, {_DOMAIN} AS domain FROM raw_events WHERE json_valid(payload) AND tenant_id IS NOT NULL) SELECT event_id, ingested_at, domain || '.events' AS topic, lower(trim(tenant_id)) || ':' || coalesce(nullif({_KEYCASE}, ''), event_id) AS partition_key FROM ev",
    "dlq_payload": f"""WITH {_PARSED} SELECT CASE WHEN bad THEN 'unknown' ELSE coalesce(nullif(trim(tenant_id), ''), 'unknown') END AS key, CASE WHEN NOT bad THEN trim(event_id) END AS original_event_id, CASE WHEN NOT bad THEN trim(tenant_id) END AS tenant_id, CASE WHEN NOT bad THEN event_type END AS event_type,
      CASE WHEN NOT bad THEN source_service END AS source_service, reason AS rejection_reason, string_split(landing_file, '/')[2] || '.events' AS original_topic, try_cast(regexp_extract(landing_file, '([0-9]+)[.]jsonl$', 1) AS INT) AS original_partition, epoch_us(ingested_at) AS original_offset,
      '2018-02-09 00:00:00' AS dlq_written_at, TRUE AS has_original FROM reasons WHERE reason IS NOT NULL""",
    "dlq_inspect": f"WITH {_PARSED} SELECT reason, 'stream' AS failed_stage, count(*) AS n, count(*) FILTER (NOT bad) AS n_readable FROM reasons WHERE reason IS NOT NULL GROUP BY 1",
    "dlq_inspect_one": f"WITH {_PARSED} SELECT coalesce(nullif(trim(tenant_id), ''), 'unknown') AS key, reason, event_id FROM reasons WHERE reason IS NOT NULL AND NOT bad AND event_id = '{_REJECTED}'",
    "dlq_replay": f"""WITH {_PARSED} SELECT coalesce(domain, 'unrouted') || '.events' AS topic, 'replay_' || substring(sha256(event_id), 1, 24) AS event_id, event_id AS causation_id, 'replay_' || substring(sha256(event_id), 1, 24) AS idempotency_key, trim(tenant_id) AS tenant_id, event_type, source_service, trace_id,
      coalesce(correlation_id, trace_id) AS correlation_id, schema_ref, '2018-02-01T00:00:00.000000Z' AS event_timestamp, payload_version, CASE WHEN json_type(payload) = 'OBJECT' THEN array_to_string(list_sort(json_keys(payload)), '|') END AS payload_keys FROM reasons WHERE reason IS NOT NULL AND NOT bad AND event_id IS NOT NULL""",
    "dlq_reason_counts": f"WITH {_PARSED} SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY 1",
    "payload_contract": f"WITH {_JUDGED} SELECT event_id, landing_file, ingested_at, domain, violations FROM told",
    "payload_orders": f"""WITH {_JUDGED} SELECT lower(trim(tenant_id)) AS tenant_id, coalesce(payload ->> '$.currency', 'USD') AS currency, coalesce(payload ->> '$.status', 'created') AS status, coalesce(payload ->> '$.channel', 'web') AS channel, count(*) AS n, CAST(sum(CAST(payload ->> '$.quantity' AS BIGINT)) AS BIGINT) AS quantity,
      CAST(sum(CAST(payload ->> '$.unit_price' AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS prices, CAST(sum(coalesce(CAST(payload ->> '$.discount_amount' AS DECIMAL(18,2)), 0)) AS DECIMAL(18,2)) AS discounts FROM told WHERE domain = 'orders' AND violations = '' AND trim(tenant_id) <> '' AND event_timestamp IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "dlq_union": f"WITH {_PARSED}, {_CLASSES} SELECT reason, count(*) AS n, count(late) AS n_late FROM (SELECT reason, NULL::DOUBLE AS late FROM reasons WHERE reason IS NOT NULL UNION ALL SELECT 'event_time_watermark_exceeded', late FROM cl WHERE lateness = 'late_rejected') GROUP BY 1",
    "lateness_classes": f"WITH {_CLASSES} SELECT tenant_id, domain, lateness, count(*) AS n FROM cl GROUP BY 1, 2, 3",
    "lateness_split": f"WITH {_CLASSES} SELECT CASE WHEN lateness = 'late_rejected' THEN 'rejected' ELSE 'kept' END AS side, count(*) AS n FROM cl WHERE lateness IS NOT NULL GROUP BY 1",
    "late_event_audit": f"WITH {_CLASSES} SELECT tenant_id, event_id, lateness, min(ingested_at) AS ingested_at FROM cl WHERE lateness LIKE 'late%' GROUP BY 1, 2, 3",
    "late_event_summary": f"WITH {_CLASSES}, a AS (SELECT tenant_id, event_id, lateness, min(ingested_at) AS ingested_at FROM cl WHERE lateness LIKE 'late%' GROUP BY 1, 2, 3) SELECT lateness, count(*) AS n, max(ingested_at) AS latest FROM a GROUP BY 1",
    "batch_duplicates": f"WITH {_STORED} SELECT tenant_id, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT tenant_id, event_id, count(*) AS n FROM st GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1",
    "raw_dedup": f"WITH {_STORED}, {_DEDUP} SELECT tenant_id, event_id, ingested_at, landing_file FROM dd",
    "compacted_events": f"WITH {_STORED}, {_DEDUP} SELECT tenant_id, strftime(event_timestamp, '%Y-%m-%d') AS event_date, domain, count(*) AS n, min(event_id) AS first_event_id FROM dd GROUP BY 1, 2, 3",
    "enriched_events": f"WITH {_STORED} SELECT c.plan AS dim_plan, c.region AS dim_region, c.tenant_id IS NULL AS tenant_missing, count(*) AS n FROM st LEFT JOIN tenant_config c ON lower(trim(c.tenant_id)) = st.tenant_id GROUP BY 1, 2, 3",
    "window_metrics": f"WITH {_STORED}, {_WSRC} SELECT tenant_id, domain, time_bucket(INTERVAL 5 MINUTE, event_timestamp) AS window_start, time_bucket(INTERVAL 5 MINUTE, event_timestamp) + INTERVAL 5 MINUTE AS window_end, {_WIN} FROM src GROUP BY 1, 2, 3, 4",
    "sliding_metrics": f"WITH {_STORED}, {_WSRC}, sl AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, event_timestamp) - off AS ws FROM src, (SELECT unnest([INTERVAL 0 MINUTE, INTERVAL 15 MINUTE]) AS off)) SELECT tenant_id, domain, ws AS window_start, ws + INTERVAL 30 MINUTE AS window_end, {_WIN} FROM sl GROUP BY 1, 2, 3, 4",
    "window_metrics_long": f"WITH {_STORED}, {_WSRC}, wide AS (SELECT tenant_id, domain, date_trunc('hour', event_timestamp) AS window_start, date_trunc('hour', event_timestamp) + INTERVAL 1 HOUR AS window_end, {_WIN} FROM src GROUP BY 1, 2, 3, 4) {_LONG}",
    "session_windows": f"""WITH {_STORED}, u AS (SELECT tenant_id, event_timestamp AS ts FROM st WHERE domain = 'users'),
      f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM u),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
      SELECT tenant_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY tenant_id, k""",
    "upsert_latest": f"WITH {_STORED} SELECT tenant_id, date_trunc('hour', event_timestamp) AS metric_hour, count(*) AS n, 2 AS batch_id FROM st GROUP BY 1, 2",
    "insert_if_absent": f"WITH {_STORED} SELECT tenant_id, count(DISTINCT event_id) AS n FROM st GROUP BY 1",
}
