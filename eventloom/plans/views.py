"""Typed views that the serving queries read: each domain's events once, and current rows of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.jsontext import object_map
from eventloom.functions.once import once
from eventloom.operators import upserts
from eventloom.sources.tables import table
from eventloom.tenancy import key_of

EVENT = ("tenant_id", "event_id")
ARRIVAL = ["ingested_at", "landing_file"]
MONEY = "decimal(18,2)"


def field(name: str, kind: str = "string") -> Column:
    return F.element_at("_p", name).try_cast(kind)


def _events(spark: SparkSession, d: str, prefix: str, key: str, **columns: Column) -> DataFrame:
    """Events of one domain whose payload names ``key``, each once, as its first copy has them: the first write wins.

    The prefix reaches the scan; payloads are parsed before the copies are dropped, so
    that only typed columns are shuffled.
    """
    rows = table(spark, d, "raw_events").filter(F.col("event_type").startswith(prefix) & F.col("event_timestamp").isNotNull() & F.col("event_id").isNotNull())
    typed = once(rows, _p=object_map("payload")).select(key_of("tenant_id").alias("tenant_id"), "event_id", "event_type", "event_timestamp", *ARRIVAL, *[c.alias(n) for n, c in columns.items()])
    return upserts.first(typed.filter(F.col("tenant_id").isNotNull() & F.col(key).isNotNull()), list(EVENT), ARRIVAL)


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """Order events with revenue: gross = quantity x unit_price, net = gross less discount, not below 0."""
    rows = _events(
        spark, d, "order.", "order_id", order_id=field("order_id"), customer_id=field("customer_id"), product_id=field("product_id"), quantity=field("quantity", "bigint"), unit_price=field("unit_price", MONEY),
        discount_amount=F.coalesce(field("discount_amount", MONEY), F.lit(0).cast(MONEY)), currency=F.coalesce(field("currency"), F.lit("USD")), status=F.coalesce(field("status"), F.lit("created")),
        channel=F.coalesce(field("channel"), F.lit("unknown")), marketing_campaign_id=field("marketing_campaign_id"), region=field("region"),
    )
    gross = (F.col("quantity") * F.col("unit_price")).cast(MONEY)
    net = F.when(gross.isNotNull(), F.greatest(gross - F.col("discount_amount"), F.lit(0)).cast(MONEY))
    return rows.withColumns({"gross_revenue": gross, "net_revenue": net})


def payment_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(
        spark, d, "payment.", "payment_id", payment_id=field("payment_id"), order_id=field("order_id"), customer_id=field("customer_id"), amount=field("amount", MONEY), currency=F.coalesce(field("currency"), F.lit("USD")),
        status=field("status"), payment_method=F.coalesce(field("payment_method"), F.lit("unknown")), failure_code=field("failure_code"), risk_score=field("risk_score", "decimal(5,4)"),
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """User events; an absent or empty session id becomes ``sessionless:<user>``, an absent duration 0."""
    rows = _events(
        spark, d, "user.", "user_id", user_id=field("user_id"), session_id=F.nullif(field("session_id"), F.lit("")), action=field("action"), page=field("page"), referrer=field("referrer"),
        duration_seconds=F.coalesce(field("duration_seconds", "bigint"), F.lit(0)), plan=field("plan"), marketing_campaign_id=field("marketing_campaign_id"),
    )
    return rows.withColumn("session_id", F.coalesce("session_id", F.concat(F.lit("sessionless:"), "user_id")))


def product_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(
        spark, d, "product.", "product_id", product_id=field("product_id"), sku=field("sku"), name=field("name"), category=field("category"), price=field("price", MONEY),
        inventory_delta=F.coalesce(field("inventory_delta", "bigint"), F.lit(0)), active=F.coalesce(field("active", "boolean"), F.lit(True)),
    )


def health(spark: SparkSession, d: str) -> DataFrame:
    return _events(
        spark, d, "system.", "service_name", service_name=field("service_name"), status=field("status"), latency_ms=field("latency_ms", "double"), error_count=F.coalesce(field("error_count", "bigint"), F.lit(0)),
        throughput_per_minute=field("throughput_per_minute", "double"), kafka_lag=field("kafka_lag", "bigint"), cache_hit_rate=field("cache_hit_rate", "double"), message=field("message"),
    )


MEASURES = ("gross_revenue", "net_revenue", "order_count", "units_sold", "new_users", "active_users", "churn_signal_count", "payment_success_count", "payment_failure_count", "attributed_revenue", "events_processed")


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """What each event, counted once at its first copy, adds to the figures of its hour and day.

    Only order payloads are parsed. An order without a readable quantity or price adds no revenue.
    """
    rows = table(spark, d, "raw_events").filter("event_timestamp is not null and event_id is not null")
    is_ = lambda *types: F.col("event_type").isin(*types)
    order = is_("order.created", "order.updated")
    parsed = once(rows, _p=object_map(F.when(order, F.col("payload"))))
    gross = (field("quantity", "bigint") * field("unit_price", MONEY)).cast(MONEY)
    typed = parsed.select(
        key_of("tenant_id").alias("tenant_id"), "event_id", "event_type", "event_timestamp", *ARRIVAL, gross.alias("gross"), F.coalesce(field("discount_amount", MONEY), F.lit(0).cast(MONEY)).alias("discount"),
        field("quantity", "bigint").alias("quantity"), field("marketing_campaign_id").alias("campaign"),
    ).filter("tenant_id is not null")
    once_each = upserts.first(typed, list(EVENT), ARRIVAL)
    one = lambda c: c.cast("bigint")
    none = F.lit(0).cast(MONEY)
    net = F.coalesce(F.greatest(F.col("gross") - F.col("discount"), F.lit(0)).cast(MONEY), none)
    net = F.when(F.col("gross").isNull(), none).otherwise(net)
    return once_each.select(
        *EVENT, "event_timestamp", "ingested_at", F.coalesce("gross", none).alias("gross_revenue"), net.alias("net_revenue"), one(order).alias("order_count"), F.coalesce("quantity", F.lit(0)).cast("bigint").alias("units_sold"),
        one(is_("user.signed_up")).alias("new_users"), one(is_("user.signed_up", "user.activity")).alias("active_users"), one(is_("user.churn_signal")).alias("churn_signal_count"),
        one(is_("payment.captured", "payment.authorized")).alias("payment_success_count"), one(is_("payment.failed")).alias("payment_failure_count"),
        F.when(F.col("campaign").isNotNull(), net).otherwise(none).alias("attributed_revenue"), F.lit(1).cast("bigint").alias("events_processed"),
    )


ORDER_FIXED = ["event_id", "customer_id", "product_id", "currency", "created_at"]
PAYMENT_FIXED = ["event_id", "order_id", "customer_id", "amount", "currency", "payment_method", "created_at"]
WRITTEN = ["updated_at", "event_id"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as they are after every write: what identifies an order as first written, the rest as last written."""
    return upserts.keep_first_update_rest(table(spark, d, "processed_orders"), ["tenant_id", "order_id"], ORDER_FIXED, WRITTEN)


def payments(spark: SparkSession, d: str) -> DataFrame:
    """Payments likewise; status, failure_code, risk_score and the times are what a later write changes."""
    return upserts.keep_first_update_rest(table(spark, d, "processed_payments"), ["tenant_id", "payment_id"], PAYMENT_FIXED, WRITTEN)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Stored daily metrics, of several rows for a day the latest."""
    return upserts.last(table(spark, d, "tenant_metrics_daily"), ["tenant_id", "metric_date"], ["updated_at", "net_revenue"])


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Landing files as pipeline runs: one run a file, its pipeline the file's domain."""
    files = table(spark, d, "raw_events").groupBy("landing_file").agg(F.count("*").alias("records_processed"), F.min("ingested_at").alias("started_at"), F.max("ingested_at").alias("finished_at"), F.count_if(F.col("payload").isNull()).alias("n_empty"))
    status = F.when(F.col("n_empty") > 0, "degraded").otherwise("succeeded")
    return files.select(F.concat(F.lit("landing:"), F.split_part("landing_file", F.lit("/"), F.lit(2))).alias("pipeline_name"), F.col("landing_file").alias("run_id"), status.alias("status"), "records_processed", "started_at", "finished_at")


VIEWS = {f.__name__: f for f in (order_events, payment_events, sessions, product_events, health, deltas, orders, payments, daily, runs)}
