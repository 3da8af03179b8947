"""Made-up event envelopes from a seed, for tests, exercises and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: tenant: (share of events in hundredths, average price); the last takes the rest.
TENANTS = {"alder": (50, 40), "briar": (30, 15), "clove": (20, 90)}
#: Weight of an hour of the day, and of a day of the week from Monday on.
HOURS = (1, 1, 1, 1, 1, 2, 3, 5, 8, 9, 9, 8, 7, 8, 9, 9, 8, 7, 6, 5, 4, 3, 2, 1)
WEEKDAYS = (6, 6, 6, 6, 8, 4, 3)
TYPES = ("order.created", "order.created", "payment.captured", "payment.failed", "user.activity", "user.activity", "user.activity", "product.inventory_changed", "system.health")


def _pick(number: Column, values: tuple | list, weights: tuple | list | None = None) -> Column:
    """One of ``values`` by a non-negative number, in proportion to whole weights."""
    every = [v for v, n in zip(values, weights or [1] * len(values)) for _ in range(n)]
    return F.element_at(F.array(*[F.lit(v) for v in every]), (number % len(every) + 1).cast("int"))


def envelopes(spark: SparkSession, n: int, seed: int, start: str = "2024-01-01", weeks: int = 4) -> DataFrame:
    """(value, ingested_at): ``n`` envelopes as JSON, the same for the same arguments on any cluster.

    Each value is drawn from a hash of the seed, the row and the value's name, so rows
    are made in parallel and in no order.
    """
    draw = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1 << 40))
    day = draw("week") % weeks * 7 + _pick(draw("day"), list(range(7)), WEEKDAYS)
    second = _pick(draw("hour"), list(range(24)), HOURS) * 3600 + draw("second") % 3600
    at = F.expr(f"timestamp_ntz'{start} 00:00:00'") + F.make_dt_interval(days=day, secs=second.cast("decimal(18,6)"))
    kind = _pick(draw("type"), TYPES)
    tenant = _pick(draw("tenant"), list(TENANTS), [w for w, _ in TENANTS.values()])
    price = _pick(draw("tenant"), [p for _, p in TENANTS.values()], [w for w, _ in TENANTS.values()])
    key = lambda prefix, size: F.concat(F.lit(prefix), F.lpad((draw(prefix) % size).cast("string"), 6, "0"))
    is_ = lambda prefix, c: F.when(kind.startswith(prefix), c)
    amount = F.round(price * (F.lit(50) + draw("amount") % 100) / 100, 2)
    payload = F.struct(
        F.coalesce(is_("order.", key("ord-", 100_000)), is_("payment.", key("ord-", 100_000))).alias("order_id"),
        is_("payment.", key("pay-", 100_000)).alias("payment_id"),
        F.coalesce(is_("order.", key("cus-", 5_000)), is_("payment.", key("cus-", 5_000))).alias("customer_id"),
        F.coalesce(is_("order.", key("prd-", 500)), is_("product.", key("prd-", 500))).alias("product_id"),
        is_("order.", draw("quantity") % 5 + 1).alias("quantity"),
        is_("order.", amount).alias("unit_price"),
        is_("payment.", amount).alias("amount"),
        F.coalesce(is_("payment.", F.substring_index(kind, ".", -1)), is_("system.", F.lit("ok"))).alias("status"),
        is_("user.", key("usr-", 5_000)).alias("user_id"),
        is_("user.", _pick(draw("action"), ("login", "search", "checkout"))).alias("action"),
        is_("product.", key("SK-", 500)).alias("sku"),
        is_("product.", key("name ", 500)).alias("name"),
        is_("product.", F.lit("general")).alias("category"),
        is_("product.", amount).alias("price"),
        is_("system.", _pick(draw("service"), ("intake", "ledger", "mailer"))).alias("service_name"),
    )
    trace = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")), 256), 1, 24)
    head = F.struct(
        F.concat(F.lit("gen-"), trace).alias("event_id"), tenant.alias("tenant_id"), kind.alias("event_type"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_timestamp"), F.lit("generator").alias("source_service"),
        F.lit(1).alias("payload_version"), trace.alias("trace_id"), payload.alias("payload"),
    )
    # most arrive at once, some minutes late
    late = F.when(draw("late") % 20 == 0, draw("delay") % 1200).otherwise(draw("delay") % 5)
    return spark.range(n).select(F.to_json(head).alias("value"), (at + F.make_dt_interval(secs=late.cast("decimal(18,6)"))).cast("timestamp").alias("ingested_at"))
