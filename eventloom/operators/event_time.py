"""Lateness, duplicates and windows over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.timeparts import micros

METRICS = ("event_count", "revenue", "order_count", "units_sold", "payment_success_count", "payment_failure_count", "late_accepted_count")
#: What the long form lists; event_count stands beside each as well.
LONG_METRICS = ("revenue", "order_count", "units_sold", "payment_success_count", "payment_failure_count", "event_count")


def classify(events: DataFrame, as_of: Column, on_time: int = 60, accept: int = 600) -> DataFrame:
    """Adds lateness_seconds and lateness: on_time, late_accepted or late_rejected; null where a time is."""
    if not 0 <= on_time <= accept:
        raise ValueError("on_time must be at most accept")
    late = (micros(as_of) - micros(F.col("event_timestamp"))) / F.lit(1_000_000)
    kind = F.when(late.isNull(), None).when(late <= on_time, "on_time").when(late <= accept, "late_accepted").otherwise("late_rejected")
    return events.withColumn("lateness_seconds", late).withColumn("lateness", kind)


def split_late(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); a null class is in neither."""
    return classified.filter("lateness <> 'late_rejected'"), classified.filter("lateness = 'late_rejected'")


def watermarked(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("event_timestamp", delay)


def dedup_stream(events: DataFrame) -> DataFrame:
    """One event per (tenant, event) within the watermark, state bounded by it."""
    return events.dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def mark_duplicates(events: DataFrame, order: list[Column]) -> DataFrame:
    """Adds is_duplicate: all but the first row of each (tenant, event)."""
    w = Window.partitionBy("tenant_id", "event_id").orderBy(*order)
    return events.withColumn("is_duplicate", F.row_number().over(w) > 1)


def enrich(events: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenant name, plan and region beside each event, and whether the tenant is missing.

    No hint: the planner broadcasts the dimension where its size allows.
    """
    dim = tenants.select(F.lower(F.trim("tenant_id")).alias("tenant_id"), F.col("tenant_name").alias("dim_tenant_name"), F.col("plan").alias("dim_plan"), F.col("region").alias("dim_region"), F.lit(True).alias("_hit"))
    return events.join(dim, "tenant_id", "left").withColumn("tenant_missing", F.col("_hit").isNull()).drop("_hit")


def windowed(events: DataFrame, size: str = "5 minutes", slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per tenant, domain and tumbling or sliding window.

    An order counts, with its revenue and units, where it is created; an update of it
    adds nothing. Its revenue is unit_price x quantity, a null quantity being 1; a
    payment's is its amount when authorized and when captured. A value that is no number
    counts as null. ``events`` has each event once, classified by :func:`classify`. Columns
    ``by`` (what depends on the tenant) are kept beside it.
    """
    number = lambda f, t: F.get_json_object("payload", f"$.{f}").try_cast(t)
    money = "decimal(18,2)"
    created, captured = F.col("event_type") == "order.created", F.col("event_type") == "payment.captured"
    quantity = number("quantity", "bigint")
    order_revenue = F.when(created, number("unit_price", money) * F.coalesce(quantity, F.lit(1)))
    payment_revenue = F.when(captured | (F.col("event_type") == "payment.authorized"), number("amount", money))
    total = lambda c: F.sum(F.coalesce(c.cast(money), F.lit(0).cast(money)))
    w = F.window("event_timestamp", size, slide) if slide else F.window("event_timestamp", size)
    return (
        events.groupBy("tenant_id", "domain", *by, w.alias("w"))
        .agg(
            F.count("*").alias("event_count"),
            (total(order_revenue) + total(payment_revenue)).cast(money).alias("revenue"),
            F.count_if(created).alias("order_count"),
            F.sum(F.coalesce(F.when(created, quantity), F.lit(0))).alias("units_sold"),
            F.count_if(captured).alias("payment_success_count"),
            F.count_if(F.col("event_type") == "payment.failed").alias("payment_failure_count"),
            F.count_if(F.col("lateness") == "late_accepted").alias("late_accepted_count"),
        )
        .select("tenant_id", "domain", *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *METRICS)
    )


def melted(wide: DataFrame) -> DataFrame:
    """Long form, one row per metric, by a single unpivot."""
    keys = ["tenant_id", "domain", "window_start", "window_end", "n_events"]
    return wide.select(*keys[:-1], F.col("event_count").alias("n_events"), *[F.col(m).cast("double").alias(m) for m in LONG_METRICS]).unpivot(keys, list(LONG_METRICS), "metric_name", "metric_value").withColumnRenamed("n_events", "event_count")
