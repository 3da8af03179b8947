"""One row per event: redelivered copies collapse to their first arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.tenancy import key_of


def first_arrivals(events: DataFrame, **carried: Column) -> DataFrame:
    """Each (tenant, event) once, with its earliest arrival.

    ``events`` has tenant_id, event_id, event_timestamp, ingested_at. Result:
    tenant_id (trimmed, lower case), event_id, event_timestamp, arrived_at, and each
    of ``carried`` as it stands in the first arrival that has it (ties: least value).

    Rows without a tenant, event_id or event_timestamp are left out. Should copies
    differ in event_timestamp, the earliest counts. An event none of whose copies has
    an ingested_at has a null arrived_at. The aggregate combines before its one
    shuffle and has no hot key, as (tenant, event) is nearly unique.
    """
    rows = events.select(
        key_of("tenant_id").alias("tenant_id"),
        F.col("event_id"),
        F.col("event_timestamp"),
        F.col("ingested_at"),
        *[c.alias(name) for name, c in carried.items()],
    ).filter("tenant_id is not null and event_id is not null and event_timestamp is not null")
    at = F.coalesce(F.col("ingested_at"), F.lit("9999-12-31").cast("timestamp_ntz"))
    return rows.groupBy("tenant_id", "event_id").agg(
        F.min("event_timestamp").alias("event_timestamp"),
        F.min("ingested_at").alias("arrived_at"),
        *[
            F.min(F.when(F.col(name).isNotNull(), F.struct(at.alias("at"), F.col(name).alias("value"))))["value"].alias(name)
            for name in carried
        ],
    )
