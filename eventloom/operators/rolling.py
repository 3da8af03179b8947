"""Totals and averages over trailing periods, for every calendar day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.tenancy import key_of


def daily_values(metrics: DataFrame, value: str = "net_revenue", entity: str = "tenant_id", day: str = "metric_date", version: str = "updated_at") -> DataFrame:
    """(entity, day, value): of several rows for a day the latest version counts.

    Equal versions: the greatest value; a null value is the least. Null values count
    as 0. Rows without an entity or day are left out.
    """
    rows = metrics.select(key_of(entity).alias("entity"), F.col(day).cast("date").alias("day"), F.col(version).alias("version"), F.col(value).alias("value"))
    latest = rows.filter("entity is not null and day is not null").groupBy("entity", "day").agg(F.max(F.struct("version", "value"))["value"].alias("value"))
    return latest.withColumn("value", F.coalesce("value", F.lit(0)).cast("decimal(28,2)"))


def calendar(daily: DataFrame, width: int) -> DataFrame:
    """Every day of each entity from its first to its last, with the first and the day's bucket of ``width`` days.

    Only the buckets are shuffled; their days come after that and stay where they are.
    """
    spans = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    buckets = spans.withColumn("bucket", F.explode(F.sequence(_bucket("first_day", width), _bucket("last_day", width)))).repartition("entity", "bucket")
    start = F.col("bucket") * width
    days = F.sequence(F.greatest("first_day", F.date_from_unix_date(start)), F.least("last_day", F.date_from_unix_date(start + (width - 1))))
    return buckets.select("entity", "bucket", "first_day", F.explode(days).alias("day"))


def _bucket(day: str, width: int) -> Column:
    return F.floor(F.unix_date(day) / width).cast("int")


def trailing(daily: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """sum_N and avg_N over days d-N+1..d for each calendar day d and each N of ``periods``.

    A range join: a calendar day matches the daily values within the longest period.
    Candidates come from coarse buckets as wide as that period: a value can only serve
    days of its own bucket and the next, so it is put into two, and the join is an equi
    join on (entity, bucket) with the bounds as a residual. A bucket of an entity holds
    at most 2 x width values, whatever the entity's share of the rows. A left join keeps
    the days without a value, and as a day lies in one bucket, the sums need no shuffle.

    Both sides are merged: sizes are estimated before the days are generated, so an
    estimate would have the whole calendar broadcast from the driver.
    """
    width = max(periods)
    own = _bucket("day", width)
    values = daily.select(F.col("entity").alias("value_entity"), F.col("day").alias("value_day"), "value", F.explode(F.array(own, own + 1)).alias("value_bucket"))
    age = F.datediff("day", "value_day")
    near = (F.col("entity") == F.col("value_entity")) & (F.col("bucket") == F.col("value_bucket")) & (age >= 0) & (age < width)
    matched = calendar(daily, width).hint("merge").join(values.hint("merge"), near, "left")
    out = matched.groupBy("entity", "bucket", "first_day", "day").agg(*[F.sum(F.when(age < n, F.col("value")).otherwise(0)).cast("decimal(28,2)").alias(f"sum_{n}") for n in periods])
    return out.select("entity", "first_day", "day", *[f"sum_{n}" for n in periods], *[(F.col(f"sum_{n}").cast("double") / n).alias(f"avg_{n}") for n in periods])


def collapses(rolled: DataFrame, short: int = 7, long: int = 30, ratio: int = 4) -> DataFrame:
    """Days on which the short average is under a ``ratio``-th of the long one, once a full long period lies behind."""
    full = F.datediff("day", "first_day") >= long - 1
    under = F.col(f"sum_{short}") * (ratio * long) < F.col(f"sum_{long}") * short
    return rolled.filter(full & under)
