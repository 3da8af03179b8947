"""Registered measures and ratios over daily facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: measure: (aggregate, column, type)
MEASURES = {
    "net_revenue": ("sum", "net_revenue", "decimal(18,2)"),
    "gross_revenue": ("sum", "gross_revenue", "decimal(18,2)"),
    "order_count": ("sum", "order_count", "bigint"),
    "active_users": ("sum", "active_users", "bigint"),
    "payment_failure_count": ("sum", "payment_failure_count", "bigint"),
}
#: ratio: (numerator, denominator), both measures
RATIOS = {"average_order_value": ("net_revenue", "order_count")}
GRAINS = ("day", "week", "month", "quarter", "year")


def measured(df: DataFrame, time: str, grain: str, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Every measure and ratio per period of ``grain`` and per ``by``; a ratio over 0 is null."""
    if grain not in GRAINS:
        raise ValueError(f"no grain {grain!r}")
    period = F.date_trunc(grain, F.col(time)).cast("date")
    sums = [getattr(F, f)(c).cast(t).alias(m) for m, (f, c, t) in MEASURES.items()]
    per = df.groupBy(*by, period.alias("period")).agg(*sums)
    ratio = [(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0))).alias(r) for r, (a, b) in RATIOS.items()]
    return per.select(F.lit(grain).alias("grain"), *by, "period", *MEASURES, *ratio)
