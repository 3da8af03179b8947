"""Declared data tests and metric contracts, each table checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Test:
    """``kind`` is not_null, accepted (values) or range (low, high); null passes all but the first."""

    model: str
    column: str
    kind: str
    values: tuple = ()

    __test__ = False  # not a test case, whatever collects this module

    def fails(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "accepted":
            return ~c.isin(*self.values)
        if self.kind == "range":
            return (c < self.values[0]) | (c > self.values[1])
        raise ValueError(f"no test {self.kind!r}")


TESTS = (
    Test("stg_orders", "tenant_id", "not_null"),
    Test("stg_orders", "order_id", "not_null"),
    Test("stg_orders", "net_revenue", "not_null"),
    Test("stg_payments", "tenant_id", "not_null"),
    Test("stg_payments", "payment_id", "not_null"),
    Test("stg_payments", "status", "accepted", ("authorized", "captured", "failed", "refunded", "pending")),
    Test("fct_tenant_daily", "tenant_id", "not_null"),
    Test("fct_tenant_daily", "metric_date", "not_null"),
    Test("fct_tenant_daily", "net_revenue", "not_null"),
    Test("fct_tenant_daily", "payment_failure_rate", "range", (0.0, 1.0)),
)


def _counted(df: DataFrame, flags: dict[tuple[str, ...], Column], names: tuple[str, ...]) -> DataFrame:
    """One aggregate over ``df``, a row per flag."""
    sums = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n{i}") for i, c in enumerate(flags.values())])
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, key)], F.col(f"n{i}").alias("n_failed")) for i, key in enumerate(flags)]
    return sums.select(F.inline(F.array(*rows)))


def run_tests(models: dict[str, DataFrame], tests: tuple[Test, ...]) -> DataFrame:
    """(model, column_name, test, n_failed, status), one scan a model whatever the number of its tests."""
    out = None
    for model, df in models.items():
        flags = {(model, t.column, t.kind): t.fails() for t in tests if t.model == model}
        part = _counted(df, flags, ("model", "column_name", "test"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("n_failed") > 0, "failed").otherwise("passed"))


@dataclass(frozen=True)
class MetricContract:
    metric: str
    query: str
    required: tuple[str, ...]
    non_negative: tuple[str, ...]


METRIC_CONTRACTS = (
    MetricContract("revenue", "fct_tenant_daily", ("metric_date", "gross_revenue", "net_revenue", "order_count", "units_sold", "average_order_value"), ("gross_revenue", "net_revenue", "order_count", "units_sold", "average_order_value")),
    MetricContract("customers", "metric_customers", ("metric_date", "new_users", "active_users"), ("new_users", "active_users")),
    MetricContract("churn", "metric_churn", ("metric_date", "churn_signal_count"), ("churn_signal_count",)),
    MetricContract("retention", "metric_retention", ("metric_date", "active_users", "churn_signal_count", "estimated_retention_rate"), ("active_users", "churn_signal_count", "estimated_retention_rate")),
)


def contract_violations(df: DataFrame, contract: MetricContract) -> DataFrame:
    """(metric, field_name, rule, n_failed) of a metric's result; a contract field it lacks is an error."""
    absent = [c for c in (*contract.required, *contract.non_negative) if c not in df.columns]
    if absent:
        raise ValueError(f"{contract.metric}: no field {', '.join(absent)}")
    flags = {(contract.metric, c, "required"): F.col(c).isNull() for c in contract.required}
    flags |= {(contract.metric, c, "non_negative"): F.col(c) < 0 for c in contract.non_negative}
    return _counted(df, flags, ("metric", "field_name", "rule"))
