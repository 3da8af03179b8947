"""Tenants: how their ids compare, and the mandatory scope of a query."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(column: str | Column) -> Column:
    """A reference as it compares: trimmed, lower case; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def scoped(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant. Fail-closed: without a tenant there are no rows."""
    if tenant is None or not tenant.strip():
        return df.filter(F.lit(False))
    return df.filter(key_of(column) == tenant.strip().lower())


def allowed(df: DataFrame, tenants: Iterable[str], column: str = "tenant_id") -> DataFrame:
    """Rows of the listed tenants; an empty list allows all."""
    listed = sorted({t.strip().lower() for t in tenants})
    return df.filter(key_of(column).isin(listed)) if listed else df


def matches(column: str, value: str | None) -> Column:
    """``column`` equals ``value``, or anything where no value is given."""
    return F.lit(True) if value is None else F.col(column) == value
