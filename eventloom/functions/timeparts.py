"""Time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a zoneless (UTC) or zoned timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def hour_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:00:00`` of the hour that holds ``c``."""
    return F.date_format(c, "yyyy-MM-dd HH:00:00")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
