"""Expressions that must be evaluated once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once a row, whatever is built on them.

    The optimizer merges projections and pushes filters by writing an alias's expression
    in place of the alias, so a parse that ten expressions use is done ten times. It
    doesn't do so across a generator; this one yields a single row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
