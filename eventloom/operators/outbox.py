"""States of rows that wait to be sent: pending, publishing, then published, pending again or failed.

Columns: outbox_id, status, attempts, created_at, available_at, error_message, published_at.
Each step returns the whole table with the rows it concerns rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def lease(df: DataFrame, n: int, now: Column) -> DataFrame:
    """The ``n`` oldest pending rows that are due become ``publishing``, with one attempt more.

    A top-n over the pending rows, of which only ids move, and a join back on them; ``n``
    is a dispatcher's batch, a few thousand at most.
    """
    if not 0 < n <= 10_000:
        raise ValueError("a lease of 1 to 10,000 rows")
    due = df.filter((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("created_at", "outbox_id").limit(n).select("outbox_id", F.lit(True).alias("_due"))
    marked = df.join(F.broadcast(due), "outbox_id", "left")
    return _set(marked, F.col("_due").isNotNull(), attempts=F.col("attempts") + 1, status=F.lit("publishing")).drop("_due")


def published(df: DataFrame, which: Column, now: Column) -> DataFrame:
    """Rows in flight that were sent."""
    return _set(df, which & (F.col("status") == "publishing"), published_at=now, error_message=F.lit(None).cast("string"), status=F.lit("published"))


def failed(df: DataFrame, which: Column, max_attempts: int, delay_seconds: int, now: Column, error: str) -> DataFrame:
    """Rows in flight that couldn't be sent: pending again after a delay, or failed after the last attempt."""
    later = now + F.expr(f"interval {int(delay_seconds)} seconds")
    status = F.when(F.col("attempts") >= max_attempts, "failed").otherwise("pending")
    return _set(df, which & (F.col("status") == "publishing"), available_at=later, error_message=F.lit(error), status=status)
