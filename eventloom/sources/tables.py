"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name`` as stored under ``folder``; readers select their columns, the scan reads no others."""
    return utc(spark).read.parquet(f"{folder}/{name}.parquet")
