"""Per-key results when a few keys hold most rows.

Rows are first grouped by key and value, where a hot key spreads over its values and
the map-side combine does most of the work; the results per key come from the weighted
values. Ranks are found by refinement: counts of coarse values place the wanted rank in
one of them, exact values inside that one settle it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage


def weighted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each key has each value. Nulls are a value of their own."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def distinct_and_mode(weights: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact count of distinct non-null values, and the most frequent one (ties: the least), per key."""
    there = F.col(value).isNotNull()
    most = F.min(F.when(there, F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))["v"]
    return weights.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count_if(there).alias("n_distinct"), most.alias("mode"))


def _locate(counts: DataFrame, keys: list[str], by: list[str], rank: Column) -> DataFrame:
    """The row of ``counts`` (weights n) in which the ``rank``-th item falls, with the rank left inside it."""
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).withColumn("_rank", rank)
    return ranked.filter("_rank <= _upto and _rank > _upto - n").select(*keys, *by, (F.col("_rank") - F.col("_upto") + F.col("n")).alias("_rank"))


def at_percentile(df: DataFrame, keys: list[str], value: str, tie: str, percent: int, coarse: int, prefix: int = 14) -> DataFrame:
    """Of each key the row at position ceil(percent/100 x n), counted from 1, in order of (value, tie).

    ``value`` is an integer column, ``tie`` a string column; rows with a null key, value
    or tie are left out, of equal rows any is the same row. Result: keys, value, tie.
    Rank refinement: buckets of ``coarse`` values, then weights of (value, first
    ``prefix`` characters of tie), then the few rows that share both.
    """
    rows = df.select(*keys, value, tie).dropna().withColumn("_bucket", F.floor(F.col(value) / coarse).cast("bigint"))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    wanted = F.floor((total * percent + 99) / 100).cast("bigint")
    bucket = _locate(counts, keys, ["_bucket"], wanted)

    inside = cut_lineage(rows.join(bucket, [*keys, "_bucket"]).withColumn("_prefix", F.substring(tie, 1, prefix)))
    finer = inside.groupBy(*keys, value, "_prefix").agg(F.count("*").alias("n"), F.max("_rank").alias("_wanted"))
    spot = _locate(finer, keys, [value, "_prefix"], F.col("_wanted")).withColumnRenamed("_rank", "_left")

    last = inside.join(spot, [*keys, value, "_prefix"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(tie))
    return last.withColumn("_place", place).filter("_place = _left").select(*keys, value, tie)


def values_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], coarse: float) -> DataFrame:
    """Of each key the values at the positions ``rank(n)``, counted from 1, of its n non-null values in order.

    As :func:`at_percentile` without ties to break, and for several ranks at once: the
    rows become weights of (key, value) in one pass, written once; buckets of ``coarse``
    values hold the ranks, the weights inside those buckets settle them. Result: keys
    and a column per rank.
    """
    weights = cut_lineage(weighted(df.select(*keys, value).dropna(), keys, value).withColumn("_bucket", F.floor(F.col(value) / coarse).cast("bigint")))
    counts = weights.groupBy(*keys, "_bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("n").over(w))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_total")).cast("bigint").alias("_rank")) for name, rank in ranks.items()]))
    spots = ranked.select("*", wanted.alias("_w")).select(*keys, "_bucket", "_upto", "n", "_w.*").filter("_rank <= _upto and _rank > _upto - n")
    spots = spots.select(*keys, "_bucket", "_name", (F.col("_rank") - F.col("_upto") + F.col("n")).alias("_wanted"))
    found = _locate(weights.join(spots, [*keys, "_bucket"]), [*keys, "_name"], [value], F.col("_wanted"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks])
