"""Merging batches into keyed tables: last or first write wins, first values kept, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each key in ``order``, which must be total for a defined result. Hot keys combine before the shuffle; nulls come first."""
    return _pick(df, keys, order, F.min_by)


def last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key in ``order``, as :func:`first`."""
    return _pick(df, keys, order, F.max_by)


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``current`` after ``batch``: per key the row with the greatest ``version``; replaying a batch changes nothing."""
    return last(current.unionByName(batch), keys, [version])


def add(current: DataFrame, deltas: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``current`` after ``key += delta``: measures are summed, a null counts as 0. Not idempotent: deltas must be of events that weren't counted yet."""
    every = current.select(*keys, *measures).unionByName(deltas.select(*keys, *measures))
    return every.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(m), F.lit(0).cast(current.schema[m].dataType))).cast(current.schema[m].dataType).alias(m) for m in measures])


def monotone(current: DataFrame, batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Watermarks that never fall back: of each key the row with the greatest ``position``, the stored one if equal."""
    both = current.withColumn("_stored", F.lit(1)).unionByName(batch.withColumn("_stored", F.lit(0)))
    return last(both, keys, [position, "_stored"]).drop("_stored")


def replace_slice(current: DataFrame, fresh: DataFrame, inside: Column) -> DataFrame:
    """``current`` with the rows ``inside`` a slice deleted and those of ``fresh`` in it put in their place, as one step."""
    return current.filter(~F.coalesce(inside, F.lit(False))).unionByName(fresh.filter(inside).select(*current.columns))


def insert_absent(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and those rows of ``batch`` whose key it lacks, once each; rows with a null key are dropped."""
    fresh = batch.dropna(subset=keys).join(current.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return current.unionByName(fresh)


def keep_first_update_rest(df: DataFrame, keys: list[str], fixed: list[str], order: list[str]) -> DataFrame:
    """One row per key: ``fixed`` columns as first written, all others as last written.

    ``order`` breaks ties to the end; aggregates only, so hot keys combine before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in fixed]
    at = F.struct(*order)
    merged = df.groupBy(*keys).agg(F.min_by(F.struct(*fixed), at).alias("_f"), F.max_by(F.struct(*rest), at).alias("_l"))
    return merged.select(*keys, "_f.*", "_l.*")


def spread_rewrite(df: DataFrame, folder: str, partitions: list[str], rows_per_file: int = 1_000_000) -> None:
    """Rewrite whole partitions of a parquet dataset, others untouched; hot partitions spread over several tasks."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(16)))
    (
        salted.repartition(*partitions, "_salt")
        .drop("_salt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partitions)
        .parquet(folder)
    )
