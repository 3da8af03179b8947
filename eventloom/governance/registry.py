"""A registry of contract versions: idempotent registration, listings and what breaks between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSIONS = "subject string, version int, fingerprint string, n_fields bigint"


def offers(fields: DataFrame) -> DataFrame:
    """Contracts (domain_name, payload_version, field_name, json_type, is_required) as what is offered for
    registration: subject, place (order of offering) and a fingerprint of the sorted fields."""
    text = F.concat_ws(":", "field_name", "json_type", F.col("is_required").cast("string"))
    per = fields.groupBy(F.col("domain_name").alias("subject"), F.col("payload_version").alias("place")).agg(F.sort_array(F.collect_set(text)).alias("f"))
    return per.select("subject", "place", F.sha2(F.array_join("f", ","), 256).alias("fingerprint"), F.size("f").cast("bigint").alias("n_fields"))


def register(known: DataFrame, offered: DataFrame) -> DataFrame:
    """VERSIONS and is_latest after offers: a fingerprint the subject has keeps its version, a new one gets the next."""
    fresh = offered.join(known.select("subject", "fingerprint"), ["subject", "fingerprint"], "left_anti").groupBy("subject", "fingerprint").agg(F.min("place").alias("place"), F.max("n_fields").alias("n_fields"))
    top = known.groupBy("subject").agg(F.max("version").alias("_top"))
    # a subject has a handful of versions
    rank = F.row_number().over(Window.partitionBy("subject").orderBy("place", "fingerprint"))
    numbered = fresh.join(top, "subject", "left").select("subject", (F.coalesce("_top", F.lit(0)) + rank).cast("int").alias("version"), "fingerprint", "n_fields")
    every = known.select("subject", "version", "fingerprint", "n_fields").unionByName(numbered)
    return every.withColumn("is_latest", F.col("version") == F.max("version").over(Window.partitionBy("subject")))


def breaks(fields: DataFrame) -> DataFrame:
    """(subject, version, field_name, problem) where a version can't stand in for the one before it:
    removed, type_changed, newly_required or no_longer_required fields. The first version has none."""
    f = fields.select(F.col("domain_name").alias("subject"), F.col("payload_version").alias("version"), "field_name", "json_type", "is_required")
    numbers = f.select("subject", "version").distinct().withColumn("before", F.lag("version").over(Window.partitionBy("subject").orderBy("version"))).dropna()
    old = numbers.join(f.withColumnsRenamed({"version": "before", "json_type": "old_type", "is_required": "old_required"}), ["subject", "before"])
    new = numbers.join(f, ["subject", "version"])
    both = old.join(new.select("subject", "version", "field_name", "json_type", "is_required"), ["subject", "version", "field_name"], "full_outer")
    none = F.lit(None).cast("string")
    problem = (
        F.when(F.col("json_type").isNull(), "removed")
        .when(F.col("old_type").isNull(), F.when(F.col("is_required"), "newly_required").otherwise(none))
        .when(F.col("json_type") != F.col("old_type"), "type_changed")
        .when(F.col("is_required") & ~F.col("old_required"), "newly_required")
        .when(~F.col("is_required") & F.col("old_required"), "no_longer_required")
    )
    return both.select("subject", "version", "field_name", problem.alias("problem")).filter("problem is not null")
