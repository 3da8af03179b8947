"""Queries p8 to p10; SQL can express only the integrity of p9, so tests hold the others against brute force and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, packing, pii
from eventloom.session import cut_lineage
from eventloom.sources.tables import table

#: Tokens of a container.
CAPACITY = 2048


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def p9_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.windows(bpe.token_counts(table(spark, d, "documents")), CAPACITY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Of each container the pieces, the tokens and the share of its capacity in use."""
    w = p9_windows(spark, d).groupBy("window_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return w.withColumn("fill", F.col("n_tokens") / F.lit(CAPACITY))


def p9_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text, and how many of them come out of the containers with other tokens than they went in or in more pieces than they need; containers above capacity."""
    sizes = cut_lineage(bpe.token_counts(table(spark, d, "documents")))
    pieces = packing.windows(sizes, CAPACITY)
    back = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("out"), F.count("*").alias("n_pieces"), F.max(F.col("token_start") + F.col("n_tokens")).alias("reach"), F.count_if(F.col("token_start") != F.col("piece_no") * CAPACITY).alias("moved"))
    both = sizes.filter("n_tokens > 0").join(back, "doc_id", "full_outer")
    off = (F.col("n_tokens").eqNullSafe(F.col("out")) & F.col("n_tokens").eqNullSafe(F.col("reach")) & (F.col("moved") == 0)).alias("ok")
    split = F.col("n_pieces") != F.ceil(F.col("n_tokens") / CAPACITY)
    docs = both.agg(F.count("*").alias("n_documents"), F.count_if(~F.coalesce(off, F.lit(False))).alias("n_off"), F.count_if(split).alias("n_split"))
    over = pieces.groupBy("window_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("n_over"))
    zero = F.lit(0).cast("bigint")
    rows = docs.withColumn("n_over", zero).unionByName(over.select(zero.alias("n_documents"), zero.alias("n_off"), zero.alias("n_split"), "n_over"))
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), table(spark, d, "person_names"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "person_names"))


QUERIES = {f.__name__: f for f in (p8_ids, p9_windows, p9_fill, p9_integrity, p10_found, p10_redacted)}
# tokens are beyond SQL, but not that none is lost
ORACLE = {"p9_integrity": "SELECT count(*) AS n_documents, 0::BIGINT AS n_off, 0::BIGINT AS n_split, 0::BIGINT AS n_over FROM documents WHERE text <> ''"}
