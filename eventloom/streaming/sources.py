"""Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventloom.streaming.config import StreamConfig

RECORD = T.StructType([T.StructField("value", T.StringType()), T.StructField("ingested_at", T.TimestampType())])


def kafka_options(config: StreamConfig) -> dict[str, str]:
    """What the Kafka reader is told; settings of the configuration may override it."""
    if not config.kafka_servers:
        raise ValueError("no Kafka servers")
    limit = {"maxOffsetsPerTrigger": str(config.max_offsets_per_trigger)} if config.max_offsets_per_trigger else {}
    return {"kafka.bootstrap.servers": config.kafka_servers, "subscribe": ",".join(config.topics), "startingOffsets": config.starting_offsets, "failOnDataLoss": "false"} | limit | config.options


def kafka(spark: SparkSession, config: StreamConfig) -> DataFrame:
    """Records of all topics; the broker's timestamp is the arrival."""
    return spark.readStream.format("kafka").options(**kafka_options(config)).load().selectExpr("cast(value as string) as value", "timestamp as ingested_at", "topic", "partition", "offset")


def records(spark: SparkSession, config: StreamConfig, folder: str | None = None) -> DataFrame:
    """The job's input: Kafka where servers are configured, else parquet files under ``folder``."""
    if config.kafka_servers:
        return kafka(spark, config)
    if not folder:
        raise ValueError("neither Kafka servers nor a folder")
    return files(spark, folder)


def files(spark: SparkSession, folder: str, schema: T.StructType = RECORD, max_files: int | None = None) -> DataFrame:
    """Parquet files as they land."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def rate(spark: SparkSession, rows_per_second: int = 20) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Landing files, one envelope a line; the line's arrival is when its file is read."""
    return spark.readStream.text(folder).selectExpr("value", "current_timestamp() as ingested_at")
