"""Sessions and session settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job wants. Sizes (shuffle partitions, advisory size) are left to
#: the cluster's own configuration; adaptive execution coalesces and splits at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.schemaInference": "false",
    # copies written by cut_lineage go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8, app: str = "eventloom") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """Pin the time zone in which the tables' zoneless timestamps are read: they mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and continue from the copy.

    The folder is ``spark.checkpoint.dir``, shared by all executors, so the copy
    survives the loss of any of them. Only where nothing is set (tests, one machine)
    a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = os.path.join(tempfile.gettempdir(), "eventloom-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
