"""Session defaults: UTC, adaptive execution, and room for large scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """A session with the defaults; a cluster's own settings and the given ones go before."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, for functions that cost far more than reading their rows: a small file is a single task, and adaptive execution makes one of few bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
