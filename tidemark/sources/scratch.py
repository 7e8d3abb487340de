"""Tables that a session writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset and the master local (as in tests) a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/") if "://" in named or named.startswith("file:") else f"file://{named.rstrip('/')}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path; what it holds goes when the session's process ends."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner then clears it
        pass


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder last changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a table: computed once, lineage cut, and readable after any executor is lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
