"""Shared pieces of the training-data operators: tables, words, scratch tables, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many rows and bytes; beyond it Spark's sort-merge join with skew splitting is used.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def columns(df: DataFrame) -> list[Column]:
    """Every column of df, whatever its name."""
    return [F.col(f"`{c}`") for c in df.columns]


def boxed(df: DataFrame, *more: Column) -> DataFrame:
    """df's rows as one struct, ``_doc``, so that its columns can't clash with those of an operator; with more columns beside it."""
    return df.select(F.struct(*columns(df)).alias("_doc"), *more)


#: Rows of a batch that goes to a Python worker; texts may be long.
BATCH_ROWS = 2000


def give_back() -> None:
    """Return a worker's free memory to the system: workers outlive their tasks, and several share an executor's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow with small batches, and with the memory given back after each task. The size of batches is a setting of the session, and stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (as in tests) a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/") if "://" in named or named.startswith("file:") else f"file://{named.rstrip('/')}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what it holds goes when the session's process ends."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete_path, spark, path)
    _made.append(path)
    return path


#: Scratch paths in the order in which they were made.
_made: list[str] = []


def made() -> int:
    """How many scratch paths there have been; release_since() takes it."""
    return len(_made)


def release_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the scratch tables made since a mark but for those to keep."""
    kept = {getattr(df, "_scratch", None) for df in keep}
    for path in _made[mark:]:
        if path not in kept:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner then clears it
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, lineage cut, and readable after any executor is lost."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        delete_path(df.sparkSession, path)


def width(df: DataFrame) -> Column:
    """About how many bytes a row of df has."""
    per = {"string": F.octet_length, "binary": F.octet_length}
    each = [F.size(F.col(f"`{c}`")) * 8 if kind.startswith("array") else per[kind](F.col(f"`{c}`")) if kind in per else F.lit(8) for c, kind in df.dtypes]
    return sum((F.greatest(F.coalesce(e, F.lit(0)), F.lit(0)).cast("long") for e in each), F.lit(16).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES bytes, else as it is. What is measured is a written table, so it is cheap."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df
