"""A job's counters while it runs: every stage that is written tells its own in the same pass, and they outlive the job.

A stage is a part of a job's records (its deletions, its creates and updates, a micro-batch of a stream). Its counters are observed as its rows are written
and go to a row of the job's progress, by the stage's number, so a stage that runs again leaves one row. The running sums of these rows
only grow, and after the last stage they are the job's counters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.lifecycle import COUNTED, counter_columns

NAMES = ["records_total", *(f"records_{n}" for n in (*COUNTED, "ignored", "errored", "validated", "warned"))]


def write_stage(done: DataFrame, number: int, job: str, out_path: str, progress_path: str, validate_only: bool = False) -> dict:
    """Write a stage's records (action, status, warned and more) and its row of progress; the counters."""
    seen, columns = Observation(), counter_columns(validate_only)
    done.observe(seen, *columns).write.mode("overwrite").parquet(f"{out_path}/stage={number}")
    counted = {name: seen.get.get(name) or 0 for name in NAMES}
    row = done.sparkSession.createDataFrame([(job, *counted.values())], f"job string, {', '.join(f'{c} long' for c in counted)}").withColumn("at", F.current_timestamp())
    row.write.mode("overwrite").parquet(f"{progress_path}/stage={number}")
    return counted


def run(stages: Iterable[DataFrame], job: str, out_path: str, progress_path: str, tell: Callable[[dict], None] = lambda _: None) -> None:
    """Write a job's stages one after another; tell hears each stage's counters as it ends."""
    for number, done in enumerate(stages):
        tell(write_stage(done, number, job, out_path, progress_path))


def stream(done: DataFrame, job: str, out_path: str, progress_path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream of records, a stage for each micro-batch."""
    return done.writeStream.foreachBatch(lambda batch, number: write_stage(batch, number, job, out_path, progress_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(job, stage, counters so far) after every stage that has ended."""
    rows = spark.read.parquet(path)
    so_far = Window.partitionBy("job").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)  # a row per stage
    return rows.select("job", "stage", *[F.sum(c).over(so_far).alias(c) for c in NAMES])
