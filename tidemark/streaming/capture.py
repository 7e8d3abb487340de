"""Change capture over a stream of snapshots: additions to the batch operators, which they reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.diff import snapshot_diff


def capture(snapshots: DataFrame, state_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch (identifier, record_type, source_hash) is a job: its changes against the state go to out_path/job=N and the new state to state_path/job=N.

    Both are overwritten by job number, so a batch that runs again leaves the same files.
    """

    def job(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_path}/job={number - 1}") if number else batch.limit(0)  # batches are numbered from 0 without gaps
        firsts = batch.groupBy("identifier", "record_type").agg(F.min("source_hash").alias("source_hash"))
        diff = snapshot_diff(firsts, state).where("action is not null")
        diff.write.mode("overwrite").parquet(f"{out_path}/job={number}")
        firsts.write.mode("overwrite").parquet(f"{state_path}/job={number}")

    return snapshots.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_actions(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of actions by day of a stream of records, rows later than the watermark left out."""
    return records.withWatermark("date_created", late).groupBy(F.window("date_created", "1 day").alias("day"), "action").agg(F.count("*").alias("n"))
