"""Which jobs are due, stuck or failed, and what is looked up about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import next_run
from tidemark.functions.identity import UUID4


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def due(jobs: DataFrame, now: str, limit: int) -> DataFrame:
    """New jobs whose time has come, oldest first."""
    return jobs.where((F.col("status") == "new") & (F.col("date_created") < at(now))).orderBy("date_created", "id").limit(limit)


def free_slots(running: int, most: int = 5, from_task: bool = False) -> int:
    return min(max(0, most - running), 1) if from_task else max(0, most - running)


def orphaned(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs in progress for a day or more, newest first."""
    return jobs.where((F.col("status") == "in_progress") & (F.col("date_created") <= at(now) - F.expr("interval 1 day"))).orderBy(F.desc("date_created"), F.desc("id"))


def failed(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Jobs in progress without a running task (job_id)."""
    return jobs.where("status = 'in_progress'").join(tasks.select(F.col("job_id").alias("id")), "id", "left_anti")


def startable(jobs: DataFrame) -> DataFrame:
    """New jobs of sources that run none: one job a source at a time."""
    running = jobs.where("status = 'in_progress'").select("harvest_source_id").distinct()
    return jobs.where("status = 'new'").join(running, "harvest_source_id", "left_anti")


def next_jobs(sources: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """(harvest_source_id, date_created) of jobs to schedule: sources with a period that have none waiting."""
    waiting = jobs.where((F.col("status") == "new") & (F.col("date_created") > at(now))).select(F.col("harvest_source_id").alias("id"))
    return sources.where("frequency <> 'manual'").join(waiting, "id", "left_anti").select(F.col("id").alias("harvest_source_id"), next_run(at(now), F.col("frequency")).alias("date_created"))


def rescheduled(jobs: DataFrame, sources: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """jobs without some sources' waiting ones, and the jobs to schedule for them anew."""
    waiting = (F.col("status") == "new") & (F.col("date_created") > at(now))
    mine = sources.select(F.col("id").alias("harvest_source_id"), F.lit(True).alias("_mine"))
    kept = jobs.join(mine, "harvest_source_id", "left").where(~(waiting & F.col("_mine").isNotNull())).drop("_mine")
    return kept, next_jobs(sources, kept, now)


def first_by(rows: DataFrame, order: list, **equal) -> DataFrame:
    """The first row, in order, whose columns equal the given values."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), equal.items(), rows).orderBy(*order).limit(1)


def organization_of(organizations: DataFrame, name: str) -> DataFrame:
    """The organization of an id, else a slug, else an alias."""
    rank = F.when((F.col("id") == name) & F.lit(name).rlike(UUID4), 1).when(F.col("slug") == name, 2).when(F.array_contains("aliases", name), 3)
    return organizations.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


def place_named(locations: DataFrame, name: str) -> DataFrame:
    """The first place whose name contains some text, in any case."""
    return locations.where(F.contains(F.lower("display_name"), F.lower(F.lit(name)))).orderBy(F.col("type_order").asc_nulls_last(), "id").limit(1)


def notify(preference: Column, errored: Column, updated: Column) -> Column:
    """Whether a finished job is worth a message."""
    return (preference == "always") | ((preference == "on_error") & (errored > 0)) | ((preference == "on_error_or_update") & ((errored > 0) | (updated > 0)))


def finished(records: DataFrame, now: str, job: str | None = None) -> DataFrame:
    """records with their end set once; a forced job takes them over."""
    out = records.withColumn("date_finished", F.coalesce("date_finished", at(now)))
    return out if job is None else out.withColumn("harvest_job_id", F.lit(job))
