"""The course of a harvest job: record states, counters, completion, and which issues end what."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of issue types: those that end a job, and those that end a record.
JOB_ISSUES = ("ExtractExternalException", "ExtractInternalException", "CompareException", "SendNotificationException", "ClearJobException")
RECORD_ISSUES = ("ExternalRecordToClass", "DuplicateIdentifierException", "TransformationException", "SpatialTransformationException", "DCATUSToCKANException", "SynchronizeException", "CKANRejectionException", "CKANDownException", "NoIdentifierException", "ValidationException", "ValidationError")
#: Fixed columns of a version that a compared record becomes.
VERSION = ("identifier", "harvest_job_id", "harvest_source_id", "source_hash", "source_raw", "action", "ckan_id", "parent_identifier", "record_type")


def issue_scope(kind: Column) -> Column:
    """What an issue of a type ends: the job, the record, or nothing known."""
    return F.when(kind.isin(*JOB_ISSUES), "job").when(kind.isin(*RECORD_ISSUES), "record")


def versions_of(compared: DataFrame, job: str, source: str) -> DataFrame:
    """Compared records as rows of the version log."""
    own = {"harvest_job_id": F.lit(job), "harvest_source_id": F.lit(source), **({} if "source_hash" in compared.columns else {"source_hash": F.col("new_hash")})}
    blank = F.lit(None).cast("string")
    return compared.select(*[(own[c] if c in own else F.col(c) if c in compared.columns else blank).alias(c) for c in VERSION])


def states(records: DataFrame, issues: DataFrame) -> DataFrame:
    """records with their state after a job: error where an issue of that severity names them, else success; synced tells which are taken on, warned which have a warning."""
    marks = issues.groupBy(F.col("harvest_record_id").alias("id")).agg(F.bool_or(F.col("severity") == "error").alias("_error"), F.bool_or(F.col("severity") == "warning").alias("_warning"))
    out = records.drop("status").join(marks, "id", "left")
    failed = F.coalesce("_error", F.lit(False))
    return out.withColumns({"status": F.when(failed, "error").otherwise("success"), "synced": ~failed & F.col("action").isNotNull(), "warned": F.coalesce("_warning", F.lit(False))}).drop("_error", "_warning")


#: What a record's action counts as.
COUNTED = {"added": "create", "updated": "update", "deleted": "delete"}


def counter_columns(validate_only: bool = False) -> list:
    """The outcome counters as aggregates of records with their states."""
    good = F.col("status") == "success"
    named = {name: good & (F.col("action") == action) for name, action in COUNTED.items()}
    rest = {"ignored": good & F.col("action").isNull() & F.lit(not validate_only), "errored": ~good, "validated": good & F.lit(validate_only), "warned": F.col("warned")}
    return [F.count("*").alias("records_total"), *[F.count_if(test).alias(f"records_{name}") for name, test in (named | rest).items()]]


def counters(done: DataFrame, by: tuple[str, ...] = (), validate_only: bool = False) -> DataFrame:
    """Outcome counters of records with their states (action, status, warned): a record with an error counts as that and nothing else."""
    return done.groupBy(*by).agg(*counter_columns(validate_only))


def planned_total(already: DataFrame, deletions: DataFrame, external: Mapping[str, DataFrame]) -> DataFrame:
    """One row: records already dealt with, deletions, and external records of every type, added up."""
    parts = [already, deletions, *external.values()]
    return reduce(DataFrame.union, [p.agg(F.count("*").alias("n")) for p in parts]).agg(F.sum("n").alias("records_total"))


def completed(jobs: DataFrame, outcome: DataFrame, now: str) -> DataFrame:
    """jobs with the counters of those that ended (outcome, by id): complete with an end, but an error stays one and keeps what it had."""
    counted = [c for c in outcome.columns if c != "id"]
    new = outcome.select("id", F.lit(True).alias("_ended"), *[F.col(c).alias(f"_new_{c}") for c in counted])
    ends = F.coalesce(F.col("_ended") & ~F.col("status").eqNullSafe("error"), F.lit(False))
    changed = {"status": F.lit("complete"), "date_finished": F.lit(now).cast("timestamp"), **{c: F.col(f"_new_{c}") for c in counted}}
    both = jobs.join(new, "id", "left")
    return both.select(*[F.when(ends, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def clear_issues(jobs: DataFrame, left: DataFrame) -> DataFrame:
    """An issue for each clear job whose source still has live records (harvest_source_id)."""
    rows = jobs.where("job_type = 'clear'").join(left.select("harvest_source_id").distinct(), "harvest_source_id", "left_semi")
    return rows.select(F.col("id").alias("harvest_job_id"), F.lit("ClearJobException").alias("type"), F.lit("the source was not cleared completely").alias("message"))


def transformed(versions: DataFrame, results: DataFrame) -> DataFrame:
    """Versions with their transformed payload (id, payload) saved; where there is none the old one stays."""
    return versions.join(results.select("id", F.col("payload").alias("_payload")), "id", "left").withColumn("source_transform", F.coalesce("_payload", "source_transform")).drop("_payload")


def validator_for(validators: Mapping[str, object], record_type: str):
    """The validator of a record type; an unknown type is an error, never another type's validator."""
    if record_type not in validators:
        raise ValueError(f"no validator for records of type {record_type!r}")
    return validators[record_type]
