"""Change capture: an external snapshot against the latest stored state, and index against table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["identifier", "record_type"]


def snapshot_diff(external: DataFrame, internal: DataFrame, keys: list[str] | None = None, force: bool = False) -> DataFrame:
    """keys, action: create, update, delete or null for unchanged; one full join of hashes, no payloads.

    force makes an update of every record that is on both sides.
    """
    keys = keys or KEYS
    left = external.select(*keys, F.col("source_hash").alias("new_hash"), F.lit(True).alias("_new"))
    right = internal.select(*keys, F.col("source_hash").alias("old_hash"), F.lit(True).alias("_old"))
    changed = F.lit(True) if force else ~F.col("new_hash").eqNullSafe(F.col("old_hash"))
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").when(changed, "update")
    return left.join(right, keys, "full_outer").select(*keys, action.alias("action"), "new_hash", "old_hash")


def deletions(external: DataFrame, internal: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stored keys that the snapshot lacks."""
    keys = keys or KEYS
    return internal.select(*keys).join(external.select(*keys), keys, "left_anti").withColumn("action", F.lit("delete"))


def modified_since(files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed files to take, those never stored or modified after their last run ended, and those to ignore."""
    known = stored.select("identifier", "date_finished")
    both = files.join(known, "identifier", "left")
    take = F.col("date_finished").isNull() | (F.col("modified_date") > F.col("date_finished"))
    take = F.coalesce(take, F.lit(False))
    return both.where(take).drop("date_finished"), both.where(~take).drop("date_finished")


def without_identifier(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a usable identifier, and error rows for the others with the best label there is."""
    label = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("description"), F.lit("")), F.lit("no-identifier"))
    blank = F.col("identifier").isNull() | (F.trim("identifier") == "")
    return records.where(~blank), records.where(blank).withColumn("label", label).withColumn("status", F.lit("error"))


def job_counters(diff: DataFrame) -> DataFrame:
    """One row: how many records a job is to add, update, delete, leave, and take on in all; lifecycle.counters() counts what came of them."""
    counted = [F.count_if(F.col("action") == a).alias(f"records_{n}") for a, n in (("create", "added"), ("update", "updated"), ("delete", "deleted"))]
    return diff.agg(F.count("*").alias("records_total"), *counted, F.count_if(F.col("action").isNull()).alias("records_ignored"))


def reconcile(stored: DataFrame, indexed: DataFrame, key: str = "id", value: str = "stamp") -> DataFrame:
    """(key, state): missing from the index, extra in it, or stale there; equal rows are left out."""
    left = stored.select(key, F.col(value).alias("_a"), F.lit(True).alias("_s"))
    right = indexed.select(key, F.col(value).alias("_b"), F.lit(True).alias("_i"))
    state: Column = F.when(F.col("_i").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "stale")
    return left.join(right, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def reconcile_gate(found: DataFrame, most_missing: int = 50) -> bool:
    """Whether an index may be taken into use: nothing extra or stale, and few missing."""
    n = {r["state"]: r["n"] for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}  # three rows at most
    return not n.get("extra") and not n.get("stale") and n.get("missing", 0) <= most_missing


def to_fetch(files: DataFrame, stored: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """modified_since(), but a forced job takes every listed file."""
    return (files, files.limit(0)) if force else modified_since(files, stored)


def harvest(external: DataFrame, internal: DataFrame, job_type: str = "harvest") -> DataFrame:
    """A job's plan: deletions first (phase 0), then creates and updates (phase 1).

    A clear job sees no external records. Deletions are found before duplicates are dropped, as any of a duplicated
    identifier keeps its stored record.
    """
    seen = external.limit(0) if job_type == "clear" else external
    named = seen.where(F.col("identifier").isNotNull() & (F.trim("identifier") != ""))
    gone = deletions(named, internal).select(*KEYS, "action", F.lit(0).alias("phase"))
    if job_type == "validate":
        return named.select(*KEYS, F.lit(None).cast("string").alias("action"), F.lit(1).alias("phase"))
    firsts = named.groupBy(*KEYS).agg(F.min_by("source_hash", "pos").alias("source_hash"))
    kept = snapshot_diff(firsts, internal, force=job_type == "force").where("action in ('create', 'update')")
    return gone.unionByName(kept.select(*KEYS, "action", F.lit(1).alias("phase")))
