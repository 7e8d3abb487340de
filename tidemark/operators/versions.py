"""The append-only record log: latest versions, live records, duplicates, outdated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.paging import numbered

IDENTITY = ("harvest_source_id", "identifier", "record_type")


def latest_versions(records: DataFrame, keys=IDENTITY, status: str | None = "success", columns: list[str] | None = None) -> DataFrame:
    """The latest successful version of each key. The rank is limited before the shuffle, and payloads that columns leaves out are never read."""
    rows = records if status is None else records.where(F.col("status") == status)
    if columns is not None:
        rows = rows.select(*dict.fromkeys([*columns, *keys, "date_created", "id"]))
    newest = Window.partitionBy(*keys).orderBy(F.col("date_created").desc_nulls_last(), F.col("id").desc_nulls_last())
    out = rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    return out if columns is None else out.select(*columns)


def latest_live(records: DataFrame, keys=IDENTITY, columns: list[str] | None = None) -> DataFrame:
    """Latest versions that aren't deletions. A null action is neither live nor deleted and drops out."""
    wanted = None if columns is None else [*dict.fromkeys([*columns, "action"])]
    out = latest_versions(records, keys, columns=wanted).where("action <> 'delete'")
    return out if columns is None else out.select(*columns)


def with_slug(latest: DataFrame, datasets: DataFrame) -> DataFrame:
    """Latest versions with the slug of the dataset that a version made, null where it made none."""
    slugs = datasets.select(F.col("harvest_record_id").alias("_record"), F.col("slug").alias("dataset_slug"))
    return latest.join(slugs, F.col("id") == F.col("_record"), "left").drop("_record")


def missing_datasets(records: DataFrame, datasets: DataFrame, keys=("harvest_source_id", "identifier")) -> DataFrame:
    """Live dataset records for which no dataset stands."""
    live = latest_live(records.where("record_type = 'dataset'"), keys)
    return live.join(datasets.select(F.col("harvest_record_id").alias("id")), "id", "left_anti")


def unexpected_datasets(records: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets whose record is a deletion or failed."""
    states = records.select(F.col("id").alias("harvest_record_id"), "status", "action", "harvest_source_id")
    return datasets.select("id", "slug", "harvest_record_id").join(states, "harvest_record_id").where("action = 'delete' or status <> 'success'")


def outdated_records(records: DataFrame, days: int, now: str) -> DataFrame:
    """Records older than so many whole days that aren't the latest live version of anything.

    The difference is one of bags, so of rows that repeat, id and all, as many go as are live: none but the first of each.
    """
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("date_created")) / 86400)
    return records.where(age > days).exceptAll(latest_live(records).select(*records.columns))


def duplicate_positions(rows: DataFrame, key: str = "identifier", order: str = "pos", within: tuple = ()) -> DataFrame:
    """Second and later rows of each key in order; null is a key as any other, and a frequent one is no task of its own."""
    return numbered(rows, [*within, key], order, "occurrence").withColumn("occurrence", F.col("occurrence").cast("int")).where("occurrence > 1")


def split_duplicates(rows: DataFrame, key: str = "identifier", order: str = "pos", within: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and an error row for each later one. Which is first is a minimum by key, added up before the shuffle; order is unique."""
    by = [*within, key]
    first = rows.groupBy(*[F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)]).agg(F.min(order).alias("_first"))
    marked = rows.join(first, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{k}")) for k, c in enumerate(by)]))
    later = F.col(order) != F.col("_first")
    errors = marked.where(later).select(*rows.columns, F.lit("error").alias("status"), F.lit("DuplicateIdentifierException").alias("type"), F.concat(F.lit("Duplicate identifier '"), F.coalesce(F.col(key).cast("string"), F.lit("None")), F.lit("' found")).alias("message"))
    return marked.where(~later).select(*rows.columns), errors


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
