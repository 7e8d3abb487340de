"""Changes to the store's tables as rewrites of Parquet: whole new tables that are swapped in, so a failed write leaves the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import slug_suffix
from tidemark.sources import versions


def patched(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """current with the non-null values of changes by key; unknown columns of changes are ignored and no row is added."""
    fields = [c for c in changes.columns if c in current.columns and c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = current.join(new, key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns])


def upserted(current: DataFrame, changes: DataFrame, key: str = "slug") -> DataFrame:
    """current with rows of changes in place of those of the same key, or added; columns that changes lacks keep their value."""
    fields = [c for c in current.columns if c != key]
    left = current.select(key, *[F.col(c).alias(f"_old_{c}") for c in fields])
    right = changes.withColumn("_changed", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.select(*[F.col(key) if c == key else F.when(F.col("_changed"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) if c in changes.columns else F.col(f"_old_{c}").alias(c) for c in current.columns])


def removed(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """current without the rows whose key is in keys."""
    return current.join(keys.select(*on), on, "left_anti")


def suffixed_slugs(new: DataFrame, existing: DataFrame, slug: str = "slug", order: str = "id") -> DataFrame:
    """new with the first of a slug as it is unless it is taken, and the others with a suffix of five characters of their id's hash, which may coincide.

    Which row is first is a minimum by slug, added up before the shuffle, so a slug that most rows share is no task of its own. order is unique.
    """
    return _suffixed(new, existing, slug, order).select(*[F.col("_own").alias(c) if c == slug else F.col(c) for c in new.columns])


def _suffixed(new: DataFrame, existing: DataFrame, slug: str, order: str) -> DataFrame:
    """new with the slug of suffixed_slugs() as _own."""
    first = new.groupBy(F.col(slug).alias("_slug")).agg(F.min(order).alias("_first"))
    taken = existing.select(F.col(slug).alias("_slug")).distinct().withColumn("_taken", F.lit(True))
    rows = new.join(first, F.col(slug).eqNullSafe(F.col("_slug")), "left").drop("_slug").join(taken, F.col(slug) == F.col("_slug"), "left").drop("_slug")
    later = ~F.col(order).eqNullSafe(F.col("_first"))
    own = F.when(later | F.col("_taken").isNotNull(), slug_suffix(F.col(slug), F.col(order).cast("string"))).otherwise(F.col(slug))
    return rows.withColumn("_own", own).drop("_taken", "_first")


def unique_slugs(new: DataFrame, existing: DataFrame, slug: str = "slug", order: str = "id") -> DataFrame:
    """new with a slug for each row that no other has: suffixed_slugs(), and the whole hash where a suffixed slug is another's."""
    rows = _suffixed(new, existing, slug, order)
    all_slugs = existing.select(slug).union(new.select(slug)).distinct().withColumnRenamed(slug, "_other")
    same = rows.where(~F.col("_own").eqNullSafe(F.col(slug))).groupBy("_own").agg(F.min(order).alias("_least"))
    rows = rows.join(same, "_own", "left").join(all_slugs, F.col("_own") == F.col("_other"), "left")
    whole = F.concat(F.col(slug), F.lit("-"), F.sha2(F.col(order).cast("string"), 256))
    again = F.col("_other").isNotNull() | (F.col(order) != F.col("_least"))
    chosen = F.when((F.col("_own") != F.col(slug)) & again, whole).otherwise(F.col("_own"))
    return rows.select(*[chosen.alias(c) if c == slug else F.col(c) for c in new.columns])


def slug_conflicts(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Changes (id, slug) whose slug another row has, or another change asks for."""
    others = current.select(F.col("id").alias("_id"), "slug").unionByName(changes.select(F.col("id").alias("_id"), "slug")).distinct()
    return changes.join(others, "slug").where("id <> _id").select(*changes.columns).distinct()


def repo_conflicts(organizations: DataFrame) -> DataFrame:
    """Organizations that have both a code repository and an exemption from having one, or a repository that is no web address."""
    url = F.trim(F.coalesce("code_repo_url", F.lit("")))
    return organizations.where(((url != "") & F.col("code_repo_exempt")) | ((url != "") & ~url.rlike("^https?://")))


def reslugged(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """current with edited slugs (id, slug), and the changes that name no row or a slug in use, which are left out."""
    bad = slug_conflicts(changes, current).unionByName(changes.join(current.select("id"), "id", "left_anti")).distinct()
    good = changes.join(bad.select("id"), "id", "left_anti").select("id", F.col("slug").alias("_slug"))
    return current.join(good, "id", "left").withColumn("slug", F.coalesce("_slug", "slug")).select(*current.columns), bad


def harvested(current: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """patched(), but a slug that stands stays: an edited slug outlives later harvests."""
    return patched(current, records.drop("slug"), key)


def popularity(datasets: DataFrame, views: DataFrame) -> DataFrame:
    """datasets with the view counts of their slugs; where there is none the old value stays."""
    seen = views.select(F.col("dataset_slug").alias("slug"), "view_count")
    joined = datasets.join(seen, "slug", "left")
    return joined.select(*[F.coalesce("view_count", "popularity").alias(c) if c == "popularity" else F.col(c) for c in datasets.columns])


def view_counts(pages: DataFrame, prefix: str = "/dataset/", order: str = "pos") -> DataFrame:
    """(dataset_slug, view_count) of a page report (path, views): first row of each slug, slugs cut to 100 characters."""
    slug = F.substring(F.expr(f"substring(path, {len(prefix) + 1})"), 1, 100)
    rows = pages.where(F.col("path").startswith(prefix)).withColumn("dataset_slug", slug)
    return rows.groupBy("dataset_slug").agg(F.min_by("views", order).alias("view_count"))


def deletable_sources(sources: DataFrame, live: DataFrame) -> DataFrame:
    """Sources of which no live record is left."""
    return sources.join(live.select(F.col("harvest_source_id").alias("id")), "id", "left_anti")


def cascade_source_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The store's tables without some sources (id) and what hangs on them; record errors outlive their record with a null key."""
    source = gone.select(F.col("id").alias("harvest_source_id"))
    jobs = tables["harvest_job"].join(source, "harvest_source_id", "left_semi").select(F.col("id").alias("harvest_job_id"))
    records = tables["harvest_record"].join(source, "harvest_source_id", "left_semi").select(F.col("id").alias("harvest_record_id"), F.lit(True).alias("_gone"))
    out = dict(tables)
    out["harvest_source"] = removed(tables["harvest_source"], gone, ["id"])
    for name in ("harvest_job", "harvest_record", "dataset"):
        out[name] = removed(tables[name], source, ["harvest_source_id"])
    out["harvest_job_error"] = removed(tables["harvest_job_error"], jobs, ["harvest_job_id"])
    left = removed(tables["harvest_record_error"], jobs, ["harvest_job_id"]).join(records, "harvest_record_id", "left")
    out["harvest_record_error"] = left.withColumn("harvest_record_id", F.when(F.col("_gone").isNull(), F.col("harvest_record_id"))).select(*tables["harvest_record_error"].columns)
    return out


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, root: str, name: str, expected: int | None = None) -> str:
    """Write df as the next version of a table under root, check its count, switch to it, and point this session's view of that name at it; the version's path.

    Other sessions find it by sources.versions; those that read the version before keep it, and it goes once none does.
    """
    spark, table = df.sparkSession, f"{root}/{name}"
    path = versions.replaced(df, table, expected)["paths"][0]
    spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
    versions.vacuum(spark, table)
    return path


def index_outcome(documents: DataFrame, required: tuple[str, ...] = ("id", "title")) -> tuple[DataFrame, DataFrame]:
    """Documents that can be indexed, and (id, error_type, error_reason) of those that can't: without a required field, or after the first of an id."""
    bare = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required])
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(*documents.columns)))
    marked = documents.withColumn("_bare", bare).withColumn("_nth", nth)
    reason = F.coalesce("_bare", F.when(F.col("_nth") > 1, F.lit("the id repeats")))
    failed = marked.withColumn("_reason", reason).where("_reason is not null").select("id", F.when(F.col("_bare").isNotNull(), "mapper_parsing_exception").otherwise("version_conflict_engine_exception").alias("error_type"), F.col("_reason").alias("error_reason"))
    return marked.where("_bare is null and _nth = 1").drop("_bare", "_nth"), failed


def index_tally(indexed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: how many documents were indexed and how many failed."""
    return indexed.agg(F.count("*").alias("succeeded")).join(F.broadcast(failed.agg(F.count("*").alias("failed"))))  # a row each


def same_schema(df: DataFrame, other: DataFrame) -> bool:
    return df.schema.simpleString() == other.schema.simpleString()


def index_batches(spark: SparkSession, ids: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of some ids, and the ids that have none."""
    return documents.join(ids.select("id"), "id", "left_semi"), ids.select("id").join(documents.select("id"), "id", "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)  # a quote in a value is doubled
