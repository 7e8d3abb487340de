"""Issue, job and catalog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import extra
from tidemark.operators.paging import slice_of
from tidemark.sources.scratch import written

VALIDATION_TYPES = ("ValidationException", "ValidationError")
FIRST = ("harvest_job_id", "date_created", "type", "severity", "id")


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "type").agg(F.count("*").alias("count"))


def issue_rollup(issues: DataFrame, types=VALIDATION_TYPES, order: str = "id") -> DataFrame:
    """Validation messages as one row a record, joined by ``::`` in order, and all other issues as they are.

    Rows without a record are one group; issues whose type is null belong to neither part, as in three-valued SQL.
    """
    # the other columns come from the group's first row
    firsts = [F.min_by(c, order).alias(c) for c in FIRST]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "message"))), lambda x: x["message"]), "::")
    rolled = issues.where(F.col("type").isin(*types)).groupBy("harvest_record_id").agg(*firsts, text.alias("message"))
    columns = ["harvest_record_id", *FIRST, "message"]
    return rolled.select(*columns).unionAll(issues.where(~F.col("type").isin(*types)).select(*columns))


def json_payload(column: Column) -> Column:
    """The payload if it looks like JSON, else null."""
    return F.when(F.substring(F.ltrim(column), 1, 1).isin("{", "["), column)


def payload_title(raw: Column, issue_type: Column | None = None) -> Column:
    """The title in a JSON payload; null for failed transformations and other payloads."""
    title = F.get_json_object(json_payload(raw), "$.title")
    return title if issue_type is None else F.when(~F.coalesce(issue_type == "TransformationException", F.lit(False)), title)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent as text, rounded down; 0% where there is no whole."""
    share = F.floor(100 * part / F.nullif(whole, F.lit(0)))
    return F.concat(F.coalesce(share, F.lit(0)).cast("string"), F.lit("%"))


def count_by_parent(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """parents with how many children each has; children are added up before they are joined."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def children_of(parents: DataFrame, children: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """The children of some parents."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def age_bins(docs: DataFrame, now: str, column: str = "last_harvested_date") -> DataFrame:
    """One row: documents harvested within 7, 7 to 30, 30 to 365 days, and before; bounds fall on days, null dates in no bin."""
    day = lambda n: F.date_trunc("day", F.lit(now).cast("timestamp") - F.expr(f"interval {n} days"))
    at = F.col(column)
    return docs.agg(
        F.count_if(at >= day(7)).alias("within_week"), F.count_if((at >= day(30)) & (at < day(7))).alias("within_month"),
        F.count_if((at >= day(365)) & (at < day(30))).alias("within_year"), F.count_if(at < day(365)).alias("older"),
    )


def catalog_counts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """name, count, other_count, difference, in_other for each name of ours; theirs has (name, count)."""
    other = theirs.select("name", F.col("count").alias("_n"), F.lit(True).alias("_in"))
    both = ours.join(other, "name", "left")
    n = F.coalesce("_n", F.lit(0))
    return both.select("name", "count", n.alias("other_count"), (F.col("count") - n).alias("difference"), F.coalesce("_in", F.lit(False)).alias("in_other"))


def match_cascade(rows: DataFrame, others: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the value of the first key, in order, by which others has a match, and that key's name."""
    out, found, by = rows, [], []
    for k, key in enumerate(keys):
        side = others.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(value).alias(f"_m{k}"))
        out = out.join(side, key, "left")
        found.append(F.col(f"_m{k}"))
        by.append(F.when(F.col(f"_m{k}").isNotNull(), F.lit(key)))
    return out.select(*rows.columns, F.coalesce(*found).alias("matched"), F.coalesce(*by).alias("matched_by"))


def mapped_names(counts: DataFrame, titles: DataFrame) -> DataFrame:
    """counts (name, count) with titles (title, name) turned into the names they stand for; other names stay. Names that meet are added up."""
    known = titles.groupBy(F.col("title").alias("name")).agg(F.min("name").alias("_name"))
    return counts.join(known, "name", "left").groupBy(F.coalesce("_name", "name").alias("name")).agg(F.sum("count").alias("count"))


def attribute_comparison(ours: DataFrame, theirs: DataFrame, same: tuple[str, ...] = ("type", "logo"), shown: tuple[str, ...] = ("package_count",), key: str = "name") -> DataFrame:
    """For each of ours: whether theirs has it, whether attributes are the same, and both sides' values of others. One that theirs lacks has no attributes and counts 0."""
    other = theirs.select(key, F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in (*same, *shown)])
    both = ours.join(other, key, "left")
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")).alias(f"same_{c}") for c in same]
    values = [x for c in shown for x in (F.col(c), F.coalesce(f"_{c}", F.lit(0)).alias(f"other_{c}"))]
    return both.select(key, F.coalesce("_in", F.lit(False)).alias("in_other"), *equal, *values)


def same_schema_type(ours: Column, theirs: Column) -> Column:
    """Whether a source's schema type fits the older catalog's kind of source; null for kinds that fit none or may be either."""
    fits = (ours.startswith("dcatus") & theirs.isin("datajson", "single-doc")) | (ours.startswith("iso") & theirs.isin("waf", "waf-collection", "single-doc"))
    return F.when(fits, True).when(theirs.isin("csw", "arcgis", "single-doc", "geoportal"), F.lit(None).cast("boolean")).otherwise(False)


def last_modified(listed: DataFrame, source: str = "source") -> DataFrame:
    """(source, last_modified): the latest of a source's Last-Modified headers (header), else the greatest modified text."""
    at = F.try_to_timestamp(F.regexp_replace("header", r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return listed.groupBy(source).agg(F.coalesce(F.date_format(F.max(at), "yyyy-MM-dd HH:mm:ss"), F.max("modified")).alias("last_modified"))


def samples(rows: DataFrame, by: str, key: str = "id", size: int = 10) -> DataFrame:
    """One row a group: how many there are, and the first ids in order, size at most. Each group's ids are cut before they are gathered."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(key))
    few = rows.select(by, key).withColumn("_n", nth).where(F.col("_n") <= size).groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return rows.groupBy(by).agg(F.count("*").alias("count")).join(few, by)


def source_fields(sources: DataFrame) -> DataFrame:
    """An older catalog's sources (source_type, frequency, extras of their organization) with the fields that this one has for them."""
    kind = F.col("source_type")
    return sources.withColumns({
        "source_type": F.when(kind.startswith("waf"), "waf").otherwise("document"), "schema_type": F.when(kind.startswith("waf"), "iso19115_2").otherwise("dcatus1.1: non-federal"), "frequency": F.lower("frequency"),
        "notification_emails": F.filter(F.split(F.coalesce(extra(F.col("extras"), "email_list"), F.lit("")), r"\s+"), lambda x: x != ""), "notification_frequency": F.lit("always"),
    })


def with_parents(jobs: DataFrame, sources: DataFrame, organizations: DataFrame) -> DataFrame:
    """Jobs with their source's and its organization's columns, in structs."""
    owned = sources.join(organizations.select(F.col("id").alias("organization_id"), F.struct("*").alias("organization")), "organization_id", "left")
    one = owned.select(F.col("id").alias("harvest_source_id"), F.struct(*sources.columns).alias("source"), "organization")
    return jobs.join(one, "harvest_source_id", "left")


def last_days(rows: DataFrame, now: str, days: int, column: str = "date_created") -> DataFrame:
    """Rows of the last days up to now, both ends included."""
    end = F.lit(now).cast("timestamp")
    return rows.where(F.col(column).between(end - F.expr(f"interval {days} days"), end))


def monitor(rows: DataFrame, now: str, by: list[str], running: Column, waiting: Column, label: str, at: str, key: str) -> DataFrame:
    """A row a group: rows, the longest age in seconds of running ones (0 without any), how many wait, and the label of the oldest."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(running, age)), F.lit(0)).alias("longest_error_age"), F.count_if(waiting).alias("waiting"), F.min_by(label, F.struct(at, key)).alias("oldest"))


def state_counts(jobs: DataFrame, by: list[str]) -> DataFrame:
    """How many jobs each group has, and when its latest began."""
    return jobs.groupBy(*by).agg(F.count("*").alias("n"), F.max("date_created").alias("latest"))


def chart_series(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row: each field's values as a list, in one order, timestamps as text. For charts of a few hundred points."""
    kinds = dict(rows.dtypes)
    shown = [F.date_format(f, "yyyy-MM-dd HH:mm:ss").alias(f) if kinds[f] == "timestamp" else F.col(f) for f in fields]
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), *shown)))
    return rows.agg(sorted_rows.alias("_r")).select(*[F.col("_r")[f].alias(f) for f in fields])


def discrepancy_share(failed: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * failed / total, 3)).otherwise(F.lit(0.0))


def issue_export(issues: DataFrame, records: DataFrame) -> DataFrame:
    """A job's record issues with their record's identifier and the title in its payload, for a CSV file."""
    own = records.select(F.col("id").alias("harvest_record_id"), "identifier", "source_raw")
    rows = issues.join(own, "harvest_record_id", "left")
    return rows.select("harvest_record_id", "identifier", payload_title(F.col("source_raw"), F.col("type")).alias("title"), "harvest_job_id", "type", "severity", "message", "date_created")


def sync_plan(records: DataFrame, datasets: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose dataset is to be added, and datasets to be deleted.

    The newest successful version of each (source, identifier), of whatever type, decides; only datasets of known sources are added.
    """
    from tidemark.operators.versions import latest_versions, unexpected_datasets

    newest = latest_versions(records, ("harvest_source_id", "identifier")).where("action <> 'delete' and record_type = 'dataset'")
    add = newest.join(sources.select("harvest_source_id"), "harvest_source_id", "left_semi").join(datasets.select(F.col("harvest_record_id").alias("id")), "id", "left_anti")
    return add, unexpected_datasets(records, datasets)


def sync_report(add: DataFrame, delete: DataFrame, batch: int = 1000) -> DataFrame:
    """One row: how much is to be added and deleted, and in how many batches."""
    n = add.agg(F.count("*").alias("to_add")).join(F.broadcast(delete.agg(F.count("*").alias("to_delete"))))  # a row each
    return n.withColumn("batches", (F.ceil(F.col("to_add") / batch) + F.ceil(F.col("to_delete") / batch)).cast("long"))


def source_summary(jobs: DataFrame, live: DataFrame, now: str) -> DataFrame:
    """(harvest_source_id, live_records, last_errors, next_run): what a source's page tells."""
    done = jobs.where("status = 'complete'").groupBy("harvest_source_id").agg(F.max_by("records_errored", F.struct("date_created", "id")).alias("last_errors"))
    ahead = jobs.where((F.col("status") == "new") & (F.col("date_created") > F.lit(now).cast("timestamp"))).groupBy("harvest_source_id").agg(F.min("date_created").alias("next_run"))
    n = live.groupBy("harvest_source_id").agg(F.count("*").alias("live_records"))
    return n.join(done, "harvest_source_id", "full_outer").join(ahead, "harvest_source_id", "full_outer").withColumn("live_records", F.coalesce("live_records", F.lit(0)))


def seeded_sample(rows: DataFrame, size: int, seed: int, key: str = "id") -> DataFrame:
    """A run of rows, by a unique key, from a place that the seed chooses: the same on every run."""
    import random

    return slice_of(rows, key, lambda n: random.Random(seed).randrange(max(1, n - size + 1)), size)


def document_differences(left: DataFrame, right: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, field, left, right) of top-level fields in which two JSON documents differ."""
    flat = lambda df, name: df.select(key, F.explode(F.from_json(doc, "map<string,string>")).alias("field", name))
    both = flat(left, "left").join(flat(right, "right"), [key, "field"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def flattened(docs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, path, value) of everything plain in JSON documents, whatever its depth: members by name, items by place; empty objects and lists are values. Text that is no JSON is one value."""
    todo, out = docs.select(key, F.lit("$").alias("path"), F.col(doc).alias("value")).where("value is not null"), None
    while True:
        parsed = F.try_parse_json("value")
        kind = F.schema_of_variant(parsed)
        filled = F.coalesce((kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~F.to_json(parsed).isin("{}", "[]"), F.lit(False))
        now = written(todo.withColumn("_kind", F.when(filled, F.substring(kind, 1, 5))), "level")
        plain = now.where("_kind is null").select(key, "path", "value")
        out = plain if out is None else out.union(plain)
        if not now.where("_kind is not null").limit(1).count():
            return out
        members = now.where("_kind = 'OBJEC'").select(key, "path", F.explode(F.try_variant_get(parsed, "$", "map<string,variant>")).alias("_name", "_v")).select(key, F.concat("path", F.lit("."), "_name").alias("path"), F.to_json("_v").alias("value"))
        items = now.where("_kind = 'ARRAY'").select(key, "path", F.posexplode(F.try_variant_get(parsed, "$", "array<variant>")).alias("_at", "_v")).select(key, F.concat("path", F.lit("["), "_at", F.lit("]")).alias("path"), F.to_json("_v").alias("value"))
        todo = members.union(items)


def deep_differences(left: DataFrame, right: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, path, left, right) of every value, at any depth, in which two JSON documents differ; values are JSON text, null where a side has none. Lists are held against each other place by place."""
    flat = lambda df, name: flattened(df, key, doc).withColumnRenamed("value", name)
    return flat(left, "left").join(flat(right, "right"), [key, "path"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
