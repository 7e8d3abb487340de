"""The search index as a versioned table that documents are added to, replaced in and deleted from.

Every change is a segment of its own: postings and lengths of the documents it adds, and tombstones, the ids it deletes or replaces in
the segments before it. A reader sees each segment's postings but for ids with a later tombstone, so a change costs what it
changes; merged() writes the live rows as one segment when there are too many. Numbers of documents and their lengths by field stand in the manifest and
follow each change, so that scores are those of an index built anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import search
from tidemark.sources import versions

#: Tombstones that are broadcast to postings; more of them meet by a shuffle.
BROADCAST_IDS = 1_000_000
#: Segments after which changed() merges.
MOST_SEGMENTS = 16


def _live(spark: SparkSession, manifest: dict, part: str) -> DataFrame | None:
    """The rows of postings or lengths that no later segment takes away."""
    segments = manifest.get("segments", [])
    rows = [spark.read.parquet(f"{s['path']}/{part}").withColumn("_nth", F.lit(k)) for k, s in enumerate(segments) if s["documents"]]
    dead = [spark.read.parquet(f"{s['path']}/tombstones").select(F.col("id").alias("_id"), F.lit(k).alias("_until")) for k, s in enumerate(segments) if s["tombstones"] and k]
    if not rows:
        return None
    every = reduce(DataFrame.unionByName, rows)
    if dead:
        last = reduce(DataFrame.unionByName, dead).groupBy("_id").agg(F.max("_until").alias("_until"))
        if sum(s["tombstones"] for s in segments) <= BROADCAST_IDS:
            last = F.broadcast(last)
        every = every.join(last, (F.col("id") == F.col("_id")) & (F.col("_nth") < F.col("_until")), "left_anti")
    return every.drop("_nth")


def opened(spark: SparkSession, table: str, reader: versions.Reader | None = None) -> search.Index:
    """The index as search takes it; with a reader, of the version that it holds."""
    manifest = reader.manifest if reader else versions.manifest(spark, table)
    stats = spark.createDataFrame([(f, n, total / n) for f, (n, total) in sorted(manifest.get("fields", {}).items()) if n], "field string, n long, mean double")
    postings, lengths = _live(spark, manifest, "postings"), _live(spark, manifest, "lengths")
    if postings is None:
        postings, lengths = (spark.createDataFrame([], MAPPING[part]) for part in ("postings", "lengths"))
    return search.Index(postings, lengths, stats)


def _totals(lengths: DataFrame | None) -> dict[str, tuple[int, int]]:
    """By field the documents that have it and the sum of its lengths: a row a field."""
    rows = [] if lengths is None else lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("total")).collect()
    return {r["field"]: (r["n"], r["total"]) for r in rows}


def changed(spark: SparkSession, table: str, added: DataFrame | None = None, deleted: DataFrame | None = None, fields=search.FIELDS, gap: str = search.TOKEN_GAP) -> dict:
    """The next version of an index: documents added, or put in place of those of their ids, and ids deleted; ids that it lacks do no harm.

    added has each id once and is in the index afterwards also where deleted names it. versions.Conflict if another writer was quicker: nothing has changed then.
    """
    before, path = versions.manifest(spark, table), versions.new_data(table)
    ids = [df.select(F.col("id")) for df in (added, deleted) if df is not None]
    reduce(DataFrame.union, ids).where("id is not null").distinct().write.parquet(f"{path}/tombstones")
    dead = spark.read.parquet(f"{path}/tombstones")
    documents = 0
    if added is not None:
        search.stored(search.index(added, fields, gap=gap), path)
        documents = added.select("id").distinct().count()
    now = _live(spark, before, "lengths")
    n = dead.count()
    taken = _totals(None if now is None else now.join(F.broadcast(dead) if n <= BROADCAST_IDS else dead, "id", "left_semi"))
    new = _totals(spark.read.parquet(f"{path}/lengths") if documents else None)
    old = before.get("fields", {})
    totals = {f: [old.get(f, (0, 0))[k] - taken.get(f, (0, 0))[k] + new.get(f, (0, 0))[k] for k in (0, 1)] for f in {*old, *new}}
    segments = [*before.get("segments", []), {"path": path, "documents": documents, "tombstones": n}]
    after = versions.publish(spark, table, before, paths=[s["path"] for s in segments], segments=segments, fields=totals)
    return merged(spark, table) if len(segments) > MOST_SEGMENTS else after


#: What the tables of a segment hold.
MAPPING = {"postings": "field string, token string, id string, places array<int>, length int", "lengths": "field string, id string, length int"}


def recreated(spark: SparkSession, table: str, mapping: dict[str, str] = MAPPING) -> dict:
    """Drop all documents of an index and start it anew, empty; ValueError if what it would hold then isn't what the mapping says."""
    made = search.index(spark.createDataFrame([], ", ".join(f"{f} string" for f in ("id", *search.FIELDS))))
    for part, kind in mapping.items():
        own, want = getattr(made, part).schema, spark.createDataFrame([], kind).schema
        if sorted((f.name, f.dataType.simpleString()) for f in own) != sorted((f.name, f.dataType.simpleString()) for f in want):
            raise ValueError(f"{part} would be {own.simpleString()}, not {want.simpleString()}")
    return versions.publish(spark, table, versions.manifest(spark, table), paths=[], segments=[], fields={})


def merged(spark: SparkSession, table: str) -> dict:
    """The next version of an index, with its live rows in one segment."""
    before, path = versions.manifest(spark, table), versions.new_data(table)
    postings, lengths = _live(spark, before, "postings"), _live(spark, before, "lengths")
    if postings is None:
        return versions.publish(spark, table, before, paths=[], segments=[], fields={})
    search.stored(search.Index(postings, lengths, lengths), path)
    segment = {"path": path, "documents": spark.read.parquet(f"{path}/lengths").select("id").distinct().count(), "tombstones": 0}
    return versions.publish(spark, table, before, paths=[path], segments=[segment], fields=before["fields"])
