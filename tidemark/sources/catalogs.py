"""Catalog documents as records: the flat list of the first form, and the nested walk of the third."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import identifier
from tidemark.functions.json_schema import schema_errors
from tidemark.schema import IDENTITY_FIELD
from tidemark.sources.scratch import written

#: Fixed names: the field of a nested catalog for each type of record.
CATALOG_FIELDS = {"dataset": "dataset", "data_service": "service", "catalog_record": "record", "data_series": "datasetSeries"}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(url, doc) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("doc"))


def flat_records(docs: DataFrame, field: str = "dataset", doc: str = "doc") -> DataFrame:
    """A row per entry of a catalog's list, with its place and JSON text as written."""
    raw = F.from_json(F.get_json_object(doc, f"$.{field}"), "array<string>")
    others = [c for c in docs.columns if c != doc]
    return docs.select(*others, F.posexplode(raw).alias("pos", "raw"))


def _object(text) -> dict | None:
    """JSON text as an object; None for anything else, so that one malformed catalog has no records and the others do."""
    try:
        value = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _walked(batches: Iterator[pd.Series], field: str) -> Iterator[pd.Series]:
    def walk(catalog, path, out):
        entries = catalog.get(field) or []
        for k, entry in enumerate(entries if isinstance(entries, list) else [entries]):
            out.append({"path": path, "pos": k, "raw": json.dumps(entry)})
        inner = catalog.get("catalog") or []
        for k, sub in enumerate(inner if isinstance(inner, list) else [inner]):
            if isinstance(sub, dict):
                walk(sub, [*path, k], out)
        return out

    for batch in batches:
        yield batch.map(lambda t: walk(_object(t) or {}, [], []), na_action=None)


def nested_records(docs: DataFrame, record_type: str = "dataset", doc: str = "doc") -> DataFrame:
    """Records of a type in a catalog and all catalogs in it, depth first, own entries before inner ones: (.., path, pos, record_type, identifier, raw)."""
    field = CATALOG_FIELDS[record_type]

    @F.pandas_udf("array<struct<path:array<int>,pos:int,raw:string>>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _walked(batches, field)

    others = [c for c in docs.columns if c != doc]
    found = docs.select(*others, F.explode(walk(F.col(doc))).alias("r")).select(*others, "r.*")
    key = IDENTITY_FIELD[record_type]
    return found.withColumn("record_type", F.lit(record_type)).withColumn("identifier", identifier(F.to_json(F.try_variant_get(F.try_parse_json("raw"), f"$['{key}']", "variant"))))


def all_records(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Records of every type."""
    parts = [nested_records(docs, t, doc) for t in CATALOG_FIELDS]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def tree_walk(nodes: DataFrame, root: str, parent: str = "parent", key: str = "id", order: str = "pos") -> DataFrame:
    """Depth-first order of a tree of rows (key, parent, pos) from a root, as (key, path): level by level joins, for trees of tables of any depth.

    A node that is reached again, by a cycle or under two parents, is an error.
    """
    level = written(nodes.where(F.col(key) == root).select(F.col(key).alias("key"), F.array(F.col(order)).alias("path")), "tree")
    out = level
    inner = nodes.select(F.col(key).alias("_key"), F.col(parent).alias("_parent"), F.col(order).alias("_pos"))
    while True:
        level = written(level.join(inner, F.col("key") == F.col("_parent")).select(F.col("_key").alias("key"), F.concat("path", F.array("_pos")).alias("path")), "tree")
        if level.isEmpty():
            return out
        if not level.join(out, "key", "left_semi").isEmpty():
            raise ValueError("the rows are no tree: a node is reached twice")
        out = out.union(level)


def single_document(docs: DataFrame, identifier_of: str = "url") -> DataFrame:
    """A source that is one document: a record per document, named by its url."""
    return docs.select(F.col(identifier_of).alias("identifier"), F.lit(0).alias("pos"), F.col("doc").alias("raw"))


def exported_pages(spark: SparkSession, path: str, field: str, key: str) -> DataFrame:
    """Items of saved pages of a paged listing, JSON files with a list under a field; pages overlap when rows are added meanwhile, so an item counts once by its key, the last page's."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.posexplode(F.from_json(F.get_json_object("value", f"$.{field}"), "array<string>")).alias("pos", "raw"))
    return raw.withColumn(key, F.get_json_object("raw", f"$.{key}")).groupBy(key).agg(F.max_by("raw", F.struct("page", "pos")).alias("raw"))


def invalid_records(docs: DataFrame, schema: dict, field: str = "dataset", doc: str = "doc") -> DataFrame:
    """(url, identifier, path, message) of all that is wrong in catalogs' records: a record's identifier, or its place where it has none."""
    rows = flat_records(docs, field, doc)
    name = F.coalesce(F.get_json_object("raw", "$.identifier"), F.col("pos").cast("string"))
    return rows.withColumn("identifier", name).select("url", "identifier", F.explode(schema_errors(schema)(F.col("raw"))).alias("e")).select("url", "identifier", "e.path", "e.message")


def nested_datasets(parents: DataFrame, fields: list[str], parent_identifier: str = "identifier", raw: str = "raw") -> DataFrame:
    """Datasets inside parents' fields, tagged with their parent; of one identifier a parent gives the first, those without one all."""
    lists = []
    for f in fields:
        text = F.get_json_object(raw, f"$.{f}")
        lists.append(F.when(text.isNull(), F.array().cast("array<string>")).when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text)))
    rows = parents.select(F.col("pos").alias("parent_pos"), F.col(parent_identifier).alias("parent_identifier"), F.posexplode(F.concat(*lists)).alias("pos", "raw"))
    rows = rows.withColumn("identifier", F.get_json_object("raw", "$.identifier"))
    nth = F.row_number().over(Window.partitionBy("parent_pos", "identifier").orderBy("pos"))
    return rows.withColumn("_nth", nth).where("_nth = 1 or identifier is null").drop("_nth")


def merged(top: DataFrame, nested: DataFrame) -> DataFrame:
    """Top-level records, told their first parent, and the nested ones that aren't among them, once each."""
    parent = nested.where("identifier is not null").groupBy("identifier").agg(F.min_by("parent_identifier", F.struct("parent_pos", "pos")).alias("parent_identifier"), F.min_by("raw", F.struct("parent_pos", "pos")).alias("raw"))
    told = top.select("identifier", "raw").join(parent.select("identifier", "parent_identifier"), "identifier", "left").select("identifier", "raw", "parent_identifier")
    added = parent.join(top.select("identifier"), "identifier", "left_anti").select("identifier", "raw", "parent_identifier")
    return told.unionByName(added).unionByName(nested.where("identifier is null").select("identifier", "raw", "parent_identifier"))


def stripped(fields=tuple(CATALOG_FIELDS.values())):
    """A column function: a catalog's JSON text without its records, at every level."""

    @F.pandas_udf("string")
    def strip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def clean(c):
            out = {k: v for k, v in c.items() if k not in fields}
            if "catalog" in out:
                inner = out["catalog"]
                out["catalog"] = [clean(x) if isinstance(x, dict) else x for x in inner] if isinstance(inner, list) else clean(inner) if isinstance(inner, dict) else inner
            return out

        for batch in batches:
            yield batch.map(lambda t: None if (c := _object(t)) is None else json.dumps(clean(c)), na_action=None)

    return strip
