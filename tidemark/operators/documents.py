"""Search documents and dataset payloads from records' JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geo import centroid, spatial
from tidemark.functions.text import slug
from tidemark.sources.scratch import written

#: Placeholders of fields that a record lacks. The contact is the caller's to give; the two spellings of the type are those that stored records have.
CONTACT = {"fn": "Not provided", "hasEmail": "mailto:unknown@example.org"}
NO_DESCRIPTION, NO_KEYWORD = "No description was provided.", "__"
ROOT_TYPE, ITEM_TYPE = "application/octet-steam", "application/octet-stream"


def _is_text(item: Column) -> Column:
    return F.schema_of_variant(item) == "STRING"


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def listed(doc: Column, path: str) -> Column:
    """A field's items as variants; a single value is a list of one."""
    one = F.try_variant_get(doc, path, "variant")
    many = F.try_variant_get(doc, path, "array<variant>")
    return F.coalesce(many, F.when(one.isNotNull() & (F.schema_of_variant(one) != "VOID"), F.array(one)), F.array().cast("array<variant>"))


def text(doc: Column, path: str) -> Column:
    one = F.try_variant_get(doc, path, "variant")
    return F.when(_is_text(one), F.try_variant_get(doc, path, "string")).otherwise("")


def identifier_text(doc: Column) -> Column:
    return F.coalesce(_clean(text(doc, "$.identifier")), _clean(text(doc, "$.identifier['@id']")), F.lit(""))


def labels(doc: Column, path: str = "$.theme") -> Column:
    """Texts, and the preferred labels of concepts."""
    own = F.transform(listed(doc, path), lambda i: _clean(F.when(_is_text(i), F.try_variant_get(i, "$", "string")).otherwise(F.try_variant_get(i, "$.prefLabel", "string"))))
    return F.filter(own, lambda x: x.isNotNull())


def keywords(doc: Column) -> Column:
    own = F.transform(listed(doc, "$.keyword"), lambda i: F.when(_is_text(i), _clean(F.try_variant_get(i, "$", "string"))))
    return F.filter(own, lambda x: x.isNotNull())


def publisher(doc: Column) -> Column:
    return F.coalesce(_clean(text(doc, "$.publisher.name")), _clean(text(doc, "$.publisher.prefLabel")), F.lit(""))


def distribution_titles(doc: Column) -> Column:
    many = F.coalesce(F.try_variant_get(doc, "$.distribution", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(many, lambda d: _clean(F.try_variant_get(d, "$.title", "string"))), lambda x: x.isNotNull())


#: The index's flat fields by name.
INDEX_FIELDS: dict[str, Callable[[Column], Column]] = {
    "title": lambda d: text(d, "$.title"),
    "description": lambda d: text(d, "$.description"),
    "publisher": publisher,
    "keyword": keywords,
    "theme": labels,
    "identifier": identifier_text,
    "distribution_titles": distribution_titles,
}


def index_fields(rows: DataFrame, doc: str = "dcat") -> DataFrame:
    """rows with the index's fields of their JSON."""
    parsed = rows.withColumn("_doc", F.try_parse_json(doc))
    return parsed.withColumns({name: f(F.col("_doc")) for name, f in INDEX_FIELDS.items()})


def documents(datasets: DataFrame, base_url: str) -> DataFrame:
    """Search documents of datasets (id, slug, dcat, translated_spatial, harvest_record_id, has_transformed, …)."""
    rows = index_fields(datasets)
    doc = F.col("_doc")
    theme = F.exists("theme", lambda t: F.lower(F.trim(t)) == "geospatial")
    place = F.try_variant_get(doc, "$.spatial", "variant")
    named = place.isNotNull() & (F.schema_of_variant(place) != "VOID") & (F.coalesce(F.trim(F.to_json(place)), F.lit("")) != '""')
    download = F.exists(F.coalesce(F.try_variant_get(doc, "$.distribution", "array<variant>"), F.array().cast("array<variant>")), lambda d: F.length(F.trim(F.try_variant_get(d, "$.downloadURL", "string"))) > 0)
    record = F.concat(F.lit(f"{base_url}/harvest_record/"), "harvest_record_id")
    out = rows.withColumns({
        "has_spatial": F.coalesce(named, F.lit(False)) | F.col("translated_spatial").isNotNull() | theme,
        "has_download": F.coalesce(download, F.lit(False)),
        "is_part_of": F.try_variant_get(doc, "$.isPartOf", "string"),
        "spatial_shape": F.col("translated_spatial"),
        "spatial_centroid": centroid(F.col("translated_spatial")),
        "harvest_record": record,
        "harvest_record_raw": F.concat(record, F.lit("/raw")),
        "harvest_record_transformed": F.when(F.col("has_transformed"), F.concat(record, F.lit("/transformed"))),
    })
    return out.drop("_doc")


def dataset_payloads(records: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Datasets of successful record versions: metadata of the transformed payload or the raw one, a slug of the title, and the place as GeoJSON.

    spatial_warning is true where a place is given and can't be resolved.
    """
    meta = F.coalesce("source_transform", "source_raw")
    rows = records.withColumn("dcat", meta).withColumn("_doc", F.try_parse_json("dcat"))
    rows = rows.withColumn("slug", slug(F.coalesce(_clean(text(F.col("_doc"), "$.title")), F.col("identifier")))).withColumn("_place", F.get_json_object("dcat", "$.spatial"))
    found = None
    if gazetteer is not None:
        named = places_named(rows.select(F.col("_place").alias("text")), gazetteer).select(F.col("text").alias("_text"), F.col("the_geom").alias("_geom"))
        rows, found = rows.join(named, F.col("_place") == F.col("_text"), "left"), F.col("_geom")
    shape = F.nullif(spatial(F.col("_place"), found), F.lit(""))
    return rows.withColumn("translated_spatial", shape).withColumn("spatial_warning", F.col("_place").isNotNull() & F.col("translated_spatial").isNull()).select("id", "slug", "dcat", F.col("record_type").alias("type"), "harvest_source_id", "translated_spatial", "date_finished", "spatial_warning")


def _parts(text: Column, n: int) -> Column:
    """All runs of n signs of a text, once."""
    return F.array_distinct(F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, n))).otherwise(F.array().cast("array<string>")))


def places_named(texts: DataFrame, locations: DataFrame) -> DataFrame:
    """(text, id, the_geom): for each distinct text the first place, by type_order and id, whose name contains it, in any case; texts without one, and blank ones, are left out.

    Names are indexed by their runs of one to three signs. A text of up to three signs is a run itself; a longer one is held against the names
    that have its rarest run of three.
    """
    size = 3
    for c, stand_in in (("id", F.col("display_name")), ("type_order", F.lit(0))):  # a gazetteer may have neither
        locations = locations if c in locations.columns else locations.withColumn(c, stand_in)
    names = locations.where("display_name is not null").select("id", "type_order", F.lower("display_name").alias("name"))
    runs = written(names.select("id", "type_order", F.explode(F.concat(*[_parts(F.col("name"), n) for n in range(1, size + 1)])).alias("run")), "runs")
    first = F.min(F.struct(F.col("type_order").isNull().alias("last"), "type_order", "id")).alias("first")
    each = written(texts.where(F.trim("text") != "").select("text", F.lower("text").alias("low")).distinct(), "texts")
    short = each.where(F.length("low") <= size).join(runs, F.col("low") == F.col("run")).groupBy("text").agg(first)
    often = runs.where(F.length("run") == size).groupBy("run").agg(F.count("*").alias("n"))
    own = each.where(F.length("low") > size).select("text", "low", F.explode(_parts(F.col("low"), size)).alias("run"))
    # a run that no name has rules its text out
    rarest = own.join(often, "run", "left").groupBy("text", "low").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    met = rarest.join(runs.where(F.length("run") == size).select("run", "id"), "run").join(names, "id").where(F.contains("name", F.col("low")))
    found = short.unionByName(met.groupBy("text").agg(first)).select("text", F.col("first.id").alias("id"))
    return found.join(locations.select("id", "the_geom"), "id").select("text", "id", "the_geom")


def repaired(contact: dict = CONTACT):
    """A column function of (JSON text, identifier, parent, organization's name): placeholders filled in, identifier and parent set, theme geospatial added."""

    @F.pandas_udf(T.StringType())
    def fill(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def url(text: str) -> str:
            return text if "://" in text or not text or " " in text or "." not in text else f"https://{text}"

        def one(raw, identifier, parent, name):
            if raw is None:
                return None
            d = json.loads(raw) | {"identifier": identifier}
            if parent:
                d["isPartOf"] = parent
            for key, value in (("contactPoint", contact), ("description", NO_DESCRIPTION), ("keyword", [NO_KEYWORD]), ("publisher", {"name": name})):
                d[key] = d.get(key) or value
            typed = lambda v: isinstance(v, str) and len(v.split("/")) == 2 and all(v.split("/"))
            if not typed(d.get("describedByType")):
                d["describedByType"] = ROOT_TYPE
            for item in d.get("distribution") or []:
                for key in ("downloadURL", "accessURL"):
                    if isinstance(item.get(key), str):
                        item[key] = url(item[key])
                if not typed(item.get("describedByType")):
                    item["describedByType"] = ITEM_TYPE
            theme = d.get("theme") or []
            d["theme"] = theme if any(str(t).strip().lower() == "geospatial" for t in theme) else [*theme, "geospatial"]
            return json.dumps(d)

        for raw, identifier, parent, name in batches:
            yield pd.Series([one(*x) for x in zip(raw, identifier, parent, name, strict=True)])

    return fill


#: Fields whose value is one text, and the field that stays as it is.
PLAIN_FIELDS, KEPT_FIELD = ("modified", "issued", "temporal", "spatial"), "publisher"


@F.pandas_udf(T.StringType())
def metadata(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A record's JSON for an index whose fields are texts: members of objects, and items of lists, that hold objects or lists themselves become JSON text with keys in order.

    Dates and places that are no text become one, the publisher stays as it is. Null where the text is no JSON object.
    """

    def as_text(v):
        return json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else v

    def level(v):
        if isinstance(v, dict):
            return {k: as_text(x) for k, x in v.items()}
        return [level(x) if isinstance(x, dict) else as_text(x) for x in v] if isinstance(v, list) else v

    def one(raw):
        try:
            doc = json.loads(raw)
        except (TypeError, ValueError):
            return None
        if not isinstance(doc, dict):
            return None
        plain = lambda v: v if v is None or isinstance(v, str) else as_text(v) if isinstance(v, (dict, list)) else str(v)
        return json.dumps({k: v if k == KEPT_FIELD else plain(v) if k in PLAIN_FIELDS else level(v) for k, v in doc.items()})

    for batch in batches:
        yield batch.map(one, na_action=None)


def normalised(payload: Column) -> Column:
    """A payload as JSON text if it is JSON, else as it stands."""
    return F.coalesce(F.to_json(F.try_parse_json(payload)), payload)
