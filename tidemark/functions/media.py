"""Media types, formats and health of what a catalog links to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension; callers may pass their own.
EXTENSIONS = {
    "csv": "text/csv", "json": "application/json", "zip": "application/zip", "rdf": "application/rdf+xml", "xml": "application/xml", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "tsv": "text/tab-separated-values", "tar": "application/x-tar",
}
#: Parts of service urls by the kind of service, in order.
SERVICES = (
    ("wms", ("service=wms", "geoserver/wms", "mapserver/wmsserver", "com.esri.wms.Esrimap", "service/wms")),
    ("wfs", ("service=wfs", "geoserver/wfs", "mapserver/wfsserver", "com.esri.wfs.Esrimap")),
    ("wcs", ("service=wcs", "geoserver/wcs", "imageserver/wcsserver", "mapserver/wcsserver")),
    ("sos", ("service=sos",)),
    ("csw", ("service=csw",)),
    ("kml", ("mapserver/generatekml",)),
    ("arcims", ("com.esri.esrimap.esrimap",)),
    ("arcgis_rest", ("arcgis/rest/services",)),
)
FORMATS = {"text/csv": "CSV", "application/json": "JSON", "application/zip": "ZIP", "application/rdf+xml": "RDF", "application/xml": "XML", "text/html": "HTML", "application/pdf": "PDF", "text/plain": "TXT", "application/vnd.ms-excel": "XLS"}


def media_type(url: Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    """By the extension of the url's path, else by the parts of service urls."""
    name = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv]), name)
    chain = by_name.isNotNull()
    out = F.when(chain, by_name)
    for kind, parts in SERVICES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | url.contains(part)
        out = out.when(hit, kind)
    return out


def format_label(kind: Column, labels: dict[str, str] = FORMATS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.lower(kind))


def repaired_distributions(distributions: Column, landing_page: Column) -> Column:
    """An array of (accessURL, downloadURL, mediaType, format): the landing page added if it isn't there, media types and formats filled in."""
    has = F.exists(distributions, lambda d: d["accessURL"].eqNullSafe(landing_page))
    page = F.struct(landing_page.alias("accessURL"), F.lit(None).cast("string").alias("downloadURL"), F.lit("text/html").alias("mediaType"), F.lit(None).cast("string").alias("format"))
    every = F.when(landing_page.isNull() | has, distributions).otherwise(F.concat(distributions, F.array(page)))

    def repaired(d: Column) -> Column:
        given = F.when(F.length(F.trim(d["mediaType"])) > 0, d["mediaType"])
        kind = F.coalesce(given, media_type(d["downloadURL"]), media_type(d["accessURL"]))
        return F.struct(d["accessURL"].alias("accessURL"), d["downloadURL"].alias("downloadURL"), kind.alias("mediaType"), F.coalesce(d["format"], format_label(kind)).alias("format"))

    return F.transform(every, repaired)


def has_download(distributions: Column) -> Column:
    return F.coalesce(F.exists(distributions, lambda d: F.length(F.trim(d["downloadURL"])) > 0), F.lit(False))


def server_type(header: Column) -> Column:
    """The kind of web server by its header."""
    return F.when(header.ilike("%apache%"), "apache").when(header.ilike("%nginx%"), "nginx").when(header.ilike("%iis%"), "iis").otherwise("unknown")


def metadata_type(content_type: Column, body: Column) -> Column:
    """What kind of metadata a source answers with."""
    root = F.regexp_extract(F.coalesce(body, F.lit("")), r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--[^>]*-->\s*)*<([A-Za-z0-9_:.-]+)", 1)
    is_json = content_type.contains("json") | (F.try_parse_json(body).isNotNull() & F.substring(F.ltrim(body), 1, 1).isin("{", "["))
    local = F.substring_index(root, ":", -1)
    return F.when(body.isNull(), "N/A").when(is_json, "JSON").when(local == "metadata", "FGDC").when(local == "MI_Metadata", "ISO-2").when(local == "MD_Metadata", "ISO-1").otherwise("INDETERMINATE")
