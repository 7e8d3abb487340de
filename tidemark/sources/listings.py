"""Web-accessible folders from fetched pages: links, times, and the crawl over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import listing_time
from tidemark.sources.scratch import written

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
#: Folders that are never entered.
EXCLUDED = ("../", "dcatus/")


def joined_url(base: Column, link: Column) -> Column:
    """A link in a page as a whole url."""
    site = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([^?#]*/)[^/?#]*", 1)
    folder = F.when(F.length(folder) <= F.length(site), F.concat(site, F.lit("/"))).otherwise(folder)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, F.regexp_replace(link, r"^(\./)+", "")))


def links(pages: DataFrame, url: str = "url", html: str = "html", extension: str = ".xml", excluded=EXCLUDED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page, pos, href, target, kind, row): each link to a file of the extension or to a folder below, with the text of its row, and the columns of its page that keep names."""
    row = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>[^<]*(?:</td>\s*<td[^>]*>[^<]*)*)"), F.lit(1))
    found = pages.select(*keep, F.col(url).alias("page"), F.posexplode(row).alias("pos", "row")).withColumn("href", F.regexp_extract("row", ANCHOR, 1))
    parent = F.regexp_replace(F.regexp_replace("page", r"/+$", ""), r"/[^/]*$", "")
    folder = F.col("href").endswith("/") & ~F.endswith(parent, F.regexp_replace("href", r"/+$", "")) & ~F.col("href").isin(*excluded)
    kind = F.when(F.col("href").endswith(extension), "file").when(folder, "folder")
    text = F.regexp_replace(F.regexp_replace("row", r"(?is)<[^>]*>", " "), r"&nbsp;|\s+", " ")
    return found.withColumn("kind", kind).where("kind is not null").select(*keep, "page", "pos", "href", joined_url(F.col("page"), F.col("href")).alias("target"), "kind", text.alias("row"))


def files(links_table: DataFrame, placeholder: str) -> DataFrame:
    """(identifier, modified_date) of the listed files; files without a known time get the placeholder, so they look new."""
    own = links_table.where("kind = 'file'")
    return own.select(F.col("target").alias("identifier"), listing_time(F.col("row"), F.lit(placeholder).cast("timestamp")).alias("modified_date"), "page", "pos")


def crawl(pages: DataFrame, start: str, **options) -> DataFrame:
    """Links of the pages that folders reach from a start page, each page once, by breadth, however deep."""
    every = links(pages, **options)
    folders = written(every.where("kind = 'folder'").select("page", "target").distinct(), "folders")
    level = pages.where(F.col("url") == start).select(F.col("url").alias("page")).distinct()
    seen = level
    while True:  # each level is pages not seen before, so it ends
        level = written(folders.join(level, "page").select(F.col("target").alias("page")).distinct().join(seen, "page", "left_anti"), "level")
        if level.isEmpty():
            return every.join(seen, "page", "left_semi")
        seen = seen.union(level)


def fetched(listed: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed files (identifier, ..) with the text of their document (url, doc), and those whose document could not be had."""
    own = documents.select(F.col("url").alias("identifier"), F.col("doc").alias("raw"))
    return listed.join(own, "identifier"), listed.join(own.select("identifier"), "identifier", "left_anti")


def collection(parent: DataFrame, members: DataFrame) -> DataFrame:
    """A collection's parent document first, then its members, told their parent; of several parents members are told the first by identifier."""
    first = parent.select("identifier", "modified_date", F.lit(None).cast("string").alias("parent_identifier"), F.lit(0).alias("phase"))
    rest = members.join(F.broadcast(parent.agg(F.min("identifier").alias("parent_identifier"))))  # one row
    return first.unionByName(rest.select("identifier", "modified_date", "parent_identifier", F.lit(1).alias("phase")))
