"""Registered queries of jobs while they run, of versioned tables and changing indexes, and of sources and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo, text
from tidemark.functions.json_schema import schema_errors
from tidemark.operators import diff, facets, lifecycle, progress, reports, scheduling, store
from tidemark.operators import documents as payloads
from tidemark.plans import roles, search, segments
from tidemark.plans.catalogue_search import GAP, documents
from tidemark.plans.registry import query
from tidemark.plans.roles import JOBS, ORDERS_NOW, RECORDS
from tidemark.schema import IDENTITY_FIELD, serialised, source_violations
from tidemark.sources import catalogs, scratch, versions, vocabularies

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


# --- changes of an index, versions of a table


@query(f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN concat_ws(' ', 'renewed', lang) ELSE concat_ws(' ', lang, 'from', source) END AS title, text FROM documents WHERE doc_id % 7 <> 0),
f AS (SELECT id, 'title' AS field, title AS v FROM d UNION ALL SELECT id, 'description', text FROM d),
p AS (SELECT id, field, unnest(list_filter(string_split_regex(lower(coalesce(v, '')), '[^a-z0-9'']+'), lambda w: w <> '')) AS token FROM f), k AS (SELECT * FROM p WHERE token NOT IN ({_STOP})),
len AS (SELECT id, field, count(*) AS l FROM k GROUP BY 1, 2), st AS (SELECT field, count(*) AS n, avg(l) AS m FROM len GROUP BY 1), tf AS (SELECT id, field, token, count(*) AS tf FROM k WHERE token IN ('renewed', 'thon') GROUP BY 1, 2, 3),
df AS (SELECT field, token, count(*) AS df FROM tf GROUP BY 1, 2)
SELECT id, round(sum(CASE field WHEN 'title' THEN 5.0 ELSE 3.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * l / m))), 4) AS score FROM tf JOIN df USING (field, token) JOIN len USING (id, field) JOIN st USING (field) GROUP BY 1""")
def index_after_changes(s, d):
    """Scores from an index that documents were added to in two goes, replaced in and deleted from."""
    table, n = scratch.new_path(s, "changing-index"), F.col("id")
    docs = documents(s, d).select("id", "title", "description", "keyword")
    change = lambda **k: segments.changed(s, table, fields={"title": 5.0, "description": 3.0}, gap=GAP, **k)
    change(added=docs.where(n % 2 == 0))
    change(added=docs.where(n % 2 == 1), deleted=docs.where(n % 14 == 0).select("id"))
    change(added=docs.where(n % 5 == 0).withColumn("title", F.concat_ws(" ", F.lit("renewed"), F.get("keyword", F.lit(0)))))
    change(deleted=docs.where(n % 7 == 0).select("id").union(s.range(10**9, 10**9 + 3)))
    return search.bm25(segments.opened(s, table), ["renewed", "thon"]).select("id", F.round("score", 4).alias("score"))


@query("SELECT 'before' AS reader, count(*)::BIGINT AS n, sum(p_size)::BIGINT AS size FROM part UNION ALL SELECT 'after', count(*)::BIGINT, sum(p_size + 1)::BIGINT FROM part WHERE p_size > 10")
def table_versions(s, d):
    """A table replaced while it is read: the reader keeps its version, later ones get the next, and two sessions see the same."""
    table, part = scratch.new_path(s, "versioned"), roles.read(s, d, "part").select("p_partkey", "p_size")
    versions.replaced(part, table)
    held = versions.Reader(s.newSession(), table)
    versions.replaced(part.where("p_size > 10").withColumn("p_size", F.col("p_size") + 1), table)
    versions.vacuum(s, table)
    told = lambda df, name: s.read.schema(df.schema).parquet(*df.inputFiles()).agg(F.count("*").alias("n"), F.sum("p_size").alias("size")).select(F.lit(name).alias("reader"), "n", "size")
    return told(held.table(), "before").union(told(versions.Reader(s, table).table(), "after"))


@query("SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier")
def loaded_and_appended(s, d):
    """A table filled anew and then added to."""
    path = store.replace_table(roles.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), scratch.new_path(s, "load"), "loaded_parts")
    store.append(roles.read(s, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name")), path)
    return s.read.parquet(path)


# --- jobs


def _stages(s, d):
    records = roles.records(s, d).withColumn("warned", F.col("id") % 10 == 0)
    return records, [records.where("action = 'delete'"), records.where("action = 'create'"), records.where("action = 'update'")]


_COUNTS = "count(*)::BIGINT AS records_total, " + ", ".join(f"(count(*) FILTER (status = 'success' AND action = '{a}'))::BIGINT AS records_{n}" for n, a in lifecycle.COUNTED.items()) + ", 0::BIGINT AS records_ignored, (count(*) FILTER (status <> 'success'))::BIGINT AS records_errored, 0::BIGINT AS records_validated, (count(*) FILTER (id % 10 = 0))::BIGINT AS records_warned"


@query(f"WITH {RECORDS}, r AS (SELECT *, CASE action WHEN 'delete' THEN 0 WHEN 'create' THEN 1 ELSE 2 END AS own FROM records) SELECT 'j' AS job, s.stage::INT AS stage, {_COUNTS} FROM r JOIN (SELECT unnest([0, 1, 2]) AS stage) s ON own <= s.stage GROUP BY 2")
def job_progress(s, d):
    """The counters of a job after each of its stages."""
    out, told = scratch.new_path(s, "job-records"), scratch.new_path(s, "job-progress")
    progress.run(_stages(s, d)[1], "j", out, told)
    return progress.progress(s, told)


@query(f"WITH {RECORDS} SELECT DISTINCT identifier, record_type, NULL::VARCHAR AS action, 1 AS phase FROM records WHERE trim(identifier) <> ''")
def harvest_validated(s, d):
    """A validate-only job compares and deletes nothing."""
    external = roles.records(s, d).select("identifier", "record_type", F.sha2(F.col("id").cast("string"), 256).alias("source_hash"), F.col("id").alias("pos"))
    return diff.harvest(external, external.select("identifier", "record_type", "source_hash").limit(0), "validate").distinct()


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END ELSE CASE WHEN length(s_name) > 12 THEN 1 ELSE 0 END END AS n_errors FROM supplier")
def validators_by_type(s, d):
    """Each record by the validator of its type."""
    schemas = {"dataset": {"properties": {"balance": {"minimum": 0}}}, "data_service": {"properties": {"name": {"maxLength": 12}}}}
    rows = roles.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "dataset").otherwise("data_service").alias("record_type"), F.to_json(F.struct(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))).alias("raw"))
    parts = [rows.where(F.col("record_type") == t).select("id", F.size(schema_errors(lifecycle.validator_for(schemas, t))("raw")).alias("n_errors")) for t in schemas]
    return parts[0].union(parts[1])


@query("SELECT c_custkey AS id FROM customer WHERE (c_custkey % 3 = 0) <> (c_custkey % 2 = 0)")
def sources_against_rule(s, d):
    n = F.col("c_custkey")
    return source_violations(roles.read(s, d, "customer").select(n.alias("id"), F.when(n % 3 == 0, "waf-collection").otherwise("document").alias("source_type"), F.when(n % 2 == 0, "https://example.org").alias("collection_parent_url"))).select("id")


@query("""WITH o AS (SELECT s_suppkey::VARCHAR AS id, lower(s_name) AS slug, ['old ' || s_suppkey, 'x' || s_suppkey % 7] AS aliases FROM supplier)
SELECT * FROM (SELECT id, slug FROM o WHERE list_contains(aliases, 'x3') ORDER BY id LIMIT 1) UNION ALL SELECT id, slug FROM o WHERE list_contains(aliases, 'old 5')""")
def organization_resolution(s, d):
    """Organizations by an alias, the first of several."""
    n = F.col("s_suppkey")
    rows = roles.read(s, d, "supplier").select(n.cast("string").alias("id"), F.lower("s_name").alias("slug"), F.array(F.concat(F.lit("old "), n), F.concat(F.lit("x"), n % 7)).alias("aliases"))
    return scheduling.organization_of(rows, "x3").union(scheduling.organization_of(rows, "old 5")).select("id", "slug")


# --- sources


@query("SELECT url AS identifier, 0 AS pos, length(html)::INT AS size FROM pages")
def single_documents(s, d):
    return catalogs.single_document(roles.read(s, d, "pages").select("url", F.col("html").alias("doc"))).select("identifier", "pos", F.length("raw").alias("size"))


@query("SELECT s_suppkey::VARCHAR AS id, s_name || CASE WHEN s_suppkey % 20 = 0 AND s_suppkey > 0 THEN ' again' ELSE '' END AS name FROM supplier")
def listing_pages(s, d):
    """Saved pages of a listing; each begins with the last item of the page before, as it reads by then."""
    n, size = F.col("s_suppkey"), 20
    item = lambda again: F.to_json(F.struct(n.cast("string").alias("id"), F.concat("s_name", F.lit(again)).alias("name")))
    rows = roles.read(s, d, "supplier")
    own = rows.select(F.floor(n / size).alias("page"), n.alias("at"), item("").alias("item"))
    # a page's first item stood last on the page before; the later page's reading counts
    early = rows.where((n % size == 0) & (n > 0)).select((n / size - 1).cast("long").alias("page"), n.alias("at"), item("").alias("item"))
    late = rows.where((n % size == 0) & (n > 0)).select(F.floor(n / size).alias("page"), n.alias("at"), item(" again").alias("item"))
    pages = own.join(late.select("page", "at"), ["page", "at"], "left_anti").unionByName(early).unionByName(late)
    text = pages.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("i")).select(F.lpad(F.col("page").cast("string"), 9, "0").alias("name"), F.concat(F.lit('{"results": ['), F.array_join(F.transform("i", lambda x: x["item"]), ", "), F.lit("]}")).alias("value"))
    path = scratch.new_path(s, "listing")
    text.select("value", "name").repartition(1).write.partitionBy("name").option("maxRecordsPerFile", 1).text(path)
    return catalogs.exported_pages(s, path, "results", "id").select("id", F.get_json_object("raw", "$.name").alias("name"))


@query("""WITH n AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT unnest(['dataset', 'data_service', 'catalog_record', 'data_series']) AS record_type, unnest(['dataset', 'service', 'record', 'datasetSeries']) AS field)
SELECT 'u' || k AS url, record_type, field || k AS identifier FROM n, t WHERE (k + length(field)) % 3 > 0 UNION ALL SELECT 'u' || k, 'dataset', 'inner' || k FROM n""")
def records_of_every_type(s, d):
    """A catalog's records of each of its four lists, and those of a catalog inside it."""
    n = F.col("s_suppkey")
    entry = lambda kind, field: F.when((n + len(field)) % 3 > 0, F.concat(F.lit(f', "{field}": [{{"{IDENTITY_FIELD[kind]}": "{field}'), n, F.lit('"}]'))).otherwise("")
    doc = F.concat(F.lit('{"title": "x"'), *[entry(*x) for x in catalogs.CATALOG_FIELDS.items()], F.lit(', "catalog": [{"dataset": [{"identifier": "inner'), n, F.lit('"}]}]}'))
    found = catalogs.all_records(roles.read(s, d, "supplier").select(F.concat(F.lit("u"), n).alias("url"), doc.alias("doc")))
    return found.select("url", "record_type", "identifier")


@query("SELECT DISTINCT lower(p_brand) AS value FROM part")
def reference_vocabulary(s, d):
    """A vocabulary's snapshot as a set."""
    path = scratch.new_path(s, "snapshot")
    roles.read(s, d, "part").agg(F.to_json(F.struct(F.struct(F.collect_set("p_brand").alias("values")).alias("brands"))).alias("value")).write.text(path)
    return vocabularies.reference_values(s, path, "brands").select("value")


# --- lookups, listings and texts


@query(f"WITH {JOBS} SELECT id, harvest_source_id FROM jobs WHERE status = 'in_progress'")
def jobs_in_progress(s, d):
    return facets.facet_filter(roles.jobs(s, d), "status eq in_progress").select("id", "harvest_source_id")


@query(f"""WITH {JOBS} SELECT id FROM jobs WHERE status = 'new' AND date_created < TIMESTAMP '{ORDERS_NOW}' AND harvest_source_id NOT IN (SELECT harvest_source_id FROM jobs WHERE status = 'in_progress') ORDER BY date_created, id LIMIT 3""")
def jobs_polled(s, d):
    """What a poll starts: due jobs of sources that run none, as many as there are free slots."""
    return scheduling.due(scheduling.startable(roles.jobs(s, d)), ORDERS_NOW, scheduling.free_slots(2)).select("id")


@query("""SELECT p_partkey AS id, 'https://example.org/harvest_record/' || p_partkey AS record, 'https://example.org/harvest_record/' || p_partkey || '/raw' AS raw,
CASE WHEN p_size % 2 = 0 THEN 'https://example.org/harvest_record/' || p_partkey || '/transformed' END AS transformed, p_size % 3 = 0 OR p_size % 5 = 0 AS has_spatial, p_size % 4 = 0 AS has_download FROM part""")
def record_urls(s, d):
    """Where a search document's record can be read, and what it has."""
    n, size = F.col("p_partkey"), F.col("p_size")
    doc = F.concat(F.lit('{"title": "x", "spatial": "'), F.when(size % 3 == 0, "here").otherwise(""), F.lit('", "theme": ["'), F.when(size % 5 == 0, " Geospatial ").otherwise("other"), F.lit('"], "distribution": [{"downloadURL": "'), F.when(size % 4 == 0, "https://x").otherwise(" "), F.lit('"}]}'))
    rows = roles.read(s, d, "part").select(n.alias("id"), doc.alias("dcat"), F.lit(None).cast("string").alias("translated_spatial"), n.alias("harvest_record_id"), (size % 2 == 0).alias("has_transformed"))
    return payloads.documents(rows, "https://example.org").select("id", F.col("harvest_record").alias("record"), F.col("harvest_record_raw").alias("raw"), F.col("harvest_record_transformed").alias("transformed"), "has_spatial", "has_download")


@query("SELECT o_orderkey AS id, o_orderkey % 6 < 4 AS number, CASE o_orderkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'neither' END AS flag FROM orders")
def texts_as_values(s, d):
    """Texts that read as numbers, in all ways to write one, and as flags."""
    n, price = F.col("o_orderkey") % 6, F.col("o_totalprice").cast("string")
    number = F.when(n == 0, F.concat(F.lit(" -"), price, F.lit(" "))).when(n == 1, F.concat(price, F.lit("e3"))).when(n == 2, "-Infinity").when(n == 3, "1_000.").when(n == 4, F.concat(price, F.lit("km"))).otherwise("")
    word = F.when(n == 0, " Yes").when(n == 1, "0").when(n == 2, "maybe")
    return roles.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), geo.is_number(number).alias("number"), F.coalesce(text.flag(word).cast("string"), F.lit("neither")).alias("flag"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","none":null}' AS json FROM region""")
def rows_as_json(s, d):
    return serialised(roles.read(s, d, "region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none")))


@query(f"WITH {JOBS}, c AS (SELECT status, count(*) AS n FROM jobs GROUP BY 1) SELECT string_agg(status, ',' ORDER BY status) AS status, string_agg(n::VARCHAR, ',' ORDER BY status) AS n FROM c")
def chart_of_states(s, d):
    """A chart's series, one list a column."""
    counts = roles.jobs(s, d).groupBy("status").agg(F.count("*").alias("n"))
    return reports.chart_series(counts, ["status", "n"], "status").select(F.array_join("status", ",").alias("status"), F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("n"))


@query("SELECT l_orderkey AS job, count(*)::BIGINT AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY 1")
def children_listing(s, d):
    """The issues of some jobs."""
    running = roles.jobs(s, d).where("status = 'in_progress'")
    return reports.children_of(running, roles.issues(s, d), "harvest_job_id").groupBy(F.col("harvest_job_id").alias("job")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name || ', \"' || c_mktsegment || '\"' AS name, c_acctbal AS balance FROM customer")
def exported_report(s, d):
    """A report as CSV, read back: quotes and commas in its values stay."""
    path, rows = scratch.new_path(s, "report"), roles.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"), F.col("c_acctbal").alias("balance"))
    store.export_csv(rows, path)
    return s.read.schema(rows.schema).csv(path, header=True, escape='"')


@query("""SELECT p_partkey AS id, '{"a": 1, "b": ' || p_size || '}' AS nested, p_size::VARCHAR AS issued, '[1, [2]]' AS place, '{"x": {"y": 2}}' AS publisher, CASE WHEN p_size % 2 = 0 THEN '["k", "[1, 2]"]' ELSE '["k", {"l": "[3]"}]' END AS many FROM part""")
def metadata_texts(s, d):
    """Metadata with whatever is nested more than a level as text."""
    n = F.col("p_size")
    raw = F.concat(F.lit('{"o": {"n": {"b": '), n, F.lit(', "a": 1}}, "issued": '), n, F.lit(', "spatial": [1,[2]], "publisher": {"x":{"y":2}}, "m": ["k", '), F.when(n % 2 == 0, "[1,2]").otherwise('{"l": [3]}'), F.lit("]}"))
    out = roles.read(s, d, "part").select(F.col("p_partkey").alias("id"), payloads.metadata(raw).alias("m"))
    at = lambda p: F.get_json_object("m", p)
    spaced = lambda c: F.regexp_replace(F.regexp_replace(c, ",", ", "), ":", ": ")  # noqa: E731  as the extractor writes it compactly
    return out.select("id", at("$.o.n").alias("nested"), at("$.issued").alias("issued"), at("$.spatial").alias("place"), spaced(at("$.publisher")).alias("publisher"), F.when(F.col("id").isNotNull(), F.regexp_extract("m", r'"m": (\[.*\])\}$', 1)).alias("many"))
