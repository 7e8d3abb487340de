"""Registered queries of the store, the job's course, sources, payloads and comparisons; each calls the library's operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, geo, identity, media, quality, text
from tidemark.operators import diff, documents, facets, lifecycle, paging, reports, scheduling, store, versions
from tidemark.plans import roles
from tidemark.plans.registry import query
from tidemark.plans.roles import EVENTS_NOW, ISSUES, JOBS, ORDERS_NOW, RECORDS
from tidemark.schema import outside
from tidemark.session import spread
from tidemark.sources import catalogs, listings, vocabularies

_SOURCES = "sources AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS organization_id, CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'manual' END AS frequency, lower(c_mktsegment) AS source_type FROM customer)"


# --- store


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS popularity FROM part")
def patch_rows(s, d):
    rows = roles.datasets(s, d).select("id", "title", "popularity")
    changes = rows.where("id % 3 = 0").select("id", F.upper("title").alias("title"), F.when(F.col("id") % 2 == 0, F.col("popularity") + 1).alias("popularity"), F.lit(1).alias("unknown"))
    return store.patched(rows, changes)


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_size <> 7")
def remove_rows(s, d):
    rows = roles.datasets(s, d)
    return store.removed(rows.select("id", "title"), rows.where("popularity = 7"), ["id"])


@query("""WITH g AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), j AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM g))
SELECT 'harvest_source' AS name, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM g))::BIGINT AS n UNION ALL SELECT 'harvest_job', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM j))::BIGINT
UNION ALL SELECT 'harvest_job_error', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM j))::BIGINT
UNION ALL SELECT 'harvest_record_error', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM j))::BIGINT
UNION ALL SELECT 'unnamed', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM j) AND l_suppkey IN (SELECT id FROM g))::BIGINT""")
def cascade_delete(s, d):
    own = roles.read(s, d, "customer")
    issues = roles.read(s, d, "lineitem").select(F.col("l_orderkey").alias("harvest_job_id"), F.col("l_suppkey").alias("harvest_record_id"))
    records = own.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("harvest_source_id"))
    tables = {
        "harvest_source": own.select(F.col("c_custkey").alias("id")), "harvest_job": roles.jobs(s, d).select("id", "harvest_source_id"), "harvest_record": records, "dataset": records,
        "harvest_job_error": issues.select("harvest_job_id"), "harvest_record_error": issues,
    }
    left = store.cascade_source_delete(tables, own.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    counts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("harvest_source", "harvest_job", "harvest_job_error", "harvest_record_error")]
    counts.append(left["harvest_record_error"].where("harvest_record_id is null").agg(F.count("*").alias("n")).select(F.lit("unnamed").alias("name"), "n"))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionAll(more)
    return out


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def deletable_sources(s, d):
    return store.deletable_sources(roles.sources(s, d).select("id"), roles.jobs(s, d).where("status = 'new'"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'missing' ELSE 'found' END AS outcome FROM part WHERE p_size > 25")
def index_batch(s, d):
    rows = roles.datasets(s, d)
    found, missing = store.index_batches(s, rows.where("popularity > 25"), rows.where("id % 11 <> 0"))
    return found.select("id", F.lit("found").alias("outcome")).unionAll(missing.select("id", F.lit("missing").alias("outcome")))


@query("""SELECT (SELECT count(*) FROM part WHERE p_size <> 3)::BIGINT AS succeeded, (SELECT count(*) FROM part WHERE p_size = 3)::BIGINT + (SELECT count(*) FROM part WHERE p_size = 5)::BIGINT AS failed""")
def index_tally(s, d):
    """Documents of size 3 lack a title, those of size 5 come twice."""
    rows = roles.datasets(s, d).select("id", F.when(F.col("popularity") != 3, F.col("title")).alias("title"), "popularity")
    return store.index_tally(*store.index_outcome(rows.unionAll(rows.where("popularity = 5"))))


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '-') || '-' || (p_partkey + 1) ELSE 'edited-' || p_partkey END AS slug FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT id FROM c WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey <> c.id AND replace(p.p_name, ' ', '-') || '-' || p.p_partkey = c.slug))
SELECT p_partkey AS id, CASE WHEN c.id IS NOT NULL AND x.id IS NULL THEN c.slug ELSE replace(p_name, ' ', '-') || '-' || p_partkey END AS slug FROM part LEFT JOIN c ON c.id = p_partkey LEFT JOIN x ON x.id = p_partkey""")
def slug_edits(s, d):
    sets = roles.datasets(s, d).select("id", "slug", "title")
    n = F.col("id")
    changes = sets.where("id % 2 = 0").select("id", F.when(n % 4 == 0, F.concat_ws("-", F.regexp_replace("title", " ", "-"), n + 1)).otherwise(F.concat(F.lit("edited-"), n)).alias("slug"))
    return store.reslugged(sets.select("id", "slug"), changes)[0]


@query("SELECT p_partkey AS id, replace(p_name, ' ', '-') || '-' || p_partkey AS slug, upper(p_name) AS title FROM part")
def slug_survives_harvest(s, d):
    sets = roles.datasets(s, d).select("id", "slug", "title")
    return store.harvested(sets, sets.select("id", F.lit("of-the-harvest").alias("slug"), F.upper("title").alias("title")))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 4 IN (1, 3)")
def organization_conflicts(s, d):
    n = F.col("id")
    rows = roles.organizations(s, d).withColumn("code_repo_url", F.when(n % 4 < 2, " https://x.org").when(n % 4 == 3, "ftp://x.org").otherwise(" ")).withColumn("code_repo_exempt", n % 2 == 1)
    return store.repo_conflicts(rows).select("id")


# --- jobs


@query(f"WITH {JOBS}, {_SOURCES} SELECT j.id, s.name AS source, n.n_name AS organization FROM jobs j LEFT JOIN sources s ON s.id = j.harvest_source_id LEFT JOIN nation n ON n.n_nationkey = s.organization_id")
def job_navigation(s, d):
    rows = reports.with_parents(roles.jobs(s, d).select("id", "harvest_source_id"), roles.sources(s, d), roles.organizations(s, d))
    return rows.select("id", F.col("source.name").alias("source"), F.col("organization.name").alias("organization"))


@query(f"WITH {JOBS} SELECT id, status, date_created FROM jobs WHERE harvest_source_id = 5 AND status = 'complete' ORDER BY date_created DESC, id LIMIT 1")
def first_job_by_values(s, d):
    return scheduling.first_by(roles.jobs(s, d), [F.desc("date_created"), F.asc("id")], harvest_source_id=5, status="complete").select("id", "status", "date_created")


@query(f"WITH {JOBS} SELECT id FROM jobs WHERE status = 'in_progress' AND id % 3 <> 0")
def jobs_without_task(s, d):
    jobs = roles.jobs(s, d)
    return scheduling.failed(jobs, jobs.where("id % 3 = 0").select(F.col("id").alias("job_id"))).select("id")


@query(f"""WITH {JOBS}, {_SOURCES} SELECT id, harvest_source_id, date_created, 'kept' AS plan FROM jobs WHERE NOT (status = 'new' AND date_created > TIMESTAMP '{ORDERS_NOW}' AND harvest_source_id % 2 = 0)
UNION ALL SELECT NULL, id, TIMESTAMP '{ORDERS_NOW}' + CASE frequency WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END, 'new' FROM sources WHERE id % 2 = 0 AND frequency <> 'manual'""")
def jobs_rescheduled(s, d):
    kept, new = scheduling.rescheduled(roles.jobs(s, d), roles.sources(s, d).where("id % 2 = 0"), ORDERS_NOW)
    return kept.select("id", "harvest_source_id", "date_created", F.lit("kept").alias("plan")).unionAll(new.select(F.lit(None).cast("long"), "harvest_source_id", "date_created", F.lit("new")))


_DONE = f"""{RECORDS}, i AS (SELECT event_id AS id, bool_or(value > 90) AS e, bool_or(value < 20) AS w FROM events WHERE value > 90 OR value < 20 GROUP BY 1),
st AS (SELECT r.id, harvest_source_id, CASE WHEN action = 'update' AND r.id % 5 = 0 THEN NULL ELSE action END AS action, CASE WHEN coalesce(e, false) THEN 'error' ELSE 'success' END AS status, coalesce(w, false) AS warned FROM records r LEFT JOIN i ON i.id = r.id)"""


def _states(s, d):
    """Records of which some are unchanged, with an error for great values and a warning for small ones."""
    r = roles.records(s, d).withColumn("action", F.when((F.col("action") == "update") & (F.col("id") % 5 == 0), F.lit(None).cast("string")).otherwise(F.col("action")))
    issues = r.where("value > 90 or value < 20").select(F.col("id").alias("harvest_record_id"), F.when(F.col("value") > 90, "error").otherwise("warning").alias("severity"))
    return lifecycle.states(r, issues)


@query(f"WITH {_DONE} SELECT id, status, status = 'success' AND action IS NOT NULL AS synced, warned FROM st")
def record_states(s, d):
    return _states(s, d).select("id", "status", "synced", "warned")


@query(f"""WITH {_DONE} SELECT harvest_source_id, count(*)::BIGINT AS records_total, (count(*) FILTER (status = 'success' AND action = 'create'))::BIGINT AS records_added, (count(*) FILTER (status = 'success' AND action = 'update'))::BIGINT AS records_updated,
(count(*) FILTER (status = 'success' AND action = 'delete'))::BIGINT AS records_deleted, (count(*) FILTER (status = 'success' AND action IS NULL))::BIGINT AS records_ignored, (count(*) FILTER (status = 'error'))::BIGINT AS records_errored, 0::BIGINT AS records_validated,
(count(*) FILTER (warned))::BIGINT AS records_warned FROM st GROUP BY 1""")
def outcome_counters(s, d):
    return lifecycle.counters(_states(s, d), ("harvest_source_id",))


@query(f"WITH {RECORDS} SELECT (count(*) FILTER (status = 'error') + count(*) FILTER (action = 'delete') + count(*) FILTER (status = 'success'))::BIGINT AS records_total FROM records")
def planned_total(s, d):
    r = roles.records(s, d)
    external = {t: r.where((F.col("status") == "success") & (F.col("record_type") == t)) for t in ("dataset", "data_service")}
    return lifecycle.planned_total(r.where("status = 'error'"), r.where("action = 'delete'"), external)


@query(f"""WITH {JOBS} SELECT id, CASE WHEN id % 3 = 0 AND status <> 'complete' THEN 'complete' ELSE replace(status, 'complete', 'error') END AS status, CASE WHEN id % 3 = 0 AND status <> 'complete' THEN id % 10 END AS records_added FROM jobs""")
def job_completion(s, d):
    """Jobs in error stay so; of the others every third has ended."""
    jobs = roles.jobs(s, d).select("id", F.when(F.col("status") == "complete", "error").otherwise(F.col("status")).alias("status"), F.lit(None).cast("timestamp").alias("date_finished"), F.lit(None).cast("long").alias("records_added"))
    done = jobs.where("id % 3 = 0").select("id", (F.col("id") % 10).alias("records_added"))
    return lifecycle.completed(jobs, done, ORDERS_NOW).select("id", "status", "records_added")


@query(f"WITH {JOBS} SELECT id AS harvest_job_id, 'ClearJobException' AS type FROM jobs WHERE priority = '1-URGENT' AND harvest_source_id IN (SELECT user_id FROM events)")
def clear_job_issues(s, d):
    jobs = roles.jobs(s, d).withColumn("job_type", F.when(F.col("priority") == "1-URGENT", "clear").otherwise("harvest"))
    return lifecycle.clear_issues(jobs, roles.records(s, d)).select("harvest_job_id", "type")


@query(f"WITH {RECORDS} SELECT id, CASE WHEN id % 2 = 0 THEN 'new' WHEN id % 3 = 0 THEN 'old' END AS source_transform FROM records")
def transformed_payloads(s, d):
    r = roles.records(s, d).select("id", F.when(F.col("id") % 3 == 0, "old").alias("source_transform"))
    return lifecycle.transformed(r, r.where("id % 2 = 0").select("id", F.lit("new").alias("payload")))


@query(f"WITH {RECORDS} SELECT id, coalesce(ts, TIMESTAMP '{EVENTS_NOW}') AS date_finished FROM (SELECT id, CASE WHEN id % 2 = 0 THEN date_created END AS ts FROM records)")
def finish_stamps(s, d):
    r = roles.records(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("date_created")).alias("date_finished"))
    return scheduling.finished(r, EVENTS_NOW)


@query(f"WITH {ISSUES} SELECT type, count(*)::BIGINT AS n, CASE type WHEN 'CompareException' THEN 'job' WHEN 'SynchronizeException' THEN 'record' END AS scope FROM (SELECT CASE WHEN severity = 'A' THEN 'CompareException' WHEN severity = 'N' THEN 'SynchronizeException' ELSE 'Other' END AS type FROM issues) GROUP BY 1")
def issue_scopes(s, d):
    kind = F.when(F.col("severity") == "A", "CompareException").when(F.col("severity") == "N", "SynchronizeException").otherwise("Other")
    return roles.issues(s, d).select(kind.alias("type")).groupBy("type").agg(F.count("*").alias("n")).withColumn("scope", lifecycle.issue_scope(F.col("type")))


@query(f"WITH {RECORDS} SELECT id, CASE WHEN id % 3 = 0 THEN 'named' WHEN id % 3 = 1 THEN 't' || id ELSE 'no-identifier' END AS label FROM records")
def records_without_identifier(s, d):
    n = F.col("id")
    r = roles.records(s, d).select("id", F.when(n % 3 == 0, n.cast("string")).otherwise(" ").alias("identifier"), F.when(n % 3 == 1, F.concat(F.lit("t"), n)).alias("title"), F.lit(" ").alias("description"))
    named, blank = diff.without_identifier(r)
    return named.select("id", F.lit("named").alias("label")).unionAll(blank.select("id", "label"))


@query(f"WITH {RECORDS} SELECT id, identifier, 'j' AS harvest_job_id, 's' AS harvest_source_id, action, record_type FROM records WHERE status = 'success'")
def version_rows(s, d):
    r = roles.records(s, d).where("status = 'success'").select(F.concat("id", F.lit("|"), "identifier").alias("identifier"), "action", "record_type", F.lit("h").alias("new_hash"))
    rows = lifecycle.versions_of(r, "j", "s")
    return rows.select(F.split_part("identifier", F.lit("|"), F.lit(1)).cast("long").alias("id"), F.split_part("identifier", F.lit("|"), F.lit(2)).alias("identifier"), "harvest_job_id", "harvest_source_id", "action", "record_type")


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') AND p_size BETWEEN 5 AND 30 AND p_type IN ('ECONOMY', 'PROMO') AND p_brand IS DISTINCT FROM 'Brand#3' AND NOT starts_with(p_name, 's')")
def facet_more_operators(s, d):
    return facets.facet_filter(roles.read(s, d, "part"), "p_name icontains_op RED,p_size between_op 5 30,p_type in_op ECONOMY PROMO,p_brand is_distinct_from Brand#3,p_name not_startswith_op s").select(F.col("p_partkey").alias("id"))


@query(f"WITH {ISSUES} SELECT severity, count(*)::BIGINT AS count, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM issues j WHERE j.severity = i.severity ORDER BY id LIMIT 10)) AS sample FROM issues i GROUP BY 1")
def issue_samples(s, d):
    return reports.samples(roles.issues(s, d), "severity").select("severity", "count", F.array_join("sample", ",").alias("sample"))


# --- sources


@query("SELECT n_nationkey AS id, u.pos::INT AS pos, u.raw AS raw FROM nation, (VALUES (0, '{\"identifier\":\"a\"}'), (1, '{\"identifier\":\"b\"}')) AS u(pos, raw) WHERE n_nationkey % 2 = 0")
def flat_catalogs(s, d):
    """Every other catalog is malformed and has no records."""
    doc = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"dataset": [{"identifier":"a"}, {"identifier":"b"}]}')).otherwise('{"dataset": [')
    return catalogs.flat_records(roles.read(s, d, "nation").select(F.col("n_nationkey").alias("id"), doc.alias("doc"))).select("id", "pos", "raw")


def _parents(s, d):
    n = F.col("p_partkey")
    one, two = (F.concat(F.lit('{"identifier": "d'), n % k, F.lit('"}')) for k in (50, 60))
    raw = F.concat(F.lit('{"servesDataset": ['), one, F.lit(", "), one, F.lit('], "primaryTopic": '), two, F.lit("}"))
    return roles.read(s, d, "part").select(n.alias("pos"), F.concat(F.lit("p"), n).alias("identifier"), raw.alias("raw"))


@query("SELECT p_partkey AS parent_pos, 'd' || p_partkey % 50 AS identifier FROM part UNION SELECT p_partkey, 'd' || p_partkey % 60 FROM part")
def nested_datasets(s, d):
    return catalogs.nested_datasets(_parents(s, d), ["servesDataset", "primaryTopic"]).select("parent_pos", "identifier")


@query("""WITH n AS (SELECT p_partkey AS pos, 'd' || p_partkey % 50 AS identifier FROM part UNION SELECT p_partkey, 'd' || p_partkey % 60 FROM part), f AS (SELECT identifier, min(pos) AS p FROM n GROUP BY 1), t AS (SELECT DISTINCT 'd' || p_partkey AS identifier FROM part WHERE p_size > 10)
SELECT coalesce(t.identifier, f.identifier) AS identifier, 'p' || f.p AS parent_identifier FROM t FULL OUTER JOIN f ON f.identifier = t.identifier""")
def merged_records(s, d):
    top = roles.read(s, d, "part").where("p_size > 10").select(F.concat(F.lit("d"), "p_partkey").alias("identifier"), F.lit("{}").alias("raw"))
    return catalogs.merged(top, catalogs.nested_datasets(_parents(s, d), ["servesDataset", "primaryTopic"])).select("identifier", "parent_identifier")


@query("SELECT n_nationkey AS id, '{\"title\": \"t' || n_nationkey || '\", \"catalog\": [{\"x\": 1}]}' AS doc FROM nation")
def stripped_catalogs(s, d):
    doc = F.concat(F.lit('{"title": "t'), "n_nationkey", F.lit('", "dataset": [1], "catalog": [{"x": 1, "service": {"a": 2}}]}'))
    return roles.read(s, d, "nation").select(F.col("n_nationkey").alias("id"), catalogs.stripped()(doc).alias("doc"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' + to_days((p_partkey % 700)::INT) + to_minutes((p_partkey % 1440)::INT) END AS at FROM part""")
def listing_times(s, d):
    n = F.col("p_partkey")
    at = F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(days=(n % 700).cast("int"), mins=(n % 1440).cast("int"))
    shown = F.when(n % 5 == 0, F.date_format(at, "yyyy-MM-dd  HH:mm")).when(n % 5 == 1, F.date_format(at, "dd-MMM-yyyy HH:mm")).when(n % 5 == 2, F.date_format(at, "M/d/yyyy h:mm a")).when(n % 5 == 3, F.date_format(at, "EEEE, MMMM d, yyyy  h:mm a")).otherwise("no time")
    row = F.concat(F.lit("<a>file.xml</a> "), shown, F.lit(" 26K"))
    return roles.read(s, d, "part").select(n.alias("id"), dates.listing_time(row, F.lit("2000-01-01").cast("timestamp")).alias("at"))


@query("SELECT p_partkey // 10 AS page, p_partkey AS file FROM part")
def folder_crawl(s, d):
    """Parts as files of a folder a tenth part, each folder inside the one of its tenth."""
    n, folder = F.col("p_partkey"), F.expr("p_partkey div 10")
    pages = roles.read(s, d, "part").withColumn("folder", folder).groupBy("folder").agg(F.concat_ws("", F.collect_list(F.concat(F.lit('<a href="'), n, F.lit('.xml">f</a>')))).alias("files"))
    inner = pages.where("folder > 0").groupBy(F.expr("folder div 10").alias("folder")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit('<a href="/w/'), "folder", F.lit('/">d</a>')))).alias("folders"))
    html = F.concat(F.lit('<a href="../">up</a>'), "files", F.coalesce("folders", F.lit("")))
    rows = pages.join(inner, "folder", "left").select(F.concat(F.lit("https://h/w/"), "folder", F.lit("/")).alias("url"), html.alias("html"))
    found = listings.crawl(rows, "https://h/w/0/").where("kind = 'file'")
    return found.select(F.regexp_extract("page", r"(\d+)/$", 1).cast("long").alias("page"), F.regexp_extract("href", r"^\d+", 0).cast("long").alias("file"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'xml ' || p_name END AS raw FROM part")
def fetched_documents(s, d):
    rows = roles.read(s, d, "part")
    listed, docs = rows.select(F.col("p_partkey").alias("identifier")), rows.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("url"), F.concat(F.lit("xml "), "p_name").alias("doc"))
    had, lost = listings.fetched(listed, docs)
    return had.select(F.col("identifier").alias("id"), "raw").unionAll(lost.select("identifier", F.lit(None).cast("string")))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey > 0 THEN 0 END AS parent, CASE WHEN s_suppkey > 0 THEN 1 ELSE 0 END AS phase FROM supplier")
def folder_collection(s, d):
    rows = roles.read(s, d, "supplier").select(F.col("s_suppkey").alias("identifier"), F.lit("2024-01-01").cast("timestamp").alias("modified_date"))
    return listings.collection(rows.where("identifier = 0"), rows.where("identifier > 0")).select(F.col("identifier").alias("id"), F.col("parent_identifier").cast("long").alias("parent"), "phase")


@query("SELECT DISTINCT 'languages' AS kind, lang AS value FROM documents WHERE length(lang) = 2 UNION ALL SELECT DISTINCT 'types', lower(p_type) || '/' || p_size FROM part UNION ALL SELECT DISTINCT 'names', lower(v) FROM (SELECT p_brand AS v FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)")
def registries(s, d):
    part = roles.read(s, d, "part")
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "value")
    langs = vocabularies.language_codes(roles.read(s, d, "documents"), "lang")
    types = vocabularies.media_types(part.select(F.concat("p_type", F.lit("/"), "p_size").alias("Template")).union(part.select("p_type")))
    names = vocabularies.charset_names(part.select(F.col("p_brand").alias("Name"), F.col("p_name").alias("Aliases")))
    return tagged(langs, "languages").unionAll(tagged(types, "types")).unionAll(tagged(names, "names"))


# --- payloads and values


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'http://a/x.csv' WHEN 1 THEN 'http://a/x.csv|http://land' WHEN 2 THEN 'http://land' ELSE 'http://a/x.csv' END AS urls, CASE p_partkey % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/csv|text/html' WHEN 2 THEN 'text/html' ELSE 'given/kind' END AS kinds FROM part""")
def distribution_repair(s, d):
    n = F.col("p_partkey")
    blank = F.lit(None).cast("string")
    item = lambda url, kind: F.struct(F.lit(url).alias("accessURL"), blank.alias("downloadURL"), kind.alias("mediaType"), blank.alias("format"))
    own = F.when(n % 4 == 2, F.array(item("http://land", blank))).when(n % 4 == 3, F.array(item("http://a/x.csv", F.lit("given/kind")))).otherwise(F.array(item("http://a/x.csv", F.lit(" "))))
    land = F.when((n % 4 == 1) | (n % 4 == 2), "http://land")
    out = roles.read(s, d, "part").select(n.alias("id"), media.repaired_distributions(own, land).alias("r"))
    return out.select("id", F.array_join("r.accessURL", "|").alias("urls"), F.array_join(F.transform("r", lambda x: F.coalesce(x["mediaType"], F.when(x["accessURL"] == "http://land", "text/html"))), "|").alias("kinds"))


@query("""SELECT p_partkey AS id, p_name AS title, 'id-' || p_partkey AS identifier, CASE WHEN p_partkey % 2 = 0 THEN 'parent' END AS parent, CASE WHEN p_partkey % 3 = 0 THEN 'given' ELSE 'No description was provided.' END AS description, 'org' AS publisher FROM part""")
def repaired_payloads(s, d):
    n = F.col("p_partkey")
    raw = F.concat(F.lit('{"title": "'), "p_name", F.lit('"'), F.when(n % 3 == 0, ', "description": "given"').otherwise(""), F.lit("}"))
    fixed = documents.repaired()(raw, F.concat(F.lit("id-"), n), F.when(n % 2 == 0, "parent"), F.lit("org"))
    at = lambda p: F.get_json_object("doc", p)
    return roles.read(s, d, "part").select(n.alias("id"), fixed.alias("doc")).select("id", at("$.title").alias("title"), at("$.identifier").alias("identifier"), at("$.isPartOf").alias("parent"), at("$.description").alias("description"), at("$.publisher.name").alias("publisher"))


@query("""SELECT p_partkey AS id, replace(lower(p_name), ' ', '-') AS slug, p_partkey % 3 = 0 AS placed, p_partkey % 3 = 1 AS spatial_warning FROM part""")
def dataset_payloads(s, d):
    n = F.col("p_partkey")
    raw = F.concat(F.lit('{"title": "'), "p_name", F.lit('"'), F.when(n % 3 == 0, ', "spatial": "1, 2"').when(n % 3 == 1, ', "spatial": "somewhere"').otherwise(""), F.lit("}"))
    none = F.lit(None).cast("string")
    rows = roles.read(s, d, "part").select(n.alias("id"), none.alias("source_transform"), raw.alias("source_raw"), F.lit("i").alias("identifier"), F.lit("dataset").alias("record_type"), F.lit(1).alias("harvest_source_id"), F.lit(None).cast("timestamp").alias("date_finished"))
    return documents.dataset_payloads(rows).select("id", "slug", F.col("translated_spatial").isNotNull().alias("placed"), "spatial_warning")


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS has_spatial FROM part")
def spatial_flags(s, d):
    n = F.col("p_partkey")
    raw = F.concat(F.lit('{"title": "t"'), F.when(n % 2 == 0, ', "spatial": "x"').otherwise(', "spatial": ""'), F.when(n % 3 == 0, ', "theme": ["Geospatial "]').otherwise(""), F.lit("}"))
    rows = roles.read(s, d, "part").select(n.alias("id"), raw.alias("dcat"), F.when(n % 5 == 0, '{"type": "Point", "coordinates": [1, 2]}').alias("translated_spatial"), n.alias("harvest_record_id"), F.lit(True).alias("has_transformed"))
    return documents.documents(rows, "http://c").select("id", "has_spatial")


@query("SELECT event_id AS id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.') || lpad((floor(millisecond(ts)) % 1000)::INT::VARCHAR, 3, '0') || 'Z' AS utc FROM events")
def utc_times(s, d):
    return roles.read(s, d, "events").select(F.col("event_id").alias("id"), dates.utc_text(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))).alias("utc"))


@query("SELECT o_orderkey AS id, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE::VARCHAR AS first, (date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE::VARCHAR AS last FROM orders")
def months_before(s, d):
    first, last = dates.last_month(F.col("o_orderdate"))
    return roles.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), first.cast("string").alias("first"), last.cast("string").alias("last"))


@query(f"SELECT event_id AS id, event_id % 4 = 0 OR epoch(TIMESTAMP '{EVENTS_NOW}') - epoch(ts) > 86400 AS stale FROM events")
def stale_tasks(s, d):
    at = F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise("no time")
    return roles.read(s, d, "events").select(F.col("event_id").alias("id"), dates.is_stale(at, EVENTS_NOW).alias("stale"))


@query("""SELECT p_partkey AS id, replace(replace(lower(p_name), ' ', '_'), '/', '') AS munged, array_to_string(list_transform(string_split(lower(p_type), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label, array_to_string(list_filter(string_split(p_name || ',' || p_brand, ','), lambda x: x <> ''), '|') AS listed, 'WARNING a, ERROR ' || p_size AS told,
'v' || p_size AS extra, coalesce(p_type, 'N/A') AS shown, CASE WHEN p_partkey % 2 = 0 THEN '0a1b2c3d-0000-4000-8000-' || lpad(p_partkey::VARCHAR, 12, '0') END AS job, p_partkey % 2 = 0 AS uuid FROM part""")
def text_functions(s, d):
    n, size = F.col("p_partkey"), F.col("p_size")
    job = F.concat(F.lit("0a1b2c3d-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    extras = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("a", F.lit("x")), ("b", F.concat(F.lit("v"), size)), ("b", F.lit("second")))])
    lines = F.array(F.lit("WARNING a"), F.lit("fine"), F.concat(F.lit("ERROR "), size))
    return roles.read(s, d, "part").select(
        n.alias("id"), text.munged_name(F.col("p_name")).alias("munged"), text.label(F.col("p_type")).alias("label"), F.array_join(text.listed(F.concat("p_name", F.lit(",,"), "p_brand"), ","), "|").alias("listed"), text.warnings_and_errors(lines).alias("told"),
        text.extra(extras, "b").alias("extra"), text.or_na(F.col("p_type")).alias("shown"), text.task_job_id(F.when(n % 2 == 0, F.concat(F.lit("harvest-job-"), job, F.lit("-run"))).otherwise("other")).alias("job"), identity.is_uuid4(F.when(n % 2 == 0, job).otherwise("x")).alias("uuid"),
    )


@query("SELECT p_partkey AS id, 'title' AS field, p_name AS left, upper(p_name) AS right FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR, NULL FROM part")
def differing_documents(s, d):
    part = roles.read(s, d, "part")
    left = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit('{"title": "'), "p_name", F.lit('", "size": "'), "p_size", F.lit('"}')).alias("doc"))
    right = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit('{"title": "'), F.when(F.col("p_size") > 10, F.upper("p_name")).otherwise(F.col("p_name")), F.lit('"}')).alias("doc"))
    return reports.document_differences(left, right)


@query("SELECT p_partkey AS id, p_type NOT IN ('ECONOMY', 'PROMO') AS outside FROM part")
def closed_vocabulary(s, d):
    return roles.read(s, d, "part").select(F.col("p_partkey").alias("id"), outside(F.col("p_type"), ("ECONOMY", "PROMO")).alias("outside"))


# --- comparisons


@query("SELECT coalesce(n_name, 'c-' || c_nationkey) AS name, count(*)::BIGINT AS count FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0 GROUP BY 1")
def title_mapping(s, d):
    counts = roles.read(s, d, "customer").groupBy(F.concat(F.lit("c-"), "c_nationkey").alias("name")).agg(F.count("*").alias("count"))
    titles = roles.organizations(s, d).where("id % 2 = 0").select(F.concat(F.lit("c-"), "id").alias("title"), "name")
    return reports.mapped_names(counts, titles)


@query("""SELECT n_name AS name, n_nationkey % 5 <> 0 AS in_other, n_nationkey % 5 <> 0 AND n_nationkey % 2 = 0 AS same_type, n_nationkey % 5 <> 0 AS same_logo, n_nationkey AS package_count, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey + 1 ELSE 0 END AS other_package_count FROM nation""")
def organization_attributes(s, d):
    ours = roles.organizations(s, d).select("name", "type", F.lit("l").alias("logo"), F.col("id").alias("package_count"), "id")
    theirs = ours.where("id % 5 <> 0").select("name", F.when(F.col("id") % 2 == 0, F.col("type")).otherwise("other").alias("type"), "logo", (F.col("package_count") + 1).alias("package_count"))
    return reports.attribute_comparison(ours, theirs)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_size % 4 IN (0, 1) THEN true WHEN p_partkey % 2 = 1 AND p_size % 4 IN (1, 2) THEN true WHEN p_size % 4 IN (1, 3) THEN NULL ELSE false END::VARCHAR AS same FROM part""")
def schema_type_comparison(s, d):
    size = F.col("p_size") % 4
    theirs = F.when(size == 0, "datajson").when(size == 1, "single-doc").when(size == 2, "waf").otherwise("csw")
    return roles.read(s, d, "part").select(F.col("p_partkey").alias("id"), reports.same_schema_type(F.when(F.col("p_partkey") % 2 == 0, "dcatus1.1: federal").otherwise("iso19115_2"), theirs).cast("string").alias("same"))


@query(f"""WITH {_SOURCES} SELECT id, CASE WHEN id % 3 = 0 THEN 'waf' ELSE 'document' END AS source_type, CASE WHEN id % 3 = 0 THEN 'iso19115_2' ELSE 'dcatus1.1: non-federal' END AS schema_type, frequency, CASE WHEN id % 2 = 0 THEN 'a@x.org|b@x.org' ELSE '' END AS emails FROM sources""")
def migrated_sources(s, d):
    n = F.col("id")
    rows = roles.sources(s, d).withColumns({"source_type": F.when(n % 3 == 0, "waf-collection").otherwise("datajson"), "frequency": F.upper("frequency"), "extras": F.when(n % 2 == 0, F.array(F.struct(F.lit("email_list").alias("key"), F.lit("a@x.org\r\nb@x.org").alias("value")))).otherwise(F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value"))))})
    return reports.source_fields(rows).select("id", "source_type", "schema_type", "frequency", F.array_join("notification_emails", "|").alias("emails"))


@query("SELECT o_custkey AS source, CASE WHEN o_custkey % 2 = 0 THEN strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS last_modified FROM orders GROUP BY 1, o_custkey % 2")
def source_last_modified(s, d):
    even = F.col("o_custkey") % 2 == 0
    rows = roles.read(s, d, "orders").select(F.col("o_custkey").alias("source"), F.when(even, F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("header"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("modified"))
    return reports.last_modified(rows)


@query("SELECT n_nationkey AS id, round(100.0 * (n_nationkey % 7) / nullif(n_nationkey % 9, 0), 3) AS share FROM nation WHERE n_nationkey % 9 > 0 UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_nationkey % 9 = 0")
def discrepancy_shares(s, d):
    n = F.col("n_nationkey")
    return roles.read(s, d, "nation").select(n.alias("id"), reports.discrepancy_share(n % 7, n % 9).alias("share"))


# --- quality


_MEDIA = "SELECT id FROM (VALUES ('text/csv'), ('application/json')) AS m(id)"


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS even, p_partkey % 3 = 0 AS third, p_size AS n FROM part)
SELECT id, '$' AS path, 'Dataset' AS class, 'keyword' AS field, 'a' AS value, 'duplicate_keyword' AS type FROM p WHERE even
UNION ALL SELECT id, '$', 'Dataset', 'accessRights', 'Non-Public', 'legacy_access_rights' FROM p WHERE even UNION ALL SELECT id, '$', 'Dataset', 'spatialResolutionInMeters', '-' || n, 'invalid_spatial_resolution' FROM p
UNION ALL SELECT id, '$', 'Dataset', 'created', '2024-02-01', 'date_out_of_order' FROM p, (VALUES (1), (2)) WHERE third UNION ALL SELECT id, '$', 'Dataset', 'language', 'x', 'invalid_language' FROM p UNION ALL SELECT id, '$', 'Dataset', 'language', 'qq', 'invalid_language' FROM p
UNION ALL SELECT id, '$.distribution[0]', 'Distribution', 'byteSize', n || 'kB', 'invalid_byte_size' FROM p WHERE third UNION ALL SELECT id, '$.distribution[0]', 'Distribution', 'mediaType', 'text/odd; q=1', 'invalid_media_type' FROM p WHERE even
UNION ALL SELECT id, '$.distribution[0]', 'Distribution', 'characterEncoding', 'utf-9', 'invalid_character_encoding' FROM p
UNION ALL SELECT id, '$.contactPoint', 'Kind', 'tel', 'call me', 'invalid_tel' FROM p WHERE third UNION ALL SELECT id, '$.contactPoint.address', 'Address', 'postal-code', 'A' || n, 'invalid_postal_code' FROM p WHERE even UNION ALL SELECT id, '$.contactPoint.address', 'Address', '', NULL, 'empty_address' FROM p WHERE NOT even
UNION ALL SELECT id, '$.temporal', 'PeriodOfTime', 'startDate', '2024-05', 'date_out_of_order' FROM p WHERE even UNION ALL SELECT id, '$.spatial', 'Location', 'bbox', 'nowhere', 'unresolvable_spatial_value' FROM p WHERE third
UNION ALL SELECT id, '$.accessRestriction[0]', 'AccessRestriction', 'restrictionStatus', 'Closed', 'invalid_restriction_status' FROM p WHERE even UNION ALL SELECT id, '$.accessRestriction[0]', 'AccessRestriction', 'specificRestriction', 'None', 'invalid_specific_restriction' FROM p WHERE third
UNION ALL SELECT id, '$.useRestriction', 'UseRestriction', 'specificRestriction', 'Senate', 'invalid_specific_restriction' FROM p UNION ALL SELECT id, '$.cuiRestriction', 'CUIRestriction', 'cuiBannerMarking', 'CUI/' || n, 'invalid_cui_banner_marking' FROM p WHERE even
UNION ALL SELECT id, '$.describedBy', 'Document', 'mediaType', 'x', 'invalid_media_type' FROM p WHERE third UNION ALL SELECT id, '$.metric', 'Metric', 'expectedDataType', 'string', 'invalid_expected_data_type' FROM p WHERE even""")
def content_warnings(s, d):
    n = F.col("p_size").cast("string")
    even, third = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0
    pick = lambda on, a, b: F.when(on, a).otherwise(b)
    raw = F.format_string(
        '{"@type": "Dataset", "keyword": ["a", %s, ""], "accessRights": "%s", "spatialResolutionInMeters": "-%s", "created": "2024-02-01", "modified": "%s", "issued": "%s", "language": ["x", "qq", "en", "eng", 5], '
        '"distribution": [{"@type": "Distribution", "byteSize": "%s", "mediaType": "%s", "characterEncoding": ["UTF-8", "utf-9"], "temporalResolution": "P1Y"}], '
        '"contactPoint": {"@type": "Kind", "tel": "%s", "address": {"@type": "Address", "postal-code": "%s", "country-name": "%s", "region": null}}, '
        '"temporal": {"@type": "PeriodOfTime", "startDate": "%s", "endDate": "2024-04-30"}, "spatial": {"@type": "Location", "bbox": "%s", "geometry": {"type": "Point", "coordinates": [1, 2]}}, '
        '"accessRestriction": [{"@type": "AccessRestriction", "restrictionStatus": {"prefLabel": "%s"}, "specificRestriction": "%s"}], "useRestriction": {"@type": "UseRestriction", "restrictionStatus": "undetermined", "specificRestriction": "Senate"}, '
        '"cuiRestriction": {"@type": "CUIRestriction", "cuiBannerMarking": "%s"}, "describedBy": {"@type": "Document", "mediaType": "%s"}, "metric": {"@type": "Metric", "expectedDataType": "%s"}, "other": {"@type": 5}}',
        pick(even, F.lit('"a"'), F.lit('"b"')), pick(even, "Non-Public", "public"), n, pick(third, "2024-01-31", "2024-03-01"), pick(third, "2024-01-30", "2024-02-02"),
        pick(third, F.concat(n, F.lit("kB")), n), pick(even, "text/odd; q=1", "Text/CSV; q=1"), pick(third, "call me", "+1 2"), pick(even, F.concat(F.lit("A"), n), F.lit("")), pick(even, " USA", ""),
        pick(even, "2024-05", "2024-04"), pick(third, "nowhere", "1, 2"), pick(even, "Closed", "Unrestricted"), pick(third, "None", "senate"),
        pick(even, F.concat(F.lit("CUI/"), n), F.lit("CUI//x")), pick(third, "x", "application/json"), pick(even, "string", "xsd:string"),
    )
    known = s.createDataFrame([("language", "EN"), ("charset", "utf-8"), ("media_type", "text/csv"), ("media_type", "application/json")], "vocabulary string, value string")
    return quality.warnings(roles.read(s, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("source_raw")), vocabularies=known)


_DRAFT = {
    "type": "object", "minProperties": 3, "patternProperties": {"^x-": {"type": "integer"}}, "additionalProperties": False, "dependentRequired": {"size": ["unit"]}, "properties": {
        "title": {"type": "string", "minLength": 8}, "size": {"type": "number", "exclusiveMinimum": 10, "multipleOf": 2}, "unit": {"const": "m"}, "kind": {"enum": ["a", "b"]},
        "tags": {"type": "array", "prefixItems": [{"const": "t"}], "items": {"type": "string"}, "contains": {"const": "c"}},
    }, "if": {"properties": {"kind": {"const": "b"}}}, "then": {"required": ["unit"]},
}


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n, p_name FROM part) SELECT id, '$.title' AS path, 'minLength' AS keyword FROM p WHERE length(p_name) < 8 UNION ALL SELECT id, '$.size', CASE WHEN n <= 10 THEN 'exclusiveMinimum' ELSE 'multipleOf' END FROM p WHERE n <= 10 OR n % 2 = 1
UNION ALL SELECT id, '$', CASE WHEN id % 3 = 0 THEN 'dependentRequired' END FROM p WHERE id % 3 = 0 UNION ALL SELECT id, '$.tags', 'contains' FROM p WHERE id % 5 = 0 UNION ALL SELECT id, '$.tags[0]', 'const' FROM p WHERE id % 5 = 1 UNION ALL SELECT id, '$.x-a', 'type' FROM p WHERE id % 7 = 0 UNION ALL SELECT id, '$.other', 'false' FROM p WHERE id % 7 = 1""")
def json_schema_keywords(s, d):
    n, size = F.col("p_partkey"), F.col("p_size")
    raw = F.format_string(
        '{"title": "%s", "size": %s, %s "kind": "%s", "tags": %s, %s}', F.col("p_name"), size, F.when(n % 3 == 0, "").otherwise('"unit": "m",'), F.when(n % 3 == 0, "b").otherwise("a"),
        F.when(n % 5 == 0, '["t", "d"]').when(n % 5 == 1, '["u", "c"]').otherwise('["t", "c"]'), F.when(n % 7 == 0, '"x-a": 1e999').when(n % 7 == 1, '"other": 1').otherwise('"x-a": 2.0'),
    )
    errors = F.explode(quality_errors(raw))
    return spread(roles.read(s, d, "part").select("p_partkey", "p_name", "p_size")).select(n.alias("id"), errors.alias("e")).select("id", "e.path", "e.keyword")


def quality_errors(raw):
    from tidemark.functions.json_schema import schema_errors

    return schema_errors(_DRAFT)(raw)


#: Choices in choices, an open list of allowed kinds, and limits that messages tell.
_CHOICES = {
    "type": "object", "required": ["title"], "properties": {
        "title": {"type": "string", "maxLength": 12}, "keyword": {"anyOf": [{"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 2}}, {"type": "string"}]},
        "contact": {"oneOf": [{"type": "string"}, {"anyOf": [{"type": "object", "required": ["fn"]}, {"type": "null"}]}]}, "unit": {"anyOf": [{"const": "m"}, {"pattern": "^x"}]},
    },
}


def _choices(s, d):
    n, size = F.col("p_partkey"), F.col("p_size")
    keyword = F.when(size % 4 == 0, "[]").when(size % 4 == 1, '["ab", "c"]').when(size % 4 == 2, '{"k": 1}').otherwise('"ab"')
    contact = F.when(n % 3 == 0, "[1]").when(n % 3 == 1, '{"x": 1}').otherwise("null")
    raw = F.concat(F.lit('{"title": "'), F.col("p_name"), F.lit('", "keyword": '), keyword, F.lit(', "contact": '), contact, F.lit(', "unit": "'), F.when(n % 2 == 0, "y").otherwise("m"), F.lit('"}'))
    return spread(roles.read(s, d, "part").select("p_partkey", "p_name", "p_size")).select(n.alias("id"), raw.alias("raw"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 4 AS k, p_name FROM part)
SELECT id, '$.title' AS path, '''' || p_name || ''' is too long [maxLength=12]' AS message FROM p WHERE length(p_name) > 12
UNION ALL SELECT id, '$.keyword', CASE k WHEN 0 THEN '[] should be non-empty; [] is not of type ''string''' ELSE '{''k'': 1} is not of type ''array''; {''k'': 1} is not of type ''string''' END FROM p WHERE k IN (0, 2)
UNION ALL SELECT id, '$.keyword[1]', '''c'' is too short' FROM p WHERE k = 1
UNION ALL SELECT id, '$.contact', CASE id % 3 WHEN 0 THEN '[1] is not of type ''object''; [1] is not of type ''null''' ELSE '''fn'' is a required property' END FROM p WHERE id % 3 < 2
UNION ALL SELECT id, '$.unit', '''m'' was expected; ''y'' does not match ''^x''' FROM p WHERE id % 2 = 0""")
def schema_causes(s, d):
    """Failures of choices by their causes."""
    from tidemark.functions.json_schema import schema_errors

    return _choices(s, d).select("id", F.explode(schema_errors(_CHOICES)("raw")).alias("e")).select("id", "e.path", "e.message")


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 4 AS k, p_name FROM part)
SELECT id, '$.title, ''' || p_name || ''' does not match any of the acceptable formats: max string length of 12 characters' AS text FROM p WHERE length(p_name) > 12
UNION ALL SELECT id, CASE k WHEN 0 THEN '$.keyword, [] does not match any of the acceptable formats: non-empty, ''string''' ELSE '$.keyword, object value does not match any of the acceptable formats: ''array'', ''string''' END FROM p WHERE k IN (0, 2)
UNION ALL SELECT id, '$.keyword[1], ''c'' does not match any of the acceptable formats: min items requirement' FROM p WHERE k = 1
UNION ALL SELECT id, CASE id % 3 WHEN 0 THEN '$.contact, array value does not match any of the acceptable formats: ''object'', ''null''' ELSE '$.contact, ''fn'' is a required property' END FROM p WHERE id % 3 < 2
UNION ALL SELECT id, '$.unit, ''y'' does not match any of the acceptable formats: constant value ''m'' was expected, ''^x''' FROM p WHERE id % 2 = 0""")
def schema_texts(s, d):
    """Failures as the texts that a publisher reads."""
    from tidemark.functions.json_schema import schema_reports

    return _choices(s, d).select("id", F.explode(schema_reports(_CHOICES)("raw")).alias("text"))


#: A tree of nodes, and a schema that extends it: through the dynamic anchor every node may have nothing that neither knows.
_TREE = {"$id": "https://example.org/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"name": True, "parts": {"type": "array", "items": {"$dynamicRef": "#node"}}}}
_STRICT = {"$id": "https://example.org/strict", "$dynamicAnchor": "node", "$ref": "tree", "if": {"properties": {"name": {"const": "even"}}, "required": ["name"]}, "then": {"properties": {"size": {"type": "integer"}}}, "unevaluatedProperties": False}


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n FROM part)
SELECT id, '$.parts[1]' AS path, 'Unevaluated properties are not allowed (''nme'' was unexpected)' AS message FROM p WHERE id % 3 = 0
UNION ALL SELECT id, '$', 'Unevaluated properties are not allowed (' || CASE WHEN id % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN '''parts'' was' ELSE '''name'', ''size'', ''parts'' were' END ELSE '''size'' was' END || ' unexpected)' FROM p WHERE n % 2 = 1 OR id % 3 = 0""")
def schema_unevaluated(s, d):
    """Members that no keyword has seen to; a schema that fails sees to none."""
    from tidemark.functions.json_schema import schema_errors

    n = F.col("p_partkey")
    raw = F.concat(F.lit('{"name": "'), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"), F.lit('", "size": 1, "parts": [{"name": "x"}, {"'), F.when(n % 3 == 0, "nme").otherwise("name"), F.lit('": "y", "parts": []}]}'))
    return spread(roles.read(s, d, "part").select("p_partkey", "p_size")).select(n.alias("id"), F.explode(schema_errors(_STRICT, {"https://example.org/tree": _TREE})(raw)).alias("e")).select("id", "e.path", "e.message")


@query("SELECT 'u' || n_nationkey AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE '0' END AS identifier, '$' AS path FROM nation UNION ALL SELECT 'u' || n_nationkey, 'b', '$.title' FROM nation")
def invalid_catalog_records(s, d):
    schema = {"type": "object", "required": ["title"], "properties": {"title": {"type": "string"}}}
    n = F.col("n_nationkey")
    doc = F.concat(F.lit('{"dataset": ['), F.when(n % 2 == 0, '{"identifier": "a"}').otherwise('{"x": 1}'), F.lit(', {"identifier": "b", "title": 1}, {"title": "good"}]}'))
    return catalogs.invalid_records(roles.read(s, d, "nation").select(F.concat(F.lit("u"), n).alias("url"), doc.alias("doc")), schema).select("url", "identifier", "path")


@query("""WITH x AS (SELECT c_custkey AS id, (c_custkey * 91 % 350) - 175 AS lon FROM customer) SELECT id, CASE WHEN lon > 160 THEN 2 ELSE 1 END AS parts, CASE WHEN lon > 160 THEN -180 ELSE lon END::DOUBLE AS west, CASE WHEN lon > 160 THEN 180 ELSE lon + 20 END::DOUBLE AS east FROM x""")
def antimeridian_parts(s, d):
    """Shapes cut at the date line: their parts and how far these reach."""
    n = F.col("c_custkey")
    lon, lat = (n * 91 % 350) - 175, (n * 37 % 170) - 85
    shape = F.format_string('{"type": "Polygon", "coordinates": [[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]]}', lon, lat, lon + 20, lat, lon + 20, lat + 4, lon, lat + 4, lon, lat)
    rows = spread(roles.read(s, d, "customer").select("c_custkey")).select(n.alias("id"), geo.fixed_geometry(shape).alias("g")).select("id", F.get_json_object("g", "$.type").alias("kind"), F.get_json_object("g", "$.coordinates").alias("c"))
    rings = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))).otherwise(F.from_json("c", "array<array<array<array<double>>>>"))
    x = F.transform(F.flatten(F.flatten("rings")), lambda p: p[0])
    return rows.withColumn("rings", rings).select("id", F.size("rings").alias("parts"), F.array_min(x).alias("west"), F.array_max(x).alias("east"))


def _measured_rings(rows, *keep):
    """id and what keep names, and of the GeoJSON polygons in g (null: none) their parts, rings, points, and the area west and east of the date line."""
    c = F.get_json_object("g", "$.coordinates")
    polygons = F.when(F.get_json_object("g", "$.type") == "Polygon", F.array(F.from_json(c, "array<array<array<double>>>"))).otherwise(F.from_json(c, "array<array<array<array<double>>>>"))
    rings = F.flatten("polygons")
    area = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda t, k: t + (F.get(F.get(r, k), F.lit(0)) * F.get(F.get(r, k + 1), F.lit(1)) - F.get(F.get(r, k + 1), F.lit(0)) * F.get(F.get(r, k), F.lit(1))) / 2)
    total = lambda kept: F.round(F.aggregate(F.filter(rings, kept), F.lit(0.0), lambda t, r: t + area(r)), 6)
    west = lambda r: F.forall(r, lambda p: F.get(p, F.lit(0)) < 0)
    return rows.withColumn("polygons", polygons).select("id", *keep, F.size("polygons").alias("parts"), F.size(rings).alias("rings"), F.aggregate(rings, F.lit(0), lambda t, r: t + F.size(r)).alias("points"), total(lambda r: ~west(r)).alias("east_area"), total(west).alias("west_area"))


@query("""WITH x AS (SELECT c_custkey AS id, (c_custkey * 43 % 175) + 1 AS lon FROM customer)
SELECT id, CASE WHEN lon > 160 THEN 2 ELSE 1 END AS parts, CASE WHEN lon <= 160 OR lon + 7 <= 180 AND lon + 13 >= 180 THEN 2 ELSE 3 END AS rings,
CASE WHEN lon <= 160 THEN 10 WHEN lon + 13 = 180 OR lon + 7 = 180 THEN 14 WHEN lon + 7 < 180 AND lon + 13 > 180 THEN 18 ELSE 15 END AS points,
(CASE WHEN lon <= 160 THEN 68 ELSE 4 * (180 - lon) - 2 * greatest(0, least(6, 173 - lon)) END)::DOUBLE AS east_area, (CASE WHEN lon <= 160 THEN 0 ELSE 4 * (lon - 160) - 2 * greatest(0, least(6, lon - 167)) END)::DOUBLE AS west_area FROM x""")
def dateline_holes(s, d):
    """Shapes with a hole, cut at the date line: a hole that reaches the line joins the ring round it."""
    lon, lat = (F.col("c_custkey") * 43 % 175) + 1, (F.col("c_custkey") * 37 % 170) - 85
    ring = lambda x0, y0, x1, y1: F.format_string("[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]", x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)
    shape = F.concat(F.lit('{"type": "Polygon", "coordinates": ['), ring(lon, lat, lon + 20, lat + 4), F.lit(", "), ring(lon + 7, lat + 1, lon + 13, lat + 3), F.lit("]}"))
    return _measured_rings(spread(roles.read(s, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), geo.fixed_geometry(shape).alias("g")))


@query("""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 6 THEN 10 WHEN 7 THEN 5 END AS points, CASE c_custkey % 8 WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 6 THEN 15 WHEN 7 THEN 16 END::DOUBLE AS area,
c_custkey % 8 IN (1, 2, 5, 6, 7) AS valid FROM customer""")
def geometry_repair(s, d):
    """Shapes that are repaired (open or clockwise rings, points that repeat) or refused (rings that meet themselves, holes outside, places out of range)."""
    n = F.col("c_custkey")
    x, y = n * 37 % 150, n * 13 % 80
    p = lambda i, j: F.format_string("[%s, %s]", x + i, y + j)
    ring = lambda *at: F.concat(F.lit("["), F.concat_ws(", ", *[p(i, j) for i, j in at]), F.lit("]"))
    square = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    polygon = lambda *rings: F.concat(F.lit('{"type": "Polygon", "coordinates": ['), F.concat_ws(", ", *rings), F.lit("]}"))
    cases = [
        polygon(ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))), polygon(ring((0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4))), polygon(ring(*square[::-1])),
        F.format_string('{"type": "LineString", "coordinates": [[%s, 0], [1, 1]]}', x + 999), polygon(ring(*square), ring((3, 1), (6, 1), (6, 2), (3, 2), (3, 1))),
        F.format_string('{"type": "LineString", "coordinates": [[%s, 0], [1, 1]]}', x), polygon(ring(*square), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))), polygon(ring(*square[:4])),
    ]
    shape = F.element_at(F.array(*cases), (n % 8 + 1).cast("int"))
    rows = spread(roles.read(s, d, "customer").select("c_custkey")).select(n.alias("id"), geo.fixed_geometry(shape).alias("g"))
    area = F.col("east_area") + F.col("west_area")
    polygons = F.when(F.col("g").contains("Polygon"), F.col("g"))
    return _measured_rings(rows.select("id", F.col("g").isNotNull().alias("valid"), polygons.alias("g")), "valid").select("id", "points", area.alias("area"), "valid")


@query(f"WITH {RECORDS} SELECT id, identifier FROM records WHERE status = 'success' AND record_type = 'dataset' AND harvest_source_id = 3")
def records_of_source(s, d):
    return facets.facet_filter(roles.records(s, d), facets.facet_string("status eq success,record_type eq dataset", harvest_source_id="3")).select("id", "identifier")


@query(f"WITH {RECORDS}, x AS (SELECT *, row_number() OVER (PARTITION BY harvest_source_id ORDER BY date_created DESC, id DESC) AS r FROM records) SELECT id, harvest_source_id FROM x WHERE r <= 10")
def newest_records(s, d):
    return versions.top_per_group(roles.records(s, d), ["harvest_source_id"], [F.desc("date_created"), F.desc("id")], 10).select("id", "harvest_source_id")

@query("""WITH t AS (SELECT DISTINCT upper(substring(p_name, 2, 1 + p_partkey % 6)) AS text FROM part), m AS (
SELECT text, p_partkey AS place, row_number() OVER (PARTITION BY text ORDER BY p_size, p_partkey) AS r FROM t JOIN part ON contains(lower(p_name), lower(text)) WHERE trim(text) <> '') SELECT text, place FROM m WHERE r = 1""")
def places_by_part_of_name(s, d):
    """For each text the first place whose name contains it."""
    part = roles.read(s, d, "part")
    texts = part.select(F.upper(F.substring("p_name", F.lit(2), (1 + F.col("p_partkey") % 6).cast("int"))).alias("text"))
    places = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("display_name"), F.col("p_size").alias("type_order"), F.lit("").alias("the_geom"))
    return documents.places_named(texts, places).select("text", F.col("id").alias("place"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n, p_name FROM part)
SELECT id, '$.size' AS path, n::VARCHAR AS left, (n + 1)::VARCHAR AS right FROM p WHERE n % 2 = 0 UNION ALL SELECT id, '$.at[1].name', '"' || p_name || '"', NULL FROM p WHERE n % 3 = 0
UNION ALL SELECT id, '$.at[0][1]', NULL, '7' FROM p WHERE n % 5 = 0 UNION ALL SELECT id, '$.deep.er', '{}', NULL FROM p WHERE n % 7 = 0 UNION ALL SELECT id, '$.deep.er.most', NULL, 'null' FROM p WHERE n % 7 = 0""")
def deep_differences(s, d):
    """Values at any depth in which two documents differ."""
    n = F.col("p_size")
    doc = lambda side: F.concat(F.lit('{"size": '), F.when(n % 2 == 0, n + side).otherwise(n), F.lit(', "at": [[1'), F.when((n % 5 == 0) & F.lit(side == 1), ", 7").otherwise(""), F.lit('], {"x": [], '), F.when((n % 3 == 0) & F.lit(side == 1), '"y": 0').otherwise(F.concat(F.lit('"y": 0, "name": "'), "p_name", F.lit('"'))), F.lit('}], "deep": {"er": {'), F.when((n % 7 == 0) & F.lit(side == 1), '"most": null').otherwise(""), F.lit("}}}"))
    left, right = (roles.read(s, d, "part").select(F.col("p_partkey").alias("id"), doc(side).alias("doc")) for side in (0, 1))
    return reports.deep_differences(left, right)


@query("SELECT doc_id AS id, n_chars FROM documents ORDER BY 1 LIMIT 40 OFFSET (SELECT count(*) // 3 FROM documents)")
def contiguous_rows(s, d):
    """A run of rows from a place in the order of all."""
    return paging.slice_of(roles.read(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id", lambda n: n // 3, 40)
