"""Record log, paging, change capture, store, search and sources on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, documents, facets, paging, reports, store, versions
from tidemark.plans import search
from tidemark.schema import TABLES, empty
from tidemark.sources import catalogs, listings, vocabularies

#: (source, identifier, date, status, action) of a version log.
LOG = [
    ("s1", "a", "2024-01-01", "success", "create"), ("s1", "a", "2024-03-01", "success", "update"), ("s1", "b", "2024-03-01", "success", "create"), ("s1", "b", "2022-05-01", "error", "update"),
    ("s1", "c", "2024-05-01", "success", "create"), ("s1", "d", "2024-05-01", "success", "delete"), ("s1", "d", "2024-04-01", "success", "create"), ("s1", "e", "2024-04-01", "success", "create"),
    ("s1", "e", "2024-04-02", "success", "delete"), ("s1", "e", "2024-04-03", "success", "create"), ("s2", "f", "2024-04-03", "success", "create"), ("s2", "f", "2024-04-04", "success", "update"),
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, s, k, dt.datetime.fromisoformat(d), st, a, "dataset") for i, (s, k, d, st, a) in enumerate(LOG)]
    return spark.createDataFrame(rows, "id long, harvest_source_id string, identifier string, date_created timestamp, status string, action string, record_type string")


def test_latest_live(log):
    got = {(r.identifier, r.action) for r in versions.latest_live(log.where("harvest_source_id = 's1'")).collect()}
    assert got == {("a", "update"), ("b", "create"), ("c", "create"), ("e", "create")}


def test_outdated(log):
    assert versions.outdated_records(log, 90, "2026-01-01 00:00:00").count() == 7


def test_duplicates_count_null_as_a_value(spark):
    rows = spark.createDataFrame(list(enumerate(["a", "a", "a", "b", "b", "c", None, None])), "pos int, identifier string")
    assert sorted(r.pos for r in versions.duplicate_positions(rows).collect()) == [1, 2, 4, 7]
    kept, errors = versions.split_duplicates(rows)
    assert kept.count() == 4 and errors.count() == 4


def test_facets(log):
    assert facets.facet_filter(log, "identifier eq a,status eq success").count() == 2
    assert facets.facet_filter(log, "id lt 3").count() == 3 and facets.facet_filter(log, None).count() == 12
    assert facets.facet_filter(log, "action startswith_op cr").count() == 7
    for bad in ("nope eq 1", "id nope 1", "id eq"):
        with pytest.raises(facets.FacetError):
            facets.facet_filter(log, bad)
    assert facets.facet_string("a eq 1", harvest_job_id="2", severity=None) == "a eq 1,harvest_job_id eq 2"


def test_facets_reach_the_scan(spark, sf):
    rows = facets.facet_filter(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus eq P").select("o_orderkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in plan and "o_totalprice" not in plan


def test_paging(spark):
    rows = spark.range(100).withColumn("date_created", F.timestamp_seconds("id"))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(paging.page(paging.ordered(rows))) == list(range(10)) and ids(paging.page(paging.ordered(rows), 1)) == list(range(10, 20))
    assert len(ids(paging.page(rows, per_page=500))) == 100 and len(ids(paging.page(rows, per_page=0))) == 1 and len(ids(paging.page(rows, paginate=False))) == 100
    seen, cursor = [], None
    while True:
        got, cursor = paging.keyset_rows(rows.withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), [("k", "desc"), ("id", "asc")], 30, cursor and paging.decode_cursor(cursor))
        seen += [r.id for r in got]
        if cursor is None:
            break
    assert sorted(seen) == list(range(100)) and seen[-1] == 99
    assert paging.page_span(3, 25, 10) == {"page": 3, "pages": 3, "offset": 20, "previous": 2, "next": None}


def test_diff(spark):
    side = lambda rows: spark.createDataFrame(rows, "identifier string, record_type string, source_hash string")
    new, old = side([("a", "dataset", "1"), ("b", "dataset", "2"), ("c", "dataset", "3"), ("x", "data_service", "1")]), side([("a", "dataset", "1"), ("b", "dataset", "9"), ("d", "dataset", "4")])
    got = {(r.identifier, r.action) for r in diff.snapshot_diff(new, old).collect()}
    assert got == {("a", None), ("b", "update"), ("c", "create"), ("x", "create"), ("d", "delete")}
    assert diff.job_counters(diff.snapshot_diff(new, old)).first().asDict() == {"records_total": 5, "records_added": 2, "records_updated": 1, "records_deleted": 1, "records_ignored": 1}
    assert {r.action for r in diff.harvest(new.withColumn("pos", F.lit(0)), old, "clear").collect()} == {"delete"}
    assert {r.identifier for r in diff.harvest(new.withColumn("pos", F.lit(0)), old, "force").where("phase = 1").collect()} == {"a", "b", "c", "x"}


def test_reconcile_gate(spark):
    side = lambda n, shift=0: spark.range(n).withColumn("stamp", F.col("id") + shift)
    assert diff.reconcile_gate(diff.reconcile(side(60), side(10)))
    assert not diff.reconcile_gate(diff.reconcile(side(61), side(10))) and not diff.reconcile_gate(diff.reconcile(side(5), side(6))) and not diff.reconcile_gate(diff.reconcile(side(5), side(5, 1)))


def test_reports(spark):
    df = spark.createDataFrame([(5, 11), (1, 0), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(reports.percent(F.col("a"), F.col("b"))).collect()] == ["45%", "0%", "0%"]
    series = reports.chart_series(spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string"), ["n", "t"], "n").first()
    assert series.n == [1, 2] and series.t == ["a", "b"]


def test_store(spark, tmp_path):
    now = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], "id string, slug string, popularity int")
    assert {tuple(r) for r in store.patched(now, spark.createDataFrame([("1", 9, "z")], "id string, popularity int, unknown string")).collect()} == {("1", "x", 9), ("2", "y", 2)}
    up = store.upserted(now, spark.createDataFrame([("y", 7), ("n", 8)], "slug string, popularity int"))
    assert {tuple(r) for r in up.collect()} == {("1", "x", 1), ("2", "y", 7), (None, "n", 8)}
    slugs = store.unique_slugs(spark.createDataFrame([("1", "x"), ("2", "n"), ("3", "n")], "id string, slug string"), now)
    got = {r.id: r.slug for r in slugs.collect()}
    assert got["2"] == "n" and got["1"].startswith("x-") and got["3"].startswith("n-") and len(set(got.values())) == 3
    store.replace_table(now, str(tmp_path), "sets", 2)
    assert spark.table("sets").count() == 2
    with pytest.raises(ValueError):
        store.replace_table(now, str(tmp_path), "sets", 3)


def test_cascade(spark):
    tables = {n: empty(spark, n) for n in TABLES}
    tables["harvest_source"] = spark.createDataFrame([("s", "n")], "id string, name string")
    tables["harvest_job"] = spark.createDataFrame([("j", "s")], "id string, harvest_source_id string")
    tables["harvest_record"] = spark.createDataFrame([("r", "s")], "id string, harvest_source_id string")
    tables["harvest_record_error"] = spark.createDataFrame([("e", "other", "r"), ("f", "j", "r")], "id string, harvest_job_id string, harvest_record_id string")
    out = store.cascade_source_delete(tables, spark.createDataFrame([("s",)], "id string"))
    assert out["harvest_source"].count() == 0 and out["harvest_record"].count() == 0
    assert [tuple(r) for r in out["harvest_record_error"].collect()] == [("e", "other", None)]


def test_query_forms():
    t = search.Term
    assert search.parse('"health food"') == search.Query((t("health food", True),), False, False)
    assert search.parse("health OR education").any_of and len(search.parse("health or education").terms) == 2
    assert search.parse('"poor food" OR health').terms == (t("poor food", True), t("health"))
    assert search.parse("health education").simple and search.parse("") is None and search.parse(None) is None


def test_search(spark):
    rows = [("1", "Health food", "state of the art food", ["Food"], 5), ("2", "Art of the state", "health", ["x"], 9), ("3", "Other", "food for health", [], None)]
    docs = spark.createDataFrame(rows, "id string, title string, description string, keyword array<string>, popularity int")
    docs = docs.withColumn("organization", F.struct(F.lit("o").alias("id"), F.lit("o-slug").alias("slug"), F.lit("Federal").alias("organization_type"))).withColumn("publisher", F.lit("P")).withColumn("last_harvested_date", F.lit(None).cast("timestamp"))
    hit = lambda q, **f: [r.id for r in search.search(docs, search.Criteria.of({"q": q, **f}))[0].collect()]
    assert hit("health food") == ["1", "3"] or set(hit("health food")) == {"1", "3"}
    assert hit('"state of the art"') == ["1"] and set(hit('"art" "state"')) == {"1", "2", "3"} and set(hit("art OR other")) == {"1", "2", "3"}
    assert hit("", keyword="food") == ["1"] and hit("", sort="popularity") == ["2", "1", "3"]
    first = search.search(docs, search.Criteria.of({"sort": "popularity", "per_page": "2"}))[0].collect()
    assert [r.id for r in first] == ["2", "1"] and hit("", sort="popularity", per_page="2", after=search.cursor(first[-1], "popularity")) == ["3"] and hit("", per_page="0") == []
    with pytest.raises(search.FilterError):
        hit("", spatial_geometry="{")
    assert search.search(docs, search.Criteria())[1]["organizations"].collect()[0]["count"] == 3
    c = search.Criteria.of({"q": "a", "keyword": ["x", "y"], "sort": "popularity"})
    assert c.to_pairs() == [("q", "a"), ("sort", "popularity"), ("keyword", "x"), ("keyword", "y")] and c.has_filters()


def test_walks_end_or_tell_of_a_cycle(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(70)], "id int, parent int, pos int")
    assert catalogs.tree_walk(chain, 0).count() == 70
    with pytest.raises(ValueError, match="twice"):
        catalogs.tree_walk(spark.createDataFrame([(0, 2, 0), (1, 0, 0), (2, 1, 0)], "id int, parent int, pos int"), 0)
    html = lambda *folders: "".join(f'<a href="/f{k}/">x</a>' for k in folders) + '<a href="a.xml">a</a>'
    pages = spark.createDataFrame([(f"https://h/f{i}/", html(i + 1, 0)) for i in range(40)], "url string, html string")
    assert listings.crawl(pages, "https://h/f0/").where("kind = 'file'").count() == 40


def test_malformed_catalogs_have_no_records(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(['{"dataset": [{"identifier": "a"}]}', "{", None, "[1]", "[" * 3000])], "n int, doc string")
    assert [r.n for r in catalogs.nested_records(docs).collect()] == [0]
    assert [r[0] is None for r in docs.select("n", catalogs.stripped()(F.col("doc")).alias("d")).orderBy("n").select("d").collect()] == [False, True, True, True, True]


def test_suffixed_slugs_are_free(spark):
    from tidemark.functions.text import slug_suffix

    new = spark.createDataFrame([("1", "x"), ("2", "x")], "id string, slug string")
    suffixed = new.where("id = '2'").select(slug_suffix(F.col("slug"), F.col("id"))).first()[0]
    got = {r.id: r.slug for r in store.unique_slugs(new, spark.createDataFrame([(suffixed,)], "slug string")).collect()}
    assert got["1"] == "x" and got["2"].startswith(suffixed) and got["2"] != suffixed
    edits = spark.createDataFrame([("1", "y"), ("2", "y"), ("9", "z")], "id string, slug string")
    rows, bad = store.reslugged(new, edits)
    assert {r.slug for r in rows.collect()} == {"x"} and {r.id for r in bad.collect()} == {"1", "2", "9"}


def test_catalog_walk(spark):
    doc = '{"dataset": [{"identifier": "a"}], "catalog": [{"dataset": {"identifier": "b"}, "catalog": {"dataset": [{"identifier": "c"}]}}, {"dataset": [{"x": 1}]}]}'
    df = spark.createDataFrame([(1, doc)], "n int, doc string")
    got = catalogs.nested_records(df).orderBy("path", "pos").collect()
    assert [r.identifier for r in got] == ["a", "b", "c", None]
    assert catalogs.flat_records(df).count() == 1 and "dataset" not in df.select(catalogs.stripped()(F.col("doc"))).first()[0]


def test_nested_and_merged(spark):
    parents = spark.createDataFrame([(0, "p", '{"servesDataset": [{"identifier": "a"}, {"identifier": "a"}, {"t": 1}]}'), (1, "q", '{"servesDataset": {"identifier": "b"}}')], "pos int, identifier string, raw string")
    nested = catalogs.nested_datasets(parents, ["servesDataset"])
    assert nested.count() == 3
    top = spark.createDataFrame([("a", "{}"), ("z", "{}")], "identifier string, raw string")
    got = {(r.identifier, r.parent_identifier) for r in catalogs.merged(top, nested).collect()}
    assert got == {("a", "p"), ("z", None), ("b", "q"), (None, "p")}


def test_listing(spark):
    html = '<a href="../">../</a>\n<a href="sub/">sub/</a> 02-Oct-2025 11:47 -\n<a href="f.xml">f.xml</a>   02-Oct-2025 11:47  26K\n<table><tr><td><a href="/g.xml">g</a></td><td align="right">2026-07-12 02:23  </td></tr></table>'
    pages = spark.createDataFrame([("http://h/a/", html), ("http://h/a/sub/", '<a href="k.xml">k</a> x')], "url string, html string")
    found = listings.crawl(pages, "http://h/a/")
    files = {r.identifier: str(r.modified_date) for r in listings.files(found, "2000-01-01").collect()}
    assert files == {"http://h/a/f.xml": "2025-10-02 11:47:00", "http://h/g.xml": "2026-07-12 02:23:00", "http://h/a/sub/k.xml": "2000-01-01 00:00:00"}


def test_vocabularies(spark):
    rows = spark.createDataFrame([("UTF-8", "csUTF8 utf8"), ("ASCII", None)], "Name string, Aliases string")
    assert [r.value for r in vocabularies.charset_names(rows).collect()] == ["ascii", "csutf8", "utf-8", "utf8"]
    assert vocabularies.media_types(spark.createDataFrame([("text/csv",), ("csv",)], "Template string")).count() == 1


def test_streaming_capture(spark, tmp_path):
    from tidemark.streaming.capture import capture

    kind = "identifier string, record_type string, source_hash string"
    for n, rows in enumerate(([("a", "dataset", "1"), ("b", "dataset", "1")], [("a", "dataset", "2"), ("c", "dataset", "1")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        capture(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        got = {(r.identifier, r.action) for r in spark.read.parquet(str(tmp_path / f"out/job={n}")).collect()}
        assert got == ({("a", "create"), ("b", "create")}, {("a", "update"), ("c", "create"), ("b", "delete")})[n]

def test_numbers_and_slices_against_windows(spark):
    rows = [(k * 7 % 101, [None, "a", "b", "a", None][k % 5] if k < 80 else "a", "x") for k in range(101)]
    df = spark.createDataFrame(rows, "pos long, key string, more string").repartition(5)
    got = sorted(tuple(r) for r in paging.numbered(df, ["key"], "pos").select("pos", "nth").collect())
    order = {}
    want = []
    for pos, key, _ in sorted(rows):
        order[key] = order.get(key, 0) + 1
        want.append((pos, order[key]))
    assert got == want and paging.numbered(df.limit(0), ["key"], "pos").count() == 0
    for start, size in ((0, 3), (50, 10), (95, 20), (200, 5), (-2, 4)):
        assert sorted(r["pos"] for r in paging.slice_of(df, "pos", start, size).collect()) == list(range(max(0, start), max(0, start) + size))[: max(0, 101 - start)]
    a, b = (sorted(r["pos"] for r in reports.seeded_sample(x, 10, 7, "pos").collect()) for x in (df, df.repartition(3)))
    assert a == b and a == list(range(a[0], a[0] + 10))
    kept, errors = versions.split_duplicates(df, "key")
    assert sorted(r["pos"] for r in kept.collect()) == sorted(p for p, n in want if n == 1) and errors.count() == 98


def test_places_by_part_of_name_against_every_pair(spark):
    names = ["Springfield, Ohio", "Springfield", "Ohio County", "oh", None, "Ünïon", "", "a.b%c_d", "Ohio"]
    places = spark.createDataFrame([(f"p{k}", n, [3, 2, None, 1][k % 4], f"g{k}") for k, n in enumerate(names)], "id string, display_name string, type_order int, the_geom string")
    texts = ["ohio", "SPRING", "field, o", "o", "OH", "h", "ünï", "%c_", "b%c_d", "nowhere", "springs", " ", "", None, "Ohio", "ohio county and more"]
    got = {r["text"]: r["id"] for r in documents.places_named(spark.createDataFrame([(t,) for t in texts * 2], "text string"), places).collect()}
    ranked = sorted((([3, 2, None, 1][k % 4] is None, [3, 2, None, 1][k % 4] or 0, f"p{k}", n) for k, n in enumerate(names) if n is not None))
    want = {t: next(r[2] for r in ranked if t.lower() in r[3].lower()) for t in texts if t and t.strip() and any(t.lower() in r[3].lower() for r in ranked)}
    assert got == want


def test_deep_differences(spark):
    kind = "id int, doc string"
    left = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "e": {}, "same": [[]]}'), (2, "no json"), (3, None), (4, "[1, 2]")], kind)
    right = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "y"}, 3]}, "e": [], "same": [[]]}'), (2, "no json"), (3, "5"), (4, '{"a": 1}')], kind)
    got = {tuple(r) for r in reports.deep_differences(left, right).collect()}
    assert got == {(1, "$.a.b[1].c", '"x"', '"y"'), (1, "$.a.b[2]", None, "3"), (1, "$.e", "{}", "[]"), (3, "$", None, "5"), (4, "$[0]", "1", None), (4, "$[1]", "2", None), (4, "$.a", None, "1")}
