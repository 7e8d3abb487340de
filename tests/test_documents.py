"""Search documents, payloads and schedules."""

import json

from pyspark.sql import functions as F

from tidemark.operators import documents, scheduling


def test_index_fields(spark):
    doc = {"title": "T", "description": 5, "publisher": {"prefLabel": "P"}, "keyword": [" a ", "", 3], "theme": [{"prefLabel": "climate"}, "geospatial "], "identifier": {"@id": "x"}, "distribution": [{"title": "D", "downloadURL": "u"}, {}], "isPartOf": "c"}
    rows = spark.createDataFrame([("1", "s", json.dumps(doc), None, "r", True), ("2", "t", '{"spatial": "", "theme": "x"}', '{"type":"Point","coordinates":[1,2]}', "q", False)], "id string, slug string, dcat string, translated_spatial string, harvest_record_id string, has_transformed boolean")
    a, b = documents.documents(rows, "http://h").orderBy("id").collect()
    assert (a.title, a.description, a.publisher, a.keyword, a.theme, a.identifier, a.distribution_titles) == ("T", "", "P", ["a"], ["climate", "geospatial"], "x", ["D"])
    assert a.has_spatial and a.has_download and a.is_part_of == "c" and a.harvest_record_transformed == "http://h/harvest_record/r/transformed"
    assert b.has_spatial and not b.has_download and b.theme == ["x"] and b.spatial_centroid.lat == 2 and b.harvest_record_transformed is None


def test_payloads(spark):
    rows = spark.createDataFrame([("1", "i", "dataset", "s", '{"title": "My Set", "spatial": "1,2"}', None, None), ("2", "i2", "dataset", "s", "{}", '{"spatial": "nowhere"}', None), ("3", "i3", "dataset", "s", '{"spatial": "Texas"}', None, None)], "id string, identifier string, record_type string, harvest_source_id string, source_raw string, source_transform string, date_finished timestamp")
    places = spark.createDataFrame([("texas", '{"type":"Point","coordinates":[0,0]}')], "display_name string, the_geom string")
    got = {r.id: r for r in documents.dataset_payloads(rows, places).collect()}
    assert got["1"].slug == "my-set" and json.loads(got["1"].translated_spatial)["coordinates"] == [1, 2] and not got["1"].spatial_warning
    assert got["2"].slug == "i2" and got["2"].spatial_warning and got["3"].translated_spatial is not None


def test_repaired(spark):
    rows = spark.createDataFrame([('{"distribution": [{"downloadURL": "x.org/a"}], "theme": ["a"]}', "id", "p", "Org"), (None, "id", None, "Org")], "raw string, i string, p string, o string")
    first, second = (r[0] for r in rows.select(documents.repaired()("raw", "i", "p", "o")).collect())
    d = json.loads(first)
    assert d["identifier"] == "id" and d["isPartOf"] == "p" and d["publisher"] == {"name": "Org"} and d["keyword"] == ["__"] and d["theme"] == ["a", "geospatial"] and d["distribution"][0]["downloadURL"] == "https://x.org/a" and second is None


def test_schedules(spark):
    now = "2024-01-02 00:00:00"
    jobs = spark.createDataFrame([("1", "a", "new", "2024-01-01"), ("2", "b", "in_progress", "2023-12-01"), ("3", "b", "new", "2024-01-01"), ("4", "c", "new", "2024-02-01")], "id string, harvest_source_id string, status string, d string").withColumn("date_created", F.col("d").cast("timestamp"))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(scheduling.due(jobs, now, 5)) == ["1", "3"] and ids(scheduling.orphaned(jobs, now)) == ["2"] and sorted(ids(scheduling.startable(jobs))) == ["1", "4"]
    assert ids(scheduling.failed(jobs, spark.createDataFrame([("9",)], "job_id string"))) == ["2"]
    sources = spark.createDataFrame([("a", "daily"), ("b", "manual"), ("c", "weekly")], "id string, frequency string")
    assert [(r[0], str(r[1])) for r in scheduling.next_jobs(sources, jobs, now).collect()] == [("a", "2024-01-03 00:00:00")]
    kept, again = scheduling.rescheduled(jobs, sources.where("id = 'c'"), now)
    assert "4" not in ids(kept) and again.count() == 1
    orgs = spark.createDataFrame([("1", "x", ["al"]), ("2", "al", [])], "id string, slug string, aliases array<string>")
    assert ids(scheduling.organization_of(orgs, "al")) == ["2"] and ids(scheduling.organization_of(orgs, "zz")) == []
    assert scheduling.free_slots(3, 5) == 2 and scheduling.free_slots(0, 5, True) == 1
