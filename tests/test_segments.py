"""Versioned tables and the incremental search index: equal to a rebuild after any changes, whole for every reader, and whole after a crash."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import search, segments
from tidemark.sources import versions

KIND = "id string, title string, description string, keyword array<string>"


def docs(spark, rows):
    return spark.createDataFrame([(str(k), t, d, [d.split()[0]]) for k, t, d in rows], KIND)


def shown(index):
    stats = {r["field"]: (r["n"], round(r["mean"], 9)) for r in index.stats.collect()}
    postings = sorted((r["field"], r["token"], r["id"], tuple(r["places"]), r["length"]) for r in index.postings.collect())
    return postings, sorted(map(tuple, index.lengths.select("field", "id", "length").collect())), stats


def scores(index):
    return {r["id"]: round(r["score"], 9) for r in search.bm25(index, ["red", "blue"]).collect()}


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 4)
    rng, table, now, most = random.Random(4), f"file://{tmp_path}/index", {}, 0
    words = ["red", "blue", "green", "the", "sky"]
    for step in range(6):
        added = {k: (k, rng.choice(words), " ".join(rng.choice(words) for _ in range(1 + rng.randrange(6)))) for k in rng.sample(range(12), 4)} if step != 3 else {}
        gone = [str(k) for k in rng.sample(range(14), 3) if k not in added] if step else []
        for k in gone:
            now.pop(int(k), None)
        now |= added
        segments.changed(spark, table, docs(spark, added.values()) if added else None, spark.createDataFrame([(k,) for k in gone], "id string") if gone else None)
        got, want = segments.opened(spark, table), search.index(docs(spark, now.values()))
        assert shown(got) == shown(want) and scores(got) == scores(want)
        most = max(most, len(versions.manifest(spark, table)["segments"]))
    assert 1 < most <= 4
    before = shown(segments.opened(spark, table))
    segments.merged(spark, table)
    assert shown(segments.opened(spark, table)) == before and len(versions.manifest(spark, table)["segments"]) == 1
    segments.changed(spark, table, deleted=spark.createDataFrame([(str(k),) for k in now] + [("absent",)], "id string"))
    assert shown(segments.opened(spark, table)) == ([], [], {})


def test_an_empty_index(spark, tmp_path):
    index = segments.opened(spark, f"file://{tmp_path}/none")
    assert index.postings.count() == 0 and search.bm25(index, ["red"]).count() == 0
    segments.changed(spark, f"file://{tmp_path}/none", deleted=spark.createDataFrame([("a",)], "id string"))
    assert segments.opened(spark, f"file://{tmp_path}/none").postings.count() == 0


def test_versions_of_a_table(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    versions.replaced(spark.range(3), table, 3)
    other = spark.newSession()
    with versions.Reader(other, table) as reader:
        old = reader.table()
        versions.replaced(spark.range(5), table, 5)
        assert versions.vacuum(spark, table) == []  # the first version is being read
        assert old.count() == 3 and versions.Reader(other, table).table().count() == 5
    assert len(versions.vacuum(spark, table)) == 1
    with pytest.raises(ValueError):
        versions.replaced(spark.range(4), table, 5)
    assert versions.Reader(other, table).table().count() == 5


def test_a_crash_between_the_steps_loses_nothing(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    versions.replaced(spark.range(3), table)
    path = versions.new_data(table)
    spark.range(9).write.parquet(path)  # the files are there, and the writer is gone
    assert versions.Reader(spark, table).table().count() == 3
    versions._put(spark, f"{table}/manifests/lost.new", '{"vers')  # or in the midst of its manifest
    assert versions.Reader(spark, table).table().count() == 3
    assert versions.vacuum(spark, table) == []  # the files may be another writer's, until they are old
    versions.replaced(spark.range(4), table)
    assert path.rsplit("/", 1)[1] in versions.vacuum(spark, table, grace=-10) and versions.Reader(spark, table).table().count() == 4


def test_only_one_of_two_writers_wins(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    versions.replaced(spark.range(3), table)
    before = versions.manifest(spark, table)
    versions.replaced(spark.range(4), table)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, table, before, paths=[])
    assert versions.manifest(spark, table)["version"] == 2 and versions.Reader(spark, table).table().count() == 4


def test_length_stands_in_postings(spark):
    index = search.index(docs(spark, [(1, "The red, red sky", "blue")]))
    assert {(r["token"], r["length"]) for r in index.postings.where(F.col("field") == "title").collect()} == {("red", 3), ("sky", 3)}


def test_recreating_and_refreshing(spark, tmp_path):
    table = f"file://{tmp_path}/index"
    segments.changed(spark, table, docs(spark, [(1, "red sky", "blue")]))
    with pytest.raises(ValueError, match="postings"):
        segments.recreated(spark, table, {"postings": "field string"})
    assert segments.opened(spark, table).postings.count() > 0
    segments.recreated(spark, table)
    assert segments.opened(spark, table).postings.count() == 0
    view = f"file://{tmp_path}/view"
    assert versions.refreshed(spark.range(2), view) is None and versions.manifest(spark, view)["version"] == 0
    versions.replaced(spark.range(2), view)
    versions.refreshed(spark.range(7), view)
    assert versions.Reader(spark, view).table().count() == 7
