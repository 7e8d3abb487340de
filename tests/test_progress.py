"""Counters while a job runs."""

from pyspark.sql import functions as F

from tidemark.operators import lifecycle, progress


def test_progress_grows_to_the_counters(spark, tmp_path):
    df = spark.createDataFrame([(k, ["create", "update", "delete", None][k % 4], ["success", "error", "success"][k % 3], k % 5 == 0) for k in range(60)], "id int, action string, status string, warned boolean")
    heard, stages = [], [df.where("id < 20"), df.where("id >= 20 and id < 21"), df.where("id < 0"), df.where("id >= 21")]
    progress.run(stages, "job", f"file://{tmp_path}/out", f"file://{tmp_path}/progress", heard.append)
    rows = [r.asDict() for r in progress.progress(spark, f"file://{tmp_path}/progress").orderBy("stage").collect()]
    assert len(rows) == len(heard) == 4 and heard[2]["records_total"] == 0
    assert all(a[c] <= b[c] for a, b in zip(rows, rows[1:], strict=False) for c in progress.NAMES)
    assert {c: rows[-1][c] for c in progress.NAMES} == lifecycle.counters(df).first().asDict()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 60
    progress.write_stage(stages[1], 1, "job", f"file://{tmp_path}/out", f"file://{tmp_path}/progress")  # a stage that runs again
    assert progress.progress(spark, f"file://{tmp_path}/progress").agg(F.max("records_total")).first()[0] == 60


def test_progress_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, "create", "success", False) for k in range(30)], "id int, action string, status string, warned boolean")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    progress.stream(source, "job", f"file://{tmp_path}/out", f"file://{tmp_path}/progress", f"file://{tmp_path}/checkpoint").awaitTermination()
    rows = progress.progress(spark, f"file://{tmp_path}/progress").orderBy("stage").collect()
    assert len(rows) == 3 and rows[-1]["records_added"] == 30
