"""The driver's tables in the roles of a catalog store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_NOW, ORDERS_NOW = "2024-01-31 00:00:00", "1998-12-01 00:00:00"
SNAPSHOT = "2024-01-16 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the record log."""
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type").isin("view", "click"), "update").when(F.col("event_type") == "purchase", "delete").otherwise("update")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("identifier"), F.col("user_id").alias("harvest_source_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), action.alias("action"),
        F.when(F.col("event_id") % 2 == 0, "dataset").otherwise("data_service").alias("record_type"), F.col("ts").alias("date_created"), "value",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as harvest sources."""
    n = F.col("c_custkey")
    frequency = F.when(n % 4 == 0, "daily").when(n % 4 == 1, "weekly").when(n % 4 == 2, "monthly").otherwise("manual")
    return read(spark, sf_dir, "customer").select(n.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("organization_id"), frequency.alias("frequency"), F.lower("c_mktsegment").alias("source_type"))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as organizations."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.concat(F.lit("type-"), "n_regionkey").alias("type"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs."""
    status = F.when(F.col("o_orderstatus") == "P", "in_progress").when(F.col("o_orderstatus") == "O", "new").otherwise("complete")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("harvest_source_id"), status.alias("status"), F.col("o_orderdate").alias("date_created"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as record issues."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("harvest_job_id"), F.col("l_partkey").alias("harvest_record_id"),
        F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("type"), F.col("l_shipdate").alias("date_created"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as datasets."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.col("p_type").alias("theme"), F.col("p_brand").alias("publisher"), F.col("p_size").alias("popularity"), F.col("p_partkey").alias("harvest_record_id"))


#: The same roles in DuckDB SQL.
RECORDS = """records AS (SELECT event_id AS id, json_extract_string(props, '$.k') AS identifier, user_id AS harvest_source_id,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'delete' ELSE 'update' END AS action,
  CASE WHEN event_id % 2 = 0 THEN 'dataset' ELSE 'data_service' END AS record_type, ts AS date_created, value FROM events)"""
LATEST = RECORDS + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY harvest_source_id, identifier, record_type
  ORDER BY date_created DESC, id DESC) AS r FROM records WHERE status = 'success') WHERE r = 1)"""
JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS harvest_source_id, CASE o_orderstatus WHEN 'P' THEN 'in_progress' WHEN 'O' THEN 'new' ELSE 'complete' END AS status,
  o_orderdate AS date_created, o_totalprice AS total, o_orderpriority AS priority FROM orders)"""
ISSUES = """issues AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS harvest_job_id, l_partkey AS harvest_record_id,
  l_returnflag AS severity, l_linestatus AS type, l_shipdate AS date_created FROM lineitem)"""
DATASETS = """datasets AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') || '-' || p_partkey AS slug, p_name AS title, p_type AS theme, p_brand AS publisher,
  p_size AS popularity, p_partkey AS harvest_record_id FROM part)"""
