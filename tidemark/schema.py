"""Tables of the catalog store and the closed vocabularies of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = {
    "organization": "id string, name string, logo string, description string, slug string, organization_type string, code_repo_url string, code_repo_exempt boolean, aliases array<string>",
    "harvest_source": "id string, name string, notification_emails array<string>, organization_id string, frequency string, url string, schema_type string, source_type string, notification_frequency string, collection_parent_url string",
    "harvest_job": "id string, harvest_source_id string, status string, job_type string, date_created timestamp, date_finished timestamp, records_total int, records_added int, records_updated int, records_deleted int, records_errored int, records_ignored int, records_validated int, records_warned int, dcatus_catalog string",
    "harvest_record": "id string, identifier string, harvest_job_id string, harvest_source_id string, source_hash string, source_raw string, source_transform string, date_created timestamp, date_finished timestamp, ckan_id string, action string, parent_identifier string, status string, record_type string",
    "dataset": "id string, slug string, dcat string, translated_spatial string, organization_id string, harvest_source_id string, harvest_record_id string, popularity int, last_harvested_date timestamp, type string",
    "dataset_view_count": "dataset_slug string, view_count int",
    "resource_view_count": "resource_url string, view_count int",
    "harvest_job_error": "id string, harvest_job_id string, date_created timestamp, type string, message string",
    "harvest_record_error": "id string, harvest_job_id string, harvest_record_id string, date_created timestamp, type string, message string, severity string",
    "locations": "id string, name string, type string, display_name string, the_geom string, type_order int",
}
#: Fixed vocabularies.
RECORD_TYPES = ("dataset", "data_service", "catalog_record", "data_series")
IDENTITY_FIELD = {"dataset": "identifier", "data_service": "identifier", "catalog_record": "@id", "data_series": "@id"}
ACTIONS = ("create", "update", "delete")
RECORD_STATUS = ("error", "success")
JOB_STATUS = ("in_progress", "complete", "new", "error")
FREQUENCY_DAYS = {"daily": 1, "weekly": 7, "biweekly": 14, "monthly": 30}
SEVERITY = ("error", "warning")


def empty(spark, name: str) -> DataFrame:
    """An empty table of the store."""
    return spark.createDataFrame([], TABLES[name])


def source_violations(sources: DataFrame) -> DataFrame:
    """Sources that break the rule that a parent url is set exactly for collections."""
    is_collection = F.coalesce(F.col("source_type") == "waf-collection", F.lit(False))
    return sources.where(is_collection != F.col("collection_parent_url").isNotNull())


def serialised(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def outside(column: Column, vocabulary) -> Column:
    """Whether a value is set and not in a closed vocabulary."""
    return column.isNotNull() & ~column.isin(*vocabulary)
