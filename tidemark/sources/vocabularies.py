"""Vocabularies from registry files, in lower case and once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _set(values: DataFrame) -> DataFrame:
    return values.select(F.lower(F.trim("value")).alias("value")).where("value <> ''").distinct().orderBy("value")


def language_codes(rows: DataFrame, column: str) -> DataFrame:
    """Two-letter codes in a column."""
    return _set(rows.where(F.col(column).rlike("^[a-z]{2}$")).select(F.col(column).alias("value")))


def charset_names(rows: DataFrame, name: str = "Name", aliases: str = "Aliases") -> DataFrame:
    """Character sets by name and by each alias, which white space separates."""
    both = F.concat(F.array(name), F.coalesce(F.split(aliases, r"\s+"), F.array().cast("array<string>")))
    return _set(rows.select(F.explode(both).alias("value")).where("value is not null"))


def media_types(rows: DataFrame, column: str = "Template") -> DataFrame:
    """Types with a subtype."""
    return _set(rows.where(F.col(column).contains("/")).select(F.col(column).alias("value")))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def reference_values(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The values list of a JSON snapshot, under keys where it has sections."""
    at = ".".join(["$", *keys, "values"])
    text = spark.read.text(path, wholetext=True)
    return _set(text.select(F.explode(F.from_json(F.get_json_object("value", at), "array<string>")).alias("value")))
