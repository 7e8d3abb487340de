"""Pages by offset and by key, and the cursors that name a place in an order."""

from __future__ import annotations

import base64
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import new_path, written

PER_PAGE, MOST_PER_PAGE, SEARCH_PER_PAGE, SEARCH_MOST = 10, 100, 20, 1000


def ordered(df: DataFrame, column: str = "date_created", order: str = "asc", key: str = "id") -> DataFrame:
    """By a column, ascending only if so asked, ties by key, so that pages don't overlap."""
    by = [F.col(c).asc_nulls_last() if order == "asc" else F.col(c).desc_nulls_first() for c in (column, key)]
    return df.orderBy(*by)


def page(df: DataFrame, number: int = 0, per_page: int = PER_PAGE, paginate: bool = True) -> DataFrame:
    """One page of an ordered DataFrame; per_page is held to 1..100 and the number to 0 and more."""
    if not paginate:
        return df
    size = max(1, min(per_page, MOST_PER_PAGE))
    return df.offset(max(0, number) * size).limit(size)


def page_span(current: int, total_rows: int, per_page: int = PER_PAGE) -> dict:
    """Which pages there are, counted from 1, and where the current one is."""
    pages = max(1, math.ceil(total_rows / per_page))
    at = min(max(1, current), pages)
    return {"page": at, "pages": pages, "offset": (at - 1) * per_page, "previous": at - 1 if at > 1 else None, "next": at + 1 if at < pages else None}


def after(keys: list[tuple[str, str]], place: list) -> Column:
    """Rows that come after a place in an order of (column, asc or desc), nulls last in each."""
    found, equal = [], F.lit(True)
    for (name, way), value in zip(keys, place, strict=True):
        column = F.col(name)
        if value is not None:
            further = (column > F.lit(value)) if way == "asc" else (column < F.lit(value))
            found.append(equal & (further | column.isNull()))
        equal = equal & column.eqNullSafe(F.lit(value))
    return reduce(Column.__or__, found, F.lit(False))


def key_order(keys: list[tuple[str, str]]) -> list[Column]:
    """An order of (column, asc or desc), nulls last in each."""
    return [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last() for c, way in keys]


def keyset_page(df: DataFrame, keys: list[tuple[str, str]], size: int, place: list | None = None) -> DataFrame:
    """The next size rows after a place, or the first; a top-k, so nothing before the place is sorted."""
    rows = df if place is None else df.where(after(keys, place))
    return rows.orderBy(*key_order(keys)).limit(size)


def keyset_rows(df: DataFrame, keys: list[tuple[str, str]], size: int, place: list | None = None) -> tuple[list, str | None]:
    """A page's rows and the cursor of the next one, null where there is none: one row more than the page is looked at."""
    rows = keyset_page(df, keys, size + 1, place).collect()
    more = len(rows) > size
    return rows[:size], encode_cursor([rows[size - 1][c] for c, _ in keys]) if more and size else None


def encode_cursor(place: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(place, default=str).encode()).decode()


def decode_cursor(cursor: str) -> list:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()))


def search_size(per_page: int | None) -> int:
    """Hits of a search page: 20 unless asked, 1000 at most, 0 for aggregations only."""
    return SEARCH_PER_PAGE if per_page is None else max(0, min(per_page, SEARCH_MOST))


def numbered(rows: DataFrame, by: list[str], order: str, name: str = "nth") -> DataFrame:
    """rows with their number, from 1, in order within the columns by; order is unique, nulls are values as any other.

    Rows are dealt by range and sorted, and counts of each part tell where the next one begins, so a group that has most rows is as many parts as any: a
    window sees a row per part of a group only.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, order)]
    dealt = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordered")
    spans = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select(*[F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)], F.col("_part").alias("_own"), (before - F.col("_first") + 1).alias("_shift"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{k}")) for k, c in enumerate(by)], F.col("_part") == F.col("_own"))
    return dealt.join(starts, same).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)


def slice_of(rows: DataFrame, key: str, start, size: int) -> DataFrame:
    """The rows whose keys, each unique, are those from a place on in the order of all; start: the place, or a function of how many rows there are.

    Keys are dealt by range and counted by part, and only the parts that the slice is in are read and sorted.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "keys")
    rows.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(path)
    keys = spark.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, _part int").parquet(path)
    counts = sorted(keys.groupBy("_part").count().collect())  # a row per part
    place, before, wanted, skipped = start(sum(n for _, n in counts)) if callable(start) else start, 0, [], None
    for part, n in counts:
        if before < place + size and place < before + n:
            wanted, skipped = [*wanted, part], place - before if skipped is None else skipped
        before += n
    chosen = keys.where(F.col("_part").isin(wanted)).select(key).orderBy(key).offset(max(0, skipped or 0)).limit(size)
    return rows.join(F.broadcast(chosen), key, "left_semi")  # no more than the slice's size
