"""Dates in catalog metadata, listings and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import FREQUENCY_DAYS

OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: What servers print for a day, by the order of its parts: year-month-day, day-month-year, month/day/year, and a written month.
DAYS = {"ymd": r"(\d{4})-(\d{2})-(\d{2})", "dny": r"(\d{2})-([A-Za-z]{3})-(\d{4})", "mdy": r"(\d{1,2})/(\d{1,2})/(\d{4})", "ndy": r"([A-Za-z]{3,9}) (\d{1,2}), (\d{4})"}
CLOCK = r"(\d{1,2}):(\d{2})(?: ([AaPp])[Mm])?"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def dcat_date(text: Column) -> Column:
    """The date of a year, a month, a day or a date-time with an offset; null for anything else. The day is the one that is written."""
    day = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    moment = F.when(text.rlike(OFFSET_TIME) & F.try_to_timestamp(F.upper(F.regexp_replace(text, " ", "T"))).isNotNull(), F.substring(text, 1, 10))
    return F.coalesce(day, moment).try_cast("date")


def later(value: Column, other: Column) -> Column:
    """Whether both are dates and the first is strictly later."""
    return F.coalesce(dcat_date(value) > dcat_date(other), F.lit(False))


def listing_time(text: Column, placeholder: Column | None = None) -> Column:
    """The first day with a clock time in a listing's row, else the placeholder; runs of white space count as one blank."""
    flat, moment = F.regexp_replace(text, r"\s+", " "), rf"(?:{'|'.join(DAYS.values())}) {CLOCK}"
    group = lambda k: F.nullif(F.regexp_extract(flat, moment, k), F.lit(""))
    at = {part: [] for part in "ymdn"}
    for k, part in enumerate("".join(DAYS)):
        at[part].append(group(k + 1))
    year, month, day, named = (F.coalesce(*at[part]) for part in "ymdn")
    at_month = F.position(F.lower(F.left(named, F.lit(3))), F.lit(MONTHS))
    month = F.coalesce(month.cast("int"), F.when(at_month % 3 == 1, ((at_month + 2) / 3).cast("int")))
    hour, minute, half = (group(3 * len(DAYS) + k) for k in (1, 2, 3))
    hour = F.when(half.isNull(), hour.cast("int")).otherwise(hour.cast("int") % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    found = F.try_make_timestamp(year.cast("int"), month, day.cast("int"), hour, minute.cast("int"), F.lit(0))
    return found if placeholder is None else F.coalesce(found, placeholder)


def utc_text(text: Column) -> Column:
    """A time as ISO text in UTC with milliseconds; text that is no time as it is, blank as null."""
    at = F.try_to_timestamp(F.trim(text))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.nullif(F.trim(text), F.lit("")))


def next_run(last: Column, frequency: Column) -> Column:
    """When a source is due again; null for frequencies without a period."""
    days = F.create_map(*[F.lit(x) for kv in FREQUENCY_DAYS.items() for x in kv])
    return last + F.make_dt_interval(F.element_at(days, frequency))


def last_month(day: Column) -> tuple[Column, Column]:
    """First and last day of the month before."""
    first = F.trunc(F.add_months(day, -1), "month")
    return first, F.last_day(first)


def is_stale(created: Column, now: str, hours: int = 24) -> Column:
    """Whether a task began more than so many hours ago, or at no known time."""
    age = F.lit(now).cast("timestamp") - F.try_to_timestamp(created)
    return F.coalesce(age > F.make_dt_interval(hours=F.lit(hours)), F.lit(True))
