"""Durations of the calendar standard: P, then numbers with units, each unit once and in order, those of the time behind a T."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units in order, of the date and of the time.
DATE_UNITS, TIME_UNITS = "YMWD", "HMS"


def is_duration(value: Column) -> Column:
    """Whether text is a duration: a sign may stand before it, weeks beside other units, and seconds may have decimals."""
    body = F.when(value.startswith("-"), F.substring(value, 2, 1 << 30)).otherwise(value)
    halves = F.split(F.substring(body, 2, 1 << 30), "T", -1)

    def half(text: Column, number: str, units: str) -> Column:
        pair = rf"{number}[A-Z]"
        own = F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(0)), lambda p: F.instr(F.lit(units), F.right(p, F.lit(1))))
        return (F.regexp_replace(text, pair, "") == "") & ~F.array_contains(own, 0) & (F.array_sort(F.array_distinct(own)) == own)

    date, time = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    fraction = F.coalesce(time.contains("."), F.lit(False))
    good = half(date, r"\d+", DATE_UNITS) & F.when(time.isNull(), date != "").otherwise((time != "") & half(time, r"\d+(?:\.\d+)?", TIME_UNITS) & (~fraction | time.rlike(r"^[^.]*\.\d+S$")))
    return body.startswith("P") & (F.size(halves) <= 2) & good


def is_plain_duration(text: str) -> bool:
    """The same for a schema's format, in Python: weeks stand alone, without sign and decimals."""
    date, split, time = text[1:].partition("T")
    pairs = [re.findall(r"(\d+)([A-Z])", x) for x in (date, time)]
    if not text.startswith("P") or any("".join(n + u for n, u in p) != x for p, x in zip(pairs, (date, time), strict=True)) or not (time if split else date):
        return False
    places = [[units.find(u) for _, u in p] for p, units in zip(pairs, (DATE_UNITS, TIME_UNITS), strict=True)]
    weeks = DATE_UNITS.index("W")
    return all(p == sorted(set(p)) and -1 not in p for p in places) and (weeks not in places[0] or places == [[weeks], []])
