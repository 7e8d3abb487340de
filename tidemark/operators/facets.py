"""Facet strings: comma-separated ``column op value`` conditions that all must hold, as one predicate that scans can take over."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Compare = Callable[[Column, Column, str], Column]


class FacetError(ValueError):
    """A facet that names no column or operator of the table, or lacks a part."""


def _is(column: Column, value: Column, text: str) -> Column:
    return column.isNull() if text.lower() in ("null", "none") else column.eqNullSafe(value)


def _any(column: Column, value: Column, text: str) -> Column:
    """Whether the column is one of the words of a value."""
    return column.cast("string").isin(*text.split())


def _between(column: Column, value: Column, text: str) -> Column:
    """Whether the column lies between the two words of a value, both included."""
    ends = text.split()
    if len(ends) != 2:
        raise FacetError(f"two ends are needed: {text!r}")
    return (column >= F.lit(ends[0])) & (column <= F.lit(ends[1]))


#: By name of the facet grammar: (column, typed literal, its text) to a predicate.
OPERATORS: dict[str, Compare] = {
    "eq": lambda c, v, t: c == v,
    "ne": lambda c, v, t: c != v,
    "lt": lambda c, v, t: c < v,
    "le": lambda c, v, t: c <= v,
    "gt": lambda c, v, t: c > v,
    "ge": lambda c, v, t: c >= v,
    "like_op": lambda c, v, t: c.like(t),
    "not_like_op": lambda c, v, t: ~c.like(t),
    "ilike_op": lambda c, v, t: c.ilike(t),
    "not_ilike_op": lambda c, v, t: ~c.ilike(t),
    "startswith_op": lambda c, v, t: c.startswith(t),
    "endswith_op": lambda c, v, t: c.endswith(t),
    "contains_op": lambda c, v, t: c.contains(t),
    "is_": _is,
    "is_not": lambda c, v, t: ~_is(c, v, t),
    "is_distinct_from": lambda c, v, t: ~c.eqNullSafe(v),
    "is_not_distinct_from": lambda c, v, t: c.eqNullSafe(v),
    "icontains_op": lambda c, v, t: F.contains(F.lower(c), F.lit(t.lower())),
    "istartswith_op": lambda c, v, t: F.startswith(F.lower(c), F.lit(t.lower())),
    "iendswith_op": lambda c, v, t: F.endswith(F.lower(c), F.lit(t.lower())),
    "not_contains_op": lambda c, v, t: ~c.contains(t),
    "not_startswith_op": lambda c, v, t: ~c.startswith(t),
    "not_endswith_op": lambda c, v, t: ~c.endswith(t),
    "in_op": _any,
    "not_in_op": lambda c, v, t: ~_any(c, v, t),
    "between_op": _between,
    "not_between_op": lambda c, v, t: ~_between(c, v, t),
    "regexp_match_op": lambda c, v, t: c.rlike(t),
    "not_regexp_match_op": lambda c, v, t: ~c.rlike(t),
}


def facet_predicate(df: DataFrame, facets: str | None) -> Column | None:
    """The predicate of a facet string; None for an empty one. Literals take their column's type."""
    found = []
    for facet in (facets or "").split(","):
        if not facets:
            break
        parts = facet.split(maxsplit=2)
        if len(parts) != 3:
            raise FacetError(f"a facet needs a column, an operator and a value: {facet!r}")
        name, op, text = parts
        if name not in df.columns:
            raise FacetError(f"no column {name!r}")
        if op not in OPERATORS:
            raise FacetError(f"no operator {op!r}")
        found.append(OPERATORS[op](F.col(name), F.lit(text).try_cast(df.schema[name].dataType), text))
    return reduce(Column.__and__, found) if found else None


def facet_filter(df: DataFrame, facets: str | None) -> DataFrame:
    predicate = facet_predicate(df, facets)
    return df if predicate is None else df.where(predicate)


def facet_string(facets: str | None = None, **equal: str | None) -> str:
    """A request's facet string with equality conditions for the named columns added; empty ones are left out."""
    return ",".join([*([facets] if facets else []), *(f"{k} eq {v}" for k, v in equal.items() if v)])
