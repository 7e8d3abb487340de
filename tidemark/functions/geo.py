"""Places: loose spatial text to GeoJSON, centres, distances, boxes and polygons."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import shapes
from tidemark.session import spread

EARTH_KM = 6371.0088
NUMBER = r"^\s*[+-]?((\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def is_number(text: Column) -> Column:
    """Whether text reads as a float, infinities and nan included."""
    return F.coalesce(F.lower(text).rlike(NUMBER), F.lit(False))


def _ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.format_string('{"type": "Polygon", "coordinates": [[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]]}', minx, miny, minx, maxy, maxx, maxy, maxx, miny, minx, miny)


#: A written number, and the layouts of loose spatial text: so many numbers between commas, whole numbers between blanks, two corners in brackets.
_N = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
COMMAS = rf"^\s*{_N}(?:\s*,\s*{_N})+\s*$"
BLANKS = r"^\s*[+-]?\d+(?: [+-]?\d+)+\s*$"
CORNERS = rf"^\s*\[\s*\[\s*{_N}\s*,\s*{_N}\s*\]\s*,\s*\[\s*{_N}\s*,\s*{_N}\s*\]\s*\]\s*$"


def plain_number(number: Column) -> Column:
    """A number as JSON has it: without a plus sign, needless leading zeros or a loose full stop, its spelling kept else."""
    sign = F.when(number.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.ltrim(number, F.lit("+-")), r"\.$", "")
    whole = F.ltrim(F.regexp_extract(digits, r"^\d*", 0), F.lit("0"))
    return F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.regexp_extract(digits, r"^\d*(.*)$", 1))


def spatial_text(value: Column) -> Column:
    """GeoJSON of loose spatial text: two numbers a point; four a box, a line if one repeats, a point if both do; two corners in brackets a box; else ""."""
    part = F.transform(F.regexp_extract_all(value, F.lit(_N), F.lit(0)), plain_number)
    p = lambda k: F.get(part, F.lit(k))
    listed, n, unique = value.rlike(COMMAS) | value.rlike(BLANKS), F.size(part), F.size(F.array_distinct(part))
    point = F.format_string('{"type": "Point", "coordinates": [%s, %s]}', p(0), p(1))
    line = F.format_string('{"type": "LineString", "coordinates": [[%s, %s], [%s, %s]]}', p(0), p(1), p(2), p(3))
    box = _ring(p(0), p(1), p(2), p(3))
    same = (p(0) == p(2)) & (p(1) == p(3))
    four = F.when(same, point).when(unique == 3, line).otherwise(box)
    return F.coalesce(F.when(listed & (n == 2), point).when(listed & (n == 4), four).when(value.rlike(CORNERS), box), F.lit(""))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres, null if any part is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def centroid(geojson: Column) -> Column:
    """The mean of all vertices in range as (lat, lon), a closing vertex counted twice; null without any."""
    pairs = F.regexp_extract_all(geojson, F.lit(r"\[\s*(-?[\d.eE+-]+\s*,\s*-?[\d.eE+-]+)"), F.lit(1))
    point = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ",", 1)).try_cast("double").alias("lon"), F.trim(F.substring_index(p, ",", -1)).try_cast("double").alias("lat")))
    kept = F.filter(point, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
    mean = lambda c: F.aggregate(kept, F.lit(0.0), lambda s, p: s + p[c]) / F.size(kept)
    return F.when(F.size(kept) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def box_within(inner: tuple, outer: tuple) -> Column:
    """Whether a box (minx, miny, maxx, maxy) of columns lies in another."""
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def box_intersects(a: tuple, b: tuple) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


# --- whole geometries, which built-in functions can't take apart: Arrow batches of GeoJSON text


def wound(polygon: list) -> list:
    """A polygon with closed rings without repeated points, the outer one counter-clockwise and holes clockwise."""
    closed = map(shapes.cleaned, polygon)
    return [ring if (shapes.area(ring) >= 0) == (k == 0) else ring[::-1] for k, ring in enumerate(closed)]


def _numbers(point, reach: float) -> bool:
    return isinstance(point, list) and len(point) >= 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in point) and abs(point[0]) <= reach and abs(point[1]) <= 90


def unwrapped(shape: dict) -> dict | None:
    """A geometry with rings in order and, where it crosses the date line, cut there.

    Null if it is none, if a point is out of range (polygons may reach 180 degrees beyond the date line), if a ring has no area or meets itself, or if a
    hole isn't within its shell.
    """
    kind, where = shape.get("type"), shape.get("coordinates")
    if kind == "GeometryCollection":
        parts = [unwrapped(g) for g in shape["geometries"]]
        return {"type": kind, "geometries": parts} if parts and all(parts) else None
    if not isinstance(where, list) or not where:
        return None
    if kind not in ("Polygon", "MultiPolygon"):
        lines = {"Point": [[where]], "MultiPoint": [where], "LineString": [where], "MultiLineString": where}.get(kind, [])
        good = all(all(_numbers(p, 180) for p in line) and len(line) >= (2 if "Line" in kind else 1) for line in lines)
        return shape if lines and good else None
    pieces = []
    for polygon in [where] if kind == "Polygon" else where:
        if not polygon or any(len(r) < 3 or not all(_numbers(p, 360) for p in r) for r in polygon):
            return None
        polygon = wound(polygon)
        if any(len(r) < 4 or not shapes.area(r) for r in polygon) or not shapes.simple(polygon) or not shapes.holes_in(polygon):
            return None
        pieces += shapes.wrapped(polygon)
    return {"type": "Polygon", "coordinates": pieces[0]} if len(pieces) == 1 else {"type": "MultiPolygon", "coordinates": pieces}


@F.pandas_udf(T.StringType())
def fixed_geometry(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """GeoJSON text repaired, null where it is no geometry."""

    def one(text):
        try:
            shape = unwrapped(json.loads(text))
            return None if shape is None else json.dumps(shape)
        except (TypeError, ValueError, AttributeError, IndexError, KeyError):
            return None

    for batch in batches:
        yield batch.map(one)


def spatial(value: Column, gazetteer: Column | None = None) -> Column:
    """GeoJSON of a spatial value: as geometry, else by name, else as loose text, else ""."""
    return F.coalesce(fixed_geometry(value), *([] if gazetteer is None else [gazetteer]), spatial_text(value))


_RELATION = T.StructType([T.StructField(c, T.BooleanType()) for c in ("within", "meets")])


def shape_filter(query: dict, relation: str = "within"):
    """A column function: whether GeoJSON text lies within, or meets, the query's geometry; sides belong to both. False where the text is no geometry.

    Put a condition on boxes or cells before it, which scans can use.
    """
    return lambda text: shape_relation(query)(text)[relation if relation == "within" else "meets"]


def shape_relation(query: dict):
    """A column function: shape_filter()'s two answers at once, as a struct (within, meets)."""
    target = shapes.shape_of(query)

    @F.pandas_udf(_RELATION)
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([related(text, target) for text in batch], columns=["within", "meets"], dtype=bool)

    return test


def related(text: str | None, target: shapes.Shape) -> tuple[bool, bool]:
    """Whether GeoJSON text lies within a shape, and whether it meets it."""
    try:
        return shapes.relation(shapes.shape_of(json.loads(text)), target)
    except (TypeError, ValueError, KeyError, IndexError, AttributeError):
        return False, False


@F.pandas_udf(_RELATION)
def pair_relation(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """related() of two columns of GeoJSON text, row by row."""

    def one(a, b):
        try:
            return related(a, shapes.shape_of(json.loads(b)))
        except (TypeError, ValueError, KeyError, IndexError, AttributeError):
            return False, False

    return pd.DataFrame([one(a, b) for a, b in zip(left, right, strict=True)], columns=["within", "meets"], dtype=bool)


# --- cells: a quadtree over longitude and latitude; a cell is its level and place in one number


_BOX = ("minx", "miny", "maxx", "maxy")
#: Levels of the quadtree: the finest cells are about a hundredth of a degree.
LEVELS = 15


def _left(v: Column, bits) -> Column:
    return F.call_function("shiftleft", v, bits if isinstance(bits, Column) else F.lit(bits))


def _right(v: Column, bits) -> Column:
    return F.call_function("shiftrightunsigned", v, bits if isinstance(bits, Column) else F.lit(bits))


def _named(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spread(v: Column) -> Column:
    """A number with a 0 before each of its binary digits: they are read as digits to the base 4."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def _grid(v: Column, reach: float, level: Column) -> Column:
    """The column or row of cells of a level that a coordinate is in; coordinates out of range are in the outermost."""
    n = _left(F.lit(1).cast("long"), level)
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor((v + reach) / (2 * reach) * n)))


def cell(level: Column, x: Column, y: Column) -> Column:
    """A cell's number: a 1 and then two bits a level, so that a cell's number without its last two bits is its parent's."""
    return _left(F.lit(1).cast("long"), 2 * level).bitwiseOR(_spread(x)).bitwiseOR(_left(_spread(y), 1))


def cover(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """One to four cells that cover a box: those of the finest level whose cells are as large as it."""
    size = F.greatest((maxx - minx) / 360, (maxy - miny) / 180, F.lit(2.0**-LEVELS))

    def at(level: Column) -> Column:
        xs, ys = F.sequence(_grid(minx, 180, level), _grid(maxx, 180, level)), F.sequence(_grid(miny, 90, level), _grid(maxy, 90, level))
        return F.array_distinct(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: cell(level, x, y)))))

    return _named(F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(-F.log2(size)).cast("int"))), at)


def with_parents(cells: Column) -> Column:
    """Cells and all that they are part of."""
    return F.array_distinct(F.flatten(F.transform(cells, lambda c: F.transform(F.sequence(F.lit(0), F.length(F.bin(c)).cast("int") - 1, F.lit(2)), lambda k: _right(c, k)))))


def cell_range(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The least and the largest of the finest cells within the smallest cell that holds a box, as columns for a table to be sorted by and pruned on."""
    finest = F.lit(LEVELS)
    ends = F.struct(*(cell(finest, _grid(x, 180, finest), _grid(y, 90, finest)).alias(n) for x, y, n in ((minx, miny, "low"), (maxx, maxy, "high"))))

    def around(e: Column) -> Column:
        bits = F.length(F.bin(e["low"].bitwiseXOR(e["high"]))).cast("int")  # two a level
        return _named(F.when(e["low"] == e["high"], 0).otherwise(bits + bits % 2), lambda n: F.struct(_left(_right(e["low"], n), n).alias("first"), (_left(_right(e["low"], n) + 1, n) - 1).alias("last")))

    return _named(ends, around)


def covering(box: tuple[float, float, float, float], most: int = 16) -> list[tuple[int, int]]:
    """Ranges of the finest cells that cover a box: at most so many cells of mixed levels, each cut in four while that leaves some of it out."""
    box = tuple(max(-reach, min(reach, v)) for v, reach in zip(box, (180, 90, 180, 90), strict=True))
    todo, done = [(0, 0, 0)], []
    while todo:
        level, x, y = todo.pop(0)
        w, h = 360 / (1 << level), 180 / (1 << level)
        left, low = x * w - 180, y * h - 90
        if left > box[2] or left + w < box[0] or low > box[3] or low + h < box[1]:
            continue
        whole = box[0] <= left and left + w <= box[2] and box[1] <= low and low + h <= box[3]
        if whole or level == LEVELS or len(todo) + len(done) + 4 > most:
            done.append((level, x, y))
        else:
            todo += [(level + 1, 2 * x + i, 2 * y + j) for j in (0, 1) for i in (0, 1)]
    spread = lambda v: sum((v >> k & 1) << 2 * k for k in range(LEVELS))
    out = []
    for level, x, y in done:
        shift, number = 2 * (LEVELS - level), 1 << 2 * level | spread(x) | spread(y) << 1
        out.append((number << shift, (number << shift) + (1 << shift) - 1))
    return sorted(out)


def in_cells(cells: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a column of cell_range() shares a cell with a box: comparisons that scans can use."""
    parts = [(cells["first"] <= last) & (cells["last"] >= first) for first, last in covering(box)]
    return reduce(Column.__or__, parts, F.lit(False))


def joined(left: DataFrame, right: DataFrame, within: bool = False) -> DataFrame:
    """(left_id, right_id) of every pair of shapes that meet, or of which left lies within right. Both have id, shape (GeoJSON text) and box (minx, miny, maxx, maxy).

    Two boxes that meet have cells of which one is part of the other: each side's own cells are joined with the other's cells and their parents, which
    is at most four cells and fifteen parents of each, and the exact test follows. Equal shapes are one, the least id's, until the pairs are known.
    """

    def alike(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        """Different shapes by their least id, and each row's."""
        own = df.select("id", "shape", *(F.col(f"box.{c}").alias(f"_{c}") for c in _BOX))
        unlike = own.groupBy("shape", *(f"_{c}" for c in _BOX)).agg(F.min("id").alias("_same"))
        members = own.join(unlike, ["shape", *(f"_{c}" for c in _BOX)]).select(F.col("id").alias(f"{side}_id"), F.col("_same").alias(f"{side}_same"))
        return unlike.select(F.col("_same").alias("id"), "shape", F.struct(*(F.col(f"_{c}").alias(c) for c in _BOX)).alias("box")), members

    def cells(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        own = cover(*(F.col(f"box.{c}") for c in _BOX))
        return tuple(df.select(F.col("id").alias(f"{side}_same"), F.col("box").alias(f"{side}_box"), F.explode(c).alias("cell")) for c in (own, with_parents(own)))

    (left, lefts), (right, rights) = alike(left, "left"), alike(right, "right")
    (lo, lp), (ro, rp) = cells(left, "left"), cells(right, "right")
    apart = [F.col(f"{a}_box.min{c}") > F.col(f"{b}_box.max{c}") for a, b in (("left", "right"), ("right", "left")) for c in "xy"]
    pairs = lo.join(rp, "cell").unionByName(lp.join(ro, "cell")).where(~reduce(Column.__or__, apart)).select("left_same", "right_same").distinct()
    met = pairs.join(left.select(F.col("id").alias("left_same"), F.col("shape").alias("_left")), "left_same").join(right.select(F.col("id").alias("right_same"), F.col("shape").alias("_right")), "right_same")
    found = spread(met).where(pair_relation("_left", "_right")["within" if within else "meets"]).select("left_same", "right_same")
    return found.join(lefts, "left_same").join(rights, "right_same").select("left_id", "right_id")
