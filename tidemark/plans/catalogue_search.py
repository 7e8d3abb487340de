"""Registered queries of the search: documents' fields are indexed once a session, and every query reads the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo, quality
from tidemark.plans import roles, search
from tidemark.plans.registry import query
from tidemark.session import spread
from tidemark.sources import scratch

#: Texts are tokenised alike in SQL: runs of ASCII letters, digits and apostrophes.
GAP = r"[^a-z0-9']+"
_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_TEXTS = """f AS (SELECT doc_id, 'description' AS field, text AS v FROM documents UNION ALL SELECT doc_id, 'title', concat_ws(' ', lang, 'from', source) FROM documents UNION ALL SELECT doc_id, 'publisher', source FROM documents
UNION ALL SELECT doc_id, 'keyword', lang FROM documents UNION ALL SELECT doc_id, 'theme', 'theme ' || doc_id % 7 FROM documents UNION ALL SELECT doc_id, 'identifier', 'doc-' || doc_id FROM documents UNION ALL SELECT doc_id, 'distribution_titles', concat_ws(' ', lang, source) FROM documents)"""
_INDEX = f"""{_TEXTS}, t AS (SELECT doc_id, field, list_filter(string_split_regex(lower(coalesce(v, '')), '[^a-z0-9'']+'), lambda w: w <> '') AS ws FROM f),
p AS (SELECT doc_id, field, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM t), k AS (SELECT * FROM p WHERE token NOT IN ({_STOP}))"""
#: The description alone, for facets, which are of one field.
_DOCS = f"""t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9'']+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM t), k AS (SELECT * FROM p WHERE token NOT IN ({_STOP}))"""
_made: dict[tuple, str] = {}


def documents(s: SparkSession, d: str) -> DataFrame:
    """documents as search documents."""
    n, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    return roles.read(s, d, "documents").select(
        n.alias("id"), F.concat(F.lit("doc-"), n).alias("slug"), F.concat_ws(" ", lang, F.lit("from"), source).alias("title"), F.col("text").alias("description"), source.alias("publisher"), F.array(lang).alias("keyword"),
        F.concat(F.lit("theme "), n % 7).alias("theme"), F.concat(F.lit("doc-"), n).alias("identifier"), F.array(lang, source).alias("distribution_titles"), F.col("n_chars").alias("popularity"), F.date_add(F.lit("2024-01-01"), (n % 90).cast("int")).cast("timestamp").alias("last_harvested_date"),
        F.struct(source.alias("id"), source.alias("slug"), lang.alias("organization_type")).alias("organization"), (n % 2 == 0).alias("has_download"), (n % 3 == 0).alias("has_spatial"), F.when(n % 5 == 0, "c").alias("is_part_of"),
    )


def index(s: SparkSession, d: str) -> search.Index:
    """The index of documents, written when a session first asks for it and again if the table changes."""
    at = (s.sparkContext.applicationId, d, scratch.modified(s, f"{d}/documents.parquet"))
    if at not in _made:
        path = scratch.new_path(s, "index")
        search.stored(search.index(documents(s, d), gap=GAP), path)
        _made[at] = path
    return search.loaded(s, _made[at])


def _match(s, d, q):
    ids = search.matching(index(s, d), search.parse(q))
    return documents(s, d).select("id") if ids is None else ids


@query(f"WITH {_INDEX} SELECT DISTINCT doc_id AS id FROM (SELECT doc_id FROM k WHERE token IN ('ering', 'thon') GROUP BY doc_id, field HAVING count(DISTINCT token) = 2)")
def search_simple_and(s, d):
    return _match(s, d, "the ering thon")


@query(f"WITH {_INDEX} SELECT DISTINCT doc_id AS id FROM (SELECT doc_id FROM k WHERE token IN ('en', 'src5') GROUP BY doc_id, field HAVING count(DISTINCT token) = 2)")
def search_fields_and(s, d):
    return _match(s, d, "src5 en")


@query(f"WITH {_INDEX} SELECT DISTINCT doc_id AS id FROM k WHERE token IN ('worthless', 'moron', 'einge', 'src5')")
def search_or(s, d):
    return _match(s, d, "worthless or moron OR einge or src5")


@query(f"WITH {_INDEX} SELECT DISTINCT a.doc_id AS id FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 WHERE a.token = 'thon' AND b.token = 'er'")
def search_phrase(s, d):
    return _match(s, d, '"thon er"')


@query(f"WITH {_INDEX} SELECT DISTINCT a.doc_id AS id FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 2 WHERE a.token = 'er' AND b.token = 'er'")
def search_phrase_gap(s, d):
    return _match(s, d, '"er the er"')


@query(f"WITH {_INDEX} SELECT DISTINCT a.doc_id AS id FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 2 WHERE a.token = 'de' AND b.token = 'src2' UNION SELECT doc_id FROM k WHERE token = 'moron'")
def search_phrase_or_word(s, d):
    return _match(s, d, '"de from src2" or moron')


@query("SELECT doc_id AS id FROM documents")
def search_match_all_quirk(s, d):
    return _match(s, d, '"thon er" ering')


_SCORES = """len AS (SELECT doc_id, field, count(*) AS l FROM k GROUP BY 1, 2), st AS (SELECT field, count(*) AS n, avg(l) AS m FROM len GROUP BY 1), tf AS (SELECT doc_id, field, token, count(*) AS tf FROM k WHERE token IN ({0}) GROUP BY 1, 2, 3),
df AS (SELECT field, token, count(*) AS df FROM tf GROUP BY 1, 2), sc AS (SELECT doc_id AS id, sum(CASE field WHEN 'title' THEN 5.0 WHEN 'description' THEN 3.0 WHEN 'publisher' THEN 3.0 WHEN 'keyword' THEN 2.0 WHEN 'distribution_titles' THEN 2.0 ELSE 1.0 END
* ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * l / m))) AS s FROM tf JOIN df USING (field, token) JOIN len USING (doc_id, field) JOIN st USING (field) GROUP BY 1)"""
_BM25 = f"WITH {_INDEX}, " + _SCORES.format("'er', 'thon', 'ering'")
_ALL_FIELDS = f"WITH {_INDEX}, " + _SCORES.format("'en', 'src5', 'thon'")
_FOUND = "hit AS (SELECT DISTINCT doc_id AS id FROM k WHERE token IN ('en', 'src5', 'thon'))"


def _page(s, d, **params):
    return search.search(documents(s, d), search.Criteria.of({"q": "en OR src5 OR thon", **params}), index(s, d))


@query(_BM25 + " SELECT id, round(s, 4) AS score FROM sc WHERE id IN (SELECT doc_id FROM tf GROUP BY doc_id, field HAVING count(*) = 3) ORDER BY round(s, 4) DESC, id DESC LIMIT 20")
def search_bm25_topk(s, d):
    made = index(s, d)
    hits = search.matching(made, search.parse("er thon ering")).join(search.bm25(made, ["er", "thon", "ering"]), "id")
    return hits.select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(20)


@query(f"{_ALL_FIELDS}, {_FOUND} SELECT id, round(s, 4) AS score FROM sc JOIN hit USING (id) WHERE id % 2 = 0 AND id % 3 = 0 ORDER BY s DESC, id DESC LIMIT 20")
def search_relevance_filtered(s, d):
    return _page(s, d, has_download="true", spatial_filter="geospatial", per_page="20")[0].select("id", F.round("score", 4).alias("score"))


@query(f"{_ALL_FIELDS}, {_FOUND} SELECT id, round(s, 4) AS score, n_chars FROM sc JOIN hit USING (id) JOIN documents ON doc_id = id ORDER BY n_chars DESC, s DESC, id DESC LIMIT 20")
def search_sort_popularity(s, d):
    return _page(s, d, sort="popularity", per_page="20")[0].select("id", F.round("score", 4).alias("score"), F.col("popularity").alias("n_chars"))


@query(f"{_ALL_FIELDS}, {_FOUND} SELECT id, round(s, 4) AS score FROM sc JOIN hit USING (id) JOIN documents ON doc_id = id ORDER BY id % 90 DESC, s DESC, n_chars DESC, id DESC LIMIT 15 OFFSET 15")
def search_second_page(s, d):
    """The second page by date of harvest, from the cursor of the first page's last hit."""
    first = _page(s, d, sort="last_harvested_date", per_page="15")[0].collect()  # a page
    after = {"after": search.cursor(first[-1], "last_harvested_date")} if first else {}
    return _page(s, d, sort="last_harvested_date", per_page="15", **after)[0].select("id", F.round("score", 4).alias("score"))


@query(f"WITH {_INDEX}, {_FOUND}, h AS (SELECT documents.* FROM hit JOIN documents ON doc_id = id WHERE lang IN ('en', 'de') AND doc_id % 5 = 0) SELECT * FROM (SELECT 'organizations' AS facet, source AS term, count(*)::BIGINT AS count FROM h WHERE source IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'publishers', source, count(*)::BIGINT FROM h WHERE source IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'keywords', lang, count(*)::BIGINT FROM h WHERE lang IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)")
def search_facets_filtered(s, d):
    """Facets of what is found and filtered, without hits."""
    hits, facets = _page(s, d, org_type=["en", "de"], collection="c", per_page="0")
    tables = [facets[name].select(F.lit(name).alias("facet"), "term", "count") for name in ("organizations", "publishers", "keywords")]
    return tables[0].unionAll(tables[1]).unionAll(tables[2])


@query("SELECT doc_id AS id, 'doc-' || doc_id AS slug FROM documents WHERE doc_id = 7")
def search_document(s, d):
    return search.document(documents(s, d).withColumn("id", F.col("id").cast("string")), "doc-7").select(F.col("id").cast("long").alias("id"), "slug")


@query("SELECT count(*)::BIGINT AS total, (count(*) FILTER (doc_id % 5 = 0))::BIGINT AS parts FROM documents")
def search_totals(s, d):
    return search.totals(documents(s, d))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0")
def search_parts(s, d):
    return search.parts(documents(s, d)).select("id")


@query(f"WITH {_DOCS} SELECT token AS term, count(DISTINCT doc_id)::BIGINT AS count FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def facet_terms_keyword(s, d):
    return search.token_counts(index(s, d), "description", 25)


@query("SELECT p_brand AS term, count(*)::BIGINT AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_terms_publisher(s, d):
    return search.term_counts(roles.datasets(s, d), F.col("publisher"))


@query("SELECT n_name AS term, count(*)::BIGINT AS count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet_terms_org(s, d):
    rows = roles.read(s, d, "customer").join(F.broadcast(roles.read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    return search.term_counts(rows.select(F.col("c_custkey").alias("id"), F.struct(F.col("n_name").alias("slug")).alias("organization")), F.col("organization.slug"))


@query(f"WITH {_DOCS} SELECT token AS term, count(DISTINCT doc_id)::BIGINT AS count FROM k WHERE contains(token, 'ing') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 ORDER BY 2 DESC, 1 LIMIT 50")
def keyword_counts(s, d):
    return search.token_counts(index(s, d), "description", 50, "ING", 5)


@query("SELECT p_partkey AS id FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND lower(p_brand) = 'brand#1' AND p_type IN ('ECONOMY', 'PROMO') AND p_size > 10 AND p_partkey % 2 = 0")
def search_filters_all(s, d):
    p = roles.read(s, d, "part")
    docs = p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("keyword"), F.col("p_brand").alias("publisher"), F.struct(F.lit("o").alias("id"), F.col("p_type").alias("organization_type")).alias("organization"), (F.col("p_size") > 10).alias("has_download"), (F.col("p_partkey") % 2 == 0).alias("has_spatial"), F.lit("c").alias("is_part_of"))
    params = {"keyword": "Red", "publisher": "BRAND#1", "org_type": ["ECONOMY", "PROMO"], "has_download": "true", "spatial_filter": "geospatial", "org_id": "o", "collection": "c"}
    out = docs
    for p in search.filter_predicates(params):
        out = out.where(p)
    return out.select("id")


@query(f"WITH {_DOCS} SELECT doc_id AS id, token AS keyword FROM k WHERE length(token) > 6 GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keywords(s, d):
    long = F.filter(search.tokens(F.col("description"), GAP), lambda w: F.length(w) > 6)
    return spread(documents(s, d).select("id", "description")).select("id", F.explode(quality.duplicate_keywords(long)).alias("keyword"))


# --- places: customers as documents with a square of two degrees

_AT = "SELECT c_custkey AS id, (c_custkey * 37 % 170) - 85 AS lat, (c_custkey * 91 % 350) - 175 AS lon FROM customer"
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - 38.9) / 2), 2) + cos(radians(38.9)) * cos(radians(lat)) * pow(sin(radians(lon + 77.0) / 2), 2))))"
_AREA = {"type": "Polygon", "coordinates": [[[-60, -30], [60, -30], [60, 30], [-60, 30], [-60, -30]]]}


def squares(s, d):
    n = F.col("c_custkey")
    at = roles.read(s, d, "customer").select(n.alias("id"), ((n * 37 % 170) - 85).alias("lat"), ((n * 91 % 350) - 175).alias("lon"))
    x, y = F.col("lon"), F.col("lat")
    shape = F.format_string('{"type": "Polygon", "coordinates": [[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]]}', x, y, x + 2, y, x + 2, y + 2, x, y + 2, x, y)
    box = F.struct(x.alias("minx"), y.alias("miny"), (x + 2).alias("maxx"), (y + 2).alias("maxy"))
    return at.select("id", shape.alias("spatial_shape"), box.alias("bbox"), F.struct("lat", "lon").alias("spatial_centroid"), F.lit(None).cast("long").alias("popularity"), F.lit("p").alias("publisher"), F.array(F.lit("k")).alias("keyword"), F.struct(F.lit("o").alias("slug")).alias("organization"), F.lit("customer").alias("title"))


def _placed(s, d, within):
    params = {"spatial_geometry": search.json.dumps(_AREA), "spatial_within": within}
    docs = squares(s, d)
    for p in search.filter_predicates(params, docs.columns):
        docs = docs.where(p)
    return docs.select("id")


@query(f"WITH x AS ({_AT}) SELECT id FROM x WHERE lon >= -60 AND lon + 2 <= 60 AND lat >= -30 AND lat + 2 <= 30")
def search_within_area(s, d):
    return _placed(s, d, "true")


@query(f"WITH x AS ({_AT}) SELECT id FROM x WHERE lon <= 60 AND lon + 2 >= -60 AND lat <= 30 AND lat + 2 >= -30")
def search_meets_area(s, d):
    return _placed(s, d, "no")


#: A square hole, and an island in it, whose sides run through the places of squares.
_HOLED = {"type": "MultiPolygon", "coordinates": [[*_AREA["coordinates"], [[-20, -10], [-20, 10], [20, 10], [20, -10], [-20, -10]]], [[[-6, -6], [6, -6], [6, 6], [-6, 6], [-6, -6]]]]}
_IN = "lon >= {0} AND lon + 2 <= {1} AND lat >= {2} AND lat + 2 <= {3}"


@query(f"""WITH x AS ({_AT}) SELECT id, ({_IN.format(-60, 60, -30, 30)} AND (lon + 2 <= -20 OR lon >= 20 OR lat + 2 <= -10 OR lat >= 10)) OR ({_IN.format(-6, 6, -6, 6)}) AS within,
(lon <= 60 AND lon + 2 >= -60 AND lat <= 30 AND lat + 2 >= -30 AND NOT (lon > -20 AND lon + 2 < 20 AND lat > -10 AND lat + 2 < 10)) OR (lon <= 6 AND lon + 2 >= -6 AND lat <= 6 AND lat + 2 >= -6) AS meets FROM x""")
def place_relations(s, d):
    """Squares against an area with a hole and an island in it: sides that run along each other, holes and all."""
    return spread(squares(s, d).select("id", "spatial_shape")).select("id", geo.shape_relation(_HOLED)("spatial_shape").alias("r")).select("id", "r.within", "r.meets")


_SITES = "SELECT s_suppkey AS site, (s_suppkey * 53 % 160) - 80 AS lat, (s_suppkey * 29 % 330) - 165 AS lon, 1 + s_suppkey % 9 AS w FROM supplier"


@query(f"WITH x AS ({_AT}), y AS ({_SITES}) SELECT x.id, site FROM x JOIN y ON x.lon <= y.lon + w AND x.lon + 2 >= y.lon AND x.lat <= y.lat + w AND x.lat + 2 >= y.lat")
def place_join(s, d):
    """Squares of customers and of suppliers that meet, joined by cells."""
    n = F.col("s_suppkey")
    x, y, w = (n * 29 % 330) - 165, (n * 53 % 160) - 80, 1 + n % 9
    shape = F.format_string('{"type": "Polygon", "coordinates": [[[%s, %s], [%s, %s], [%s, %s], [%s, %s], [%s, %s]]]}', x, y, x + w, y, x + w, y + w, x, y + w, x, y)
    box = F.struct(x.alias("minx"), y.alias("miny"), (x + w).alias("maxx"), (y + w).alias("maxy"))
    sites = roles.read(s, d, "supplier").select(n.alias("id"), shape.alias("shape"), box.alias("box"))
    own = squares(s, d).select("id", F.col("spatial_shape").alias("shape"), F.col("bbox").alias("box"))
    return geo.joined(own, sites).select(F.col("left_id").alias("id"), F.col("right_id").alias("site"))


@query(f"WITH x AS ({_AT}) SELECT id, round({_KM}, 3) AS distance FROM x ORDER BY {_KM}, id DESC LIMIT 40")
def geo_distance_sort(s, d):
    criteria = search.Criteria.of({"sort": "distance", "lat": "38.9", "lon": "-77", "per_page": "40"})
    return search.search(squares(s, d), criteria)[0].select("id", F.round("distance", 3).alias("distance"))
