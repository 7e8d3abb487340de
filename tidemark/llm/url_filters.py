"""URL filters with redirect equivalence.

A rule is a host and a path prefix; it fits its host and all subdomains where the url's path starts with the rule's, and
the longest fitting rule decides. Urls that redirect to each other or name each other as canonical are aliases: connected
components over those edges carry a block to all aliases without a rule of their own. An explicit allow goes before: a url
keeps its own rule's verdict, and a component that holds an explicitly allowed url blocks none of its other aliases.

Edges come from three places: a page's <link rel=canonical>, a page's <meta http-equiv=refresh>, and the url's own canonical
form (scheme and fragment apart, host in lower case without a default port, without tracking parameters or a final slash). A target is
read against its page's url, with dot segments taken out and &amp; decoded, so that it names one url; <base> is not looked at. Targets without
a host (mailto:, javascript:) make no edge. A caller may add a table of further redirects, between whole urls.

Defined cases: a null url, or one without "://", has empty host and path, no rule, no aliases and the verdict allow, whatever its page links to;
empty rule or page tables give no matches or no rows; pages that repeat are judged alike; of rules that fit equally long the first holds; urls and
html of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, written
from tidemark.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
#: Parameters that name where a visitor came from and not what the page is.
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The url's canonical form, with "//" before the host so that it is no url itself; null where the url has no host."""
    rest = after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$")), "&")
    name = F.regexp_replace(host(url), r":(80|443)$", "")
    form = F.concat(F.lit("//"), name, F.regexp_replace(path(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(name != "", form)


#: What begins a target that needs no page: a scheme.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def undotted(path: Column) -> Column:
    """A path from its first slash on without its "." and ".." segments."""
    parts = F.split(path, "/")
    dots = F.element_at(parts, -1).isin(".", "..")  # the path then ends in a slash
    start = F.slice(parts, 1, 1)
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), start, lambda all, p: F.when(p == ".", all).when(p == "..", F.slice(all, 1, F.greatest(F.size(all) - 1, F.lit(1)))).otherwise(F.concat(all, F.array(p))))
    return F.concat(F.array_join(kept, "/"), F.when(dots, F.lit("/")).otherwise(""))


def resolved(url: Column, target: Column) -> Column:
    """The whole url that a page's target names, without its fragment; null where it names none with a host."""
    t = F.regexp_replace(F.regexp_replace(target, "&amp;", "&"), "#.*$", "")
    origin = F.regexp_extract(url, r"^.*?://[^/?#]*", 0)
    folder = F.concat(F.lit("/"), F.regexp_extract(path(url), r"^/(.*/)", 1))
    whole = F.when(t == "", F.lit("")).when(t.rlike(SCHEME), t).when(t.startswith("//"), F.concat(F.regexp_extract(url, r"^(.*?:)//", 1), t)).when(t.startswith("?"), F.concat(origin, path(url), t)).when(t.startswith("/"), F.concat(origin, t)).otherwise(F.concat(origin, folder, t))
    place = F.regexp_extract(whole, r"^[^?]*?://[^/?]*(/[^?]*)", 1)
    clean = F.when(place.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.regexp_extract(whole, r"^[^?]*?://[^/?]*", 0), undotted(place), F.regexp_extract(whole, r"\?.*$", 0))).otherwise(whole)
    return F.when(host(whole) != "", clean)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) in order of preference; of equal rules the first holds."""
    return spark.createDataFrame([(v, h, p, h + p, k) for k, (v, h, p) in enumerate(rules)], "rule_verdict string, rule_host string, rule_path string, rule string, rank int")


def matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule of each distinct (host, path): (host, path, rule, rule_verdict), for those with one."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = places.select("host", "path").where("host <> ''").distinct().withColumn("rule_host", F.explode(suffix))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), -F.col("rank"))).alias("best")
    return tried.join(small(rules), "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(best).select("host", "path", "best.*")


def links(pages: DataFrame) -> DataFrame:
    """Alias edges (a, b) of pages (url, html); both ends are whole urls or canonical forms."""
    tag = F.regexp_extract("html", LINK, 0)
    jump = F.regexp_extract("html", REFRESH, 0)
    named = F.filter(F.array(F.regexp_extract(tag, HREF, 1), F.regexp_extract(jump, TARGET, 1)), lambda t: t != "")
    own = F.concat(F.array(canonical(F.col("url"))), F.transform(named, lambda t: resolved(F.col("url"), t)))
    found = pages.where((F.instr("url", "://") > 0) & (host(F.col("url")) != "")).select(F.col("url").alias("a"), F.explode(own).alias("b")).where("b <> ''")
    # a target's canonical form joins the forms of one page
    also = found.where("b like '%://%'").select(F.col("b").alias("a"), canonical(F.col("b")).alias("b"))
    return found.union(also).where("b is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) to (page_id, host, path, rule, verdict, component)."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    edges = written(edges.distinct(), "url-edges")
    # an alias that one page alone has tells nothing, yet its rule may: all stay
    member = written(connected_components(edges, "url-components"), "url-members")
    placed = member.where("node like '%://%'").withColumns({"host": host(F.col("node")), "path": path(F.col("node"))})
    own = placed.join(matched(placed, rules), ["host", "path"])
    decided = own.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"), F.bool_or(F.col("rule_verdict") == "block").alias("blocked"))
    blocked = decided.where("blocked and not allowed").select("component")
    aliases = member.join(blocked, "component").select(F.col("node").alias("url"), F.lit(True).alias("alias_blocked"))
    at = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = at.join(matched(at, rules), ["host", "path"], "left").join(aliases, "url", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def sql(rules: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL for judge() over ``pages``; the closure of the alias edges stands in for components."""
    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"

    def place(url: str) -> str:
        after = rest.format(url)
        return f"lower_az(regexp_extract(coalesce({after}, ''), '^[^/?#]*')) AS host, regexp_extract(coalesce({after}, ''), '^[^/?#]*([^?#]*)', 1) AS path"

    def form(url: str) -> str:
        after = rest.format(url)
        kept = f"array_to_string(list_filter(string_split(regexp_extract({after}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '{TRACKING}')), '&')"
        name = f"regexp_replace(lower_az(regexp_extract({after}, '^[^/?#]*')), ':(80|443)$', '')"
        return f"CASE WHEN {name} <> '' THEN '//' || {name} || regexp_replace(regexp_extract({after}, '^[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"

    def whole(url: str, target: str) -> str:
        """resolved() of a page's target, by the stages t (target), w (whole url), p (its path)."""
        origin, own = f"regexp_extract({url}, '^.*?://[^/?#]*')", f"regexp_extract(coalesce({rest.format(url)}, ''), '^[^/?#]*([^?#]*)', 1)"
        t = f"SELECT regexp_replace(replace({target}, '&amp;', '&'), '#.*$', '') AS t"
        w = f"SELECT CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '{SCHEME}') THEN t WHEN starts_with(t, '//') THEN regexp_extract({url}, '^(.*?:)//', 1) || t WHEN starts_with(t, '?') THEN {origin} || {own} || t WHEN starts_with(t, '/') THEN {origin} || t ELSE {origin} || '/' || regexp_extract({own}, '^/(.*/)', 1) || t END AS w FROM ({t})"
        p = f"SELECT w, string_split(regexp_extract(w, '^[^?]*?://[^/?]*(/[^?]*)', 1), '/') AS s FROM ({w})"
        kept = "list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN x = ['.'] THEN acc WHEN x = ['..'] THEN acc[1:greatest(len(acc) - 1, 1)] ELSE list_concat(acc, x) END)"
        return f"(SELECT CASE WHEN regexp_extract({rest.format('w')}, '^[^/?#]*') = '' THEN NULL WHEN len(list_intersect(s, ['.', '..'])) > 0 THEN regexp_extract(w, '^[^?]*?://[^/?]*') || array_to_string({kept}, '/') || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(w, '\\?.*$') ELSE w END FROM ({p}))"

    quoted = lambda r: r.replace("'", "''")
    values = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}', {k})" for k, (v, h, p) in enumerate(rules))
    text = f"""WITH RECURSIVE rules(rule_verdict, rule_host, rule_path, rule, rank) AS (VALUES {values}),
tags AS (SELECT url, regexp_extract(regexp_extract(html, '{quoted(LINK)}'), '{quoted(HREF)}', 1) AS c, regexp_extract(regexp_extract(html, '{quoted(REFRESH)}'), '{quoted(TARGET)}', 1) AS r FROM pages WHERE strpos(url, '://') > 0 AND regexp_extract({rest.format('url')}, '^[^/?#]*') <> ''),
found AS (SELECT url AS a, {form('url')} AS b FROM tags UNION ALL SELECT url, {whole('url', 'c')} FROM tags WHERE c <> '' UNION ALL SELECT url, {whole('url', 'r')} FROM tags WHERE r <> ''),
one AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM found WHERE b <> '' UNION ALL SELECT b, {form('b')} FROM found WHERE b LIKE '%://%') WHERE b IS NOT NULL),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
urls AS (SELECT url, {place('url')} FROM (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT b FROM reach WHERE b LIKE '%://%'))),
m AS (SELECT url, arg_max(rule, (length(rule), -rank)) AS rule, arg_max(rule_verdict, (length(rule), -rank)) AS rule_verdict FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) WHERE host <> '' GROUP BY url),
d AS (SELECT a AS url, bool_or(rule_verdict = 'allow') AS allowed, bool_or(rule_verdict = 'block') AS blocked FROM reach JOIN m ON m.url = reach.b GROUP BY a)
SELECT page_id, urls.host, urls.path, m.rule, coalesce(m.rule_verdict, CASE WHEN d.blocked AND NOT d.allowed THEN 'block' END, 'allow') AS verdict
FROM pages JOIN urls ON urls.url IS NOT DISTINCT FROM pages.url LEFT JOIN m ON m.url = pages.url LEFT JOIN d ON d.url = pages.url"""
    while "lower_az(" in text:  # A-Z only, as the contract has it
        at = text.index("lower_az(")
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}translate({text[at + 9 : end - 1]}, '{UPPER}', '{LOWER}'){text[end:]}"
    return text
