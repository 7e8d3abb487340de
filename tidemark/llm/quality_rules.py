"""Quality rules of documents and, through them, of their hosts.

Every document has counts over its whole text and fails rules by them: it is short, mostly repeats itself, has many symbols, or many lines that
stood before. The first two are base rules, which drop a document by themselves. Failures of each rule are added up by host
(the source), and a host's failure rate is shrunk toward the rate of all hosts by a beta prior of the rule's own that is fitted to the hosts by
moments, so a host of few documents isn't judged by them alone. The host's verdict on a rule is joined back to its documents: above ``HOST_RATE``
all of them are dropped; else those that fail the rule are, unless the host's rate is below ``LENIENT`` of the prior's mean, as one that hardly ever
fails is given the benefit of the doubt. All of it is built-in functions: the repeated windows of a text are found by sorting the hashes of
its windows, so a text needs memory in proportion to its own length and no shuffle.

Defined cases: null, empty and blank texts have no words and fail as short, not by the other rules; a null source is a host of its own; documents that repeat are
counted each; very long texts are counted whole; hosts whose rates tie fare alike; an empty table gives no rows; extra columns are ignored. Two windows are held equal if their 64-bit hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, words, written

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Percent of symbols, of a text's characters in words, and of lines that stood before, of its lines, above which a text fails.
MOST_SYMBOL_PERCENT, MOST_LINE_PERCENT = 5, 50
#: A host of which a rule's shrunk failure rate is above this is dropped; below this share of the prior's mean its failures of that rule are forgiven.
HOST_RATE, LENIENT = 0.6, 0.5
RULES = ("short", "repeated", "symbols", "lines")
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 3


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def word_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    """How many lines are equal to an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(word: Column, hashes: Column, order: Column) -> Column:
    """Words inside a 3-word window that the text has at least twice.

    hashes holds the hash of the window at each place, order the (hash, place) pairs sorted, so equal windows are neighbours.
    """
    last = F.size(order) - 1
    same = F.filter(
        F.transform(order, lambda x, k: F.when(
            ((k > 0) & (F.get(order, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(order, k + 1)["h"] == x["h"])), x["p"])),
        lambda p: p.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(*[p + k for k in range(WINDOW)]))))
    # only texts with a repeated window pay for the sort
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.size(covered)).cast("long")


def features(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, source and the counts of each document of docs (doc_id, source, text), beside the columns to keep."""
    base = docs.select("doc_id", "source", *keep, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", words(F.col("_text"))).withColumn("_lines", word_lines(F.col("_text")))
    base = base.withColumn("_hash", F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda k: F.xxhash64(*[F.get("_words", k + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    order = F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.array_sort(F.transform("_hash", lambda h, k: F.struct(h.alias("h"), k.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    base = base.withColumn("_order", order)
    counted = base.select(
        "doc_id", "source", *keep, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("_text")).alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"), n_dup_lines(F.col("_lines")).alias("n_dup_lines"), n_repeat_words(F.col("_words"), F.col("_hash"), F.col("_order")).alias("n_repeat_words"),
    )
    failed = {
        "short": F.col("n_words") < LEAST_WORDS, "repeated": 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * F.col("word_chars"), "lines": 100 * F.col("n_dup_lines") > MOST_LINE_PERCENT * F.col("n_lines"),
    }
    return counted.select("*", *[failed[r].alias(r) for r in RULES], (failed["short"] | failed["repeated"]).alias("base_failed"))


def host_verdicts(counted: DataFrame, host_rate: float = HOST_RATE, lenient: float = LENIENT) -> DataFrame:
    """host, documents, and of each rule the shrunk failure rate; whether the host is dropped; and the rules of which its failures are forgiven.

    A rule's prior has as mean the mean of the hosts' rates and as weight a + b = m(1 - m)/v - 1, with v their variance; without
    any spread, or with a single host, the prior weighs as much as the mean host.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("host")
    hosts = written(counted.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in RULES]), "hosts")
    rate = lambda r: F.col(r) / F.col("n")
    row = hosts.agg(F.avg("n").alias("n"), *[x for r in RULES for x in (F.avg(rate(r)).alias(f"m_{r}"), F.var_samp(rate(r)).alias(f"v_{r}"))]).first()
    rates, forgiven = [], []
    for r in RULES:
        m, v = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        weight = min(max(m * (1 - m) / v - 1 if v > 0 else row["n"] or 1.0, 1.0), 1e6)
        rates.append((F.col(r) + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))
        forgiven.append(F.when(rates[-1] < lenient * m, r))
    return hosts.select("host", "n", *[x.alias(f"rate_{r}") for x, r in zip(rates, RULES, strict=True)], (F.greatest(*rates) > host_rate).alias("host_dropped"), F.array_compact(F.array(*forgiven)).alias("forgiven"))


def judge(docs: DataFrame, host_rate: float = HOST_RATE, lenient: float = LENIENT) -> DataFrame:
    """Each document's counts, whether it fails the base rules, its host's rates, and whether it is kept."""
    counted = written(features(docs), "quality-features")
    keyed = counted.withColumn("host", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))).join(small(host_verdicts(counted, host_rate, lenient).drop("n")), "host")
    fails = [F.col(r) & ~F.array_contains("forgiven", r) for r in ("symbols", "lines")]
    kept = ~F.col("base_failed") & ~F.col("host_dropped") & ~fails[0] & ~fails[1]
    return keyed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *[F.round(f"rate_{r}", 9).alias(f"rate_{r}") for r in RULES])


#: DuckDB SQL for judge() over ``documents``.
SQL = rf"""
WITH wr AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (
    SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM wr))),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY rid),
f AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM wr) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} AS short, 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS repeated, 100 * n_symbols > {MOST_SYMBOL_PERCENT} * word_chars AS symbols, 100 * n_dup_lines > {MOST_LINE_PERCENT} * n_lines AS lines FROM f),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({r}) AS k_{r}" for r in RULES)} FROM b GROUP BY source),
p AS (SELECT avg(n) AS mn, {", ".join(f"avg(k_{r} / n) AS m_{r}, coalesce(var_samp(k_{r} / n), 0) AS v_{r}" for r in RULES)} FROM h),
q AS (SELECT *, {", ".join(f"least(greatest(CASE WHEN v_{r} > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE mn END, 1), 1e6) AS w_{r}" for r in RULES)} FROM p),
r AS (SELECT h.source, {", ".join(f"(k_{r} + m_{r} * w_{r}) / (n + w_{r}) AS rate_{r}, m_{r}" for r in RULES)} FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed,
       NOT (short OR repeated) AND greatest({", ".join(f"rate_{r}" for r in RULES)}) <= {HOST_RATE} AND NOT (symbols AND rate_symbols >= {LENIENT} * m_symbols) AND NOT (lines AND rate_lines >= {LENIENT} * m_lines) AS kept,
       {", ".join(f"round(rate_{r}, 9) AS rate_{r}" for r in RULES)}
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
