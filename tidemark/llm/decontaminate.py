"""Benchmark decontamination by spaced seeds.

A seed is a run of ``SPAN`` words of which a fixed mask looks at some and ignores the others, so a substituted word at an
ignored place leaves the seed's hash as it is. The seeds of every benchmark text and of every document are hashed and joined; a hit
proposes that the document holds the benchmark text at one offset. Around the hits of an offset the words of both texts
are compared place by place, which tolerates substitutions: the overlap is the longest run of places that begins and ends with
an equal word and in which at least ``LEAST_EQUAL`` of the places are equal. A document is contaminated by a text if the overlap has
at least ``LEAST_WORDS`` places, or all of a shorter text.

Words are in lower case and without punctuation at their ends. A benchmark text shorter than a seed is matched as a whole by the hash of all its words.

All of it is built-in functions. The benchmark's hashes are broadcast only if they are few and small; the documents that have hits are read again
for the comparison, by a broadcast of their ids only if those are few, else by a join that can split hot keys.

Defined cases: null, empty and blank texts have no seeds and match nothing; benchmark texts that repeat are each reported; documents that
repeat (same doc_id and text) are reported once; of a text's overlaps that tie the first place counts; very long texts are taken whole, and texts
that repeat few words meet in rows in proportion to their lengths; a null doc_id or item_id is carried as null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, small, words, written

#: Fixed masks within SPAN words: places that a seed looks at. Any run of SPAN places or more that begins and ends equal and of which
#: LEAST_EQUAL are equal has one of them whole, wherever its substitutions stand (a test tries all of them up to 20 places).
SPAN = 10
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 7, 8), (2, 5, 6, 7, 8))
LEAST_WORDS, LEAST_EQUAL = 13, 0.8
#: Benchmark seeds and hit documents that may be broadcast.
SEED_ROWS, ID_ROWS = 2_000_000, 1_000_000


def terms(text: Column) -> Column:
    """Lower-case words without punctuation at their ends; words of punctuation only are left out."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(^|[\x20\x09-\x0D])[\p{P}\p{S}]+|[\p{P}\p{S}]+(?=[\x20\x09-\x0D]|$)", "$1")
    return words(clean)


def word_hashes(text: Column) -> Column:
    return F.transform(terms(text), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, lengths: list[int] = ()) -> DataFrame:
    """rows (.., h: word hashes) to a row per seed: (.., at, mask, seed); a mask needs its own places only, in texts of SPAN words or more. lengths: spans shorter than SPAN whose whole runs are seeds too."""
    others = [c for c in rows.columns if c != "h"]
    shifted = F.arrays_zip(*[(F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))) if k else F.col("h")).alias(f"w{k}") for k in range(SPAN)])
    places = rows.where(F.size("h") > 0).select(*others, (F.size("h") >= SPAN).alias("_long"), F.posexplode(shifted).alias("at", "w")).select(*others, "_long", "at", *[F.col(f"w.w{k}").alias(f"w{k}") for k in range(SPAN)])
    full = [F.when(F.col("_long") & F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"w{k}") for k in mask])) for m, mask in enumerate(MASKS)]
    short = [F.when(F.col(f"w{n - 1}").isNotNull(), F.xxhash64(F.lit(-n), *[F.col(f"w{k}") for k in range(n)])) for n in lengths]
    return places.select(*others, "at", F.posexplode(F.array(*full, *short)).alias("mask", "seed")).where("seed is not null")


def classes(found: DataFrame, *key: str) -> DataFrame:
    """(*key, seed, prior, places) of seeds (*key, at, mask, seed): the places of a seed in a text, by the seed of the same mask one place before (null without one)."""
    by = Window.partitionBy(*key, "mask").orderBy("at")
    prior = F.when(F.lag("at").over(by) == F.col("at") - 1, F.lag("seed").over(by))
    return found.withColumn("prior", prior).groupBy(*key, "seed", "prior").agg(F.collect_list("at").alias("places"))


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, copy, item, shift) with a hit: the document's word at ``at`` stands where the text's word at ``at - shift`` does.

    Of hits one behind the other only the first is made: where both seeds follow on equal ones, the hit before has the same shift. So texts
    that repeat a word or phrase meet in as many rows as they have places together, not as many as their product.
    """
    items = written(bench.select("item", word_hashes(F.col("text")).alias("h")), "bench")
    sizes = [r[0] for r in items.select(F.size("h").alias("n")).where(f"n > 0 and n < {SPAN}").distinct().collect()]
    own = seeds(items.select("item", "h", F.size("h").alias("n")), sorted(sizes))
    # a short text counts as a whole only, and so do the short seeds
    own = written(own.where(f"n >= {SPAN} or at = 0").select("item", "at", "mask", "seed"), "bench-seeds")
    theirs = seeds(docs.select("doc_id", "copy", word_hashes(F.col("text")).alias("h")), sorted(sizes))
    known = small(written(own.select("seed").distinct(), "bench-hashes"), SEED_ROWS)
    theirs = classes(theirs.join(known, "seed", "left_semi"), "doc_id", "copy")
    item = written(classes(own, "item").select("item", "seed", F.col("prior").alias("item_prior"), F.col("places").alias("item_places")), "bench-classes")
    met = theirs.join(small(item, SEED_ROWS), "seed").where(F.coalesce(F.col("prior") != F.col("item_prior"), F.lit(True)))
    return met.withColumn("at", F.explode("places")).select("doc_id", "copy", "item", F.explode(F.transform("item_places", lambda k: F.col("at") - k)).alias("shift")).distinct()


def longest_run(spots: Column, least_equal: float) -> Column:
    """The longest run that begins and ends with an equal place and has least_equal of its places equal: a struct (n, back, equal), back the negative of its first place; of equally long ones the first.

    spots: the equal places in order. With a(j) = j - least_equal * spots[j] a run from the j-th to the k-th has enough if a(j) is at most
    a(k) + 1 - least_equal. So starts and ends are put in order of these, and each end takes the first place of all starts before it.
    """
    value = lambda x: F.round(x * 1_000_000).cast("long")  # noqa: E731  shares such as 0.8 are exact here
    starts = F.transform(spots, lambda s, j: F.struct(value(j - F.lit(least_equal) * s).alias("v"), F.lit(0).alias("end"), j.alias("k"), s.alias("s")))
    ends = F.transform(spots, lambda s, k: F.struct(value(k + 1 - F.lit(least_equal) * (s + 1)).alias("v"), F.lit(1).alias("end"), k.alias("k"), s.alias("s")))
    far = F.lit(1 << 30)
    state = F.struct(far.alias("k"), far.alias("s"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("back"), F.lit(0).alias("equal")).alias("best"))

    def step(now: Column, e: Column) -> Column:
        run = F.struct((e["s"] - now["s"] + 1).alias("n"), (-now["s"]).alias("back"), (e["k"] - now["k"] + 1).alias("equal"))
        at_end = F.struct(now["k"].alias("k"), now["s"].alias("s"), F.greatest(run, now["best"]).alias("best"))
        at_start = F.struct(F.least(now["k"], e["k"]).alias("k"), F.least(now["s"], e["s"]).alias("s"), now["best"].alias("best"))
        return F.when(e["end"] == 1, at_end).otherwise(at_start)

    return F.aggregate(F.array_sort(F.concat(starts, ends)), state, step, lambda x: x["best"])


def overlaps(docs: DataFrame, bench: DataFrame, least_words: int = LEAST_WORDS, least_equal: float = LEAST_EQUAL) -> DataFrame:
    """(doc_id, item_id, doc_from, doc_to, n_places, n_equal, item_words): the longest overlap of each document and benchmark text that have one."""
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("copy"), "text")
    tests = bench.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    found = written(hits(base, tests), "hits")
    ids = small(written(found.select("copy").distinct(), "hit-documents"), ID_ROWS)
    again = base.join(ids, "copy", "left_semi").dropDuplicates(["copy"]).select("copy", "doc_id", word_hashes(F.col("text")).alias("doc_words"))
    both = found.select("copy", "item", "shift").join(again, "copy").join(small(written(tests.select("item", "item_id", word_hashes(F.col("text")).alias("item_words")), "bench-words"), ID_ROWS), "item")
    # the stretch where both texts have words
    head = F.greatest(F.lit(0), -F.col("shift"))
    count = F.least(F.size("item_words"), F.size("doc_words") - F.col("shift")) - head
    equal = F.zip_with(F.slice("item_words", head + 1, count), F.slice("doc_words", head + F.col("shift") + 1, count), lambda a, b: a == b)
    spots = F.filter(F.transform(equal, lambda e, k: F.when(e, k)), lambda k: k.isNotNull())
    placed = both.select("doc_id", "copy", "item_id", "item", "shift", head.alias("head"), F.size("item_words").alias("n_item"), spots.alias("spots"))
    need = F.least(F.lit(least_words), F.col("n_item"))
    best = placed.where((F.size("spots") > 0) & (F.size("spots") >= F.lit(least_equal) * need - 1e-6)).withColumn("run", longest_run(F.col("spots"), least_equal))
    rows = best.where(F.col("run.n") >= need).select("doc_id", "copy", "item_id", "item", (F.col("head") + F.col("shift") - F.col("run.back")).alias("doc_from"), F.col("run.n").alias("n_places"), F.col("run.equal").alias("n_equal"), F.col("n_item").alias("item_words"))
    longest_of = F.max_by(F.struct("doc_id", "item_id", "doc_from", "n_places", "n_equal", "item_words"), F.struct("n_equal", "n_places", -F.col("doc_from"))).alias("r")
    out = rows.groupBy("copy", "item").agg(longest_of).select("r.*")
    return out.withColumn("doc_to", F.col("doc_from") + F.col("n_places"))


def clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark text."""
    dirty = overlaps(docs, bench, **options).select("doc_id").distinct()
    dirty = written(dirty.withColumn("_hit", F.lit(True)).withColumnRenamed("doc_id", "_dirty"), "contaminated")
    return boxed(docs).join(small(dirty, ID_ROWS), F.col("_doc.doc_id").eqNullSafe(F.col("_dirty")), "left_anti").select("_doc.*")


def sql(least_words: int = LEAST_WORDS, least_equal: float = LEAST_EQUAL) -> str:
    """DuckDB SQL of overlaps(): every pair of equal words names a shift, and all runs between a shift's equal places are tried. Texts shorter than a seed count as they are only."""
    clean = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '(^|[\x20\x09-\x0D])[\pP\pS]+|[\pP\pS]+([\x20\x09-\x0D]|$)', '\1\2', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""WITH b AS (SELECT DISTINCT item_id, text FROM benchmark), i AS (SELECT item_id, {clean} AS ws, row_number() OVER (ORDER BY item_id, text) AS item FROM b), q AS (SELECT DISTINCT doc_id, text FROM documents), d AS (SELECT doc_id, {clean} AS ws, row_number() OVER (ORDER BY doc_id, text) AS doc FROM q),
iw AS (SELECT item, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS at FROM i), dw AS (SELECT doc, unnest(ws) AS word, unnest(range(len(ws))) AS at FROM d),
m AS (SELECT doc, item, dw.at - iw.at AS shift, iw.at AS s, n, count(*) OVER (PARTITION BY doc, item, dw.at - iw.at) AS spots FROM dw JOIN iw USING (word)), c AS (SELECT *, row_number() OVER (PARTITION BY doc, item, shift ORDER BY s) AS j FROM m WHERE spots >= {least_equal} * least({least_words}, n) - 1e-6),
r AS (SELECT x.doc, x.item, x.shift, x.n, x.s + x.shift AS doc_from, y.s - x.s + 1 AS n_places, y.j - x.j + 1 AS n_equal FROM c x JOIN c y ON y.doc = x.doc AND y.item = x.item AND y.shift = x.shift AND y.j >= x.j
WHERE y.j - x.j + 1 >= (CASE WHEN x.n < {SPAN} THEN 1 ELSE {least_equal} END) * (y.s - x.s + 1) - 1e-6 AND y.s - x.s + 1 >= least({least_words}, x.n)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, item, shift ORDER BY n_places DESC, doc_from) AS o FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY n_equal DESC, n_places DESC, doc_from) AS g FROM o WHERE o = 1)
SELECT doc_id, item_id, doc_from::INT AS doc_from, n_places::INT AS n_places, n_equal::INT AS n_equal, n::INT AS item_words, (doc_from + n_places)::INT AS doc_to FROM g JOIN d USING (doc) JOIN i USING (item) WHERE g = 1"""
