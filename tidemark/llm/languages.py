"""Language identification by character language models.

A text is the run of its letters and marks in lower case, one space in place of whatever stands between, and ORDER - 1 spaces before its first letter. For
each language an interpolated Kneser-Ney model of order ``ORDER`` is estimated from all texts to learn from: the highest order from
counts, lower orders from the number of distinct left neighbours, the lowest mixed with a uniform share for symbols never seen. A text's language is
the one whose model gives it the lowest cross-entropy, in nats a symbol.

The models are joins and sums over (language, n-gram) rows, and grow with the texts. Scoring keeps them as sorted hash arrays, per language one for the n-grams
and one for the histories of each order: a block's distinct n-grams are looked up once by binary search in each. Models of at most ``MODEL_ENTRIES`` entries
together go to every worker; larger ones stay a written table, which the distinct n-grams of each block of texts are joined with, and
the block gets arrays of what it needs. Both ways give the same scores.

The score is the posterior of the chosen language, softmax(-b n^a entropy), n being the text's symbols; a and b are those of a grid that make the
languages of a part likeliest which the calibrated models did not count. Rejection is calibrated on that part too: ``accepted`` is false for scores
below the least at which ``PRECISION`` of its texts are right, and for entropies above all but ``TAIL`` of its right texts of that language; such texts may be
in none of the languages. All sums go over all rows; the final models count every part.

Defined cases: null texts and texts without a letter have the language ``und``, score 0, and are not accepted; so have all where no language is known; a
language of one text has a model of its own; equal entropies give the language that is first in order; rows that repeat count each; rows with a null lang or
doc_id are not learned from; very long texts are taken whole, one at a time; letters beyond the basic plane share 2048 codes; an empty table gives no rows; extra
columns stay out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, small, written
from tidemark.llm.textvec import mixed
from tidemark.llm.token_ids import slices

ORDER, BITS, DISCOUNT = 4, 16, 0.75
UNKNOWN = "und"
#: Marks a history's kind; an n-gram's kind is its order.
HISTORY = 8
#: Entries of models that go to every worker: 12 bytes each.
MODEL_ENTRIES = 1 << 23
#: Bytes of text that a worker takes apart at once, and of a block whose n-grams are joined with larger models.
PIECE_BYTES, BLOCK_BYTES = 1 << 19, 1 << 20
#: Counted n-grams that a worker holds before it adds equal ones up.
HELD = 500_000
#: The grid of exponents and slopes of the score.
EXPONENTS, SLOPES = (0.0, 0.5, 1.0), tuple(0.25 * 1.5**k for k in range(20))
PRECISION, TAIL, STEPS = 0.99, 0.001, 200


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: whether it is part of a word, and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(1 << 16)]
    return np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])


def _beyond(points: np.ndarray) -> np.ndarray:
    """Which code points beyond the basic plane are letters."""
    each, back = np.unique(points, return_inverse=True)
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in each.tolist()], bool)[back]


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, ORDER - 1 spaces before each; where each text begins; and whether it has a letter."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    size = pc.utf8_length(low).to_numpy().astype(np.int64) + ORDER - 1
    points = np.frombuffer("".join(" " * (ORDER - 1) + t for t in low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    word, letter = _classes()
    base = points < 1 << 16
    within, letters = base & word[np.minimum(points, 0xFFFF)], base & letter[np.minimum(points, 0xFFFF)]
    if not base.all():
        far = np.flatnonzero(~base)
        within[far] = letters[far] = _beyond(points[far])
    coded = np.where(base, points, 0xD800 + (points * np.uint32(2654435761) >> np.uint32(21)))
    coded = np.where(within, coded, 32).astype(np.int64)
    kept = np.append(True, within[1:] | within[:-1])[: len(points)]  # of neighbouring spaces the first stays
    start = np.concatenate(([0], np.cumsum(size)))
    kept[(start[:-1, None] + np.arange(ORDER - 1)).ravel()] = True
    has = np.diff(np.concatenate(([0], np.cumsum(letters)))[start]) > 0
    return coded[kept], np.concatenate(([0], np.cumsum(kept)))[start], has


def grams(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each of the texts' own symbols, the last symbol lowest, and where each text's begin."""
    out = np.zeros(max(0, len(values) - ORDER + 1), np.int64)
    for k in range(ORDER):
        out = out << BITS | values[k : k + len(out)]
    place = np.arange(ORDER - 1, len(values))
    own = place - np.repeat(at[:-1], np.diff(at))[ORDER - 1 :] >= ORDER - 1
    return out[own], at - (ORDER - 1) * np.arange(len(at))


def counts(labelled: DataFrame) -> DataFrame:
    """(lang, g, n0, n1): counts of each language's n-grams by part. labelled: (text, lang as a number, part)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        held: dict[int, list] = {}
        size = base = 0

        def summed(some: list) -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([s[0] for s in some]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([s[1] for s in some]), len(key)).astype(np.int64)

        for batch in batches:
            group = batch["lang"].to_numpy().astype(np.int64) * 2 + batch["part"].to_numpy()
            for a, b in slices(batch["text"], PIECE_BYTES):
                gram, at = grams(*symbols(batch["text"].slice(a, b - a))[:2])
                own = np.repeat(group[a:b], np.diff(at))
                for one in np.unique(own).tolist():
                    held.setdefault(one, []).append(np.unique(gram[own == one], return_counts=True))
                    size += len(held[one][-1][0])
                if size > base + HELD:
                    held = {one: [summed(some)] for one, some in held.items()}
                    size = base = sum(len(s[0][0]) for s in held.values())
        for one, some in held.items():
            key, n = summed(some or [(empty, empty)])
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), one // 2, np.int32)), pa.array(np.full(len(part), one % 2, np.int32)), pa.array(part), pa.array(n[k : k + 100_000])], ["lang", "part", "g", "n"])

    rows = mapped(labelled, count, "lang int, part int, g long, n long")
    return rows.groupBy("lang", "g").agg(*[F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])


def _tail(k: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))


def weights(seen: DataFrame, n: Column) -> DataFrame:
    """(lang, kind, key, value): each n-gram's log probability, each history's log backoff weight, and, of kind 0, what an unseen symbol gets."""
    level = {ORDER: written(seen.select("lang", "g", n.alias("n")).where("n > 0"), "order")}
    for k in range(ORDER - 1, 0, -1):
        level[k] = written(level[k + 1].groupBy("lang", _tail(k).alias("g")).agg(F.count("*").alias("n")), "order")
    share = DISCOUNT * F.col("t") / F.col("s")
    sums = written(level[1].groupBy("lang").agg(F.sum("n").alias("s"), F.count("*").alias("t")), "histories")
    unseen = share / float(1 << BITS)
    lower = level[1].join(small(sums), "lang").select("lang", "g", ((F.col("n") - DISCOUNT) / F.col("s") + unseen).alias("p"))
    out = sums.select("lang", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.log(unseen).alias("value"))
    for k in range(1, ORDER + 1):
        if k > 1:
            ahead = F.shiftrightunsigned("g", BITS).alias("h")
            sums = written(level[k].groupBy("lang", ahead).agg(F.sum("n").alias("s"), F.count("*").alias("t")), "histories")
            found = level[k].withColumn("h", ahead).withColumn("low", _tail(k - 1)).join(sums, ["lang", "h"]).join(lower.select("lang", F.col("g").alias("low"), F.col("p").alias("q")), ["lang", "low"])
            lower = written(found.select("lang", "g", ((F.col("n") - DISCOUNT) / F.col("s") + share * F.col("q")).alias("p")), "model")
            out = out.union(sums.select("lang", F.lit(HISTORY + k), "h", F.log(share)))
        out = out.union(lower.select("lang", F.lit(k), "g", F.log("p")))
    return written(out.select("lang", "kind", "key", F.col("value").cast("float").alias("value")), "models")


def arranged(rows: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Models as sorted hash arrays: by language and kind the hashes in order, and their values. The hash is a bijection, so equal hashes are equal keys."""
    lang, kind = rows["lang"].to_numpy().astype(np.int64), rows["kind"].to_numpy().astype(np.int64)
    hashes, value, group = mixed(rows["key"].to_numpy()), rows["value"].to_numpy(), lang << 8 | kind
    order = np.lexsort((hashes, group))
    hashes, value, group = hashes[order], value[order], group[order]
    each, first = np.unique(group, return_index=True)
    end = np.append(first, len(group))[1:]
    return {(int(g) >> 8, int(g) & 255): (hashes[a:b], value[a:b]) for g, a, b in zip(each, first, end, strict=True)}


def looked_up(table: tuple[np.ndarray, np.ndarray] | None, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's value, 0 where the array has none, and whether it has."""
    if table is None:
        return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
    found = table[0][at] == hashes
    return np.where(found, table[1][at], 0.0), found


def log_probabilities(gram: np.ndarray, models: dict, langs: list[int]) -> np.ndarray:
    """Each n-gram's log probability in each language, a column per language."""
    key = {k: gram & (1 << BITS * k) - 1 for k in range(1, ORDER)} | {ORDER: gram}
    own = {k: mixed(v) for k, v in key.items()}
    history = {k: mixed(v >> BITS & (1 << BITS * (k - 1)) - 1) for k, v in key.items() if k > 1}
    out = np.zeros((len(gram), len(langs)))
    for column, lang in enumerate(langs):
        left = np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            value, found = looked_up(models.get((lang, k)), own[k][left])
            out[left, column] += value
            left = left[~found]
            if k > 1:
                out[left, column] += looked_up(models.get((lang, HISTORY + k)), history[k][left])[0]
        if len(left):
            out[left, column] += models[lang, 0][1][0]
    return out


def needed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every (kind, key) that scoring the texts may look up, once."""
    gram, kinds, keys = np.unique(grams(*symbols(texts)[:2])[0]), [], []
    for k in range(ORDER, 0, -1):
        gram = gram if k == ORDER else np.unique(gram & (1 << BITS * k) - 1)
        for kind, key in ((k, gram), (HISTORY + k, np.unique(gram >> BITS & (1 << BITS * (k - 1)) - 1)))[: 1 + (k > 1)]:
            kinds.append(np.full(len(key), kind, np.int32))
            keys.append(key)
    return np.concatenate(kinds), np.concatenate(keys)


class Models:
    """What weights() made of the languages by these names: for every worker as arrays up to MODEL_ENTRIES, beyond them as rows.

    Languages whose texts gave no symbol are left out; ``places`` has the others' places, a row per language.
    """

    def __init__(self, rows: DataFrame, names: list[str]):
        have = sorted(r[0] for r in rows.where("kind = 0").select("lang").collect())
        self.langs = [names[k] for k in have]
        self.places = F.broadcast(rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(have)], "lang int, place int"))
        self.rows = rows if len(have) == len(names) else written(rows.join(self.places, "lang").select(F.col("place").alias("lang"), "kind", "key", "value"), "models")
        self.shared = rows.sparkSession.sparkContext.broadcast(arranged(self.rows.toArrow())) if rows.count() <= MODEL_ENTRIES else None


def measured(docs: DataFrame, models: Models, *keep: Column) -> DataFrame:
    """docs' kept columns, with n, a text's symbols (null without a letter), and its entropy in every language."""
    langs, names = list(range(len(models.langs))), [f"_{k}" for k in range(len(keep))]
    rows = docs.select(*[c.alias(n) for n, c in zip(names, keep, strict=True)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names) + "n long, entropy array<double>"

    def of(batch: pa.RecordBatch, table: dict) -> Iterator[pa.RecordBatch]:
        for a, b in slices(batch["text"], PIECE_BYTES):
            values, at, has = symbols(batch["text"].slice(a, b - a))
            gram, at = grams(values, at)
            each, back = np.unique(gram, return_inverse=True)
            size = np.diff(at)
            total = np.zeros((b - a, len(langs)))
            some = np.flatnonzero(size)
            if len(some):
                known = log_probabilities(each, table, langs)
                for column in range(len(langs)):  # one language at a time, so that what a piece takes doesn't grow with them
                    total[some, column] = np.add.reduceat(known[back, column], at[:-1][some])
            entropy = -total / np.maximum(size, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array((np.arange(b - a + 1) * len(langs)).astype(np.int32)), pa.array(entropy.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in names), pa.array(size, mask=~has), lists], [*names, "n", "entropy"])

    if models.shared is None:
        return _met(rows, models, of, kind)
    shared = models.shared

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from of(batch, shared.value)

    return mapped(rows, measure, kind)


def _met(rows: DataFrame, models: Models, of, kind: str) -> DataFrame:
    """of() in blocks, each with the part of the models that its texts need."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(batch["text"], BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(np.full(b - a, block))], [*batch.schema.names, "_block"])
                block += 1

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a block may lie in several batches: a key that comes twice does no harm
            block = batch["_block"].to_numpy()
            for one in np.unique(block):
                own = batch["text"].filter(pa.array(block == one))
                for a, b in slices(own, PIECE_BYTES):
                    kinds, keys = needed(own.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), one)), pa.array(kinds), pa.array(keys)], ["_block", "kind", "key"])

    unseen = models.rows.where("kind = 0").toArrow()  # a row per language

    def measure(texts: pa.Table, found: pa.Table) -> pa.Table:
        table = arranged(pa.concat_tables([unseen, found.select(unseen.schema.names).cast(unseen.schema)]))
        return pa.Table.from_batches([piece for batch in texts.to_batches() for piece in of(batch, table)])

    given = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    dealt = written(mapped(rows, deal, f"{given}, _block long"), "blocks")
    met = mapped(dealt.select("_block", "text"), want, "_block long, kind int, key long").distinct().join(models.rows, ["kind", "key"]).select("_block", "lang", "kind", "key", "value")
    return dealt.groupBy("_block").cogroup(met.groupBy("_block")).applyInArrow(measure, kind)


def best() -> Column:
    return F.array_min("entropy")


def chosen() -> Column:
    """The place, from 0, of the lowest entropy."""
    return F.array_position("entropy", best()).cast("int") - 1


def posterior(exponent: float, slope: float) -> Column:
    scale = F.lit(float(slope)) * F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    return 1 / F.aggregate("entropy", F.lit(0.0), lambda z, e: z + F.exp(-F.least(scale * (e - best()), F.lit(700.0))))


def calibrated(placed: DataFrame) -> dict:
    """How scores and rejection follow from entropies. placed: measured() rows with ``lang``, the place of their language."""
    rows = placed.where("n is not null").withColumn("right", chosen() == F.col("lang")).withColumn("excess", F.get("entropy", F.col("lang")) - best())
    grid = [(a, b) for a in EXPONENTS for b in SLOPES]
    score = lambda a, b: F.sum(F.log(posterior(a, b)) - b * F.pow(F.col("n").cast("double"), F.lit(a)) * F.col("excess"))
    likely = rows.agg(*[score(a, b).alias(f"g{k}") for k, (a, b) in enumerate(grid)]).first()
    exponent, slope = max(zip(likely, grid, strict=True), key=lambda x: x[0])[1] if likely[0] is not None else (1.0, 1.0)
    per = rows.groupBy(F.floor(posterior(exponent, slope) * STEPS).alias("step")).agg(F.count("*").alias("all"), F.count_if("right").alias("right")).collect()
    threshold, every, right = 1.0, 0, 0
    for r in sorted(per, key=lambda r: -r["step"]):
        every, right = every + r["all"], right + r["right"]
        if right >= PRECISION * every:
            threshold = min(r["step"] / STEPS, 1.0)
    limits = {r["lang"]: r["limit"] for r in rows.where("right").groupBy("lang").agg(F.percentile_approx(best(), 1 - TAIL, 10_000).alias("limit")).collect()}  # a row per language
    return {"exponent": exponent, "slope": slope, "threshold": threshold, "limits": limits}


def fit(docs: DataFrame, part: Column) -> tuple[Models, dict] | None:
    """Models and calibration from docs (text, lang); part: 0 is counted for the models that are calibrated, 1 calibrates, both are counted in the end; null: neither."""
    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("_lang"), F.coalesce("text", F.lit("")).alias("text"), part.cast("int").alias("part")).where("part is not null")
    names = sorted(r[0] for r in rows.select("_lang").distinct().collect())  # a row per language
    if not names:
        return None
    coded = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(names)), "lang int, _lang string"))
    rows = rows.join(coded, "_lang").select("text", "lang", "part")
    seen = written(counts(rows), "n-grams")
    half, shift = Models(weights(seen, F.col("n0")), names), {"exponent": 1.0, "slope": 1.0, "threshold": 0.0, "limits": {}}
    if half.langs:
        placed = measured(rows.where("part = 1").join(half.places, "lang"), half, F.col("place")).withColumnRenamed("_0", "lang")
        shift = calibrated(written(placed, "placed"))
        shift["limits"] = {half.langs[k]: limit for k, limit in shift["limits"].items()}
    full = Models(weights(seen, F.col("n0") + F.col("n1")), names)
    return (full, shift) if full.langs else None


def identify(docs: DataFrame, model: tuple[Models, dict] | None, *keep: Column) -> DataFrame:
    """docs' kept columns (as _0 and so on), lang_pred, score, accepted and the entropy of every document."""
    if model is None:
        return docs.select(*[c.alias(f"_{k}") for k, c in enumerate(keep)], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("entropy"))
    models, shift = model
    some = F.col("n").isNotNull()
    lang = F.get(F.array(*map(F.lit, models.langs)), chosen())
    limit = F.get(F.array(*[F.lit(float(shift["limits"].get(name, np.inf))) for name in models.langs]), chosen())
    score = posterior(shift["exponent"], shift["slope"])
    rows = measured(docs, models, *keep)
    return rows.select(
        *[f"_{k}" for k in range(len(keep))], F.when(some, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"),
        F.coalesce(some & (score >= shift["threshold"]) & (best() <= limit), F.lit(False)).alias("accepted"), F.when(some, best()).alias("entropy"))


def judge(docs: DataFrame, divisor: int = 4, held_out: int = 2, calibrates: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted and entropy of every document of docs (doc_id, text, lang)."""
    left = F.crc32(F.col("doc_id").cast("string")) % divisor
    model = fit(docs, F.when(left != held_out, left == calibrates))
    held = F.coalesce(left == held_out, F.lit(False))
    return identify(docs, model, F.col("doc_id"), held).withColumnsRenamed({"_0": "doc_id", "_1": "held_out"})
