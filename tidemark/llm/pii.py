"""Personal data: fixed forms, and identifiers that bootstrapped contexts discover.

Four kinds have a form of their own: e-mail addresses, IP addresses, card numbers and phone numbers. They are the seeds, and so are
long runs of letters and digits (``SECRET``), as keys and tokens have; these count as an identifier, of the kind secret, only if a context confirms them. The one or
two words before a seed and the one or two behind it are lexical patterns; so are the words about any other token that could be an identifier (it has at least
``LEAST_DIGITS`` digits or an @). Patterns and instances make a graph that Spark scores in rounds, until one finds nothing new: a pattern's confidence for a kind is
the share of all its occurrences in the corpus that known instances of that kind stand at, if at least ``LEAST_INSTANCES`` different ones do; an instance's is
1 - prod(1 - confidence) over its accepted patterns; instances that reach ``LEAST_INSTANCE`` become known, with the kind of
their most confident pattern, and the next round's patterns count them, also patterns that no seed of a fixed form stands at. Spans of discovered instances are added; spans of
the fixed forms stay as they are. A context that ordinary words share is never confident, however often it stands at a seed.

Occurrences of patterns are counted in one pass over all texts, for every pattern that ``LEAST_INSTANCES`` instances stand at: workers pass a pattern's
count in a block on if a bitmap of ``2 ** MASK_BITS`` places may hold it, and a join with the patterns themselves keeps the right ones.

Defined cases: null and empty texts have no spans; rows that repeat are each reported; of kinds that tie the last by name holds; an empty table gives no rows;
very long texts are scanned whole, one at a time; a very long token costs time in proportion to its length, and is known by a hash beyond ``LONG_INSTANCE`` characters; extra columns stay out. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, small, written
from tidemark.llm.textvec import mixed, word_hashes
from tidemark.llm.token_ids import slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only a context confirms; their spans come after the others.
SOFT = "secret"
#: Fixed forms. A domain is tried at each @; the others begin where no digit stands before, which leaves their matches as they are and their time linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(r"[^\W_]+|[=:#]")
CANDIDATE = re.compile(r"[^\s=:;,\"'<>()\[\]{}]+(?:\x20[0-9][^\s=:;,\"'<>()\[\]{}]*)*")
SECRET = re.compile(r"(?=(?:[A-Za-z]*[0-9]){4})(?=(?:[0-9]*[A-Za-z]){4})[A-Za-z0-9]{16,}")
#: Characters about an identifier that are looked at first for its two words; more are if those are not whole.
LEAST_DIGITS, LEAST_LENGTH, REACH, LONG_INSTANCE = 4, 6, 80, 64
LEAST_INSTANCES, LEAST_PATTERN, LEAST_INSTANCE = 3, 0.5, 0.8
#: Places of the bitmap of patterns: 16 MB, whatever the corpus. With more patterns than places more counts are passed on in vain, and none is lost.
MASK_BITS = 27
#: Counts that a worker holds before it adds equal ones up.
HELD = 500_000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: the local part is the whole run before an @, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1  # no address can hold this @, nor what stands before it
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed forms, by kind and then start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that could be identifiers and overlap none of the spans taken."""
    out, spans, k = [], sorted((a, b) for _, a, b in taken), 0
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < LEAST_LENGTH or not re.search(r"[0-9@]", m[0]):
            continue
        piece = m[0].rstrip(".!?")
        start, end = m.start() + len(piece) - len(piece.lstrip(".!?*#$%&|-")), m.start() + len(piece)
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if any(a < end and start < b for a, b in spans[max(0, k - 1) : k + 2]):
            continue
        if LEAST_LENGTH <= end - start and (sum(c.isdigit() for c in text[start:end]) >= LEAST_DIGITS or "@" in text[start:end]):
            out.append((start, end))
    return out


def context_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words as patterns see them: lower case, letters and digits, with = : # as words of their own."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN=:#]+", " ")
    return word_hashes(pc.replace_substring_regex(clean, r"([=:#])", r" \1 "))


def pattern_keys(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word the keys of four patterns: it alone, and it after the word before, with an identifier behind; it alone, and it before the next word, with an identifier before."""
    before, after = np.concatenate(([0], words[:-1])).astype(np.uint64), np.concatenate((words[1:], [0])).astype(np.uint64)
    return tuple(k.view(np.int64) for k in (mixed(words), mixed(mixed(before) * np.uint64(3) + words), mixed(words ^ np.uint64(0x5EED)), mixed(mixed(words) * np.uint64(5) + after)))


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and behind a span, as far as two words each need."""
    reach = REACH
    while reach < max(start, len(text) - end):
        left, right = text[max(0, start - reach) : start], text[end : end + reach]
        if (len(left) == start or len(WORDS.findall(left)) > 2) and (len(right) == len(text) - end or len(WORDS.findall(right)) > 2):
            return left, right
        reach *= 4
    return text[max(0, start - reach) : start], text[end : end + reach]


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: its base spans, and every seed and candidate with the patterns before it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        seen = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.int64()))])
        for batch in batches:
            for a, b in slices(batch["text"]):
                texts = batch["text"].slice(a, b - a)
                maybe = pc.match_substring_regex(pc.fill_null(texts, ""), r"[0-9@]").to_numpy(zero_copy_only=False)
                spans: list = [[] for _ in range(b - a)]
                found: list = [[] for _ in range(b - a)]
                for row in np.flatnonzero(maybe):
                    text = texts[int(row)].as_py()
                    spans[row] = base_spans(text)
                    for kind, s, e in [*spans[row], *((None, *c) for c in candidates(text, spans[row]))]:
                        instance, (left, right) = re.sub(r"\s", " ", text[s:e]).lower(), around(text, s, e)
                        if len(instance) > LONG_INSTANCE:
                            instance = sha256(instance.encode()).hexdigest() + f":{len(instance)}"
                        found[row].append({"kind": kind or (SOFT if SECRET.fullmatch(text, s, e) else None), "start": s, "end": e, "instance": instance, "left": left, "right": right})
                flat = [f for fs in found for f in fs]
                if flat:
                    for side in ("left", "right"):
                        words, at = context_words(pa.array([f.pop(side) for f in flat], pa.string()))
                        keys = pattern_keys(words)[0 if side == "left" else 2 :]
                        for f, s, e in zip(flat, at[:-1].tolist(), at[1:].tolist(), strict=True):
                            near = e - 1 if side == "left" else s
                            f["patterns"] = [*f.get("patterns", ()), *(int(k[near]) for k in keys[: min(2, e - s)])]
                joined = [",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in spans]
                counts = [pa.array([sum(k == kind for k, _, _ in x) for x in spans], pa.int64()) for kind in KINDS]
                base = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *counts, pa.array([sha256(j.encode()).hexdigest() for j in joined]), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(seen))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "kind string, start int, end int"
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return mapped(docs.select("doc_id", "text"), find, f"doc_id {kind}, {counts}, base_sha256 string, base array<struct<{span}>>, found array<struct<{span}, instance string, patterns array<long>>>")


def bitmap(patterns: DataFrame) -> np.ndarray:
    """The places of patterns as bits, lowest first; 2^MASK_BITS of them."""
    place = F.col("pattern").bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    rows = patterns.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((max(1, 1 << MASK_BITS - 15), 1 << 12), np.uint8)
    for r in rows.toArrow().to_pylist():  # 2^(MASK_BITS - 15) rows of 4 KB at most
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern occurs beside a word in all texts."""
    wanted = written(patterns.select("pattern"), "patterns")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, held, size = shared.value, [(np.empty(0, np.int64), np.empty(0, np.int64))], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

        for batch in batches:
            for a, b in slices(batch["text"]):
                words, at = context_words(batch["text"].slice(a, b - a))
                if not len(words):
                    continue
                last = at[1:][np.diff(at) > 0] - 1
                first = at[:-1][np.diff(at) > 0]
                for n, key in enumerate(pattern_keys(words)):
                    place = key & (1 << MASK_BITS) - 1
                    fits = (mask[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                    if n != 2:  # nothing stands behind a text's last word, nor is there a next word
                        fits[last] = False
                    if n:
                        fits[first] = False
                    held.append(np.unique(key[fits], return_counts=True))
                    size += len(held[-1][0])
                if size > HELD + len(held[0][0]):
                    held, size = [summed()], 0
        key, n = summed()
        for k in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["pattern", "n"])

    got = mapped(docs.select("text"), count, "pattern long, n long")
    return got.groupBy("pattern").agg(F.sum("n").alias("total")).join(wanted, "pattern", "left_semi")


def discovered(docs: DataFrame, scanned: DataFrame) -> DataFrame | None:
    """(instance, kind) of the instances that confident patterns discover; None where no pattern could."""
    seen = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.instance", F.explode("f.patterns").alias("pattern"))
    open_ = F.col("kind").isNull() | (F.col("kind") == SOFT)
    edges = written(seen.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")), "pattern-edges")
    often = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {LEAST_INSTANCES}").select("pattern"), "candidate-patterns")
    if not often.limit(1).count() or not edges.where(open_).limit(1).count():
        return None
    totals = written(occurrences(docs, often), "pattern-totals")
    graph = written(edges.join(totals, "pattern"), "pattern-graph")
    known = None
    while True:  # every round but the last finds an instance
        now, left = graph, graph.where(open_)
        if known is not None:
            now = graph.join(known.withColumnRenamed("kind", "_kind"), "instance", "left").withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind")
            left = left.join(known, "instance", "left_anti")
        by_kind = now.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("instances"), F.sum("n").alias("hits"), F.max("total").alias("total"))
        accepted = by_kind.withColumn("confidence", F.least("hits", "total") / F.col("total")).where(f"instances >= {LEAST_INSTANCES} and confidence >= {LEAST_PATTERN}")
        accepted = accepted.groupBy("pattern").agg(F.max_by(F.struct("confidence", "kind"), F.struct("confidence", "kind")).alias("best")).select("pattern", "best.confidence", F.col("best.kind").alias("pattern_kind"))
        miss = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9))))
        new = left.join(accepted, "pattern").groupBy("instance").agg((1 - F.exp(miss)).alias("score"), F.max_by("pattern_kind", F.struct("confidence", "pattern_kind")).alias("kind")).where(f"score >= {LEAST_INSTANCE}").select("instance", "kind")
        new = written(new, "instances")
        if not new.limit(1).count():
            return known
        known = new if known is None else written(known.union(new), "instances")


def extract(docs: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, text): the counts and digest of the fixed forms, and all spans."""
    scanned = written(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    known = discovered(docs, scanned)
    order = F.array(*map(F.lit, (*KINDS, SOFT)))
    spans = F.col("base")
    rows = scanned
    if known is not None:
        unknown = scanned.select("row", F.explode("found").alias("f")).where(F.col("f.kind").isNull() | (F.col("f.kind") == SOFT)).select("row", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.instance").alias("instance"))
        more = unknown.join(small(known), "instance").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
        rows = scanned.join(more, "row", "left")
        spans = F.concat(spans, F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    sorted_spans = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", text.alias("spans"))
