"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another, and how often over the corpus.

Tokenizer A is byte-level BPE, B a sentencepiece model; both see a text behind one space. Byte offsets where tokens of both end
cut a text into groups; an A and a B token are linked where their bytes overlap. Between any two neighbouring ends of either side lies exactly one
linked pair, so a group of p and q tokens has p + q - 1 links, and all of them are found by merging the ends.

Corpus-wide, pairs are counted by a postings cogroup. Each block of documents gives, for every B id, a posting: the A ids that it is linked with, and the
documents and multiplicities of each pair. Pair counts are added up first, in the blocks and then over them; they become one header for each B id (at most
A's vocabulary long). Headers and postings are dealt by B id and sorted, header first, by Spark's spilling sort; a task reads that stream once, keeps the header of
the B id at hand, takes the largest count there, and emits what each document's links add. Sums by document end it. A B id with many postings is
dealt over several tasks, each with a copy of its header.

Texts are taken apart at single spaces and line feeds between other signs, where neither tokenizer has a token that goes across: A's pattern starts a
piece there, and B has no piece with either sign inside. A worker aligns each such unit once and remembers it. Where a unit's tokens don't give its bytes back (or a
tokenizer isn't of that kind) the text is taken whole.

Defined cases: null and empty texts, and texts that tokens of either side don't give back, have no tokens and zeros; rows that repeat are documents of
their own and count each; ties of the highest count are all best; very long texts are taken whole, their units in runs; an empty table
gives no rows; extra columns stay out; a null doc_id is kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, mapped, written
from tidemark.llm.token_ids import slices

#: Bits of a token id, and of a document's place in its block of BATCH_ROWS at most.
ID_BITS, PLACE_BITS = 17, 11
SPACE_SIGN = "▁"
#: A unit begins with the text, or at one space or line feed between other signs; other white space is inside.
UNIT = re.compile(r"(?:\A\s+|[ \n])\S*(?:(?:\s{2,}|[^\S \n])\S+)*(?:\s+\Z)?")
#: Characters from which a text's units are taken in runs, and so many units a run.
LONG_TEXT, RUN_UNITS = 4 << 20, 100_000
#: Units that a tokenizer gets in one text.
TOGETHER = 64
#: Units and characters that a worker remembers before it starts anew, and bytes of text in a block; neither changes the result.
CACHE_UNITS, CACHE_CHARS, BLOCK_BYTES = 400_000, 16 << 20, 2 << 20
#: Entries of a B id's postings that go to one task, and all entries of a task.
SPLIT_ENTRIES, TASK_ENTRIES = 100_000, 2_000_000
#: Documents' sums that a task holds before it passes them on.
HELD = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers, and the units that this worker has aligned."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte, kind = byte_alphabet(), json.loads(self.a.to_str())
        known = self.a.get_vocab()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(piece)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # ids as text with what stands after them: a comma, or the sign that ends a group's side
        self.signs = [np.array([f"{i}{c}" for i in range(n) for c in (",", last)], object) for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";"))]
        before = kind.get("pre_tokenizer") or {}
        self.cuts = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}|.\n|\n.", p) for p in piece)
        self.forget()

    def forget(self) -> None:
        """Unit 0 is one whose tokens don't give its bytes back."""
        self.place: dict[str, int] = {}
        self.chars = 0
        self.shown = [""]
        self.tallies = np.zeros((1, 4), np.int64)  # A tokens, B tokens, groups, links
        self.links = np.empty(0, np.int64)
        self.first = np.zeros(2, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of texts, one behind the other; each begins with its space or with a line feed."""
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        b = [self.b.encode(t[1:]) if t[0] == " " else self.b.encode(t)[1:] for t in texts]  # B puts a space before what it gets
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
        return flat(e.ids for e in a), flat(b)

    def aligned(self, texts: list[str], cut: np.ndarray):
        """Each part's tallies, groups as text, and links (B id and A id in one number); None if the tokens don't give the texts back or go across a cut.
        cut: the byte offsets at which the parts end, the texts standing one behind the other."""
        a, b = self.ids(texts)
        text = "".join(texts).encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != text or b"".join([self.b_bytes[i] for i in b.tolist()]) != text:
            return None
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(cut, both).all():
            return None
        either = np.union1d(a_end, b_end)
        links = b[np.searchsorted(b_end, either)] << ID_BITS | a[np.searchsorted(a_end, either)]
        until = np.stack([np.searchsorted(x, cut, "right") for x in (a_end, b_end, both, either)], 1)
        # every group shows its A ids, a bar after the last, and its B ids, a semicolon after the last
        last = [np.isin(end, both) for end in (a_end, b_end)]
        shown = [self.signs[k][i] for k, i in enumerate((a * 2 + last[0], b * 2 + last[1]))]
        order = np.argsort(np.concatenate((np.searchsorted(both, a_end) * 2, np.searchsorted(both, b_end) * 2 + 1)), kind="stable")
        sign = np.concatenate(shown)[order].tolist()
        at = [0, *until[:, :2].sum(1).tolist()]
        return np.diff(until, axis=0, prepend=0), ["".join(sign[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], links

    def learn(self, units: list[str]) -> None:
        """Align units and remember them: many at once where they can stand one behind the other."""
        odd = {u for u in units if u[-1].isspace() or u[1].isspace() or SPACE_SIGN in u} if self.cuts else set(units)
        plain, found = [u for u in units if u not in odd], []
        for k in range(0, len(plain), RUN_UNITS):
            some = plain[k : k + RUN_UNITS]
            size = np.fromiter((len(u.encode()) for u in some), np.int64, len(some))
            found.append((some, self.aligned(["".join(some[j : j + TOGETHER]) for j in range(0, len(some), TOGETHER)], np.cumsum(size))))
        for some, got in [*found, *(([u], None) for u in odd)]:
            if got is None:
                found += [([u], self.aligned([u], np.array([len(u.encode())]))) for u in some]
        for some, got in found:
            if got is None and len(some) == 1:
                self.place[some[0]] = 0
        found = [(some, got) for some, got in found if got is not None]
        for some, (_, shown, _) in found:
            self.place.update(zip(some, range(len(self.shown), len(self.shown) + len(some)), strict=True))
            self.chars += sum(map(len, some))
            self.shown += shown
        self.tallies = np.concatenate((self.tallies, *(got[0] for _, got in found)))
        self.links = np.concatenate((self.links, *(got[2] for _, got in found)))
        self.first = np.concatenate(([0], np.cumsum(self.tallies[:, 3])))

    def known(self, units: list[str]) -> np.ndarray:
        """The units' places, those learned that were new."""
        if len(self.place) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.forget()
        if new := list({u for u in units if u not in self.place}):
            self.learn(new)
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def linked(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of units, one unit's behind the other's, and how many each has."""
        size = self.first[unit + 1] - self.first[unit]
        ends = np.cumsum(size)
        return self.links[np.repeat(self.first[unit] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def document(self, text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray] | None:
        """A text's tallies, the digest of its groups, links and how often each stands; its units are taken in runs. None if its tokens don't give it back."""
        text, tallies, digest, parts = " " + text, np.zeros(4, np.int64), sha256(), []
        every = UNIT.finditer(text)
        while self.cuts and (run := [m[0] for m in islice(every, RUN_UNITS)]):
            at = self.known(run)
            if not at.all():
                break
            digest.update((";" if parts else "").encode() + "".join([self.shown[i] for i in at.tolist()])[:-1].encode())
            tallies += self.tallies[at].sum(0)
            unit, n = np.unique(at, return_counts=True)
            links, size = self.linked(unit)
            parts.append((links, np.repeat(n, size)))
        else:
            if parts:
                return tallies, digest.hexdigest(), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        whole = self.aligned([text], np.array([len(text.encode())]))  # a unit that B doesn't give back tells nothing yet of the whole
        return whole and (whole[0][0], sha256(whole[1][0][:-1].encode()).hexdigest(), whole[2], np.ones(len(whole[2]), np.int64))

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Each text's tallies and digest; and the texts' links: the text's place, the link, and how often it stands there, in one or more rows."""
        tallies, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        short = [k for k, t in enumerate(texts) if t and self.cuts and len(t) < LONG_TEXT]
        units = [UNIT.findall(" " + texts[k]) for k in short]
        size = np.fromiter(map(len, units), np.int64, len(units))
        at = self.known(list(chain.from_iterable(units)))
        end = np.cumsum(size)
        whole = np.add.reduceat(at == 0, end - size) == 0 if len(at) else np.zeros(0, bool)
        each = at.tolist()
        for k, a, b, good in zip(short, (end - size).tolist(), end.tolist(), whole.tolist(), strict=True):
            if good:
                tallies[k] = self.tallies[at[a:b]].sum(0)
                digests[k] = sha256("".join([self.shown[i] for i in each[a:b]])[:-1].encode()).hexdigest()
        good = np.repeat(whole, size)
        both, n = np.unique(np.repeat(np.array(short, np.int64), size)[good] * len(self.shown) + at[good], return_counts=True)
        links, count = self.linked(both % len(self.shown))
        out = [(np.repeat(both // len(self.shown), count), links, np.repeat(n, count))]
        for k in sorted({k for k, t in enumerate(texts) if t} - {k for k, w in zip(short, whole.tolist(), strict=True) if w}):
            if got := self.document(texts[k]):
                tallies[k], digests[k] = got[:2]
                out.append((np.full(len(got[2]), k), *got[2:]))
        return tallies, digests, *(np.concatenate([o[j] for o in out]) for j in range(3))


@cache
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, so that its tasks share the units."""
    return Aligner(a_path, b_path)


POSTING = "b int, block long, a array<int>, n array<long>, per binary, doc binary, times binary"


def binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of values, cut at the places at, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def values_of(column: pa.Array, kind: type) -> np.ndarray:
    """All values of a column of binaries, one after another."""
    return np.frombuffer(b"".join(v or b"" for v in column.to_pylist()), kind)


def postings(block: int, place: np.ndarray, key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """The postings of a block: place, key and times are of every pair of every document, in one or more rows."""
    both = key << PLACE_BITS | place
    order = np.argsort(both, kind="stable")
    both, times = both[order], times[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    both, times = both[first], np.add.reduceat(times, first) if len(first) else times
    place, key = both & (1 << PLACE_BITS) - 1, both >> PLACE_BITS
    pair = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])  # where each pair begins
    code = key[pair]
    b = code >> ID_BITS
    own = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])  # where each B id's pairs begin
    pair_at, b_at = np.append(pair, len(key)), np.append(own, len(b))
    lists = lambda v: pa.ListArray.from_arrays(pa.array(b_at.astype(np.int32)), pa.array(v))
    n = np.add.reduceat(times, pair) if len(pair) else times
    return pa.RecordBatch.from_arrays(
        [pa.array(b[own].astype(np.int32)), pa.array(np.full(len(own), block)), lists((code & (1 << ID_BITS) - 1).astype(np.int32)), lists(n), binaries(np.diff(pair_at).astype(np.int32), b_at),
         binaries(place.astype(np.int16), pair_at[b_at]), binaries(times.astype(np.int32), pair_at[b_at])], ["b", "block", "a", "n", "per", "doc", "times"],
    )


def encode(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents (row, doc_id, their tallies and digest) and postings of docs (doc_id, text), the other's columns null."""
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {POSTING}"
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                       ("b", pa.int32()), ("block", pa.int64()), ("a", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("per", pa.binary()), ("doc", pa.binary()), ("times", pa.binary())])
    filled = lambda batch: pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(len(batch), f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = aligner_of(a_path, b_path), TaskContext.get().partitionId() << 28
        for batch in batches:
            for lo in range(0, len(batch), BATCH_ROWS):
                some = batch.slice(lo, BATCH_ROWS)
                for a, b in slices(some["text"], BLOCK_BYTES):
                    tallies, digests, *links = aligner.block(some["text"].slice(a, b - a).to_pylist())
                    rows = {"row": pa.array(np.arange(b - a) | block << PLACE_BITS), "doc_id": some["doc_id"].slice(a, b - a), "groups_sha256": pa.array(digests, pa.string())}
                    rows |= {c: pa.array(np.ascontiguousarray(tallies[:, k])) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                    yield filled(pa.RecordBatch.from_pydict(rows))
                    yield filled(postings(block, *links))
                    block += 1

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def pair_counts(posted: DataFrame) -> DataFrame:
    """(b, a, n): how many links hold each pair of ids linked."""
    return posted.select("b", F.explode(F.arrays_zip("a", "n")).alias("e")).groupBy("b", F.col("e.a").alias("a")).agg(F.sum("e.n").alias("n"))


def contributions(posted: DataFrame, counts: DataFrame, split: int = SPLIT_ENTRIES) -> DataFrame:
    """(row, n_best, count_sum) of every document with links: postings and headers by B id, cogrouped as sorted streams."""
    entries = posted.groupBy("b").agg(F.sum(F.octet_length("doc") / 2).cast("long").alias("entries"))  # a row per B id: no more than its vocabulary
    entries = written(entries.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("entries") / split)).cast("int")), "entries")
    total = entries.agg(F.sum("entries")).first()[0] or 0
    parts = max(posted.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ENTRIES))
    spread = F.broadcast(entries.select("b", "parts"))
    header = counts.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("e")).join(spread, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("e.a").alias("a"), F.col("e.n").alias("n"))
    entry = posted.join(spread, "b").select("b", F.pmod(F.xxhash64("block"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "a", F.lit(None).cast("array<bigint>").alias("n"), "block", "per", "doc", "times")
    streams = header.unionByName(entry, allowMissingColumns=True).repartition(parts, "b", "part").sortWithinPartitions("b", "part", "kind", "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.empty(0, np.int64),) * 3
        known, last, held, size = nothing[:2], np.empty(0, np.int64), [nothing], 0  # known: (B id, A id) in one number and its count, of the headers at hand

        def summed() -> tuple[np.ndarray, ...]:
            row, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            out = [np.zeros(len(row), np.int64) for _ in range(2)]
            for k in (0, 1):
                np.add.at(out[k], back, np.concatenate([h[k + 1] for h in held]))
            return row, *out

        def shown(sums: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            block = sums[0] >> PLACE_BITS
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
            at = np.append(first, len(block))
            packed = [binaries(x, at) for x in ((sums[0] & (1 << PLACE_BITS) - 1).astype(np.int16), *sums[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), *packed], ["block", "doc", "n_best", "count_sum"])

        for batch in batches:
            b, head = batch["b"].to_numpy().astype(np.int64), batch["kind"].to_numpy() == 0
            a_size, a = np.diff(batch["a"].offsets.to_numpy()), batch["a"].flatten().to_numpy().astype(np.int64)
            code = np.repeat(b, a_size) << ID_BITS | a
            of_head = np.repeat(head, a_size)
            if head.any():
                own = batch.filter(pa.array(head))
                known = np.concatenate((known[0], code[of_head])), np.concatenate((known[1], own["n"].flatten().to_numpy()))
                order = np.unique(known[0], return_index=True)[1]  # a header may have a copy for another part
                known = known[0][order], known[1][order]
            if not head.all():
                first = np.flatnonzero(np.append(True, np.diff(known[0] >> ID_BITS) > 0))
                most = np.repeat(np.maximum.reduceat(known[1], first), np.diff(np.append(first, len(known[0]))))
                at = np.searchsorted(known[0], code[~of_head])
                rest = batch.filter(pa.array(~head))
                per = values_of(rest["per"], np.int32)
                at = np.repeat(at, per)
                entry_size = np.fromiter((len(v) // 2 for v in rest["doc"].to_pylist()), np.int64, len(rest))
                row = np.repeat(rest["block"].to_numpy() << PLACE_BITS, entry_size) | values_of(rest["doc"], np.int16)
                times = values_of(rest["times"], np.int32).astype(np.int64)
                count = known[1][at]
                held.append((row, np.where(count == most[at], times, 0), times * count))
                size += len(row)
            last = b[-1:] if len(b) else last
            kept = known[0] >> ID_BITS == last[0] if len(last) else slice(0)  # only the last B id goes on in the next batch
            known = known[0][kept], known[1][kept]
            if size > HELD:
                held = [summed()]
                size = 0
                if len(held[0][0]) > HELD:
                    yield from shown(held[0])
                    held = [nothing]
        yield from shown(summed())

    def total(group: pa.Table) -> pa.Table:
        """A block's sums, of a part per task: its documents are BATCH_ROWS at most."""
        doc, out = values_of(group["doc"], np.int16), []
        each, back = np.unique(doc, return_inverse=True)
        for c in ("n_best", "count_sum"):
            out.append(np.zeros(len(each), np.int64))
            np.add.at(out[-1], back, values_of(group[c], np.int64))
        return pa.table({"row": group["block"].to_numpy()[:1] << PLACE_BITS | each, "n_best": out[0], "count_sum": out[1]})

    sums = mapped(streams, meet, "block long, doc binary, n_best binary, count_sum binary")
    return sums.groupBy("block").applyInArrow(total, "row long, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, split: int = SPLIT_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Per document of docs (doc_id, text) its tokens, groups, links, best links and sum of counts; and the pair counts (b, a, n)."""
    coded = written(encode(docs, a_path, b_path), "alignments")
    posted = coded.where("row is null").select("b", "block", "a", "n", "per", "doc", "times")
    counts = written(pair_counts(posted), "pair-counts")
    sums = contributions(posted, counts, split)
    rows = coded.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), counts
