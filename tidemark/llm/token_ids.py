"""Token ids in files of directly addressable codes.

Layout of a file, little-endian:

    8 bytes   magic b"TMDAC\\x00\\x01\\n"
    8 bytes   length of the JSON header
    header    {"chunk_bits", "n_tokens", "n_docs", "parts": [[name, dtype, count], ...]}
    parts     one after another, each padded to 8 bytes:
              doc_id int64, doc_null uint8, n_tokens uint32 per document, then for each level
              chunk<k> uint8   the level's chunk of every id that reaches it
              more<k>  uint8   packed bits (bit i in byte i // 8, lowest first): id continues in the next level
              rank<k>  uint32  set bits of more<k> before each run of 512 bits

An id is split into chunks of 8 bits, lowest first. Its place in level k + 1 is the number of set bits before its
place in level k, so any one token is read with a byte and a rank per level, without decoding a block.

Defined cases: a null or empty text has the end id only; a null doc_id comes first; repeated doc_ids stay separate
documents, ordered by text; an empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.common import mapped, scratch_path, written

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC, RUN = b"TMDAC\x00\x01\n", 512
END_ID = 1
#: Ids per file, and words whose ids a worker remembers before it starts anew; neither changes the result.
FILE_IDS, CACHE_WORDS = 4_000_000, 250_000
#: Bytes of text that are worked on at once, and that the encoder takes.
SLICE_BYTES, ENCODED_BYTES = 1 << 20, 2 << 20


def pack(ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """The levels of a run of ids."""
    parts, level, left = [], 0, ids
    while level == 0 or len(left):
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(np.concatenate((bits, np.zeros(-len(bits) % (RUN // 8), np.uint8)))).reshape(-1, RUN // 8).sum(1)
        rank = np.concatenate(([0], np.cumsum(ones)))[: len(left) // RUN + 1].astype(np.uint32)
        parts += [(f"chunk{level}", left.astype(np.uint8)), (f"more{level}", bits), (f"rank{level}", rank)]
        left, level = left[more] >> 8, level + 1
    return parts


class Codes:
    """A file's ids: all at once, or any one by its place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16 : 16 + size])
        self.n_tokens, self.n_docs, at, self.parts = head["n_tokens"], head["n_docs"], 16 + size, {}
        for name, kind, count in head["parts"]:
            at += -at % 8
            self.parts[name] = np.frombuffer(data, kind, count, at)
            at += self.parts[name].nbytes
        self.levels = sum(name.startswith("chunk") for name in self.parts)

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for k in range(self.levels):
            value |= int(self.parts[f"chunk{k}"][place]) << 8 * k
            more = self.parts[f"more{k}"]
            if not more[place >> 3] >> (place & 7) & 1:
                break
            run = place // RUN
            bits = np.unpackbits(more[run * RUN // 8 : place // 8 + 1], bitorder="little")[: place - run * RUN]
            place = int(self.parts[f"rank{k}"][run]) + int(bits.sum())
        return value

    def ids(self) -> np.ndarray:
        out = None
        for k in reversed(range(self.levels)):
            chunk = self.parts[f"chunk{k}"].astype(np.uint32)
            more = np.unpackbits(self.parts[f"more{k}"], count=len(chunk), bitorder="little").view(bool)
            if out is not None:
                chunk[more] |= out << 8
            out = chunk
        return out


def packed(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The file of some documents, in pieces."""
    parts = [("doc_id", np.array([d or 0 for d in doc_ids], "<i8")), ("doc_null", np.array([d is None for d in doc_ids], np.uint8)), ("n_tokens", lengths.astype("<u4")), *pack(ids)]
    head = json.dumps({"chunk_bits": 8, "n_tokens": len(ids), "n_docs": len(doc_ids), "parts": [[n, a.dtype.str, len(a)] for n, a in parts]}).encode()
    out, at = [MAGIC, len(head).to_bytes(8, "little"), head], 16 + len(head)
    for _, a in parts:
        out += [b"\0" * (-at % 8), a.tobytes()]
        at += -at % 8 + a.nbytes
    return out


class Encoder:
    """A tokenizer that remembers the ids of words.

    It is for tokenizers that drop white space and never join what it separates: a text's ids are then its
    words' ids one after another, and a word is given to the tokenizer once. The words' ids lie in one flat array.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        # a special token between words lets one call take many of them
        self.between = next(((i, t.content) for i, t in added if t.special and ids(f"a {t.content} b") == [*ids("a"), i, *ids("b")]), None)
        # whether case, and a full stop or comma at a word's end, can be taken apart before words are looked up
        self.folds = all(ids(w) == ids(w.lower()) for w in ("A", "Word", "QX", "Ab,"))
        apart = lambda p: all(ids(w + p) == ids(w) + ids(p) for w in ("a", "word", "é", "don't", "中"))
        self.parts = all(map(apart, ".,"))
        # and runs of which other signs: those that come apart alone, repeated, and beside each other
        signs = [c for c in PUNCTUATION if apart(c) and apart(c * 2) and apart(c * 3)]
        self.runs = r"(\pL)([" + "".join(f"\\{c}" for c in signs) + r"]+)(\s|$)" if self.parts and all(apart(c + d) for c in signs for d in signs) else None
        self.forget()

    def forget(self) -> None:
        """Word 0 is the end id."""
        self.place: dict[str, int] = {}
        self.flat, self.first = np.array([self.end], np.uint32), np.array([0, 1], np.int64)

    def coded(self, new: list[str]) -> list[list[int]]:
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.between is None:
            return encode(new)
        mark, name = self.between
        out: list = [None] * len(new)
        apart = [k for k, w in enumerate(new) if name[:2] in w]
        plain = [k for k, w in enumerate(new) if name[:2] not in w]
        for k, ids in zip(apart, encode([new[k] for k in apart]), strict=True):
            out[k] = ids
        for lo in range(0, len(plain), 1 << 14):
            some = plain[lo : lo + (1 << 14)]
            packs = [some[k : k + 64] for k in range(0, len(some), 64)]
            for pack, ids in zip(packs, encode([f" {name} ".join([new[k] for k in pack]) for pack in packs]), strict=True):
                at = 0
                for k in pack[:-1]:
                    end = ids.index(mark, at)
                    out[k], at = ids[at:end], end + 1
                out[pack[-1]] = ids[at:]
        return out

    def learn(self, new: list[str]) -> None:
        coded = self.coded(new)
        self.place.update(zip(new, range(len(self.first) - 1, len(self.first) - 1 + len(new)), strict=True))
        count = np.fromiter(map(len, coded), np.int64, len(coded))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(coded), np.uint32, int(count.sum()))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(count)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, an end id after each, and how many each has."""
        texts = pc.fill_null(texts, "")
        special = pc.any(pc.match_substring(texts, "<|")).as_py()  # a special token's name keeps its case and its signs
        if self.folds and not special:
            texts = pc.ascii_lower(texts)
        if self.runs and not special:
            texts = pc.replace_substring_regex(texts, self.runs, r"\1 \2\3")
        elif self.parts:
            texts = pc.replace_substring_regex(texts, r"(\pL)([.,])(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        each = coded.dictionary.to_pylist()
        if len(self.place) > CACHE_WORDS:
            self.forget()
        if new := [w for w in each if w not in self.place]:
            self.learn(new)
        place = np.fromiter(map(self.place.__getitem__, each), np.int64, len(each))
        # the end id is one more word, put after each text's words
        order = np.insert(place[coded.indices.to_numpy()], at[1:], 0)
        n = (self.first[1:] - self.first[:-1])[order]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.first[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        total = ends[at[1:] + np.arange(len(at) - 1)]
        return out, np.diff(np.concatenate(([0], total)))


@cache
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder for each worker process, so that its tasks share the words."""
    return Encoder(path, end_id)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about so many bytes; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row, done = 0, 0
    while row < len(size):
        to = max(row + 1, int(np.searchsorted(size, done + limit, "right")))
        yield row, to
        row, done = to, size[to - 1]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of docs (doc_id, text) into files in ascending doc_id order; the manifest, a row per file in that order.

    The documents are dealt out by range of doc_id, so the part number orders the files. A task names its files anew each time it
    runs, and only the files of tasks that ended well come into the manifest.
    """
    files.make_dir(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, number = encoder_of(tokenizer_path, end_id), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            doc_ids, lengths, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            path = f"{folder}/ids-{uuid.uuid4().hex}.tmdac"
            files.write_bytes(path, *packed(doc_ids, lengths, ids))
            held, number = [], number + 1
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number - 1], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]}, schema)

        part = 0
        for batch in batches:
            part = batch["part"][0].as_py() if len(batch) else part
            texts = batch["text"].cast(pa.string()) if not pa.types.is_string(batch["text"].type) else batch["text"]
            for a, b in slices(texts, ENCODED_BYTES):
                ids, lengths = encoder(texts.slice(a, b - a))
                held.append((batch["doc_id"].slice(a, b - a).to_pylist(), lengths, ids.astype(np.uint16) if len(ids) == 0 or ids.max() < 65536 else ids))
                if sum(len(h[2]) for h in held) >= file_ids:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    # rows that share a doc_id are told apart by their texts, and rows that repeat by their place in the input, so that no key is a task of its own
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_hash", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("doc_id").asc_nulls_first(), "_hash", "_tie"]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    manifest = written(mapped(ordered.withColumn("part", F.spark_partition_id()), encode, "part int, number long, path string, n_docs long, n_ids long"), "manifest")
    before = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = manifest.groupBy("part").agg(F.sum("n_ids").alias("_ids")).select("part", before(Window.orderBy("part"), "_ids").alias("_ahead"))  # a row per task
    return manifest.join(ahead, "part").withColumn("start", F.col("_ahead") + before(Window.partitionBy("part").orderBy("number"), "n_ids")).drop("_ahead")


def read(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: a row per document, (doc_id, start, n_tokens, ids_crc32)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                codes = Codes(files.read_bytes(path))
                ids, ends = codes.ids().astype("<u4"), np.cumsum(codes.parts["n_tokens"].astype(np.int64))
                begins = ends - codes.parts["n_tokens"]
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                doc_id = pa.array(codes.parts["doc_id"], mask=codes.parts["doc_null"].astype(bool))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(begins + start), pa.array(codes.parts["n_tokens"].astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, manifest.sparkSession.sparkContext.defaultParallelism, -(-manifest.count() // 8))
    return mapped(manifest.select("path", "start").repartition(parts), decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    return read(write(docs, folder or scratch_path(docs.sparkSession, "token-ids"), tokenizer_path))
