"""WARC archives as a Spark data source, read and written by Python tasks.

``spark.read.format("warc").schema(...).load(folder)`` plans one partition per archive file. Filters on the record type
and on header fields are pushed into the scan; a record's WARC header is parsed first, and the payload of a record that
the filters reject, or whose payload no column of the schema asks for, is stepped over without inflating it where the archive says
how long it is (a "sl" field in the member's gzip header, which the writer puts there), else inflated and dropped.

``df.write.format("warc").mode("append").save(folder)`` writes a gzip member per record. A task names its files anew each
time it runs, and a commit lists the files of the tasks that ended well in a manifest; readers go by manifests, so files of
lost or repeated tasks are never read. A folder without any manifest is read file by file (*.warc, *.warc.gz).

Columns, each nullable: record_id, record_type, target_uri, date, refers_to, payload_digest, content_type string,
http_status int, payload_length long, payload binary. payload_length is the HTTP Content-Length where the record has
HTTP headers (so a revisit tells the length of the payload it refers to), else the length of the block.

Archives are read in pieces of 64 KB, whatever their size; a payload that a column asks for is held whole, as are the rows of a batch of some 4 MB.

Defined cases: a null payload is written as an empty one; blanks, control characters and line separators in a header's value are
percent-encoded; of a header that repeats the first holds; a record without a readable length has an empty block; an empty table gives no
archive and reads as no rows; payloads and urls of any length are kept whole; pages that repeat are written each; extra columns stay out.
Reading and writing turn on spark.sql.python.filterPushdown.enabled for the session.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from tidemark.llm import files
from tidemark.llm.common import scratch_path

#: Fixed names of the WARC 1.1 format.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, http_status int, payload_length long, payload binary"
FILE_BYTES, LEVEL, BATCH_BYTES, PIECE = 32 << 20, 3, 4 << 20, 1 << 16


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with its own length and the record's in its extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def member_sizes(head: bytes) -> tuple[int, int] | None:
    """The length of the gzip member that begins there and of what it holds, if its extra field tells them."""
    if len(head) > 12 and head[3] & 4:
        end, k = 12 + int.from_bytes(head[10:12], "little"), 12
        while k + 4 <= end:
            size = int.from_bytes(head[k + 2 : k + 4], "little")
            if head[k : k + 2] == b"sl" and size == 8:
                return int.from_bytes(head[k + 4 : k + 8], "little"), int.from_bytes(head[k + 8 : k + 12], "little")
            k += 4 + size
    return None


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name, the first of a name that repeats. Only LF, with or without CR, ends a line; continued lines are joined."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon and name.strip():
            out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip(b" \t\r").decode("utf-8", "replace"))
    return out


def length_of(head: dict[str, str]) -> int | None:
    told = head.get("content-length", "")
    return int(told) if told.isascii() and told.isdigit() else None


#: Blanks, controls and whatever else some reader may take for the end of a line.
UNSAFE = re.compile("[\x00-\x20\x7f-\x9f\u2028\u2029]")


def safe(value: str | None) -> str | None:
    """A header's value with UNSAFE characters percent-encoded as UTF-8."""
    return value and UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record_bytes(row: dict) -> bytes:
    payload = row.get("payload") or b""
    length = row.get("payload_length")
    http = f"HTTP/1.1 {row.get('http_status') or 200} OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http + (b"" if row["record_type"] == "revisit" else payload)
    told = {c: safe(row.get(c)) for c in HEADERS}
    head = [("WARC-Type", told["record_type"]), ("WARC-Record-ID", f"<{told['record_id']}>"), ("WARC-Date", told["date"] or "1970-01-01T00:00:00Z"), ("WARC-Target-URI", told["target_uri"]), ("WARC-Payload-Digest", told["payload_digest"] and f"sha256:{told['payload_digest']}")]
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", told["refers_to"] and f"<{told['refers_to']}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v).encode() + b"\r\n" + block + b"\r\n\r\n"


class Wanted:
    """The pushed filters, put to a record's header fields."""

    def __init__(self, filters: list[Filter] = ()):
        self.filters = list(filters)

    @staticmethod
    def takes(f: Filter) -> bool:
        return isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS

    def __call__(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            ok = v is None if isinstance(f, IsNull) else v is not None and (isinstance(f, IsNotNull) or (v == f.value if isinstance(f, EqualTo) else v in f.value if isinstance(f, In) else v.startswith(f.value)))
            if not ok:
                return False
        return True


def named(head: dict[str, str]) -> dict:
    row = {c: head.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c] and row[c].strip("<>")
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha256:")
    return row


class Raw:
    """A file's bytes from a place on; what is stepped over is not read, but for what a piece holds of it."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held, self.base = file, size, 0, b"", 0

    def __call__(self, n: int) -> bytes:
        off = self.at - self.base
        if not 0 <= off <= len(self.held) - min(n, self.size - self.at):
            self.file.seek(self.at)
            self.held, self.base, off = self.file.read(max(n, 4 * PIECE)), self.at, 0
        piece = self.held[off : off + n]
        self.at += len(piece)
        return piece

    def peek(self, n: int) -> bytes:
        at, piece = self.at, self(n)
        self.at = at
        return piece

    def skip(self, n: int) -> None:
        self.at = min(self.size, self.at + n)


class Inflated:
    """What the gzip members from a place on, or up to another, hold, a bounded piece at a time."""

    def __init__(self, raw: Raw, end: int | None = None):
        self.raw, self.end, self.inflate, self.rest = raw, raw.size if end is None else end, zlib.decompressobj(31), b""

    def __call__(self, n: int) -> bytes:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.rest = self.rest or self.raw(min(PIECE, self.end - self.raw.at))
            if not self.rest:
                return b""
            piece = self.inflate.decompress(self.rest, n)
            self.rest = self.inflate.unconsumed_tail
            if piece:
                return piece


class Text:
    """Bytes that come in pieces: heads are looked for, blocks taken or stepped over, and what has passed is let go."""

    def __init__(self, more):
        self.more, self.held, self.passed = more, bytearray(), 0

    def grow(self) -> bool:
        piece = self.more(PIECE)
        self.held += piece
        return bool(piece)

    def skip(self, n: int) -> None:
        self.passed += n
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if isinstance(self.more, Raw):
                self.more.skip(n)
                return
            if not self.grow():
                return
        del self.held[:n]

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.grow():
            pass
        block = bytes(self.held[:n])
        self.skip(len(block))
        return block

    def head(self, mark: bytes = b"") -> bytes | None:
        """What stands before the next blank line, from mark on; None if there is none. What stands before mark is let go."""
        if mark:
            while (at := self.held.find(mark)) < 0:
                self.skip(max(0, len(self.held) - len(mark)))
                if not self.grow():
                    return None
            self.skip(at)
        tried = 0
        while (end := self.held.find(b"\r\n\r\n", tried)) < 0:
            tried = max(0, len(self.held) - 3)
            if not self.grow():
                return None
        return self.take(end + 4)[:-4]


def next_record(text: Text, wanted: Wanted, columns: set[str]) -> tuple[int, dict | None]:
    """Where the next record ends, and its row if it is wanted; (-1, None) if there is none. Only as much of the block is read as the columns ask for."""
    head = text.head(b"WARC/")
    if head is None:
        return -1, None
    known = fields(head)
    size, end = length_of(known) or 0, text.passed
    row: dict | None = named(known)
    if not wanted(row):
        row = None
    elif columns & {"payload", "payload_length", "http_status"}:
        row |= {"http_status": None, "payload_length": size, "payload": None}
        payload, rest = "payload" in columns, size
        if (row["content_type"] or "").startswith("application/http"):
            block = Text(lambda n: text.take(min(n, end + size - text.passed)))
            http = block.head()
            if http is not None:
                status = http.split(b" ", 2)[1:2]
                rest = size - len(http) - 4
                told = length_of(fields(http))
                row |= {"http_status": int(status[0]) if status and status[0].isdigit() else None, "payload_length": rest if told is None else told}
                row["payload"] = block.take(rest) if payload else None
        elif payload:
            row["payload"] = text.take(size)
    return end + size, row


def records(file, size: int, wanted: Wanted, columns: set[str]) -> Iterator[dict]:
    """The wanted records of an archive: plain, with a gzip member per record, or gzipped as a whole."""
    raw = Raw(file, size)
    while raw.at < size:
        start, zipped = raw.at, raw.peek(2) == b"\x1f\x8b"
        head = raw.peek(12) if zipped else b""
        sizes = member_sizes(raw.peek(12 + int.from_bytes(head[10:12], "little"))) if zipped else None
        text = Text(Inflated(raw, start + sizes[0] if sizes else None) if zipped else raw)
        while True:
            end, row = next_record(text, wanted, columns)
            if row is not None:
                yield row
            if end < 0 or sizes and end + 4 >= sizes[1]:  # a member that tells its length is left here, what is left of it not inflated
                break
            text.skip(end - text.passed)
        if not sizes:
            return
        raw.at = start + sizes[0]


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Archives(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[tuple[str, pa.DataType]]):
        self.path, self.columns, self.wanted = path, columns, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.wanted = Wanted([f for f in filters if Wanted.takes(f)])
        return [f for f in filters if not Wanted.takes(f)]

    def partitions(self) -> list[InputPartition]:
        store, path = files.opened(self.path)
        names = [f.path for f in store.get_file_info(files.fs.FileSelector(path, allow_not_found=True)) if f.is_file]
        lists = [n for n in names if n.rsplit("/", 1)[-1].startswith("_manifest-")]
        root = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        if lists:
            names = [f"{path}/{n}" for m in sorted(lists) for n in json.loads(store.open_input_file(m).read())]
        else:
            names = sorted(n for n in names if re.search(r"\.warc(\.gz)?$", n))
        return [ArchiveFile(root + n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = pa.schema(self.columns)
        held, size = [], 0
        store, path = files.opened(partition.path)
        with store.open_input_file(path) as file:
            for row in records(file, file.size(), self.wanted, {c for c, _ in self.columns}):
                held.append(row)
                size += 200 + len(row.get("payload") or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held, size, paths = [], 0, []

        def flush():
            nonlocal held, size
            name = f"{uuid.uuid4().hex}.warc.gz"
            files.write_bytes(f"{self.path}/{name}", *held)
            paths.append(name)
            held, size = [], 0

        for batch in iterator:
            for row in range(len(batch)):
                held.append(member(record_bytes({n: batch[n][row].as_py() for n in batch.schema.names})))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    flush()
        if held:
            flush()
        return Archives(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files.write_bytes(f"{self.path}/_manifest-{uuid.uuid4().hex}", json.dumps([p for m in messages if m for p in m.paths]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = files.opened(self.path)
        for m in messages:
            for p in m.paths if m else ():
                store.delete_file(f"{path}/{p}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_type

        return WarcReader(self.options["path"].rstrip("/"), [(f.name, to_arrow_type(f.dataType)) for f in schema])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"].rstrip("/")
        if overwrite:
            store, at = files.opened(path)
            store.delete_dir_contents(at, missing_dir_ok=True)
        files.make_dir(path)
        return WarcWriter(path)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """WARC records of pages (page_id, url, html); of equal payloads of at least least_bytes the one of the smallest page_id is a response, others revisit it.

    A page without page_id is always a response, as are pages that repeat the smallest page_id.
    """
    full = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    full = full.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # narrow rows only are gathered by digest, and the payloads meet just those digests that repeat
    first = full.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    joined = full.join(first, "payload_digest", "left")
    revisit = (F.col("first") != F.col("page_id")) & F.col("page_id").isNotNull() & F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, name("first")).alias("refers_to"),
        "payload_digest", "payload_length", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str | None = None) -> str:
    """Write pages as archives; the folder."""
    register(pages.sparkSession)
    folder = folder or scratch_path(pages.sparkSession, "warc")
    page_records(pages).write.format("warc").mode("append").save(folder)
    return folder


def page_index(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives' records; the digest of a response is taken anew from its payload."""
    register(spark)
    rows = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, payload_length long, payload binary").load(folder)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    length = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))
    kept = rows.where(F.col("record_type").isin("response", "revisit"))
    return kept.select(page("record_id").alias("page_id"), length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


#: DuckDB SQL of page_index(archive(pages)): what the archives must give back.
SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.digest = p.digest AND n >= 100"""
