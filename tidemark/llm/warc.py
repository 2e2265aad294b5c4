"""WARC archives as a PySpark data source.

Reading plans one partition per file, takes over predicates on the record type and on header fields, parses a record's
headers first, and decodes a payload only if the record is wanted. Each record is a gzip member of its own; its
``sl`` extra field holds the member's lengths, so an unwanted record is skipped without inflating its payload. Members
without that field (other writers') are inflated in small pieces to find their end.

Files are reached through pyarrow's file systems, so folders may be local, shared or remote.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tidemark.llm.common import scratch, split_join, table

#: Columns, the header each comes from, and whether it is a number.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_length": "WARC-Payload-Length",
}
NUMBERS = {"content_length", "payload_length"}
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", payload binary, file string, offset long"
_ARROW = pa.schema(
    [(c, pa.int64() if c in NUMBERS else pa.string()) for c in HEADERS]
    + [("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
)
#: Bytes read at a time, and inflated at a time where only an end is looked for.
CHUNK = 1 << 20


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """Hadoop writes file:/x where others write file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


# ---- records ----


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member, with its compressed and plain length in the extra field ``sl``."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A WARC/1.1 record: its header lines, an empty line, the block, two line ends."""
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = len(block) if column == "content_length" else fields.get(column)
        if value is not None:
            lines.append(f"{name}: {value}".replace("\r", " ").replace("\n", " "))
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, object]:
    """The columns that a header has; others are None. Header names compare without case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    got = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    found = {c: got.get(h.lower()) for c, h in HEADERS.items()}
    return found | {c: int(found[c]) for c in NUMBERS if found[c] is not None}


def payload_of(fields: dict[str, object], block: bytes) -> bytes:
    """What follows the HTTP head of an HTTP record; else the block."""
    if str(fields["content_type"] or "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Window:
    """A stream of which only what is needed is held."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.pos = stream, b"", 0, 0

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = self.stream.read(max(CHUNK, n))
            if not more:
                break
            self.held, self.at = self.held[self.at :] + more, 0
        return self.held[self.at : self.at + n]

    def skip(self, n: int) -> None:
        self.pos += n
        have = len(self.held) - self.at
        if n <= have:
            self.at += n
        else:
            self.held, self.at = b"", 0
            self.stream.seek(self.pos)


def _gzip_head(w: Window) -> tuple[int, int | None]:
    """Length of the member's head, and of the whole member if the extra field tells."""
    head = w.peek(10)
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at {w.pos}")
    size, flags, told = 10, head[3], None
    if flags & 4:
        (n,) = struct.unpack("<H", w.peek(12)[10:])
        extra = w.peek(12 + n)[12:]
        size += 2 + n
        while len(extra) >= 4:
            (k,) = struct.unpack("<H", extra[2:4])
            if extra[:2] == b"sl" and k == 8:
                told = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + k :]
    for bit in (8, 16):  # name, comment
        if flags & bit:
            n = 64
            while (end := w.peek(size + n).find(b"\0", size)) < 0:
                n *= 2
            size = end + 1
    return size + (2 if flags & 2 else 0), told


def read_records(stream, wanted, with_payload: bool = True) -> Iterator[tuple[dict[str, object], bytes | None, int]]:
    """Header fields, payload and offset of the records of which ``wanted(fields)`` is true.

    Headers come first; the payload of another record is never built. A response whose payload hasn't the digest
    in its header raises ValueError.
    """
    w = Window(stream)
    while w.peek(1):
        start = w.pos
        size, told = _gzip_head(w)
        inflate = zlib.decompressobj(-15)
        data, at = b"", size
        while b"\r\n\r\n" not in data:
            piece = w.peek(at + 4096)[at:]
            if not piece:
                raise ValueError(f"record at {start} has no end of its headers")
            data += inflate.decompress(piece)
            at += len(piece) - len(inflate.unused_data)
            if inflate.eof:
                break
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = parse_headers(head)
        keep = wanted(fields)
        need = keep and with_payload
        if need or told is None:
            parts = [rest]
            while not inflate.eof:
                piece = w.peek(at + CHUNK)[at:]
                if not piece:
                    raise ValueError(f"record at {start} is cut short")
                got = inflate.decompress(piece)
                at += len(piece) - len(inflate.unused_data)
                if need:
                    parts.append(got)
            told = at + 8
            rest = b"".join(parts)
        w.skip(told)
        if keep:
            payload = None
            if need:
                payload = payload_of(fields, rest[: fields["content_length"]])
                check_digest(fields, payload)
            yield fields, payload, start


def check_digest(fields: dict[str, object], payload: bytes) -> None:
    import hashlib

    digest = str(fields["payload_digest"] or "")
    if fields["record_type"] == "response" and digest.startswith("sha256:"):
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ValueError(f"wrong payload digest in {fields['record_id']}")


# ---- predicates ----

_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


def takes(f) -> bool:
    """Whether a predicate is one that headers decide."""
    if isinstance(f, Not):
        return type(f.child) in (EqualNullSafe, IsNull, IsNotNull) and takes(f.child)
    return type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS


def holds(f, fields: dict[str, object]) -> bool:
    if isinstance(f, Not):
        return not holds(f.child, fields)
    return _TESTS[type(f)](fields[f.attribute[0]], f)


# ---- data source ----


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = _uri(path), payload, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if takes(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc.gz", ".warc")) and not x.base_name.startswith((".", "_")))
        return [WarcFile(f) for f in files] or [WarcFile("")]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as stream:
            rows, size = [], 0
            wanted = lambda fields: all(holds(f, fields) for f in self.filters)
            for fields, payload, at in read_records(stream, wanted, self.payload):
                rows.append(fields | {"payload": payload, "file": partition.path, "offset": at})
                size += len(payload or b"") + 500
                if size > 8 * CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; the commit gives the files of the tasks that counted their names."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _uri(path), overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"{root}/.part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with system.open_output_stream(name, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record(row, row.get("payload") or b"")))
                    n += 1
        return Written(name, n)

    def commit(self, messages):
        from pyarrow import fs

        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.is_file and not x.base_name.startswith("."):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None and m.records:
                folder, _, base = m.file.rpartition("/")
                system.move(m.file, f"{folder}/{base[1:]}")
            elif m is not None:
                system.delete_file(m.file)

    def abort(self, messages):
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.file)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``.

    Option ``payload`` = false leaves every payload undecoded and null. An empty or missing folder has no rows.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take over predicates."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, *, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of pages (page_id, url, html): a row per page, in the columns of the format.

    Of pages with equal payloads of at least ``least`` bytes, compared by SHA-256, the smallest page_id is a
    response; the others are revisits that refer to it and hold no payload. Smaller ones are all responses. Null html
    is an empty payload; a null page_id is written as ``null`` and is never the smallest beside another;
    a page_id that occurs twice with one payload gives two responses. Other columns aren't read. The pages of a frequent
    payload meet its first page in a join whose shuffles adaptive execution can split.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("target_uri"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"),
    ).select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("payload_length"))
    large = rows.where(F.col("payload_length") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"))
    same = F.col("page_id").eqNullSafe(F.col("first"))
    typed = (
        split_join(large, first, "digest")
        .withColumn("record_type", F.when(same, "response").otherwise("revisit"))
        .withColumn("refers", F.when(~same, F.col("first")))
        .select(*rows.columns, "record_type", "refers")
        .union(rows.where(F.col("payload_length") < least).select("*", F.lit("response"), F.lit(None).cast("long")))
    )
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_length").cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise(http)
    return typed.select(
        "record_type",
        name("page_id").alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(F.col("refers").isNotNull(), name("refers")).alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        "payload_length",
        block.alias("payload"),
        F.lit("").alias("file"),
        F.lit(0).cast("long").alias("offset"),
    )


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back.

    Revisits come from a read that decodes no payload. Null and repeated rows are as page_records has them; an empty table
    has no rows.
    """
    register(spark)
    path = scratch(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    number = lambda c: F.try_to_number(F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1), F.lit("S" + "9" * 19)).cast("long")
    read = spark.read.format("warc")
    whole = (
        read.load(path)
        .where("record_type = 'response'")
        .select(
            number("record_id").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
            "record_type",
            F.lit(None).cast("long").alias("refers_to"),
        )
    )
    again = (
        read.option("payload", "false")
        .load(path)
        .where("record_type = 'revisit'")
        .select(
            number("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.substring("payload_digest", 8, 64).alias("payload_digest"),
            "record_type",
            number("refers_to").alias("refers_to"),
        )
    )
    return whole.union(again)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
