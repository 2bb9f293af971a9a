"""WARC records in ZIP archives: written as stored members with an index, read by range without extraction.

An archive has two stored members, the WARC file and an index with the place of every record. It is written front to
back (sizes follow the data) with ZIP64 structures throughout and ends in a line feed, its comment, so that Spark's text
writer, with its commit protocol and on any store, writes each archive as a file. A task closes an archive before it
outgrows `ARCHIVE_BYTES`; only one record longer than that makes a longer one.

The reader's tasks get names of archives. Each opens its archive in the store and reads the tail, the ZIP64 locator and
directory, the local header of each member, the index, and then runs of records by offset and length; neither an
archive nor a member is ever read whole. Python reads shared folders (scheme file) itself, and any store for which the
caller gives an `opener`; in other stores Spark's own reader hands over whole archives, which are of bounded size, and
ranges are taken from those.

Of equal payloads of at least `least` bytes the row with the largest id is a response and the others revisit it; rows
of equal id and payload are alike, so all of them are responses. Null payloads count as empty, a null address is left
out. A row without an id is a response, unless a row with an id has its payload. A very long page is one record. An empty
table gives no archive and reads as no rows. Columns beyond id, address and page are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scheme_of, written

LEAST_REVISIT_BYTES = 1000
#: Size at which a task closes an archive, and bytes of neighbouring records that are read at once.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = b"archive/data.warc", b"indexes/index.cdxj"

#: Fixed values of the formats.
LOCAL, DESCRIPTOR, CENTRAL, END64, LOCATOR, END = (b"PK" + bytes(x) for x in ((3, 4), (7, 8), (1, 2), (6, 6), (6, 7), (5, 6)))
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DOS_DATE = (2024 - 1980) << 9 | 1 << 5 | 1
MAX32 = 0xFFFFFFFF


# ---- ZIP, written front to back


def local_header(name: bytes) -> bytes:
    """Stored, sizes in the descriptor after the data; the ZIP64 field says that they have eight bytes."""
    extra = struct.pack("<HHQQ", 1, 16, 0, 0)
    return LOCAL + struct.pack("<HHHHHIIIHH", 45, 1 << 3, 0, 0, DOS_DATE, 0, MAX32, MAX32, len(name), len(extra)) + name + extra


def descriptor(crc: int, size: int) -> bytes:
    return DESCRIPTOR + struct.pack("<IQQ", crc, size, size)


def directory(members: list[tuple[bytes, int, int, int]], at: int, comment: bytes) -> bytes:
    """Central directory and both end records for (name, crc, size, offset of the local header)."""
    out = b""
    for name, crc, size, offset in members:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
        out += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 1 << 3, 0, 0, DOS_DATE, crc, MAX32, MAX32, len(name), len(extra), 0, 0, 0, 0, MAX32) + name + extra
    end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(out), at)
    locator = LOCATOR + struct.pack("<IQI", 0, at + len(out), 1)
    return out + end64 + locator + END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, MAX32, MAX32, len(comment)) + comment


# ---- ZIP, read by range


class Ranges:
    """Bytes by offset and length, of a buffer or of an open file."""

    def __init__(self, source):
        self.source = source
        if hasattr(source, "seek"):
            self.size = source.seek(0, 2)
        else:
            self.source, self.size = memoryview(source), len(source)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError("the archive ends too early")
        if isinstance(self.source, memoryview):
            return bytes(self.source[offset : offset + length])
        self.source.seek(offset)
        return self.source.read(length)


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Fields of 32 bits that are full stand in the ZIP64 field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            inside = at + 4
            for i, v in enumerate(values):
                if v == MAX32 and inside + 8 <= at + 4 + size:
                    (values[i],) = struct.unpack_from("<Q", extra, inside)
                    inside += 8
        at += 4 + size
    return values


def members(archive: Ranges) -> dict[str, tuple[int, int, int]]:
    """Name to (offset of the data, size, crc32) of stored members, from the central directory or its ZIP64 form."""
    tail = min(archive.size, 22 + 0xFFFF)
    ending = archive.read(archive.size - tail, tail)
    at = len(ending) - 22
    while at >= 0 and not (ending[at : at + 4] == END and at + 22 + struct.unpack_from("<H", ending, at + 20)[0] == len(ending)):
        at -= 1
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, size, offset = struct.unpack_from("<HII", ending, at + 10)
    place = archive.size - tail + at
    if place >= 20 and archive.read(place - 20, 4) == LOCATOR:
        (where,) = struct.unpack("<Q", archive.read(place - 12, 8))
        head = archive.read(where, 56)
        if head[:4] != END64:
            raise ValueError("the locator leads nowhere")
        count, size, offset = struct.unpack_from("<QQQ", head, 32)
    entries, at, found = archive.read(offset, size), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is broken")
        _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, start = struct.unpack_from("<HHHHHHIIIHHHHHII", entries, at + 4)
        name = entries[at + 46 : at + 46 + n_name].decode()
        plain, packed, start = _wide(entries[at + 46 + n_name : at + 46 + n_name + n_extra], [plain, packed, start])
        if method == 0:
            local = archive.read(start, 30)
            if local[:4] != LOCAL:
                raise ValueError("a local header is missing")
            n_local_name, n_local_extra = struct.unpack_from("<HH", local, 26)
            found[name] = (start + 30 + n_local_name + n_local_extra, packed, crc)
        at += 46 + n_name + n_extra + n_comment
    return found


# ---- WARC


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, block and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"version": lines[0], "headers": headers, "http": fields, "payload": payload}


def archive_sections(rows: Iterator[tuple]) -> Iterator[bytes]:
    """The sections of one archive, each without its last line feed; one record and the index are held."""
    at = crc = size = 0
    lead = local_header(WARC_MEMBER)
    index: list[bytes] = []
    first = len(lead)
    for row in rows:
        raw = record(*row)
        index.append(json.dumps({"id": row[0], "offset": size, "length": len(raw)}).encode())
        crc, size = zlib.crc32(raw, crc), size + len(raw)
        yield lead + raw[:-1]
        lead = b""
    if not index:
        return
    at = first + size
    listing = b"\n".join(index) + b"\n"
    closing = descriptor(crc, size)
    second = at + len(closing)
    opening = local_header(INDEX_MEMBER)
    yield closing + opening + listing[:-1]
    index_crc = zlib.crc32(listing)
    closing = descriptor(index_crc, len(listing))
    at = second + len(opening) + len(listing) + len(closing)
    yield closing + directory([(WARC_MEMBER, crc, size, 0), (INDEX_MEMBER, index_crc, len(listing), second)], at, b"\n")[:-1]


def archives(rows: Iterator[tuple], most: int) -> Iterator[bytes]:
    """Whole archives, each without its last line feed, of rows as they come."""

    def size(row: tuple) -> int:
        return 1024 + len(row[1] or "") + len(row[2])

    row = next(rows, None)
    while row is not None:

        def own() -> Iterator[tuple]:
            nonlocal row
            held = 0
            while row is not None and (not held or held + size(row) <= most):
                held += size(row)
                yield row
                row = next(rows, None)

        yield b"\n".join(archive_sections(own()))


def records(archive: Ranges, most: int = READ_BYTES) -> Iterator[dict]:
    """Every record of an archive that its index lists, read by ranges: neighbours together up to so many bytes."""
    found = members(archive)
    start, size, crc = found[INDEX_MEMBER.decode()]
    data, _, _ = found[WARC_MEMBER.decode()]
    listing = archive.read(start, size)
    if zlib.crc32(listing) != crc:
        raise ValueError("the index is broken")
    entries = [json.loads(line) for line in listing.splitlines()]
    at = 0
    while at < len(entries):
        first, stop = entries[at]["offset"], at + 1
        end = first + entries[at]["length"]
        while stop < len(entries) and entries[stop]["offset"] == end and end + entries[stop]["length"] - first <= most:
            end += entries[stop]["length"]
            stop += 1
        raw = archive.read(data + first, end - first)
        for entry in entries[at:stop]:
            place = entry["offset"] - first
            yield entry | parse_record(raw[place : place + entry["length"]])
        at = stop


# ---- Spark


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("long", F.octet_length("payload") >= least).withColumn("sha", F.when(F.col("long"), F.sha2("payload", 256)))
    groups = rows.where("long").groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    # written, so that the join below deals both sides itself and can split a payload that many pages share
    joined = rows.join(written(groups, "equal-payloads"), "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    named = joined.select("id", "url", "payload", F.sha1("payload").alias("digest"), "first", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for low in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns), strict=True))
        for archive in archives(rows, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["value"])

    lines = named.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def open_shared(uri: str) -> BinaryIO:
    """A file of a folder that every machine sees under the same name."""
    return open(unquote(urlsplit(uri).path), "rb")


def read_archives(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    opener: gives a seekable file for an archive's address, in stores that tasks reach by themselves.
    """
    if opener is None and scheme_of(spark, path) == "file":
        opener = open_shared

    def number(urn: str | None) -> int | None:
        tail = urn.rsplit(":", 1)[-1].rstrip(">") if urn else "none"
        return None if tail == "none" else int(tail)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def rows_of(archive: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for r in records(archive):
            head, kind = r["headers"], r["headers"]["WARC-Type"]
            stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != stated:
                raise ValueError("a payload differs from its digest")
            size = len(r["payload"]) if kind == "response" else int(r["http"]["Content-Length"])
            rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, stated, kind, number(head.get("WARC-Refers-To")), r["payload"] if kind == "response" else None))
            held += len(r["payload"])
            if len(rows) == 256 or held >= READ_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0):
                if opener is None:
                    yield from rows_of(Ranges(source.as_buffer()))
                else:
                    with opener(source.as_py()) as file:
                        yield from rows_of(Ranges(file))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content" if opener is None else "path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
