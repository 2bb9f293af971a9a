"""Token ids in files of shuffled planes.

A file holds the documents of one range of ids in order. Its ids are cut into blocks of fixed size; a block's 32-bit
numbers are transposed into byte planes (or bit planes), each plane is compressed by zstandard alone, and an index at
the end says where every plane of every block lies and how many ids each document has. So any run of ids can be read
from the planes of its blocks only.

Layout: sections `magic`, one per block (its planes in a row), `index` (zstandard over JSON head and numpy arrays), `footer`
(offset and length of the index, crc32 of it, magic). Each section is followed by one byte, a line feed, so that
Spark's own text writer, with its commit protocol and on any store, writes the files.

Null texts count as empty; such documents have the end id only. Rows without an id come first. Rows of equal id are
ordered by the input partition they were read from and a hash of the text, and may lie in several files; each repeated row is a document of its own. An empty table
gives files without documents or no files. A text of any length is one document, which may fill many blocks. Columns
beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, written
from .tokenization import encoder

MAGIC = b"TMPLANE1"
FOOTER = struct.Struct("<QQI8s")
BLOCK_IDS = 1 << 16
FILE_TEXT_BYTES = 32 << 20


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes from the lowest; a block that doesn't fill its last byte of bits is padded with zeros."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(columns[:, i]).tobytes() for i in range(4)]
    return [np.packbits((columns[:, i // 8] >> (i % 8)) & 1).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    out = np.zeros(n, np.uint32)
    for i, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(i)
    return out


def sections(documents: Iterator[tuple[int | None, bytes]], block: int = BLOCK_IDS, bits: bool = False) -> Iterator[bytes]:
    """The sections of one file from (id, ids as 32-bit bytes) in order; at most one block and the lengths are held."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    at = len(MAGIC) + 1
    yield MAGIC
    keys, lengths, index, held, size = [], [], [], [], 0

    def closed(data: bytes) -> bytes:
        nonlocal at
        planes = [packer.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), bits)]
        index.append([at, len(data) // 4, *map(len, planes)])
        made = b"".join(planes)
        at += len(made) + 1
        return made

    for key, ids in documents:
        keys.append(key)
        lengths.append(len(ids) // 4)
        held.append(ids)
        size += len(ids)
        if size >= 4 * block:
            data = b"".join(held)
            for i in range(0, size - 4 * block + 1, 4 * block):
                yield closed(data[i : i + 4 * block])
            rest = data[size - size % (4 * block) :]
            held, size = [rest], len(rest)
    if size:
        yield closed(b"".join(held))
    head = json.dumps({"block": block, "bits": bits, "n": len(keys), "index": index}).encode()
    body = struct.pack("<I", len(head)) + head + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes() + np.array(lengths, "<i8").tobytes()
    packed = packer.compress(body)
    yield packed
    yield FOOTER.pack(at, len(packed), zlib.crc32(packed), MAGIC)


class PlaneFile:
    """Reads runs of ids of a file's bytes (anything that slices)."""

    def __init__(self, data):
        import zstandard

        self.data, self.unpacker = data, zstandard.ZstdDecompressor()
        end = len(data) - 1
        at, size, crc, magic = FOOTER.unpack(bytes(data[end - FOOTER.size : end]))
        packed = bytes(data[at : at + size])
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("not a whole file of planes")
        body = self.unpacker.decompress(packed)
        (n_head,) = struct.unpack_from("<I", body)
        head = json.loads(body[4 : 4 + n_head])
        self.block, self.bits, self.index, n = head["block"], head["bits"], head["index"], head["n"]
        at = 4 + n_head
        self.keys = np.frombuffer(body, "<i8", n, at)
        self.missing = np.frombuffer(body, np.uint8, n, at + 8 * n)
        self.lengths = np.frombuffer(body, "<i8", n, at + 9 * n)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block_ids(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            at, n, *sizes = self.index[k]
            planes = []
            for size in sizes:
                planes.append(self.unpacker.decompress(bytes(self.data[at : at + size])))
                at += size
            self.last = (k, from_planes(planes, n))
        return self.last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts = [self.block_ids(k)[max(0, start - k * self.block) : stop - k * self.block] for k in range(start // self.block, -(-stop // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, file_text_bytes: int = FILE_TEXT_BYTES, block: int = BLOCK_IDS, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append the end id to each, and write files in ascending order of id."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield key, tokens.encode(text or "") + end

        rows_of_file = rows()
        first = next(rows_of_file, None)
        if first is None:
            return

        def again():
            yield first
            yield from rows_of_file

        for section in sections(again(), block, bits):
            yield pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], names=["value"])

    # rows of one id are dealt by where they were read, so that bounds of ranges are found without reading texts
    dealt = picked.withColumn("_from", F.spark_partition_id()).repartitionByRange(max(1, -(-total // file_text_bytes)), "id", "_from")
    ordered = dealt.sortWithinPartitions("id", "_from", F.xxhash64("text"))
    ordered.select("id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").text(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: id, file, number (in the file), file_start, n_tokens, ids_crc32, and ids (binary) if wanted."""
    kinds = {"id": pa.int64(), "file": pa.string(), "number": pa.int64(), "file_start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = PlaneFile(memoryview(content.as_buffer()))
                ends = np.cumsum(file.lengths)
                low = 0
                while low < len(ends):
                    # as many documents as fill a block of ids, a longer one alone
                    start = int(ends[low] - file.lengths[low])
                    high = max(low + 1, min(low + 4096, int(np.searchsorted(ends, start + file.block, "right"))))
                    raw = memoryview(file.ids(start, int(ends[high - 1])).astype("<u4").tobytes())
                    rows = []
                    for k in range(low, high):
                        at, stop = int(ends[k] - file.lengths[k]), int(ends[k])
                        ids = raw[4 * (at - start) : 4 * (stop - start)]
                        row = (None if file.missing[k] else int(file.keys[k]), name.rsplit("/", 1)[-1], k, at, stop - at, zlib.crc32(ids))
                        rows.append((*row, bytes(ids)) if with_ids else row)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    low = high

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = "id long, file string, number long, file_start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.mapInArrow(run, schema)


def file_number(name: Column) -> Column:
    """The number that Spark gave a part file: names of 100,000 files and more don't sort by text."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`: all ids of earlier files and of earlier documents of the file.

    One total a file is a table; sums over the files before are made in ranges, so nothing goes through the driver.
    """
    numbered = rows.withColumn("_file", file_number(F.col("file")))
    totals = written(numbered.groupBy("_file").agg(F.sum("n_tokens").alias("n")), "file-totals")
    base = written(prefix_sums(totals, "_file", "n"), "file-starts")
    return numbered.join(base, "_file").withColumn("start", F.col("before") + F.col("file_start")).drop("before", "_file")
