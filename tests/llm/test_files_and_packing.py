"""Planes, archives and packing: exact round trips, bounds and odd rows."""

import io
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import bitplane, packing, warc_zip
from tallymark.llm.common import fresh_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_planes(bits, block):
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 2 ** rng.integers(1, 33), rng.integers(0, 90), dtype=np.uint64).astype("<u4")) for i in range(30)]
    data = b"".join(s + b"\n" for s in bitplane.sections(((k, d.tobytes()) for k, d in docs), block, bits))
    file = bitplane.PlaneFile(data)
    every = np.concatenate([d for _, d in docs])
    assert file.lengths.tolist() == [len(d) for _, d in docs] and (file.ids(0, len(every)) == every).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(every) + 1, 2))
        assert (file.ids(int(a), int(b)) == every[a:b]).all()
    with pytest.raises(ValueError):
        bitplane.PlaneFile(data[:-5])


def test_token_files(spark):
    rows = [(5, "b c"), (1, None), (3, "the quick\n brown"), (None, "x"), (3, "again"), (9, "word " * 3000)]
    path = fresh_path(spark, "planes-test")
    bitplane.write_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, BYTES, file_text_bytes=4000, block=512)
    got = sorted(bitplane.with_starts(bitplane.read_documents(spark, path)).collect(), key=lambda r: r["start"])
    place = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1]]))
    library, at = Tokenizer.from_file(BYTES), 0
    for r, (key, text) in zip(got, order, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_starts_of_more_files_than_names_sort(spark):
    """100,001 files: part-100000 sorts before part-99999 as text."""
    rows = spark.range(100_001).selectExpr("id", "format_string('part-%05d-x.txt', id) as file", "0L as file_start", "id % 7 as n_tokens")
    got = bitplane.with_starts(rows)
    want, at = [], 0
    for i in range(100_001):
        want.append(at)
        at += i % 7
    assert [r["start"] for r in got.orderBy("id").collect()] == want


def test_one_id_is_dealt_over_files(spark):
    rows = [(7, f"text number {i} of one id")for i in range(400)] + [(None, None)] * 50
    path = fresh_path(spark, "planes-test")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("_from", F.lit("x"))
    bitplane.write_files(docs, path, BYTES, file_text_bytes=1000)
    got = bitplane.with_starts(bitplane.read_documents(spark, path)).collect()
    assert len(got) == 450 and max(Counter(r["file"] for r in got).values()) < 200
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_no_token_files(spark):
    path = fresh_path(spark, "planes-test")
    bitplane.write_files(spark.createDataFrame([], "doc_id long, text string"), path, BYTES)
    assert bitplane.with_starts(bitplane.read_documents(spark, path)).count() == 0


PAGES = [(1, "http://a/1", "x" * 1500), (2, None, "x" * 1500), (3, "http://b/\n2", "y"), (4, "u", "y"), (5, "u", None), (6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "PK\x05\x06 \r\n\r\n WARC/1.1" * 80), (None, "u", "x" * 1500), (9, "u", "x" * 999)]


def test_archives(spark):
    path = fresh_path(spark, "warc-test")
    warc_zip.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2), path)
    got = {r["page_id"]: r for r in warc_zip.read_archives(spark, path).collect()}
    assert len(got) == len(PAGES)
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("revisit", 7), 7: ("response", None), 8: ("response", None), None: ("revisit", 2), 9: ("response", None)}
    for key, _, html in PAGES:
        raw = (html or "").encode()
        assert got[key]["payload_bytes"] == len(raw)
        assert got[key]["record_type"] == "revisit" or bytes(got[key]["payload"]) == raw


def test_archive_is_a_zip_and_is_read_by_range():
    rows = [(i, f"http://{i}", f"page {i}".encode(), "d" * 40, None, False) for i in range(20)]
    data = b"".join(s + b"\n" for s in warc_zip.archive_sections(iter(rows)))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and len(z.namelist()) == 2
    assert [r["payload"] for r in warc_zip.records(warc_zip.Ranges(io.BytesIO(data)))] == [r[2] for r in rows]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:  # an archive by another writer, without ZIP64
        z.writestr("a.txt", b"hello")
    at, size, crc = warc_zip.members(warc_zip.Ranges(plain.getvalue()))["a.txt"]
    assert plain.getvalue()[at : at + size] == b"hello" and crc == zlib.crc32(b"hello")
    with pytest.raises(ValueError):
        warc_zip.members(warc_zip.Ranges(b"nothing of the kind, though long enough"))


def test_archives_are_of_bounded_size_and_read_by_range(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i} " * 200, 1, "x") for i in range(300)] + [(900, "long", "z" * 300_000, 1, "x"), (901, "long", "z" * 300_000, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int, id string").repartition(2)
    path = str(tmp_path / "a b")
    warc_zip.write_archives(pages, path, archive_bytes=60_000)
    sizes = [f.stat().st_size for f in (tmp_path / "a b").glob("part-*") if f.stat().st_size]
    assert len(sizes) > 5 and sorted(sizes)[-2] < 80_000  # one record is longer than an archive should be

    def opened(uri):
        file, most = warc_zip.open_shared(uri), 50_000

        class Limited:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def seek(self, *a):
                return file.seek(*a)

            def read(self, n):
                assert n <= max(most, 301_000) and n >= 0
                return file.read(n)

        return Limited()

    by_range = warc_zip.read_archives(spark, path, opened)
    monkeypatch.setattr(warc_zip, "scheme_of", lambda *_: "other")
    whole = warc_zip.read_archives(spark, path)
    assert sorted(map(str, by_range.collect())) == sorted(map(str, whole.collect())) and by_range.count() == 302
    assert "content" not in by_range._jdf.queryExecution().executedPlan().toString()


def test_no_pages(spark):
    path = fresh_path(spark, "warc-test")
    warc_zip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_zip.read_archives(spark, path).count() == 0


def test_bounds_and_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 12))])
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        assert packing.lower_bound(lengths, 100) <= least_bins(lengths.tolist()) <= bins.max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def least_bins(lengths):
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= lengths[k]:
                place(k + 1, [*free[:i], free[i] - lengths[k], *free[i + 1 :]])
        place(k + 1, [*free, 100 - lengths[k]])

    lengths.sort(reverse=True)
    place(0, [])
    return best


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(0, 60)) for i in range(300)] + [(1000, "long " * 1000), (1001, None), (1001, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pieces(docs, WORDS, 1, 64)
    packed, certificate = packing.with_certificate(found, 64, part_pieces=40)
    got, certificate = packed.toPandas(), certificate.toPandas()
    library = Tokenizer.from_file(WORDS)
    want = []
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(key, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if v is None or v != v else int(v) for v in r)
    assert sorted(map(key, got[["id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(map(key, want))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 64
    bound = packing.lower_bound(got["length"].to_numpy(), 64)
    assert bound <= got["sequence_id"].nunique() <= bound * 1.03 + 1
    whole, parts = certificate[certificate.stage == 0], certificate[certificate.stage > 0]
    assert whole["bins"].tolist() == [got["sequence_id"].nunique()] and whole["bound"].tolist() == [bound]
    assert (certificate["bins"] >= certificate["bound"]).all() and (certificate["bound"] > 0).all()
    assert parts["bins"].sum() + (got["length"] == 64).sum() >= whole["bins"].iloc[0] >= parts["bins"].sum()
    extra = docs.selectExpr("*", "1 as row", "2 as piece", "'x' as _part", "3 as length")
    assert packing.pack_documents(extra, WORDS).count() == 304 and packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_equal_rows_are_dealt_over_partitions(spark):
    docs = spark.createDataFrame([(7, "the same text")] * 400, "doc_id long, text string")
    packed, certificate = packing.with_certificate(packing.pieces(docs, WORDS, 1, 64), 64, part_pieces=50)
    of = certificate.where("stage > 0").groupBy("stage").agg(F.max("bins").alias("b")).toPandas()
    assert packed.count() == 400 and of["b"].max() < packed.select("sequence_id").distinct().count()
