"""Importance resampling towards a target distribution, over hashed n-grams, by the algebra of CRCs.

A CRC is linear over GF(2): the CRC of A followed by B is the CRC of A, taken through the matrix that appends as many zero
bytes as B has, xor the CRC of B. So the CRC of every word is computed once, and those of n-grams (words joined by one
space) are composed from them with matrices for 1, 2, 4, ... zero bytes; no n-gram is ever put together as a string.

1. All n-grams of all documents and of all target texts are counted by bucket (CRC modulo the number of buckets). A task
   sends one number a bucket, so the shuffle doesn't grow with texts.
2. The gains of the buckets (as many numbers as buckets, a parameter) go to the tasks, which give each document the
   floored mean of its n-grams' gains.
3. A document's score is that weight plus a Gumbel number from a hash of its id; the highest scores are a sample without
   replacement. Ranks are places in a range-sorted table, so nothing passes one task.

Words are lower-cased (A-Z only) runs of letters A-Z, digits and all characters beyond ASCII. Null and empty texts have no
n-gram and weigh 0. Texts of any length are read whole, in slices. Rows with equal scores rank by smaller id; of repeated
rows either comes first; rows without an id hash as an empty id and come after others. An empty table gives no rows, an
empty target gives gains from the documents alone. Columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

BUCKETS = 10_000
SLICE = 4 << 20
#: Words up to so many bytes have their CRCs computed together, longer ones each.
TOGETHER = 48
POLYNOMIAL = 0xEDB88320


def byte_table() -> np.ndarray:
    """What each byte does to a CRC: eight divisions by the polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1)).astype(np.uint32)
    return c


BYTES = byte_table()
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
IS_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SPACE = zlib.crc32(b" ")


class Shift:
    """CRCs of texts to which zero bytes are appended: one matrix over GF(2) for each power of two of them."""

    def __init__(self) -> None:
        basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.matrices = [self._lookup(BYTES[basis & np.uint32(255)] ^ (basis >> np.uint32(8)))]

    @staticmethod
    def _lookup(columns: np.ndarray) -> np.ndarray:
        """A matrix as four tables: what each byte of a number becomes."""
        table = np.zeros((4, 256), np.uint32)
        for bit, column in enumerate(columns.tolist()):
            low = 1 << bit % 8
            table[bit // 8, low : 2 * low] = table[bit // 8, :low] ^ np.uint32(column)
        return table

    @staticmethod
    def _times(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        eight, last = np.uint32(8), np.uint32(255)
        return table[0][crc & last] ^ table[1][crc >> eight & last] ^ table[2][crc >> np.uint32(16) & last] ^ table[3][crc >> np.uint32(24)]

    def __call__(self, crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        crc = crc.astype(np.uint32)
        for k in range(int(zeros.max(initial=0)).bit_length()):
            if k == len(self.matrices):
                basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
                half = self.matrices[-1]
                self.matrices.append(self._lookup(self._times(half, self._times(half, basis))))
            some = np.flatnonzero(zeros >> k & 1)
            crc[some] = self._times(self.matrices[k], crc[some])
        return crc


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each word of `data`, a byte of all words at a time."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(lengths <= TOGETHER)
    order = short[np.argsort(-lengths[short], kind="stable")]
    crc, begin, size = out[order], starts[order], lengths[order]
    left = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # words longer than 0, 1, ...
    for at, n in enumerate(left.tolist()):
        now = crc[:n]
        crc[:n] = BYTES[(now ^ data[begin[:n] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[order] = ~crc
    for i in np.flatnonzero(lengths > TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in slices that end between words."""
    low = 0
    while len(text) - low > SLICE:
        end = NO_WORD.search(text, low + SLICE)
        if end is None:
            break
        yield text[low : end.end()]
        low = end.end()
    yield text[low:]


class Grams:
    """n-gram CRCs of texts, for all lengths from `shortest` to `longest` words."""

    def __init__(self, shortest: int, longest: int):
        self.lengths, self.shift = (shortest, longest), Shift()
        self.clear()

    def clear(self) -> None:
        """Forget the words that a next slice of the same text would go on from."""
        self.held = (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text, and for each length of n-grams the CRCs and the number of the text of each."""
        data = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
        inside = np.concatenate([[False], IS_WORD[data], [False]]).view(np.int8)
        turns = np.flatnonzero(np.diff(inside))
        starts, lengths = turns[::2], turns[1::2] - turns[::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(starts, ends, side="left")
        words = np.diff(last, prepend=0)
        crc = np.concatenate([self.held[0], word_crcs(data, starts, lengths)])
        lengths = np.concatenate([self.held[1], lengths])
        owner = np.concatenate([np.zeros(len(self.held[0]), np.int64), np.repeat(np.arange(len(texts)), words)])
        old = len(self.held[0])
        shortest, longest = self.lengths
        keep = min(longest - 1, len(crc))
        self.held = (crc[len(crc) - keep :], lengths[len(crc) - keep :])
        found, gram = [], crc
        spaced = self.shift(np.full(len(crc), SPACE, np.uint32), lengths) ^ crc if longest > 1 else crc
        for n in range(1, longest + 1):
            if n > 1:
                gram = self.shift(gram[: max(0, len(crc) - n + 1)], lengths[n - 1 :] + 1) ^ spaced[n - 1 :]
            if n >= shortest:
                low = max(0, old - n + 1)  # those that end in a word of these texts
                same = owner[low : low + len(gram) - low] == owner[low + n - 1 :]
                found.append((gram[low:][same], owner[low : len(gram)][same]))
        return words, found


def _portions(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first text and texts together of about a slice; a longer one is alone, in several portions."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > SLICE:
            yield first, held
            held, size = [], 0
        if not held:
            first = i
        if len(raw) > SLICE:
            for part in slices(raw):
                yield i, [part]
            continue
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def _walk(texts: list[str | None], grams: Grams) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Portion by portion: the first text's number, how many texts, their words and n-grams."""
    before = -1
    for first, part in _portions(texts):
        if first != before or len(part) > 1:
            grams.clear()
        before = first
        yield first, len(part), *grams.of(part)


def bucket_counts(texts: DataFrame, text_col: str, shortest: int, longest: int, buckets: int) -> DataFrame:
    """bucket, n: n-grams of all texts, a row a bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grams = np.zeros(buckets, np.int64), Grams(shortest, longest)
        for batch in batches:
            for _, _, _, found in _walk(batch.column(0).to_pylist(), grams):
                for crc, _ in found:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "bucket long, n long")


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", shortest: int = 1, longest: int = 2, buckets: int = BUCKETS, scale: int = 1000) -> np.ndarray:
    """Of each bucket: the floored log ratio of its smoothed shares in the target and in the documents, times `scale`."""
    both = [bucket_counts(df, text_col, shortest, longest, buckets).withColumn("target", F.lit(of)) for df, of in ((docs, 0), (target, 1))]
    rows = both[0].unionByName(both[1]).groupBy("target", "bucket").agg(F.sum("n").alias("n")).collect()  # two a bucket
    counts = np.zeros((2, buckets))
    for r in rows:
        counts[r["target"], r["bucket"]] = r["n"]
    raw, wanted = counts.sum(axis=1).tolist()
    ratio = (counts[1] + 1) * (raw + buckets) / ((counts[0] + 1) * (wanted + buckets))
    return np.array([math.floor(scale * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shortest: int = 1, longest: int = 2) -> DataFrame:
    """id, n_words, n_features, weight: the floored mean of the gains of a document's n-grams."""
    numbers = docs.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gain = Grams(shortest, longest), numbers.value
        for batch in batches:
            words, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, n, own, found in _walk(batch.column(1).to_pylist(), grams):
                words[first : first + n] += own
                for crc, owner in found:
                    running = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                    cuts = np.searchsorted(owner, np.arange(n + 1))
                    features[first : first + n] += np.diff(cuts)
                    sums[first : first + n] += np.diff(running[cuts])
            mean = np.floor_divide(sums, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, features, mean)]], names=["id", "n_words", "n_features", "weight"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, shortest: int = 1, longest: int = 2, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank. Of the documents with so many words at least, `percent` in a hundred
    (rounded down) are drawn; the rank of others is null."""
    gains = bucket_gains(docs, target, text_col, shortest, longest, buckets)
    weighed = weights(docs, gains, id_col, text_col, shortest, longest)
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = written(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last()]
    ranked = numbered(able, order, "_place", "ranked")
    draw = F.lit(able.count() * percent // 100)
    rank = F.when(F.col("_place") < draw, F.col("_place") + 1).cast("long")
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.withColumn("rank", rank).drop("_place").unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def oracle(percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, seed: int = 2024) -> str:
    """The rows for single words in DuckDB's SQL, with a CRC of its own, byte by byte over distinct words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = f"case when c & 1 = 1 then xor(c >> 1, {POLYNOMIAL}) else c >> 1 end"
    return f"""
        with recursive k(i, c, bit) as (
            select i, i, 0 from range(256) r(i) union all select i, {step}, bit + 1 from k where bit < 8),
        t as (select list(c order by i) as t from k where bit = 8),
        d as (select row_number() over () as r, doc_id, {words} as w from documents),
        dw as (select r, unnest(w) as w from d),
        bw as (select unnest({words}) as w from benchmark),
        v as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
        b as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint)),
                lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {buckets} as bucket from v, t),
        s as (select bucket, count(*) as s from dw join b using (w) group by 1),
        q as (select bucket, count(*) as t from bw join b using (w) group by 1),
        n as (select (select count(*) from dw)::double as sn, (select count(*) from bw)::double as tn),
        g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (sn + {buckets}) / ((coalesce(s, 0) + 1)::double * (tn + {buckets}))))::bigint as gain
              from (select distinct bucket from b) left join s using (bucket) left join q using (bucket), n),
        m as (select r, count(*) as f, floor(sum(gain)::double / count(*))::bigint as weight from dw join b using (w) join g using (bucket) group by r),
        e as (select d.doc_id, coalesce(f, 0) as n_features, coalesce(weight, 0) as weight,
                     ('0x' || sha256('{seed}:' || coalesce(d.doc_id::varchar, ''))[1:8])::bigint as h from d left join m using (r)),
        z as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from e),
        o as (select *, case when n_features >= {least_words} then row_number() over (partition by n_features >= {least_words} order by score desc, doc_id) end as p,
                     count(*) filter (where n_features >= {least_words}) over () as able from z)
        select doc_id, n_features::bigint as n_features, weight, score, case when p <= able * {percent} // 100 then p end as rank from o"""
