"""Best-fit packing of token pieces into sequences, with certified bounds and repacking.

Texts become pieces of at most `capacity` tokens; only longer documents are cut. Full pieces are sequences by
themselves. The others are dealt evenly over partitions, each packed best-fit decreasing. Dual feasible functions give
each partition a lower bound of its bins, and one of all. Where all bins together are at their bound, all is certified
and done. Else partitions exchange documents: each gives those of its emptiest bins away, more of them the larger its
gap; what all gave is dealt anew over fewer partitions and packed again, until the bound is met, a round saves no
bin, one partition is left, or `MOST_ROUNDS` have been made. `with_certificate` tells for each partition, and for all,
how many bins there are and how many there must be, so an end without a certificate shows.

Null texts count as empty: one piece, the end id. Repeated rows are packed each for itself, and dealt over partitions
like others. Ties among bins go to the bin opened first, among pieces to the smaller id. Texts of any length are cut into
pieces. An empty table gives no rows. Columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokenization import encoder

CAPACITY = 4096
PART_PIECES = 16_384
MOST_ROUNDS = 8


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the bounds that dual feasible functions give: no packing has fewer bins."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same, from the number of pieces of each length."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    tail = np.cumsum(count[::-1])[::-1]  # pieces of at least this length
    mass = np.cumsum(count * size)
    cuts = np.flatnonzero(count[: capacity // 2 + 1])
    for cut in cuts[cuts > 0]:  # large pieces count as a bin, those under the cut as nothing
        large = int(tail[capacity - cut + 1])
        middle = int(mass[capacity - cut] - mass[cut - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):  # sizes rounded to k-ths, unless they are (k+1)-ths exactly
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Bins are kept by their free space; a bit set finds the smallest space that fits."""
    bins = np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, chosen = capacity, opened
            opened += 1
        bins[i] = chosen
        left = space - n
        if left:
            by_space[left].append(chosen)
            spaces |= 1 << left
    return bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id (of full pieces, else null), row (a number of the document)."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, drops_space=True)
        task = TaskContext.get().partitionId() << 36
        full, row = (1 << 62) + task, task
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    own = full if len(piece) == 4 * capacity else None
                    full += own is not None
                    rows.append((key, k, at // 4, len(piece) // 4, zlib.crc32(piece), own, row))
                row += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "row"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, row long")


def _packer(capacity: int, stage: int, last: bool):
    """Packs one partition and marks the bins to give away: the emptiest, whose free space is the gap and one bin more.

    A partition at its bound gives as much as one bin: bounds of partitions add up to more than the bound of all.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(lengths[order])
        starts_bin = np.r_[True, bins[order][1:] != bins[order][:-1]]
        before = np.maximum.accumulate(np.where(starts_bin, sums - lengths[order], 0))
        offset = np.empty(len(rows), np.int64)
        offset[order] = sums - lengths[order] - before
        rows["offset"] = offset
        rows["sequence_id"] = (stage << 56) + (int(rows["_part"].iloc[0]) << 24) + bins
        gap = n_bins - lower_bound(lengths, capacity)
        rows["given"] = False
        if not last:
            filled = np.bincount(bins, weights=lengths, minlength=n_bins)
            emptiest = np.argsort(filled, kind="stable")
            waste = np.cumsum(capacity - filled[emptiest])
            released = emptiest[: int(np.searchsorted(waste, (gap + 1) * capacity)) + 1]
            rows["given"] = np.isin(bins, released)
        given = rows["given"].to_numpy(bool)
        for name, some in (("bound", slice(None)), ("kept_bound", ~given), ("given_bound", given)):
            rows[name] = lower_bound(lengths[some], capacity)
        return rows

    return run


COLUMNS = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(found: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of the given pieces."""
    return with_certificate(found, capacity, part_pieces, most_rounds)[0]


def with_certificate(found: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The packed pieces, and the certificate: stage, part, bins, bound (the fewest bins that those pieces can fill).

    Parts are those whose bins are final in a stage; stage 0 without a part is the whole, full pieces included.
    """
    found = written(found, "pieces")
    spark, kind = found.sparkSession, found.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, row long, _part long, given boolean, bound long, kept_bound long, given_bound long"
    full = found.where("sequence_id is not null")
    done, certificates = [full.withColumn("offset", F.lit(0).cast("long")).select(COLUMNS)], []
    open_pieces = found.where("sequence_id is null").drop("sequence_id")
    counts, n_full = np.zeros(capacity + 1, np.int64), 0
    of_length = found.groupBy("length", F.col("sequence_id").isNotNull().alias("full")).agg(F.count("*").alias("c"))
    for r in of_length.collect():  # a row for each length at most, and one for full pieces
        if r["full"]:
            n_full += r["c"]
        else:
            counts[r["length"]] = r["c"]
    n, settled, bound = int(counts.sum()), 0, bound_of_counts(counts, capacity)
    bins_before, given = None, None

    def finish(rows: DataFrame, stage: int, which: str) -> None:
        done.append(rows.select(COLUMNS))
        certificates.append(rows.groupBy(F.lit(stage).alias("stage"), F.col("_part").alias("part")).agg(F.count_distinct("sequence_id").alias("bins"), F.max(which).alias("bound")))

    for stage in range(1, most_rounds + 1):
        if not n:
            break
        parts = -(-n // part_pieces)
        # dealt by a number of the row, anew in each round, so that every partition gets as many of each length
        dealt = open_pieces.withColumn("_part", F.pmod(F.xxhash64("row", "piece", F.lit(stage)), F.lit(parts)).cast("long"))
        last = stage == most_rounds or parts == 1
        empty = F.lit(None).cast("long")
        packed = written(dealt.withColumns({"sequence_id": empty, "offset": empty}).groupBy("_part").applyInPandas(_packer(capacity, stage, last), schema), "packed")
        one = packed.agg(F.count_distinct("sequence_id").alias("bins"), F.count_distinct(F.when(F.col("given"), F.col("sequence_id"))).alias("given_bins"), F.count_if("given").alias("given")).first()
        if bins_before is not None and one["bins"] > bins_before:  # the earlier packing of these pieces was better
            finish(given, stage - 1, "given_bound")
            break
        if last or not one["given"] or one["bins"] == bins_before or settled + one["bins"] == bound:
            finish(packed, stage, "bound")
            settled += one["bins"]
            bins_before = 0
            break
        settled += one["bins"] - one["given_bins"]
        finish(packed.where("not given"), stage, "kept_bound")
        given = packed.where("given")
        open_pieces = given.select("id", "piece", "start", "length", "ids_crc32", "row")
        n, bins_before = one["given"], one["given_bins"]
    out, whole = done[0], settled + (bins_before or 0)
    for more in done[1:]:
        out = out.unionByName(more)
    certificate = spark.createDataFrame([(0, None, whole + n_full, bound + n_full)], "stage int, part long, bins long, bound long")
    for more in certificates:
        certificate = certificate.unionByName(more)
    return out, certificate


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity).withColumnRenamed("id", id_col)
