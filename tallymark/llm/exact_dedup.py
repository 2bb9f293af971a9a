"""Exact copies by distributed MSD radix partitioning.

Documents are split by successive bytes until a group holds one document or its documents have ended; two texts are
equal when they ended in the same group, so no digest decides anything.

1. Every task splits the rows it reads, some tens of MB at a time, by radix. Copies met together keep one
   representative with a count, so a text that a third of all rows share shrinks before anything is shuffled.
2. A census finds prefixes that too many representatives share and splits those, and only those, by further bytes,
   until each bucket is small or can't be split. Heavy prefixes stay a table of one number each (a hash, which only
   places texts: two prefixes of one hash are split alike).
3. A bucket that stays heavy holds copies of one long or frequent text. Its representatives are merged first, in groups of
   bounded bytes, so that of such a text no more go to one task than there are groups.
4. Representatives are shuffled once by their bucket. Each task ends the recursion inside its buckets.

Null texts count as empty, and empty texts are equal. Of equal texts the row with the largest id stays; rows without
an id come last, and of rows equal in text and id exactly one stays. Columns beyond id and text are carried along,
whatever their names. An empty table gives no rows. Very long texts are compared whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_place, written

FIRST_BYTES = 16
GROWTH = 4
FLUSH_BYTES = 32 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKET_BYTES = 64 << 10


def radix_groups(texts: list[bytes], stride: int = FIRST_BYTES) -> list[list[int]]:
    """Positions of equal texts together, by most significant bytes first."""
    done, stack = [], [(list(range(len(texts))), 0, stride)]
    while stack:
        members, depth, width = stack.pop()
        if len(members) == 1:
            done.append(members)
            continue
        buckets: dict[bytes, list[int]] = defaultdict(list)
        for i in members:
            buckets[texts[i][depth : depth + width]].append(i)
        for piece, inside in buckets.items():
            if len(inside) == 1 or len(piece) < width:  # alone, or all have ended
                done.append(inside)
            else:
                stack.append((inside, depth + width, min(width * GROWTH, 1 << 16)))
    return done


def _first(ids: list, uids: list, members: list[int]) -> int:
    """The position that stays: largest id, ties to the row read first."""
    return max(members, key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, -uids[i]))


def _local(id_col: str):
    """Rows with `_uid`, `_rep` (the uid of the local representative), and, for representatives, `_text` and `_n`."""

    def flush(tables: list[pa.RecordBatch], start: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables).combine_chunks()
        texts = table.column("_text").to_pylist()
        ids = table.column(id_col).to_pylist()
        n = len(texts)
        uids = list(range(start, start + n))
        rep, count = [0] * n, [0] * n
        for members in radix_groups(texts):
            keeper = _first(ids, uids, members)
            count[keeper] = len(members)
            for i in members:
                rep[i] = uids[keeper]
        kept = [t if c else None for t, c in zip(texts, count, strict=True)]
        arrays = [table.column(name) for name in table.column_names if name != "_text"]
        full = pa.table([*arrays, pa.array(uids, pa.int64()), pa.array(rep, pa.int64()), pa.array(kept, pa.binary()), pa.array(count, pa.int64())], names=[*[n for n in table.column_names if n != "_text"], "_uid", "_rep", "_text", "_n"])
        return full.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield flush(held, at)
                at += sum(b.num_rows for b in held)
                held, size = [], 0
        if held:
            yield flush(held, at)

    return run


def _global(id_col: str, carried: list[str], whole_rows: bool):
    """Ends the recursion inside buckets; rows come sorted by bucket."""

    def keeper(members: list[tuple]) -> tuple:
        return max(members, key=lambda m: (m[1] is not None, m[1] if m[1] is not None else 0, -m[0]))

    def kept_rows(groups: list[tuple]) -> pa.RecordBatch:
        rows = [keeper(members)[3] for _, members in groups]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(type_of)], names=carried)

    def decisions(groups: list[tuple]) -> pa.RecordBatch:
        rows = []
        for text, members in groups:
            keep, size, digest = keeper(members), sum(m[2] for m in members), hashlib.sha256(text).hexdigest()
            rows += [(m[0], keep[0], keep[1], size, digest) for m in members]
        kinds = {"_rep": pa.int64(), "_keep_uid": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "text_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    type_of: list[pa.DataType] = []

    def collapse(texts: list[bytes], members: list[list]) -> tuple[list[bytes], list[list]]:
        merged_texts, merged = [], []
        for group in radix_groups(texts):
            merged_texts.append(texts[group[0]])
            merged.append([m for i in group for m in members[i]])
        return merged_texts, merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        members: list[list] = []
        size, last, floor = 0, None, FLUSH_BYTES

        def finish() -> pa.RecordBatch:
            return (kept_rows if whole_rows else decisions)(list(zip(*collapse(texts, members), strict=True)))

        for batch in batches:
            type_of[:] = [batch.schema.field(c).type for c in carried] if whole_rows else []
            cols = {n: batch.column(n).to_pylist() for n in ("_bucket", "_uid", "_text", "_n", id_col)}
            other = list(zip(*[batch.column(c).to_pylist() for c in carried], strict=True)) if whole_rows else [None] * batch.num_rows
            for bucket, uid, text, n, key, row in zip(*cols.values(), other, strict=True):
                if bucket != last and size >= FLUSH_BYTES // 4:
                    yield finish()
                    texts, members, size, floor = [], [], 0, FLUSH_BYTES
                last = bucket
                texts.append(text)
                members.append([(uid, key, n, row)])
                size += len(text) + 100
                if size > floor:  # one bucket of many copies: keep each text once
                    texts, members = collapse(texts, members)
                    size = sum(len(t) + 100 * len(m) for t, m in zip(texts, members, strict=True))
                    floor = max(FLUSH_BYTES, 2 * size)
        if texts:
            yield finish()

    return run


def _buckets(reps: DataFrame) -> DataFrame:
    """`_bucket`: a placement number of the shortest prefix that isn't heavy. Equal texts get equal buckets."""
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.length("_text")
    total = reps.agg(F.sum(length)).first()[0] or 0
    limit = max(LEAST_BUCKET_BYTES, min(BUCKET_BYTES, total // (4 * parts)))
    prefix = lambda d: F.xxhash64(F.substring("_text", 1, d))
    levels, width = [], FIRST_BYTES
    while True:
        at = reps.select(length.alias("_l"), prefix(width).alias("_p"), *[prefix(w).alias(f"_p{i}") for i, (w, _) in enumerate(levels)])
        for i, (_, table) in enumerate(levels):
            at = at.join(table, f"_p{i}", "left_semi")
        heavy = at.groupBy("_p").agg(F.sum("_l").alias("w"), F.max("_l").alias("l")).where((F.col("w") > limit) & (F.col("l") > width))
        heavy = written(heavy.select(F.col("_p").alias(f"_p{len(levels)}")), "heavy-prefixes")
        if not heavy.limit(1).count():
            break
        levels.append((width, heavy))
        width *= GROWTH
    out, key = reps, prefix(FIRST_BYTES)
    for i, (width, table) in enumerate(levels):
        out = out.withColumn(f"_p{i}", prefix(width)).join(table.withColumn(f"_h{i}", F.lit(True)), f"_p{i}", "left")
        key = F.when(F.col(f"_h{i}"), prefix(width * GROWTH)).otherwise(key)
    return out.withColumn("_bucket", key).drop(*[f"_{x}{i}" for i in range(len(levels)) for x in "ph"])


def _representatives(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, list[str]]:
    """Rows by place (c0, c1, ...) with what the first pass adds; the id's column; the columns other than the text."""
    named = by_place(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    others = [c for c in named.columns if c != text]
    source = named.select(*others, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), F.col(text).isNull().alias("_null"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "_text"] + [T.StructField("_uid", T.LongType()), T.StructField("_rep", T.LongType()), T.StructField("_text", T.BinaryType()), T.StructField("_n", T.LongType())])
    return written(source.mapInArrow(_local(key), schema), "radix"), key, others


def _merging(id_col: str, schema: pa.Schema):
    """Of equal texts of a task's rows one keeps its text and counts for all; others get its uid as `_into`, and no text."""

    def merged(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        texts, ids, uids, counts = (table.column(c).to_pylist() for c in ("_text", id_col, "_uid", "_n"))
        into, total = list(uids), list(counts)
        kept = list(texts)
        for members in radix_groups(texts):
            keeper = _first(ids, uids, members)
            total[keeper] = sum(counts[i] for i in members)
            for i in members:
                if i != keeper:
                    into[i], kept[i] = uids[keeper], None
        made = {"_text": pa.array(kept, pa.binary()), "_n": pa.array(total, pa.int64()), "_into": pa.array(into, pa.int64())}
        return pa.RecordBatch.from_arrays([made[n] if n in made else table.column(n).combine_chunks() for n in schema.names], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield merged(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield merged(pa.Table.from_batches(held))

    return run


def _placed(reps: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Representatives with their bucket, and, where copies of hot texts were merged, _rep -> _into of those that went.

    A bucket over twice the bytes that a bucket may have couldn't be split, so it holds copies.
    """
    placed = _buckets(reps)
    heavy = placed.groupBy("_bucket").agg(F.ceil(F.sum(F.length("_text")) / BUCKET_BYTES).cast("int").alias("_groups")).where("_groups > 2")
    heavy = written(heavy, "heavy-buckets")
    if not heavy.limit(1).count():
        return placed, None
    salted = placed.join(heavy, "_bucket").withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.col("_groups")))
    columns = [f for f in placed.schema.fields] + [T.StructField("_into", T.LongType())]
    schema = T.StructType(columns)
    dealt = salted.repartition("_bucket", "_salt").select(*placed.columns)
    merged = written(dealt.mapInArrow(_merging(key, to_arrow_schema(schema)), schema), "merged")
    gone = merged.where("_text is null").select(F.col("_uid").alias("_rep"), "_into")
    rest = placed.join(heavy.select("_bucket"), "_bucket", "left_anti").select(*placed.columns)
    return rest.unionByName(merged.where("_text is not null").select(*placed.columns)), gone


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows, key, _ = _representatives(docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").alias(text_col)), id_col, text_col)
    reps = rows.where("_n > 0").select(key, "_uid", "_text", "_n")
    placed, gone = _placed(reps, key)
    placed = placed.repartition("_bucket").sortWithinPartitions("_bucket")
    found = placed.mapInArrow(_global(key, [], False), "_rep long, _keep_uid long, keep_id long, group_size long, text_sha256 string")
    if gone is not None:
        found = written(found, "decisions")
        found = found.unionByName(gone.join(found.withColumnRenamed("_rep", "_into"), "_into").select(*found.columns))
    return rows.select(key, "_uid", "_rep").join(found, "_rep").select(F.col(key).alias(id_col), "keep_id", "group_size", (F.col("_uid") == F.col("_keep_uid")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; texts travel once."""
    rows, key, others = _representatives(docs, id_col, text_col)
    reps = rows.where("_n > 0").drop("_rep")
    placed, _ = _placed(reps, key)
    placed = placed.repartition("_bucket").sortWithinPartitions("_bucket")
    carried = [*others, "_text", "_null"]
    schema = T.StructType([reps.schema[c] for c in carried])
    kept = placed.mapInArrow(_global(key, carried, True), schema)
    text = F.when(~F.col("_null"), F.col("_text").cast("string"))
    return kept.select(*[(text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
