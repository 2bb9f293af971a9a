"""Shards of nearly equal bytes, by a k-d tree over what is known of documents.

Documents with equal texts are one item of the tree and stay together, so no text lies in two shards. An item has the sum
of its documents' bytes and the smallest value of each dimension (numbers, or strings by their first bytes), on a common
scale from 0 to 2^31 - 1.

1. Items that hold more than an equal share each get a shard of their own (as many rows as shards at most).
2. All nodes of a level are split at once: along the dimension in which a node is widest, at the weighted median (the
   quantile that leaves whole shards on both sides). Medians come from histograms over ranges of keys that are refined
   around the quantile, until the range holds a five-hundredth of a shard or one item; rows equal in the dimension are told
   apart by a hash of their text. Sums are combined in tasks first, and a histogram has at most `BINS` rows a node.
3. Documents get their item's shard by a join on the text's digest. The few items that hold a thousandth of all documents
   or more (a thousand rows at most) are known to every task, so their documents need not meet in one.
4. Documents are written as one folder a shard. A row's slot is its place in its file after the rows of earlier files.

With `target_bytes`, the tree goes on until leaves have at most about so many bytes. Sizes are UTF-8 bytes plus one. Null
texts count as empty and equal; null and non-finite values of a dimension come first. Shards stay empty where there are
fewer texts than shards. Repeated rows are kept. Very long texts are read whole and count by their bytes. An empty table
gives empty shards. All columns are written, whatever their names; names of our own are by place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, fresh_path, written

BINS = 4096
SPREAD = 2**31 - 1
#: Of an equal share: histograms stop when the range around the quantile holds no more.
TOLERANCE = 1 / 500
HOT_SHARE = 1000


def _number(column: Column, kind: T.DataType) -> Column:
    """A dimension's value as a finite double or null; strings and binaries in the order of their first seven bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0")
        return F.conv(raw, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        column = F.datediff(column, F.lit("1970-01-01").cast("date"))
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _items(docs: DataFrame, text: str, dims: list[str]) -> DataFrame:
    """digest, w, n, c0, c1, ... (coordinates), t (hash): a row for each different text."""
    values = {f"v{i}": _number(F.col(d), docs.schema[d].dataType) for i, d in enumerate(dims)}
    rows = docs.select(_digest(F.col(text)).alias("digest"), _size(F.col(text)).alias("_s"), *[v.alias(n) for n, v in values.items()])
    raw = written(rows.groupBy("digest").agg(F.sum("_s").alias("w"), F.count("*").alias("n"), *[F.min(n).alias(n) for n in values]), "shard-items")
    ends = raw.agg(*[f(n).alias(f"{n}{e}") for n in values for e, f in (("l", F.min), ("h", F.max))]).first() if values else {}

    def scaled(n: str) -> Column:
        low, high = ends[f"{n}l"], ends[f"{n}h"]
        if low is None or low == high:
            return F.lit(0).cast("long")
        share = (F.col(n) - F.lit(low)) / F.lit(high - low)
        return F.coalesce(F.least(F.lit(SPREAD), F.round(share * SPREAD).cast("long")), F.lit(0)).cast("long")

    tie = F.xxhash64("digest").bitwiseAND(F.lit(SPREAD)).alias("t")
    return raw.select("digest", "w", "n", *[scaled(n).alias(f"c{i}") for i, n in enumerate(values)], tie)


def _key(dims: int) -> Column:
    """The place of an item along its node's dimension; the last is the hash alone."""
    along = reduce(lambda rest, i: F.when(F.col("dim") == i, F.col(f"c{i}")).otherwise(rest), reversed(range(dims)), F.lit(0))
    return along.cast("long") * F.lit(2**31) + F.col("t")


def _cuts(state: DataFrame, dims: int) -> DataFrame:
    """node, dim, cut (keys below it go left), left (leaves of the left side): a row for each node that can be split."""
    open_ = state.where("leaves > 1")
    ends = [f(x).alias(f"{x}{e}") for x in [*[f"c{i}" for i in range(dims)], "t"] for e, f in (("l", F.min), ("h", F.max))]
    nodes = open_.groupBy("node", "leaves").agg(F.sum("w").alias("total"), *ends)
    wide = F.array_max(F.array(*[F.struct((F.col(f"c{i}h") - F.col(f"c{i}l")).alias("width"), F.lit(-i).alias("i")) for i in range(dims)], F.struct(F.lit(0).cast("long").alias("width"), F.lit(-dims).alias("i"))))
    nodes = nodes.select("*", (-wide["i"]).alias("dim"))
    end = lambda e: reduce(lambda rest, i: F.when(F.col("dim") == i, F.col(f"c{i}{e}")).otherwise(rest), reversed(range(dims)), F.lit(0)).cast("long") * F.lit(2**31)
    nodes = nodes.where(F.greatest(F.lit(0), *[F.col(f"{x}h") - F.col(f"{x}l") for x in [*[f"c{i}" for i in range(dims)], "t"]]) > 0)
    goal = F.col("total") * (F.floor(F.col("leaves") / 2) / F.col("leaves"))
    at = written(nodes.select("node", "leaves", "total", "dim", goal.alias("goal"), end("l").alias("lo"), (end("h") + SPREAD).alias("hi"), F.lit(0).cast("long").alias("before"), F.col("total").alias("inside")), "shard-nodes")
    settled = []
    wide_enough = (F.col("lo") < F.col("hi")) & (F.col("inside") > F.col("total") / F.col("leaves") * TOLERANCE)
    while True:
        settled.append(at.where(~wide_enough))
        rest = at.where(wide_enough)
        if not rest.limit(1).count():
            break
        step = F.floor((F.col("hi") - F.col("lo")) / BINS).cast("long") + 1
        among = open_.drop("leaves").join(rest, "node").withColumn("key", _key(dims)).where(F.col("key").between(F.col("lo"), F.col("hi")))
        bins = among.withColumn("bin", F.floor((F.col("key") - F.col("lo")) / step)).groupBy("node", "leaves", "total", "dim", "goal", "before", "bin").agg(F.sum("w").alias("inside"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        running = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows a node
        summed = bins.withColumn("upto", F.col("before") + F.sum("inside").over(running))
        first = summed.where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min_by(F.struct("leaves", "total", "dim", "goal", "lo", "hi", (F.col("upto") - F.col("inside")).alias("before"), "inside"), "bin").alias("x"))
        at = written(first.select("node", "x.leaves", "x.total", "x.dim", "x.goal", "x.lo", "x.hi", "x.before", "x.inside"), "shard-nodes")
    below, above = F.col("before"), F.col("before") + F.col("inside")
    right_of = (below == 0) | ((above < F.col("total")) & (F.abs(above - F.col("goal")) < F.abs(below - F.col("goal"))))
    found = reduce(DataFrame.unionByName, settled).select("*", right_of.alias("_above"))
    found = found.select("node", "dim", "leaves", F.when(F.col("_above"), F.col("hi") + 1).otherwise(F.col("lo")).alias("cut"), (F.when(F.col("_above"), above).otherwise(below) / F.col("total")).alias("share"))
    left = F.greatest(F.lit(1), F.least(F.col("leaves") - 1, F.round(F.col("share") * F.col("leaves")))).cast("int")
    return found.where((F.col("share") > 0) & (F.col("share") < 1)).select("node", "dim", "cut", left.alias("left"))


def shards_of_items(items: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """digest, n, shard. Give the number of shards, or the bytes that a shard should have."""
    total, docs = items.agg(F.sum("w"), F.sum("n")).first()
    leaves = shards or max(1, -(-(total or 0) // target_bytes))
    dims = sum(c[0] == "c" and c[1:].isdigit() for c in items.columns)
    own: list[bytearray] = []
    for digest, w in items.orderBy(F.col("w").desc(), "digest").select("digest", "w").limit(leaves).collect():
        if w * (leaves - len(own)) <= total:
            break
        own.append(digest)
        total -= w
    rest = leaves - len(own)
    known = items.sparkSession.createDataFrame([(bytes(d), rest + i) for i, d in enumerate(own)], "digest binary, own int")
    state = items.join(F.broadcast(known), "digest", "left")  # as many rows as shards at most
    state = written(state.select(*items.columns, F.coalesce(F.col("own"), F.lit(0)).alias("node"), F.when(F.col("own").isNull(), F.lit(rest)).otherwise(1).alias("leaves")), "shard-tree")
    while state.where("leaves > 1").limit(1).count():
        split = state.join(_cuts(state, dims), "node", "left")
        is_left = _key(dims) < F.col("cut")
        node = F.when(F.col("cut").isNull() | is_left, F.col("node")).otherwise(F.col("node") + F.col("left"))
        size = F.when(F.col("cut").isNull(), F.lit(1)).when(is_left, F.col("left")).otherwise(F.col("leaves") - F.col("left"))
        state = written(split.select(*items.columns, node.alias("node"), size.cast("int").alias("leaves")), "shard-tree")
    return state.select("digest", "n", F.col("node").alias("shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dims: list[str] | None = None, text_col: str = "text") -> None:
    """All columns of the documents (c0, c1, ... by place), in one folder a shard."""
    named = by_place(docs)
    place = lambda c: f"c{docs.columns.index(c)}"
    text = place(text_col)
    every = [d for d in (dims if dims is not None else ["lang", "source", "n_chars"]) if d in docs.columns]
    found = shards_of_items(_items(named, text, [place(d) for d in every]), shards, target_bytes)
    n_docs = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") * HOT_SHARE >= n_docs).select(F.col("digest").alias("_hot"), F.col("shard").alias("_hot_shard"))
    rows = named.select("*", _digest(F.col(text)).alias("_digest")).join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left")  # HOT_SHARE rows at most
    alone = F.unhex(F.hex(F.xxhash64(F.monotonically_increasing_id())))  # of eight bytes: equal to no digest
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(alone))
    cold = found.select(F.col("digest").alias("_key"), F.col("shard").alias("_cold_shard"))
    placed = rows.join(cold, "_key", "left").select(*named.columns, F.coalesce("_hot_shard", "_cold_shard").alias("_shard"))
    placed.write.option("compression", "zstd").partitionBy("_shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType, columns: dict[str, Column] | None = None) -> DataFrame:
    """Rows of written shards with shard and slot. columns: what is kept of each row (columns of `schema` by place: c0,
    c1, ...), all by default; a slot's join then carries no more than that."""
    by = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)] + [T.StructField("_shard", T.IntegerType())])
    files = spark.read.schema(by).parquet(path)
    kept = columns or {f.name: F.col(f"c{i}") for i, f in enumerate(schema.fields)}
    rows = files.select(*[v.alias(f"k{i}") for i, v in enumerate(kept.values())], "_shard", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = files.select("_shard", F.col("_metadata.file_path").alias("_file")).groupBy("_shard", "_file").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    before = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.join(before, "_file")
    return joined.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(kept)], F.col("_shard").cast("int").alias("shard"), (F.col("_before") + F.col("_row")).cast("long").alias("slot"))


def shard_table(docs: DataFrame, shards: int = 8, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard, from the shards that were written and read back."""
    path = fresh_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, dims=dims, text_col=text_col)
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    kept = {id_col: key, "size": _size(text), "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary"))}
    placed = read_shards(docs.sparkSession, path, docs.schema, kept)
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
