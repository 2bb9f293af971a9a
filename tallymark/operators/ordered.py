"""Operators that depend on an explicit order: contexts, islands, first and latest rows, running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import kept


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; ties must be broken by the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# ---- scans of keys of any size: ranges are scanned apart, a row a range says what came before it


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of keys and order, kept, with the range's number: a key with very many rows lies in several."""
    return kept(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def _inside(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_range").orderBy(*order)


def _with_carry(rows: DataFrame, keys: list[str], of_range: Column, fold: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds what earlier ranges of the key leave: fold of their summaries in order; null where there are none."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    summaries = rows.groupBy(*keys, "_range").agg(of_range.alias("_s"))
    left = summaries.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), fold(F.col("_s")).over(before).alias(name), F.count("*").over(before).alias("_earlier")).where("_earlier > 0").drop("_earlier")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # a key that goes on from an earlier range is the first of its range: a row a range at most
    return rows.join(F.broadcast(left), same, "left").drop("_r", *[f"_k{i}" for i in range(len(keys))])


def last_marked(rows: DataFrame, keys: list[str], order: list[str], marker: Column, name: str, before: bool = False) -> DataFrame:
    """Adds the last marker that isn't null up to the row, or before it. rows: as in_ranges gives them."""
    marked = rows.withColumn("_marker", marker)
    last = F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.struct(*order)))
    carried = _with_carry(marked, keys, last, lambda s: F.last(s, ignorenulls=True), "_carry")
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return carried.withColumn(name, F.coalesce(F.last("_marker", ignorenulls=True).over(w), F.col("_carry"))).drop("_marker", "_carry")


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds a struct of the columns of the row before; null on a key's first row."""
    own = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    carried = _with_carry(rows, keys, F.max_by(own, F.struct(*order)), lambda s: F.last(s, ignorenulls=True), "_carry")
    return carried.withColumn(name, F.coalesce(F.lag(own).over(_inside(keys, order)), F.col("_carry"))).drop("_carry")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum up to the row."""
    counted = rows.withColumn("_amount", amount)
    carried = _with_carry(counted, keys, F.sum("_amount"), lambda s: F.sum(s), "_carry")
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(name, F.sum("_amount").over(w) + F.coalesce("_carry", F.lit(0))).drop("_amount", "_carry")


def running_min(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the least value up to the row; nulls don't count."""
    valued = rows.withColumn("_value", value)
    carried = _with_carry(valued, keys, F.min("_value"), lambda s: F.min(s), "_carry")
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(name, F.array_min(F.array(F.min("_value").over(w), "_carry"))).drop("_value", "_carry")


def mark_first(df: DataFrame, keys: list[str], order: list, name: str = "is_first") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by aggregation: no key has to be sorted."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def heading_context(lines: DataFrame, keys: list[str], order: list[str], name: str = "ctx") -> DataFrame:
    """Carries the object of the last object heading; another heading of the same or a higher level ends it.

    lines: object (of an object heading, else null), level (of any heading, else null).
    """
    level = F.when(F.col("object").isNotNull(), F.col("level"))
    seen = last_marked(in_ranges(lines, keys, order), keys, order, level, "_seen", before=True)
    marker = F.when(F.col("object").isNotNull(), F.col("object")).when(F.col("level").isNotNull() & (F.col("level") <= F.col("_seen")), F.lit(""))
    return last_marked(seen, keys, order, marker, name).withColumn(name, F.nullif(name, F.lit(""))).drop("_seen", "_range")


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, clears: Column, name: str) -> DataFrame:
    """The last value set and not cleared since."""
    marker = F.when(clears, F.lit("")).otherwise(value)
    return last_marked(in_ranges(df, keys, order), keys, order, marker, name).withColumn(name, F.nullif(name, F.lit(""))).drop("_range")


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str], name: str = "island") -> DataFrame:
    """Numbers runs of neighbouring rows with equal values."""
    rows = previous(in_ranges(df, keys, order), keys, order, same, "_before")
    own = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(same)])
    begins = (F.col("_before").isNull() | ~own.eqNullSafe(F.col("_before"))).cast("int")
    return running_sum(rows, keys, order, begins, name).drop("_before", "_range")


def continuation_tables(tables: DataFrame, between: DataFrame) -> DataFrame:
    """Tables that go on over pages: the same header as the table before and no line but furniture in between.

    tables: doc_id, table_no, header; between: doc_id, table_no, n_lines (lines before the table that are no furniture).
    """
    keys, order = ["doc_id"], ["table_no"]
    rows = previous(in_ranges(tables.join(between, ["doc_id", "table_no"], "left"), keys, order), keys, order, ["header"], "_before")
    goes_on = F.col("_before").isNotNull() & F.col("header").eqNullSafe(F.col("_before.v0")) & (F.coalesce("n_lines", F.lit(0)) == 0)
    return running_sum(rows, keys, order, (~goes_on).cast("int"), "merged_no").drop("_before", "n_lines", "_range")


def running_number(df: DataFrame, keys: list[str], order: list[str], counts: Column, name: str) -> DataFrame:
    """A number for rows that count; others get null."""
    rows = in_ranges(df.withColumn("_counts", F.coalesce(counts, F.lit(False))), keys, order)
    return running_sum(rows, keys, order, F.col("_counts").cast("int"), name).withColumn(name, F.when(F.col("_counts"), F.col(name))).drop("_counts", "_range")


def label_above(df: DataFrame, keys: list[str], order: list[str], label: str, name: str) -> DataFrame:
    rows = previous(in_ranges(df, keys, order), keys, order, [label], "_before")
    return rows.withColumn(name, F.coalesce(F.col(label), F.col("_before.v0"))).drop("_before", "_range")


def rolling_count(df: DataFrame, keys: list[str], ts: str, seconds: int, name: str) -> DataFrame:
    """Rows of the key in the window of time that ends at the row, the row included.

    A key's rows are cut by time into stretches as long as the window; a stretch also reads the one before it, so a key
    with very many rows is spread over as many tasks as it has stretches.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    stretch = F.floor(at / span)
    copies = F.explode(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own")))).alias("_in")
    w = Window.partitionBy(*keys, "_in.stretch").orderBy("_at").rangeBetween(-span, 0)
    return df.select("*", at.alias("_at"), copies).where("_in.own or _at is not null").withColumn(name, F.count("*").over(w)).where("_in.own").drop("_at", "_in")


def numbered(df: DataFrame, group: Column, value: str, name: str = "number", width: int = 65_536) -> DataFrame:
    """Numbers 1, 2, ... over all rows in order of group and a whole-number column, without one task sorting them all.

    Values are cut into ranges; rows are numbered inside a range, and a range begins where those before it end. Ranges
    are summed in wider ranges, so only a table smaller by the square of the width passes one task. Rows of equal group
    and value are numbered in any order.
    """
    ranged = df.withColumn("_group", group).withColumn("_range", F.floor(F.col(value) / width))
    of_range = kept(ranged.groupBy("_group", "_range").agg(F.count("*").alias("_rows"))).withColumn("_wide", F.floor(F.col("_range") / width))
    before = lambda w: F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = of_range.groupBy("_group", "_wide").agg(F.sum("_rows").alias("_rows")).withColumn("_far", before(Window.orderBy("_group", "_wide"))).drop("_rows")
    near = of_range.withColumn("_near", before(Window.partitionBy("_group", "_wide").orderBy("_range")))
    starts = near.join(wide, ["_group", "_wide"]).select("_group", "_range", (F.col("_near") + F.col("_far")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(value))
    return ranged.withColumn("_inside", inside).join(starts, ["_group", "_range"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_group", "_range", "_inside", "_start")
