"""What several operators share: the shared folder, cut lineage and sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a folder of our own, on a local master only: on a cluster each machine would have its own.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
        set_to = context.getCheckpointDir()
    return set_to.rstrip("/")


#: Folders made in each `scratch` that is open, the innermost last.
_made: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the intermediate tables that operators wrote inside: their results must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: later steps depend on no executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder by Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scheme_of(spark: SparkSession, path: str) -> str:
    """The scheme of the store that a path lies in, as Hadoop resolves it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()


def by_place(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ... by place, so that columns of our own can't clash with a user's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def prefix_sums(totals: DataFrame, key: str, value: str, width: int = 1024) -> DataFrame:
    """key, before: the sum of `value` over smaller keys (whole numbers from 0, one row each).

    Keys are summed in ranges, ranges in ranges of ranges, so no task reads more than `width` rows of one range.
    """
    if width < 2:
        raise ValueError("ranges hold two keys at least")
    own = totals.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    upper = F.floor(F.col("_k") / width)
    inside = Window.partitionBy(upper).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    near = own.select("_k", upper.alias("_range"), F.coalesce(F.sum("_v").over(inside), F.lit(0)).cast("long").alias("_near"))
    ranges = written(own.groupBy(upper.alias("_r")).agg(F.sum("_v").cast("long").alias("_s")), "range-sums")
    if ranges.where("_r > 0").limit(1).count() == 0:
        return near.select(F.col("_k").alias(key), F.col("_near").alias("before"))
    far = prefix_sums(ranges, "_r", "_s", width).select(F.col("_r").alias("_range"), F.col("before").alias("_far"))
    return near.join(far, "_range").select(F.col("_k").alias(key), (F.col("_near") + F.col("_far")).alias("before"))


def numbered(df: DataFrame, order: list[Column], number: str, name: str) -> DataFrame:
    """The rows with their place from 0 in the total order of `order`: ranges of it are sorted and written once, a row's
    place is its place in its file after the rows of earlier files. No range holds a key's rows together, so no key is
    too frequent. Rows equal in `order` come in any order.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = spark.read.schema(df.schema).parquet(path).select("*", part.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = prefix_sums(rows.groupBy("_file").agg(F.count("*").alias("_rows")), "_file", "_rows")
    return rows.join(before, "_file").select(*df.columns, (F.col("before") + F.col("_row")).alias(number))


def crc_remainder(column, modulus: int):
    """crc32 of the value as text, modulo a number: a stable split of rows."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
