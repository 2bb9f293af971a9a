"""Session factory with the settings that the queries assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", app: str = "tallymark", **conf: str) -> SparkSession:
    """UTC, adaptive execution and a partition count that suits a small machine; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by columns to as many tasks as a shuffle has: rows of few bytes and much work come in few otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, not to be sent through the driver.

    Spark takes a table's packed files for its size, and what is exploded from it for no larger: at a few MB of files that
    is millions of rows in the driver. So joins of such sides are sorted shuffles.
    """
    return df.hint("merge")


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder of spark.checkpoint.dir, without their lineage, so that later steps don't compute
    them again and depend on no executor.

    Where no folder is set, one of our own, on a local master only.
    """
    spark = df.sparkSession
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    path = f"{(folder or context.getCheckpointDir()).rstrip('/')}/kept-{uuid.uuid4().hex}"
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any names can be written so
    named.write.parquet(path)
    return spark.read.schema(named.schema).parquet(path).toDF(*df.columns)
