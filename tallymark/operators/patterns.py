"""Many constant texts looked for in many long ones, in one pass over each: an Aho-Corasick automaton a chunk of patterns.

Patterns are a table. Distinct ones are dealt by hash into chunks of about `CHUNK_BYTES`; a chunk goes to every task as one
automaton and all texts are read once for it. So what a task holds is bounded however many patterns there are, and more
patterns mean more passes, not larger tasks. What is found is exactly what `contains` of each pattern would find.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept

CHUNK_BYTES = 4 << 20
#: Rows of finds that a task gives out at once.
FLUSH_ROWS = 20_000


def occurrences(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep, pattern, n: how often each pattern that occurs stands in a text, overlapping occurrences of it not counted.

    Null and empty patterns and texts give nothing; repeated patterns count once; repeated texts give repeated rows.
    """
    spark = texts.sparkSession
    known = kept(patterns.select(F.col(pattern).alias("p")).where("length(p) > 0").distinct())
    total = known.agg(F.sum(F.octet_length("p") + 8)).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    picked = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("t")).where("t is not null")
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("p", T.StringType()), T.StructField("n", T.LongType())])
    found = []
    for chunk in range(chunks):
        some = [r["p"] for r in known.where(F.pmod(F.xxhash64("p"), F.lit(chunks)) == chunk).collect()]  # CHUNK_BYTES, about
        if some:
            found.append(picked.mapInArrow(_finder(spark.sparkContext.broadcast(some), schema.names), schema))
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return every.toDF(*keep, pattern, "n")


def _finder(patterns, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        own, automaton = patterns.value, ahocorasick.Automaton()
        for i, p in enumerate(own):
            automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()

        def out(batch: pa.RecordBatch, rows: list[int], which: list[int], counts: list[int]) -> pa.RecordBatch:
            taken = batch.take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array([own[i] for i in which], pa.string()), pa.array(counts, pa.int64())], names=names)

        for batch in batches:
            rows, which, counts = [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ends: dict[int, int] = {}
                times: dict[int, int] = {}
                for end, (i, length) in automaton.iter(text):
                    if end - length >= ends.get(i, -1):
                        ends[i] = end
                        times[i] = times.get(i, 0) + 1
                rows += [row] * len(times)
                which += times
                counts += times.values()
                if len(rows) >= FLUSH_ROWS:
                    yield out(batch, rows, which, counts)
                    rows, which, counts = [], [], []
            if rows:
                yield out(batch, rows, which, counts)

    return run
