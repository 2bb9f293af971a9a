"""Scores of predictions against gold: slots, values, multisets, intervals, and one-to-one matching."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept


def slot_counts(want: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn of every slot, as 0 or 1; slots are distinct."""
    w, g = want.select(*keys).distinct().withColumn("_w", F.lit(1)), got.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = w.join(g, keys, "full_outer").na.fill(0, ["_w", "_g"])
    return both.select(*keys, (F.col("_w") * F.col("_g")).cast("long").alias("tp"), ((1 - F.col("_w")) * F.col("_g")).cast("long").alias("fp"), (F.col("_w") * (1 - F.col("_g"))).cast("long").alias("fn"))


def precision(tp="tp", fp="fp") -> Column:
    return F.try_divide(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return F.try_divide(F.col(tp), F.col(tp) + F.col(fn))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """Null only for an empty slice; 0 where something was expected or said and nothing met."""
    return F.try_divide(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def prf_by(counts: DataFrame, sets: list[list[str]], columns: list[str], digits: int = 5, zero: bool = False) -> DataFrame:
    """Precision, recall and F1 over grouping sets. zero: 0 instead of null on empty denominators."""
    some = counts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    last = lambda x: F.round(F.coalesce(x, F.lit(0.0)) if zero else x, digits)
    return some.select(*columns, "tp", "fp", "fn", last(precision()).alias("p"), last(recall()).alias("r"), last(f1()).alias("f1"))


def value_counts(gold: DataFrame, said: DataFrame, keys: list[str], value: str, within: float = 1e-6) -> DataFrame:
    """One value a slot: a wrong value is a false positive and a false negative at once."""
    joined = gold.select(*keys, F.col(value).alias("_g")).join(said.select(*keys, F.col(value).alias("_s")), keys, "full_outer")
    right = F.coalesce(F.abs(F.col("_g") - F.col("_s")) <= within, F.lit(False))
    return joined.select(*keys, right.cast("long").alias("tp"), (F.col("_s").isNotNull() & ~right).cast("long").alias("fp"), (F.col("_g").isNotNull() & ~right).cast("long").alias("fn"))


def multiset_matches(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs the n-th row of a key on one side with the n-th on the other, by counts: no pairs of all rows."""
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return number(left).join(number(right).select(*keys, "_n"), [*keys, "_n"], "left_semi").drop("_n")


#: Numbers of 32 bits below which a Poisson(1) count is 0, at most 1, at most 2, ...
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))) for i in range(12)]
#: Multipliers of the mixing steps.
MIX_KEY, MIX_ITERATION, MIX_1, MIX_2 = 2654435761, 2246822519, 2246822507, 3266489909
#: Groups whose sums a task holds at once.
HELD_GROUPS = 64


def resampling_weights(keys: np.ndarray, iterations: int) -> np.ndarray:
    """How often each set (rows) is drawn in each iteration (columns): a Poisson(1) count from a hash of both numbers."""
    mask, key = np.uint64(0xFFFFFFFF), keys.astype(np.uint64)
    h = (key[:, None] * np.uint64(MIX_KEY) + np.arange(iterations, dtype=np.uint64) * np.uint64(MIX_ITERATION)) & mask
    h ^= h >> np.uint64(16)
    h = h * np.uint64(MIX_1) & mask
    h ^= h >> np.uint64(13)
    h = h * np.uint64(MIX_2) & mask
    h ^= h >> np.uint64(16)
    return np.searchsorted(np.array(POISSON, np.uint64), h, side="right")


def resampled_counts(counts: DataFrame, key: str, by: list[str], iterations: int) -> DataFrame:
    """by, iteration, tp, fp, fn: weighted sums over all sets, one array of iterations a group and task, then added.

    counts: by, key (a set's number from 0 to 2^32 - 1, distinct in its group), tp, fp, fn. A set's weights depend on its
    number alone, so any partitioning and any order give the same sums.
    """
    picked = counts.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.pmod(F.col(key).cast("long"), F.lit(2**32)).alias("key"), *[F.col(c).cast("long") for c in ("tp", "fp", "fn")])
    groups = [f"g{i}" for i in range(len(by))]
    schema = T.StructType([*[picked.schema[g] for g in groups], *[T.StructField(n, T.LongType()) for n in ("iteration", "tp", "fp", "fn")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for group, total in sums.items():
                same = [pa.array([v] * iterations, k) for v, k in zip(group, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(iterations), pa.int64()), *[pa.array(total[:, i]) for i in range(3)]], names=schema.names)
            sums.clear()

        for batch in batches:
            kinds[:] = [batch.schema.field(g).type for g in groups]
            numbers = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("tp", "fp", "fn")], axis=1).astype(np.int64)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            members: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*[batch.column(g).to_pylist() for g in groups], strict=True) if groups else [()] * batch.num_rows):
                members.setdefault(group, []).append(i)
            for group, rows in members.items():
                if group not in sums and len(sums) >= HELD_GROUPS:
                    yield from flush()
                total = sums.setdefault(group, np.zeros((iterations, 3), np.int64))
                for low in range(0, len(rows), 1024):
                    some = rows[low : low + 1024]
                    total += resampling_weights(keys[some], iterations).T @ numbers[some]
        yield from flush()

    added = picked.mapInArrow(run, schema).groupBy(*groups, "iteration").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return added.toDF(*by, "iteration", "tp", "fp", "fn")


def bootstrap_f1(counts: DataFrame, key: str = "set_no", by: list[str] | None = None, iterations: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, low, high: percentiles of F1 over resampled sets; null where no resample expects or says anything.

    Sets are drawn by independent Poisson counts, the form of the bootstrap that needs no number of sets beforehand and no
    set in two tasks. Resamples in which nothing is expected or said have no F1 and don't count.
    """
    by = by or []
    scores = resampled_counts(counts, key, by, iterations).select(*by, f1().alias("f1"))
    ordered = scores.groupBy(*by).agg(F.sort_array(F.collect_list("f1")).alias("s"))  # as many numbers as iterations
    at = lambda q: F.get("s", F.floor(F.lit(q) * (F.size("s") - 1)).cast("int"))
    return ordered.select(*by, at(low).alias("low"), at(high).alias("high"))


def scoreboard(counts: DataFrame, set_col: str, key: Column, by: list[str], sets: list[list[str]], iterations: int = 1000) -> DataFrame:
    """Of each slice of the grouping sets: by, sets, tp, fp, fn, p, r, f1, low, high, fp_per_set.

    counts: slots with by, set_col, tp, fp, fn; key numbers a set of a slice. A column that a slice ranges over is null.
    """
    slices = F.explode(F.array(*[F.struct(*[(F.col(c).cast("string") if c in some else F.lit(None).cast("string")).alias(c) for c in by]) for some in sets]))
    each = counts.select(F.col(set_col).alias("_set"), key.alias("_key"), slices.alias("_by"), "tp", "fp", "fn")
    of_set = each.groupBy("_by", "_set", "_key").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select("_set", "_key", "tp", "fp", "fn", F.to_json("_by").alias("_slice"), *[F.col(f"_by.{c}").alias(c) for c in by])
    total = of_set.groupBy("_slice", *by).agg(F.count("*").alias("sets"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    interval = bootstrap_f1(of_set, "_key", ["_slice"], iterations)
    return total.join(interval, "_slice", "left").select(*by, "sets", "tp", "fp", "fn", precision().alias("p"), recall().alias("r"), f1().alias("f1"), "low", "high", (F.col("fp") / F.col("sets")).alias("fp_per_set"))


#: Pairs of a group that one task may choose from; larger groups go by rounds of joins until they are as small.
GROUP_PAIRS = 100_000


def greedy_one_to_one(pairs: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """Best score first, then greater ids; each side is used once. Groups are the pairs of one document.

    In large groups, a pair that is the best of both its sides is taken, and its rivals are removed, in rounds: that is
    what the choice in order takes, since no pair before it can use its sides. Of rows alike in sides and score, both ways
    keep the one with the greatest hash of all its columns.
    """
    columns = pairs.columns
    pairs = pairs.withColumn("_tie", F.xxhash64(*columns))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, left, right, "_tie"], ascending=False, kind="stable")
        used_left, used_right, keep = set(), set(), []
        for row in rows.itertuples():
            a, b = getattr(row, left), getattr(row, right)
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                keep.append(row.Index)
        return rows.loc[keep]

    def same(columns: list[str], a: str, b: str):
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])

    sized = lambda df: df.groupBy(*group).agg(F.count("*").alias("_n"))
    large = sized(pairs).where(F.col("_n") > GROUP_PAIRS)
    if not large.limit(1).count():
        return pairs.groupBy(*group).applyInPandas(choose, pairs.schema).drop("_tie")
    done, rest = [], pairs
    while True:
        large = sized(rest).where(F.col("_n") > GROUP_PAIRS).drop("_n")
        small = rest.alias("r").join(large.alias("l"), same(group, "r", "l"), "left_anti")
        done.append(kept(small.groupBy(*group).applyInPandas(choose, pairs.schema)))
        rest = rest.alias("r").join(large.alias("l"), same(group, "r", "l"), "left_semi").select("r.*")
        rest = kept(rest.groupBy(*group, left, right, score).agg(F.max_by(F.struct(*pairs.columns), "_tie").alias("_row")).select("_row.*"))
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, done).drop("_tie")
        rank = F.struct(F.when(~F.isnan(F.col(score).cast("double")), F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"), F.col("_tie").alias("t"))
        best = lambda side: rest.groupBy(*group, side).agg(F.max(rank).alias("_best"))
        of_left, of_right = best(left), best(right)
        both = of_left.alias("a").join(of_right.alias("b"), same([*group, "_best"], "a", "b"), "left_semi")
        both = kept(both.select(*group, F.col("_best.l").alias(left), F.col("_best.r").alias(right)))
        # pairs with equal sides and another score are rivals, so the best score is kept
        taken = rest.alias("r").join(both.alias("t"), same([*group, left, right], "r", "t"), "left_semi")
        one = taken.groupBy(*group, left, right).agg(F.max_by(F.struct(*pairs.columns), rank).alias("_row"))
        done.append(kept(one.select("_row.*")))
        rest = rest.alias("r").join(both.alias("t"), same([*group, left], "r", "t"), "left_anti")
        rest = kept(rest.alias("r").join(both.alias("t"), same([*group, right], "r", "t"), "left_anti"))
