"""Systems and stages side by side, values held against their anchors, and counts of annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_per
from .scoring import prf_by, slot_counts

#: The object that stands for the whole project, and the field of the number of floors.
PROJECT, FLOORS = "project", "floors"


def compared(gold: DataFrame, systems: dict[str, DataFrame], keys: list[str], sets: list[list[str]], name: str = "system") -> DataFrame:
    """Precision, recall and F1 of each system (or list of stages) over sets of key columns; 0 for empty denominators.

    All systems are counted in one grouping, so an empty set of columns gives each system's total.
    """
    counts = [slot_counts(gold, said, keys).withColumn(name, F.lit(n)) for n, said in systems.items()]
    columns = [name, *dict.fromkeys(c for s in sets for c in s)]
    return prf_by(reduce(DataFrame.unionByName, counts), [[name, *s] for s in sets], columns, zero=True)


def has_prefix(field, prefixes: list[str]) -> Column:
    """Whether a field begins with one of a few constant prefixes; not so for null."""
    found = [F.col(field).startswith(p) if isinstance(field, str) else field.startswith(p) for p in prefixes]
    return F.coalesce(reduce(Column.__or__, found, F.lit(False)), F.lit(False))


def building_values(values: DataFrame, keys: list[str], building: str, prefixes: list[str]) -> DataFrame:
    """keys, field, value: of one building's fields with these prefixes, else of the project where it has none.

    values: keys, object, field, value and the column that names the package's building; without one, the project's.
    """
    own = F.col("object") == F.coalesce(F.col(building), F.lit(PROJECT))
    rows = values.where(has_prefix("field", prefixes) & (own | (F.col("object") == PROJECT)))
    return first_per(rows, [*keys, "field"], [F.when(own, 0).otherwise(1), "value"]).select(*keys, "field", "value")


def floors_of_objects(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Whole floors of every object, from the values chosen for its slots."""
    return slots.where(F.col("field") == FLOORS).select(*keys, "object", F.col("value").cast("int").alias("floors"))


def annotation_counts(annotations: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, what, value, n: how many annotations have each value of each of the columns."""
    items = F.array(*[F.struct(F.lit(b).alias("what"), F.col(b).cast("string").alias("value")) for b in by])
    return annotations.select(*keys, F.explode(items).alias("x")).groupBy(*keys, "x.what", "x.value").agg(F.count("*").alias("n"))


def with_anchors(refs: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """References with the list of their anchors, by `mention` or else by `section.field`; an empty list for none.

    refs: keys, mention, section, field; anchors: keys, name, page, seq. Lists are made before the join.
    """
    listed = anchors.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(F.struct("page", "seq"))).alias("anchors"))
    named = refs.withColumn("name", F.coalesce("mention", F.concat_ws(".", "section", "field")))
    none = F.array().cast(listed.schema["anchors"].dataType)
    return named.join(listed, [*keys, "name"], "left").withColumn("anchors", F.coalesce("anchors", none))


def anchor_problems(values: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, problem: values without an anchor, and values marked as missing that have one. values: keys, name, value."""
    found = anchors.select(*keys, "name").distinct().withColumn("_found", F.lit(True))
    held = values.join(found, [*keys, "name"], "left")
    problem = F.when(F.col("value").isNotNull() & F.col("_found").isNull(), "not anchored").when(F.col("value").isNull() & F.col("_found"), "missing but anchored")
    return held.select(*keys, "name", problem.alias("problem")).where("problem is not null")
