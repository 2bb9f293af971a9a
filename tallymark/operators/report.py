"""From findings to what a reader sees: references with places, names, messages, warnings, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c, format_number, last_number_equal
from ..sources.lexicon import constant_map
from .ordered import first_per

#: Names of objects that are no buildings.
SPECIAL_OBJECTS = {"site": "Площадка", "document": "Документ в целом", "all": "Все здания", "project": "Проект в целом"}
#: How far a value may stand above or below its quote, in points; sideways counts a quarter.
QUOTE_SLACK, SIDEWAYS = 2.0, 4.0


def shown_number(value, decimals: int = 3) -> Column:
    """1234.5 as 1 234,5; a dash for null."""
    text = F.regexp_replace(F.regexp_replace(format_number(value, decimals), r"(,\d*?)0+$", "$1"), ",$", "")
    return F.coalesce(text, F.lit("—"))


def shown_axes(derived) -> Column:
    """8.5 x 24 as 8,5 × 24."""
    return F.regexp_replace(F.replace(F.coalesce(c(derived), F.lit("")), F.lit("x"), F.lit("×")), r"(?<=\d)\.(?=\d)", ",")


def shown_material(value, words: dict[str, str]) -> Column:
    """The material's word in a value like `asphalt, 1500 мм`; unknown values as they are."""
    head = F.regexp_extract(c(value), r"^([^,]*)", 1)
    word = F.try_element_at(constant_map(words), head)
    return F.coalesce(F.concat(word, F.substring(c(value), F.length(head) + 1, F.length(c(value)))), c(value))


def object_name(object_id, names: Column) -> Column:
    """Special objects by their fixed names, others by the package's, else the id."""
    key = F.coalesce(c(object_id), F.lit(""))
    return F.coalesce(F.try_element_at(constant_map(SPECIAL_OBJECTS), key), F.try_element_at(names, key), key)


def raw_value(quote, value) -> Column:
    """The value as the quote writes it, else formatted; null for none."""
    return F.when(c(value).isNotNull(), F.coalesce(last_number_equal(quote, value), shown_number(value)))


def boxes_of_values(quotes: DataFrame, values: DataFrame) -> DataFrame:
    """The box of each quote's value: inside the quote's lines, from the left; else the nearest on the page.

    quotes: ref_id, doc_id, page, raw, top, bottom, x0; values: doc_id, page, text, v_top, v_bottom, v_x0.
    """
    pairs = quotes.join(values.withColumnRenamed("text", "raw"), ["doc_id", "page", "raw"])
    inside = (F.col("v_top") >= F.col("top") - QUOTE_SLACK) & (F.col("v_bottom") <= F.col("bottom") + QUOTE_SLACK)
    distance = F.abs(F.col("v_top") - F.col("top")) + F.abs(F.col("v_x0") - F.col("x0")) / SIDEWAYS
    order = [F.when(inside, 0).otherwise(1), F.when(inside, F.round("v_top")).otherwise(distance), "v_x0", "v_top"]
    return first_per(pairs, ["ref_id"], order).select("ref_id", "v_top", "v_bottom", "v_x0")


def extractions(slots: DataFrame, values: DataFrame) -> DataFrame:
    """What a report shows of each chosen value: as its quote writes it, with its box, from a table or from text.

    slots: ref_id, doc_id, object, field, value, page, quote, source, top, bottom, x0; values: as for boxes_of_values.
    """
    said = slots.withColumn("raw", raw_value("quote", "value")).withColumn("source", F.when(F.col("source").startswith("table"), "table").otherwise("text"))
    boxes = boxes_of_values(said.select("ref_id", "doc_id", "page", "raw", "top", "bottom", "x0"), values)
    return said.drop("top", "bottom", "x0").join(boxes, "ref_id", "left")


def with_references(findings: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with their references as one list in order. refs: keys, seq and what is shown of each."""
    shown = [x for x in refs.columns if x not in keys]
    lists = refs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *[x for x in shown if x != "seq"]))).alias("refs"))
    return findings.join(lists, keys, "left").withColumn("refs", F.coalesce("refs", F.array().cast(lists.schema["refs"].dataType)))


def message(kind, templates: dict[str, str], parts: dict[str, Column]) -> Column:
    """The text of a finding's type, with {name} replaced by parts; unknown types give their name."""
    text = F.coalesce(F.try_element_at(constant_map(templates), c(kind)), c(kind))
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("—")))
    return text


def warnings_in_order(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """Each warning once, where it came first. warnings: keys, seq, text."""
    return warnings.groupBy(*keys, "text").agg(F.min("seq").alias("seq"))


def names_merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Names of both; the first one's win. Both: keys, object_id, name."""
    return first.unionByName(second.join(first, [*keys, "object_id"], "left_anti"))


def by_object(values: DataFrame, keys: list[str]) -> DataFrame:
    """Values grouped for display: fields of each object as a sorted list, rooms only counted."""
    room = F.col("field").startswith("room.")
    shown = F.array_sort(F.collect_list(F.when(~room, F.struct("field", "value"))))
    return values.groupBy(*keys, "object").agg(shown.alias("fields"), F.count_if(room).alias("n_rooms"))


def sheets(findings: DataFrame, values: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of an export: findings (mismatches first, then as numbered), values and completeness of files."""
    order = F.when(F.col("verdict") == "MISMATCH", 0).when(F.col("verdict") == "MISSING", 1).otherwise(2)
    return {
        "findings": findings.withColumn("sheet_order", order).orderBy("package_id", "sheet_order", "finding_no"),
        "values": values.orderBy("package_id", "object", "field"),
        "files": files.orderBy("package_id", "file_no"),
    }


def observation_template(sets: DataFrame, tools: list[str]) -> DataFrame:
    """A row to fill in by hand for every set and tool."""
    return sets.select("*", F.explode(F.array(*[F.lit(t) for t in tools])).alias("tool")).withColumns({"minutes": F.lit(None).cast("double"), "found": F.lit(None).cast("string"), "note": F.lit(None).cast("string")})


# ---- what a service lists


def listing(checks: DataFrame, owner: str, most: int | None = None) -> DataFrame:
    """The owner's checks, the newest first; someone else's are as if they weren't there."""
    mine = checks.where(F.col("owner") == owner).orderBy(F.desc("created_at"), F.desc("check_id"))
    return mine if most is None else mine.limit(most)


def not_spam(requests: DataFrame, trap: str = "website") -> DataFrame:
    """Requests that leave the field empty which people don't see."""
    return requests.where(F.coalesce(F.col(trap), F.lit("")) == "")


def unknown_files(asked: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Files named in a start request that were never uploaded. Both: check_id, name."""
    return asked.join(uploaded, ["check_id", "name"], "left_anti").distinct()


def with_reviews(findings: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with the verdict and comment of their review, if there is one."""
    return findings.join(reviews.select(*keys, F.col("verdict").alias("review"), "comment"), keys, "left")
