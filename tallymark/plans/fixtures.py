"""Packages of our own invention with known discrepancies: the same rows for the same seed, on any partitioning.

Every number is a hash of (seed, package, name), so a richer profile adds fields and changes none of the others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CYRILLIC_LOOK, LATIN_LOOK, format_number

MATERIALS = ["concrete", "rebar", "brick"]
KINDS = ["area", "material", "cost", "missing"]
#: What must be stated where, and what shows that it exists.
MANDATORY = [("PZ", "cost_ktg", "SMETA", "object_estimate_ktg")]


def drawn(seed: int, name: str, low: float, high: float, digits: int = 2) -> Column:
    """A number from low to high by the package and the name."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("package_id"), F.lit(name)), F.lit(1_000_003)) / 1_000_002
    return F.round(low + share * (high - low), digits)


def injected(seed: int, kind: str, inject: str | list[str]) -> Column:
    """Whether a package has a discrepancy of this kind: all, none, a list of kinds, or random (about a third)."""
    if inject in ("all", "none"):
        return F.lit(inject == "all")
    if isinstance(inject, list):
        return F.lit(kind in inject)
    return F.pmod(F.xxhash64(F.lit(seed), F.col("package_id"), F.lit("inject"), F.lit(kind)), F.lit(3)) == 0


def moved(seed: int, value: Column, kind: str, wrong: Column, rel: float, absolute: float) -> Column:
    """The value again: within half its tolerance where right, 1.2 to 3 tolerances off where wrong."""
    step = F.greatest(F.lit(absolute), rel * value)
    sign = F.when(drawn(seed, f"sign {kind}", 0, 1) < 0.5, -1.0).otherwise(1.0)
    return value + sign * step * F.when(wrong, drawn(seed, f"far {kind}", 1.25, 3.0)).otherwise(drawn(seed, f"near {kind}", 0.0, 0.5))


def packages(spark: SparkSession, n: int, seed: int = 1, inject: str | list[str] = "random") -> DataFrame:
    """One row a package with the values of every section and what is wrong."""
    base = spark.range(n).select(F.concat(F.lit(f"s{seed}-"), F.col("id")).alias("package_id"), F.when(F.col("id") % 2 == 0, "ru").otherwise("kz").alias("lang"))
    base = base.withColumns({f"wrong_{k}": injected(seed, k, inject) for k in KINDS})
    base = base.withColumns({"area": drawn(seed, "area", 300, 9000), "cost": drawn(seed, "cost", 10_000, 900_000, 3), **{m: drawn(seed, m, 20, 800) for m in MATERIALS}})
    again = {"area_again": moved(seed, F.col("area"), "area", F.col("wrong_area"), 0.005, 0.1), "cost_again": F.when(F.col("wrong_cost"), F.round(F.col("cost") * 1.01, 3)).otherwise(F.col("cost"))}
    again |= {f"{m}_again": moved(seed, F.col(m), m, F.col("wrong_material") & F.lit(m == MATERIALS[0]), 0.01, 0.01) for m in MATERIALS}
    return base.withColumns(again)


def statements(rows: DataFrame) -> DataFrame:
    """What the sections of each package state, in reading order."""
    said = [("PZ", "total_area_m2", F.col("area"), "table"), ("PZ", "total_area_m2", F.col("area") * 2, "text"), ("AR", "total_area_m2", F.col("area_again"), "table"), ("PZ", "cost_ktg", F.when(~F.col("wrong_missing"), F.col("cost")), "text"), ("SMETA", "object_estimate_ktg", F.col("cost"), "table"), ("SMETA", "summary_line.1", F.col("cost_again"), "table")]
    for m in MATERIALS:
        said += [("KR", f"qty.{m}", F.col(m), "table"), ("SMETA", f"local_qty.{m}", F.col(f"{m}_again"), "table")]
    items = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), v.alias("value"), F.lit(src).alias("source"), F.lit(i).alias("seq")) for i, (s, f, v, src) in enumerate(said)])
    return rows.select("package_id", F.explode(items).alias("x")).select("package_id", "x.*").where("value is not null")


def gold(rows: DataFrame) -> DataFrame:
    """package_id, type, field of every discrepancy put in."""
    found = [("wrong_area", "AREA_PZ_VS_AR_EXPLICATION", "total_area_m2"), ("wrong_material", "MATERIAL_VOLUME_KR_VS_LOCAL_ESTIMATE", f"qty.{MATERIALS[0]}"), ("wrong_cost", "COST_OBJECT_ESTIMATE_VS_SUMMARY", "object_estimate_ktg"), ("wrong_missing", "MISSING_MANDATORY_TEP", "cost_ktg")]
    items = F.array(*[F.struct(F.col(w).alias("w"), F.lit(t).alias("type"), F.lit(f).alias("field")) for w, t, f in found])
    return rows.select("package_id", F.explode(items).alias("x")).where("x.w").select("package_id", "x.type", "x.field")


def mandatory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANDATORY, "section string, field string, shown_by string, shown_field string")


def note_pages(rows: DataFrame) -> DataFrame:
    """A page of text a package that states its area in a sentence, numbers in four styles."""
    style = F.pmod(F.xxhash64("package_id"), F.lit(4))
    number = F.coalesce(*[F.when(style == i, format_number("area", 2, s)) for i, s in enumerate(("space_comma", "nbsp_comma", "plain_comma", "plain_dot"))])
    ru = F.concat(F.lit("Общая площадь здания составляет "), number, F.lit(" м². Здание отапливаемое."))
    kz = F.concat(F.lit("Ғимараттың жалпы ауданы — "), number, F.lit(" м². Ғимарат жылытылады."))
    return rows.select(F.col("package_id").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("lang") == "ru", ru).otherwise(kz).alias("text"))


def sheet_cells(rows: DataFrame) -> DataFrame:
    """A table a package: materials with a total row, wrong where the area is wrong."""
    total = sum((F.col(m) for m in MATERIALS), F.lit(0.0)) + F.when(F.col("wrong_area"), 1.0).otherwise(0.0)
    items = F.array(*[F.struct(F.lit(i + 1).alias("row_no"), F.col(m).alias("value"), F.lit(False).alias("is_total")) for i, m in enumerate(MATERIALS)], F.struct(F.lit(len(MATERIALS) + 1).alias("row_no"), F.round(total, 2).alias("value"), F.lit(True).alias("is_total")))
    return rows.select(F.col("package_id").alias("doc_id"), F.explode(items).alias("x")).select("doc_id", F.lit(1).alias("table_no"), "x.row_no", F.lit(2).alias("col_no"), "x.value", "x.is_total")


def write_gold(rows: DataFrame, path: str) -> None:
    """What was put in, as JSON lines in a folder a language."""
    said = rows.select("lang", "package_id")
    gold(rows).join(said, "package_id").write.partitionBy("lang").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("package_id string, type string, field string, lang string").json(path)


#: Profit in a local estimate, reserve and tax in a summary estimate, parts of a hundred.
PROFIT_PERCENT, RESERVE_PERCENT, TAX_PERCENT = 8, 2, 12


def local_estimate(direct: Column, overhead_percent: Column) -> dict[str, Column]:
    """Overhead on direct costs, profit on both, and the total, each rounded to 2 digits; decimals in and out."""
    money = lambda x: F.round(x, 2).cast("decimal(18,2)")
    overhead = money(direct * overhead_percent / 100)
    profit = money((direct + overhead) * PROFIT_PERCENT / 100)
    return {"overhead": overhead, "profit": profit, "total": (direct + overhead + profit).cast("decimal(18,2)")}


def summary_estimate(chapters: list[Column]) -> dict[str, Column]:
    """Subtotal of the chapters, reserve on it, tax on both, and the total, each rounded to 3 digits; decimals in and out."""
    money = lambda x: F.round(x, 3).cast("decimal(18,3)")
    subtotal = money(sum(chapters[1:], chapters[0]))
    reserve = money(subtotal * RESERVE_PERCENT / 100)
    with_reserve = money(subtotal + reserve)
    tax = money(with_reserve * TAX_PERCENT / 100)
    return {"subtotal": subtotal, "reserve": reserve, "with_reserve": with_reserve, "tax": tax, "total": money(with_reserve + tax)}


def summary_totals(values: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of a table of buildings: sums of every field, rounded. values: keys, field, value."""
    total = F.sum(F.col("value").cast("decimal(18,4)"))
    return values.groupBy(*keys, "field").agg(F.round(total, 2).cast("double").alias("total"))


def filled(template: str, anchored: dict[str, Column], plain: dict[str, Column] | None = None) -> Column:
    """The template's text, and of each anchored value its name, value and place (from 0)."""
    given = (plain or {}) | anchored
    pieces = [(p, i % 2 == 1) for i, p in enumerate(re.split(r"\{(\w+)\}", template))]
    so_far, places = F.lit(""), []
    for piece, is_name in pieces:
        if is_name and piece in anchored:
            places.append(F.struct(F.lit(piece).alias("name"), given[piece].alias("value"), F.length(so_far).alias("at")))
        so_far = F.concat(so_far, given[piece] if is_name else F.lit(piece))
    return F.struct(so_far.alias("text"), F.array(*places).alias("anchors"))


LONG_HEADER_WORD = 7


def broken_header(text: Column, draw: Column) -> Column:
    """One of a header's words of letters, drawn, broken before its last one to three letters, as narrow columns do."""
    words = F.split(text, " ")
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike(rf"^\p{{L}}{{{LONG_HEADER_WORD},}}$"))
    place = F.get(places, F.pmod(draw, F.greatest(F.size(places), F.lit(1))).cast("int"))
    tail = F.get(F.array(*map(F.lit, (1, 2, 2, 3))), F.pmod(draw, F.lit(4)).cast("int"))
    cut = lambda w: F.concat(F.substring(w, F.lit(1), F.length(w) - tail), F.lit("\n"), F.substring(w, F.length(w) - tail + 1, tail))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == place, cut(w)).otherwise(w)), " ")


SPLIT_WORD = 6


def misread(text: Column, draw: Column) -> Column:
    """One defect of a scan, drawn: a letter as its Latin look-alike, a lost space, or else a long word in two.

    What the text has no place for becomes a split word; without a long word the text stays as it is.
    """
    kind, choice = F.pmod(draw, F.lit(3)), F.floor(draw / 3)
    pick = lambda places: F.get(places, F.pmod(choice, F.greatest(F.size(places), F.lit(1))).cast("int"))
    letter = lambda i: F.substring(text, i, F.lit(1))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    swap = pick(F.filter(at, lambda i: F.lower(letter(i)).isin(*CYRILLIC_LOOK)))
    space = pick(F.filter(at, lambda i: letter(i) == " "))
    around = lambda i, new: F.concat(F.substring(text, F.lit(1), i - 1), new, F.substring(text, i + 1, F.length(text)))
    looks = F.translate(letter(swap), CYRILLIC_LOOK + CYRILLIC_LOOK.upper(), LATIN_LOOK + LATIN_LOOK.upper())
    words = F.split(text, " ")
    long = pick(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.length(F.get(words, i)) >= SPLIT_WORD))
    cut = lambda w: (2 + F.pmod(choice, F.length(w) - 3)).cast("int")
    parted = F.transform(words, lambda w, i: F.when(i == long, F.concat(F.substring(w, F.lit(1), cut(w)), F.lit(" "), F.substring(w, cut(w) + 1, F.length(w)))).otherwise(w))
    return F.when((kind == 0) & swap.isNotNull(), around(swap, looks)).when((kind == 1) & space.isNotNull(), around(space, F.lit(""))).otherwise(F.array_join(parted, " "))
