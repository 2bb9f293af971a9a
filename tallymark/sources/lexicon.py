"""The lexicon: labels of fields, spellings of units, kinds of header cells, negative labels and building parameters.

A lexicon is configuration in JSON: new wordings and new parameters are entries, not code. It is read by Spark into flat
rows; `load` turns them into a small value on the driver, whose size is checked, for expressions with constants.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import c, let, normalize_unit, squash

BY_SOURCE = "map<string,array<string>>"
BY_LANGUAGE = f"map<string,{BY_SOURCE}>"
LEXICON = f"fields map<string,struct<unit:string,table:{BY_LANGUAGE},text:{BY_LANGUAGE},text_number_first:{BY_LANGUAGE}>>, units map<string,{BY_SOURCE}>, headers map<string,{BY_SOURCE}>, negatives {BY_SOURCE}"
PARAMETERS = f"parameters map<string,struct<mention:{BY_LANGUAGE},materials:map<string,{BY_LANGUAGE}>,width:boolean,unit:string>>"
#: Entries of a lexicon that the driver holds as constants at most.
MOST_ENTRIES = 10_000


@dataclass(frozen=True)
class Lexicon:
    """Small by nature: labels are (field, kind, label) with kinds table, text and text_number_first."""

    units_of: dict[str, str]
    labels: list[tuple[str, str, str]]
    negatives: list[str] = field(default_factory=list)
    units: list[tuple[str, str]] = field(default_factory=list)
    headers: list[tuple[str, str]] = field(default_factory=list)


def entries(rows: DataFrame, column: str, keys: list[str], value: str) -> DataFrame:
    """Maps nested in each other as rows: a column for each level of keys, and one for the listed values, in order."""
    depth = len(keys)
    at = rows
    for i, key in enumerate(keys):
        kept = [k for k in keys[:i]]
        at = at.select(*kept, F.explode(F.col(column)).alias(key, column))
    if depth == 0:
        raise ValueError("name the keys of each level")
    return at.select(*keys, F.posexplode(F.array_distinct(column)).alias("seq", value))


def read_lexicon(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """labels (field, unit, kind, lang, source, seq, label), units, headers and negatives as flat rows."""
    whole = spark.read.schema(LEXICON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    fields = whole.select(F.explode("fields").alias("field", "spec"))
    labels = None
    for kind in ("table", "text", "text_number_first"):
        some = fields.select("field", "spec.unit", F.col(f"spec.{kind}").alias("m")).where("m is not null")
        flat = some.select("field", "unit", F.explode("m").alias("lang", "m")).select("field", "unit", "lang", F.explode("m").alias("source", "l"))
        flat = flat.select("field", "unit", F.lit(kind).alias("kind"), "lang", "source", F.posexplode(F.array_distinct("l")).alias("seq", "label"))
        labels = flat if labels is None else labels.unionByName(flat)
    return {
        "labels": labels,
        "units": entries(whole.select("units"), "units", ["unit", "source"], "spelling"),
        "headers": entries(whole.select("headers"), "headers", ["kind", "source"], "spelling"),
        "negatives": entries(whole.select("negatives"), "negatives", ["source"], "label"),
    }


def read_parameters(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """mentions (parameter, prefix), materials (parameter, material, prefix) and settings (parameter, width, unit)."""
    whole = spark.read.schema(PARAMETERS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = whole.select(F.explode("parameters").alias("parameter", "spec"))
    mentions = each.select("parameter", F.explode("spec.mention").alias("lang", "m")).select("parameter", F.explode("m").alias("source", "l")).select("parameter", F.explode("l").alias("prefix")).distinct()
    materials = each.select("parameter", F.explode("spec.materials").alias("material", "m")).select("parameter", "material", F.explode("m").alias("lang", "m"))
    materials = materials.select("parameter", "material", F.explode("m").alias("source", "l")).select("parameter", "material", F.explode("l").alias("prefix")).distinct()
    return {"mentions": mentions, "materials": materials, "settings": each.select("parameter", F.coalesce("spec.width", F.lit(False)).alias("width"), "spec.unit")}


def load(spark: SparkSession, path: str) -> Lexicon:
    """The lexicon as constants; a file of more than MOST_ENTRIES entries is refused."""
    rows = read_lexicon(spark, path)
    taken = {name: df.limit(MOST_ENTRIES + 1).collect() for name, df in rows.items()}
    if sum(map(len, taken.values())) > MOST_ENTRIES:
        raise ValueError(f"a lexicon has at most {MOST_ENTRIES} entries")
    distinct = lambda pairs: list(dict.fromkeys(pairs))
    return Lexicon(
        {r["field"]: r["unit"] for r in taken["labels"]},
        distinct((r["field"], r["kind"], r["label"]) for r in taken["labels"]),
        distinct(r["label"] for r in taken["negatives"]),
        distinct((r["unit"], r["spelling"]) for r in taken["units"]),
        distinct((r["kind"], r["spelling"]) for r in taken["headers"]),
    )


def read_wordings(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(kind, name, label) of a JSON file [{"kind", "name", "labels": [...]}, ...], in its order, for `wordings.Wordings`.

    A file of more than MOST_ENTRIES labels is refused.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<kind: string, name: string, labels: array<string>>>", {"mode": "FAILFAST"})).alias("at", "e"))
    each = whole.select("at", "e.kind", "e.name", F.posexplode("e.labels").alias("nth", "label"))
    taken = each.orderBy("at", "nth").limit(MOST_ENTRIES + 1).collect()
    if len(taken) > MOST_ENTRIES:
        raise ValueError(f"a file of wordings has at most {MOST_ENTRIES} labels")
    return [(r["kind"], r["name"], r["label"]) for r in taken]


def bare_text(text: str) -> str:
    """`squash` of a constant."""
    return "".join(ch for ch in text.replace("ё", "е").replace("Ё", "Е").lower() if ch.isalnum())


def constant_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


def unit_of(text, units: list[tuple[str, str]]) -> Column:
    """The unit with such a spelling, spaces, signs and case apart; else what the usual spellings of metres say."""
    known: dict[str, str] = {}
    for unit, spelling in units:
        known.setdefault(bare_text(spelling), unit)
    return F.coalesce(F.try_element_at(constant_map(known), squash(text)), normalize_unit(text))


def unit_at_end(header, units: list[tuple[str, str]]) -> Column:
    """The unit named after a comma or in brackets at the end of a header."""
    return unit_of(F.regexp_extract(c(header), r"[,(]\s*([^,()]+?)\s*\)?\s*$", 1), units)


def begins_with(text, spellings: list[str]) -> Column:
    """Whether the text begins with one of the spellings, spaces, signs and case apart."""
    begun = sorted({bare_text(x) for x in spellings})
    return F.coalesce(let(squash(text), lambda bare: reduce(or_, [bare.startswith(s) for s in begun], F.lit(False))), F.lit(False))


def unit_of_field(name) -> Column:
    """The unit that a field's id ends with."""
    f = c(name)
    return F.when(f.endswith("_m2"), "m2").when(f.endswith("_m3"), "m3").when(f.endswith("_ktg"), "kKZT").when(f.endswith("_months"), "month").when(f.endswith("_t"), "t").when(f == "floors", "floor")


def field_for_display(name, labels: dict[str, str]) -> Column:
    """A field's label without the prefix of its source; rooms and unknown fields by their id."""
    bare = F.regexp_replace(c(name), r"^local_qty\.", "")
    room = F.regexp_extract(bare, r"^room\.([^.]+)\.", 1)
    return F.coalesce(F.try_element_at(constant_map(labels), bare), F.when(room != "", F.concat(F.lit("room "), room)), bare)


def material_in(text, materials: list[tuple[str, str]]) -> Column:
    """The material whose prefix begins a word of the text; the longest prefix wins, then the order given."""
    low = F.translate(F.lower(c(text)), "ё", "е")
    hits = F.array(*[F.when(low.rlike(r"(?<!\p{L})" + "\\Q" + prefix + "\\E"), F.struct(F.lit(-len(prefix)).alias("short"), F.lit(i).alias("at"), F.lit(material).alias("material"))) for i, (material, prefix) in enumerate(materials)])
    return F.array_min(F.filter(hits, lambda h: h.isNotNull()))["material"]
