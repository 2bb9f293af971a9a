"""From cells and sentences to statements (object, field, value), with objects by mention or heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, TOTAL, let, normalize_unit, norm_ws, parse_number, squash, stem, unit_in
from ..session import kept, shuffled
from .labels import cascade

#: A numbered heading of few words, with its number.
HEADING = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\p{L}.*\S)\s*$"


def headings(lines: DataFrame, most_words: int = 8) -> DataFrame:
    """Adds level and title to numbered headings outside tables that don't end in a number."""
    number, title = F.regexp_extract("text", HEADING, 1), F.regexp_extract("text", HEADING, 2)
    is_heading = (title != "") & (F.size(F.split(title, r"\s+")) <= most_words) & ~title.rlike(r"\d[.,]\d+$") & ~F.coalesce(F.col("in_table"), F.lit(False))
    return lines.withColumn("level", F.when(is_heading, F.size(F.split(number, r"\.")))).withColumn("title", F.when(is_heading, title))


def discover_objects(lines: DataFrame, nouns: str, most_words: int = 6) -> DataFrame:
    """Objects named by headings: doc_id, object_id (obj1, obj2, ... in order), name, stems that name it alone."""
    titles = headings(lines).where(F.col("title").rlike(nouns) & (F.size(F.split("title", r"\s+")) <= most_words))
    first = titles.groupBy("doc_id", F.lower("title").alias("_k")).agg(F.min(F.struct("page", "line_no", "title")).alias("f"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.page", "f.line_no"))  # a document has few headings
    objects = kept(first.select("doc_id", F.concat(F.lit("obj"), number).alias("object_id"), F.col("f.title").alias("name")))
    words = objects.select("doc_id", "object_id", F.explode(F.array_distinct(F.transform(F.filter(F.split("name", r"[\s\-–]+"), lambda w: F.length(w) >= 3), stem))).alias("stem"))
    unique = words.groupBy("doc_id", "stem").agg(F.count("*").alias("n"), F.first("object_id").alias("object_id")).where("n = 1")
    stems = unique.groupBy("doc_id", "object_id").agg(F.sort_array(F.collect_list("stem")).alias("stems"))
    return objects.join(shuffled(stems), ["doc_id", "object_id"], "left").withColumn("stems", F.coalesce("stems", F.array().cast("array<string>")))


def mentioned(texts: DataFrame, objects: DataFrame, text: str, name: str = "mentioned") -> DataFrame:
    """The one object of the document that a text names by a stem of its own, else null."""
    known = objects.groupBy("doc_id").agg(F.collect_list(F.struct("object_id", "stems")).alias("_objects"))
    every = F.coalesce("_objects", F.array().cast("array<struct<object_id:string,stems:array<string>>>"))
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    hits = let(words, lambda ws: F.filter(every, lambda o: F.exists(o["stems"], lambda s: F.exists(ws, lambda w: F.startswith(w, s)))))
    only = let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))["object_id"]))
    return texts.join(shuffled(known), "doc_id", "left").withColumn(name, only).drop("_objects")


def sentences(pages: DataFrame) -> DataFrame:
    """doc_id, page, sentence_no, sentence; cut at a full stop and white space."""
    return pages.select("doc_id", "page", F.posexplode(F.split(norm_ws("text"), r"(?<=\p{L}{2}|\)|\d)\.\s+(?=\p{Lu}|\d)")).alias("sentence_no", "sentence"))


def sentence_statements(pages: DataFrame, labels: dict[str, list[str]], units: dict[str, str]) -> DataFrame:
    """Label first or number first, with a unit that fits the field. labels: patterns of each field."""
    unit = r"((?:кв\.?|куб\.?)\s?[мm]|[мm]\s?[23²³])"
    found = None
    split = sentences(pages)
    for field, patterns in sorted(labels.items()):
        for order, pattern in enumerate(patterns):
            for turn, rx in enumerate((rf"(?iu){pattern}[^\d.;:]{{0,60}}?({NUMBER})\s*{unit}", rf"(?iu)({NUMBER})\s*{unit}\s+(?:\p{{L}}+\s+)?{pattern}")):
                hit = split.select("doc_id", "page", "sentence_no", "sentence", F.regexp_extract("sentence", rx, 1).alias("raw"), F.regexp_extract("sentence", rx, 2).alias("unit"), F.lit(field).alias("field"), F.lit(2 * order + turn).alias("pattern"))
                hit = hit.where((F.col("raw") != "") & (normalize_unit("unit") == F.lit(units[field])))
                found = hit if found is None else found.unionByName(hit)
    once = found.withColumn("value", parse_number("raw")).where("value is not null").groupBy("doc_id", "page", "sentence_no", "field", "raw").agg(F.min_by(F.struct("sentence", "value"), "pattern").alias("s"))
    return once.select("doc_id", "page", "sentence_no", "field", "raw", "s.sentence", "s.value")


def table_statements(cells: DataFrame, lexicon: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Values of tables whose header cells name fields: doc_id, table_no, page, row_no, col_no, field, value, row_label.

    The header is row 0; total rows give nothing; a unit in the header must be the field's.
    """
    header = cells.where("row_no = 0").select("doc_id", "table_no", "col_no", F.col("text").alias("label"))
    named = header.join(cascade(header.select("label"), lexicon), "label").withColumn("unit", unit_in("label"))
    if units:
        fits = F.create_map(*[F.lit(x) for kv in sorted(units.items()) for x in kv])
        named = named.where(F.col("unit").isNull() | (F.col("unit") == F.try_element_at(fits, F.col("field"))))
    body = cells.where("row_no > 0")
    rows = body.groupBy("doc_id", "table_no", "row_no").agg(F.min_by("text", F.when(F.coalesce("text", F.lit("")) != "", F.col("col_no"))).alias("first"), F.min_by("text", F.when(F.col("text").rlike(r"\p{L}"), F.col("col_no"))).alias("row_label"))
    kept = rows.where(~F.coalesce(F.col("first").rlike(TOTAL), F.lit(False)))
    values = body.withColumn("value", parse_number(norm_ws("text"))).where("value is not null")
    return values.join(named.select("doc_id", "table_no", "col_no", "field"), ["doc_id", "table_no", "col_no"]).join(kept, ["doc_id", "table_no", "row_no"]).select("doc_id", "table_no", "page", "row_no", "col_no", "field", "value", F.col("text").alias("raw"), "row_label")


def choose_slots(statements: DataFrame, keys: list[str], source: str = "source", method: str = "method", score: str = "score", seq: str = "seq") -> DataFrame:
    """One value a slot: tables before sentences, exact before fuzzy before vectors, higher scores, then reading order."""
    rank = lambda c, order: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))
    order = [rank(source, ["table_h", "table_v", "table", "text", "ocr"]), rank(method, ["exact", "fuzzy", "embedding"]), -F.col(score), F.col(seq)]
    return statements.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def header_field(header: Column, fields: list[tuple[str, str]]) -> Column:
    """The field of the first pattern, in order, that the squashed header contains."""
    text = squash(header)
    return F.coalesce(*[F.when(text.contains(pattern), F.lit(field)) for field, pattern in fields])


def classify_section(lines: DataFrame, titles: list[tuple[str, str]], codes: list[tuple[str, str]]) -> DataFrame:
    """Section of each document: its earliest title, else the code in its name, else unknown."""
    hits = F.array(*[F.struct(F.nullif(F.regexp_instr("text", F.lit(rx)), F.lit(0)).alias("at"), F.lit(s).alias("section")) for s, rx in titles])
    first = lines.withColumn("_h", F.array_min(F.filter(hits, lambda h: h["at"].isNotNull()))).where("_h is not null")
    by_title = first.groupBy("doc_id").agg(F.min_by("_h.section", F.struct("page", "line_no", "_h.at")).alias("section"))
    by_code = F.coalesce(*[F.when(F.col("doc_id").rlike(rx), F.lit(s)) for s, rx in codes])
    return lines.select("doc_id").distinct().join(by_title, "doc_id", "left").select("doc_id", F.coalesce("section", by_code, F.lit("unknown")).alias("section"), F.when(F.col("section").isNotNull(), "title").when(by_code.isNotNull(), "code").otherwise("none").alias("how"))
