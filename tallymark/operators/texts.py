"""Running text to statements: numbers named by the words around them, paragraphs, scanned lines, heights, scopes.

Texts are whole pages (doc_id, page, text); places count characters of the page from 0. A page is one row and is read by
expressions; distinct windows of words are matched once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, cost_scale, number_readings, once
from ..session import kept, shuffled, spread
from ..sources.lexicon import Lexicon
from . import labels
from .ordered import first_per
from .tables import indicator_value
from .wordings import CELL_NUMBER, NOTHING, Wordings, cell_number, first_named, plain_yo, says, stem_pattern, unit_pattern

#: Characters looked at around a number, after a paragraph's label, for a cost's unit and after a mention.
WINDOW, AFTER_LABEL, AFTER_COST, AFTER_MENTION = 120, 120, 20, 80
#: Heights that a storey can have, in metres.
LEAST_HEIGHT, MOST_HEIGHT = 1.5, 20.0
CAPITAL = "A-ZА-ЯЁӘҒҚҢӨҰҮҺІ"
#: The end of a clause: a sentence's end before a capital, a semicolon, a comma with white space.
CLAUSE_END = rf"(?:[.!?]\s+(?=[{CAPITAL}])|;|,\s)"
ANCHORED_UNITS = ("m2", "m3", "kKZT", "month")
IN_TEXT = rf"(?<![0-9,.])({CELL_NUMBER})(?![0-9])"


def _unit_forms(lexicon: Lexicon) -> dict[str, str]:
    forms = {u: [unit_pattern(s) for s in sorted({s for k, s in lexicon.units if k == u}, key=lambda s: (-len(s), s))] for u in ANCHORED_UNITS}
    forms["m2"] += [r"[мm]\.?\s?[2²]", r"кв\.\s?[мm]\.?"]
    forms["m3"] += [r"[мm]\.?\s?[3³]", r"куб\.\s?[мm]\.?"]
    return {u: "|".join(f) for u, f in forms.items() if f}


def places_of(text: Column, pattern: str) -> Column:
    """Every match: said, start, stop and since (where the match before it stops); places count characters from 0.

    Places are running sums of the matches and of the gaps between them, so equal matches have places of their own.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found, lambda g, a: F.struct(F.length(g).alias("gap"), a.alias("said")))
    none = F.array().cast("array<struct<said:string,start:int,stop:int,since:int>>")

    def add(done: Column, s: Column) -> Column:
        start = done["at"] + s["gap"]
        stop = start + F.length(s["said"])
        return F.struct(stop.alias("at"), F.concat(done["all"], F.array(F.struct(s["said"].alias("said"), start.alias("start"), stop.alias("stop"), done["at"].alias("since")))).alias("all"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("all")), add)["all"]


def anchors(pages: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Every number with a unit: doc_id, page, start, stop, raw, unit, before and after (words up to a clause's end).

    The words before begin after the previous number at the earliest, and with a whole word.
    """
    forms = _unit_forms(lexicon)
    unit_group = "|".join(f"(?:{f})" for f in forms.values())
    pattern = rf"(?iu)({NUMBER})\s*({unit_group})(?![\p{{L}}\p{{N}}/])"
    cut = pages.select("doc_id", "page", plain_yo(F.coalesce("text", F.lit(""))).alias("text"))
    rows = cut.select("doc_id", "page", "text", F.explode(places_of(F.col("text"), pattern)).alias("x"))
    rows = rows.select("doc_id", "page", "text", "x.start", "x.stop", "x.since", F.regexp_extract("x.said", pattern, 1).alias("raw"), F.regexp_extract("x.said", pattern, 2).alias("said_unit"))
    unit = F.coalesce(*[F.when(F.col("said_unit").rlike(f"(?iu)^(?:{f})$"), F.lit(u)) for u, f in forms.items()])
    low = F.greatest(F.col("since"), F.col("start") - WINDOW)
    left = F.substring("text", low + 1, F.col("start") - low)
    broken = (low > F.col("since")) & F.substring("text", low, F.lit(1)).rlike(r"\S")
    left = F.when(broken, F.regexp_replace(left, r"^\S+\s", "")).otherwise(left)
    before = F.regexp_replace(left, rf"(?s)^.*{CLAUSE_END}", "")
    after = F.regexp_replace(F.substring("text", F.col("stop") + 1, F.lit(WINDOW)), rf"(?s){CLAUSE_END}.*$", "")
    return rows.select("doc_id", "page", "start", "stop", "raw", unit.alias("unit"), before.alias("before"), after.alias("after"))


def anchored_values(pages: DataFrame, lexicon: Lexicon, stages=labels.STAGES) -> DataFrame:
    """Values of numbers with a unit that the words before them name, else those after, and of numbers of floors.

    doc_id, page, start, field, value, raw, quote, method, score: one reading a number.
    """
    pages = kept(spread(pages, "doc_id", "page"))
    found = kept(anchors(pages, lexicon))
    windows = found.select(F.explode(F.array("before", "after")).alias("label"), "unit")
    known = labels.answers(windows, lexicon, unit="unit", stages=stages, where="text")
    side = lambda name: known.select(F.col("label").alias(name), "unit", F.col("match").alias(f"_{name}"))
    named = found.join(side("before"), ["before", "unit"], "left").join(side("after"), ["after", "unit"], "left")
    named = named.withColumn("_m", F.coalesce("_before", "_after")).where("_m is not null")
    quote = F.when(F.col("_before").isNotNull(), F.concat("before", "raw")).otherwise(F.concat("raw", F.lit(" "), "after"))
    values = named.withColumn("value", indicator_value(F.col("raw"), F.col("unit"))).where("value is not null")
    columns = ["doc_id", "page", "start", "field", "value", "raw", "quote", "method", "score"]
    values = kept(values.select("doc_id", "page", "start", F.col("_m.field").alias("field"), "value", "raw", F.trim(quote).alias("quote"), F.col("_m.method").alias("method"), F.col("_m.score").alias("score")))
    floors = [(f, stem_pattern(label)) for f, kind, label in lexicon.labels if kind == "text_number_first" and lexicon.units_of[f] == "floor"]
    if not floors:
        return values
    text = plain_yo(F.coalesce("text", F.lit("")))
    rx = rf"(?iu)(?<![0-9])([0-9]{{1,2}})\s*-?\s*(?:{'|'.join(p for _, p in floors)})"
    storeys = pages.select("doc_id", "page", F.explode(places_of(text, rx)).alias("p")).select("doc_id", "page", "p.start", F.col("p.said").alias("quote"))
    storeys = storeys.withColumn("raw", F.regexp_extract("quote", rx, 1))
    storeys = storeys.withColumns({"field": F.lit(floors[0][0]), "value": F.col("raw").cast("double"), "method": F.lit("exact"), "score": F.lit(1.0)})
    return values.unionByName(storeys.select(*columns).join(shuffled(values.select("doc_id", "page", "start")), ["doc_id", "page", "start"], "left_anti"))


def table_lines(lines: DataFrame, boxes: DataFrame, slack: float = 1.0) -> DataFrame:
    """Marks lines that lie in a table's box and hold one of its cells: a frame drawn around a page holds none.

    lines: doc_id, page, line_no, text, top; boxes: doc_id, page, top, bottom, cells (array of text).
    """
    bare = lambda c: F.regexp_replace(F.lower(plain_yo(c)), r"[^\p{L}\p{N}]+", "")
    near = boxes.select("doc_id", "page", F.struct("top", "bottom", F.filter(F.transform("cells", bare), lambda c: F.length(c) >= 2).alias("cells")).alias("b")).groupBy("doc_id", "page").agg(F.collect_list("b").alias("_boxes"))
    joined = lines.join(near, ["doc_id", "page"], "left").withColumn("_bare", bare(F.coalesce("text", F.lit(""))))
    inside = F.exists("_boxes", lambda b: (F.col("top") >= b["top"] - slack) & (F.col("top") <= b["bottom"]) & F.exists(b["cells"], lambda c: F.col("_bare").contains(c)))
    return joined.withColumn("in_table", F.coalesce(inside, F.lit(False))).drop("_boxes", "_bare")


def paragraph_values(pages: DataFrame, words: Wordings) -> DataFrame:
    """Of each page and field the first label with a number after it, and the number of floors: doc_id, page, field, value, raw.

    A cost counts only with its unit right after the number.
    """
    text = plain_yo(F.coalesce("text", F.lit("")))
    found = []
    for field, pattern in sorted(words.by_name("paragraph").items()):
        windows = F.regexp_extract_all(text, F.lit(rf"(?ius)(?<!\p{{L}})(?:{pattern})(?=(.{{0,{AFTER_LABEL}}}))"), F.lit(1))
        hits = F.transform(windows, _number_and_rest)
        good = F.filter(hits, lambda h: (h["raw"] != "") & says(h["rest"], words.cost_unit())) if field == "estimated_cost_ktg" else F.filter(hits, lambda h: h["raw"] != "")
        found.append(F.struct(F.lit(field).alias("field"), F.get(good, F.lit(0)).alias("h")))
    floors = F.struct(F.regexp_extract(text, f"(?iu){words.storeys()}", 1).alias("raw"), F.lit("").alias("rest"))
    found.append(F.struct(F.lit("floors").alias("field"), F.when(floors["raw"] != "", floors).alias("h")))
    rows = pages.select("doc_id", "page", F.explode(F.filter(F.array(*found), lambda x: x["h"].isNotNull())).alias("x")).select("doc_id", "page", "x.field", "x.h.raw", "x.h.rest")
    scale = F.when(F.col("field") == "estimated_cost_ktg", F.coalesce(cost_scale(F.col("rest")), F.lit(1.0))).otherwise(1.0)
    return rows.select("doc_id", "page", "field", F.round(cell_number(F.col("raw")) * scale, 3).alias("value"), "raw")


def _number_and_rest(window: Column) -> Column:
    """The first number of a window and the characters after it."""
    rx = rf"(?s){IN_TEXT}(.{{0,{AFTER_COST}}})"
    return F.struct(F.regexp_extract(window, rx, 1).alias("raw"), F.regexp_extract(window, rx, 2).alias("rest"))


def scanned_lines(lines: DataFrame, words: Wordings) -> DataFrame:
    """Values of lines of a scan, where tables have no cells: a label and the first number after it.

    lines: doc_id, page, line_no, section (PZ, AR, KR, SMETA), text. Gives the field, raw and value of each such line.
    """
    row_fields, materials, totals, ref = words.patterns("row"), words.patterns("material"), words.by_name("totals"), words.estimate_ref()
    text = plain_yo(F.coalesce("text", F.lit("")))
    after = lambda pattern: F.regexp_extract(text, rf"(?ius)(?<!\p{{L}})(?:{pattern}).*?{IN_TEXT}", 1)
    # the pattern of each field's labels, then the first number after them
    by_field = {f"{part}:{f}": rf"(?ius)(?<!\p{{L}})(?:{'|'.join(f'(?:{p})' for g, p in patterns if g == f)}).*?{IN_TEXT}" for part, patterns in (("row", row_fields), ("material", materials)) for f, _ in patterns}
    known = F.create_map(*[F.lit(x) for pair in by_field.items() for x in pair])
    after_of = lambda part: F.call_function("regexp_extract", text, F.coalesce(F.try_element_at(known, F.concat(F.lit(f"{part}:"), "_named")), F.lit("(?!)()")), F.lit(1))
    total = lambda which: says(text, totals.get(which, NOTHING))
    section = F.col("section")
    named = F.when((section == "AR") & total("explication_total") & ~total("floor_subtotal"), F.lit("explication_total_area_m2")).when(section.isin("PZ", "AR"), first_named(text, row_fields)).when(section.isin("KR", "SMETA"), first_named(text, materials))
    rows = once(lines, {"_named": named, "_ref": F.regexp_extract(text, f"(?u){ref}", 1)})
    last = F.try_element_at(F.regexp_extract_all(F.regexp_replace(text, f"(?su)^.*?{ref}", ""), F.lit(IN_TEXT), F.lit(1)), F.lit(-1))
    after_unit = F.regexp_extract(text, rf"(?iu)(?:м³|м²|м3|м2|(?<!\p{{L}})т(?!\p{{L}}))[\s|]*({CELL_NUMBER})", 1)
    smeta = section == "SMETA"
    field = (
        F.when(smeta & F.col("_named").isNotNull(), F.concat(F.lit("local_qty."), "_named"))
        .when(smeta & (F.col("_ref") != ""), F.concat(F.lit("ssr.ch2.os_"), "_ref", F.lit("_ktg")))
        .when(smeta & total("object_total"), "os.total_ktg")
        .when(smeta & total("summary_total"), "ssr.total_ktg")
        .otherwise(F.col("_named"))
    )
    raw = (
        F.when(F.col("_named") == "explication_total_area_m2", after(totals.get("explication_total", NOTHING)))
        .when(section.isin("PZ", "AR"), after_of("row"))
        .when(section == "KR", after_of("material"))
        .when(smeta & F.col("_named").isNotNull(), after_unit)
        .when(smeta & (F.col("_ref") != ""), last)
        .when(total("object_total"), after(totals.get("object_total", NOTHING)))
        .when(total("summary_total"), after(totals.get("summary_total", NOTHING)))
    )
    rows = once(rows, {"field": field, "raw": F.nullif(raw, F.lit(""))}).where("field is not null and raw is not null")
    number = cell_number(F.col("raw"))
    scaled = F.when(F.col("field") == "floors", F.floor(number).cast("double")).when(F.col("field") == "estimated_cost_ktg", F.round(number * F.coalesce(cost_scale(text), F.lit(1.0)), 3)).otherwise(number)
    return rows.withColumn("value", scaled).drop("_named", "_ref")


def section_statements(rows: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """What tables and then paragraphs of a document state, in one order: keys, seq, field, value, raw, source.

    rows: doc_id, field, value, raw and a place `at` that orders them; pages as paragraph_values gives them.
    """
    tables = rows.select(*keys, F.struct(F.lit(0).alias("kind"), F.col("at").cast("long").alias("at"), F.col("field").alias("f")).alias("seq"), "field", "value", "raw", F.lit("table").alias("source"))
    texts = pages.select(*keys, F.struct(F.lit(1).alias("kind"), F.col("page").cast("long").alias("at"), F.col("field").alias("f")).alias("seq"), "field", "value", "raw", F.lit("text").alias("source"))
    return tables.unionByName(texts)


def heights(pages: DataFrame, mention: str) -> DataFrame:
    """Heights in metres right after a mention, in its sentence: doc_id, page, nth, value, raw; only what a storey can have."""
    end = rf"\.\s+(?=[{CAPITAL}][a-zа-яёәғқңөұүһі])"
    tails = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?ius)(?<!\p{{L}}){mention}\p{{L}}*(?=(.{{0,{AFTER_MENTION}}}))"), F.lit(1))
    said = pages.select("doc_id", "page", F.posexplode(tails).alias("nth", "t")).withColumn("t", F.get(F.split("t", end), F.lit(0)))
    raw = F.regexp_extract("t", rf"(?iu)({NUMBER})\s*м(?!\p{{L}})", 1)
    found = said.withColumn("raw", raw).where("raw <> ''").withColumn("value", F.get(number_readings("raw"), F.lit(0)))
    return found.where(F.col("value").between(LEAST_HEIGHT, MOST_HEIGHT)).select("doc_id", "page", "nth", "value", "raw")


def seismic_scope(sentence: Column, objects: Column, words: Wordings) -> Column:
    """Of which scope a sentence on seismicity is: the one building that it names, unless it speaks of the site; else the site."""
    of_site = says(sentence, words.pattern("site"))
    one = F.when(F.size(objects) == 1, F.get(objects, F.lit(0)))
    return F.when(of_site, "site").otherwise(F.coalesce(one, F.lit("site")))


def comparable_values(values: DataFrame, building: DataFrame, project_fields: list[str]) -> DataFrame:
    """The values of the building that other sections speak of; project fields that it lacks come from the project.

    values: package_id, object, field, value, with object `project` for the whole; building: package_id, object (null:
    the note has no buildings, so the project's values stand for one).
    """
    own = values.join(building, ["package_id", "object"], "left_semi").select("package_id", "field", "value")
    whole = values.where("object = 'project'").join(building.select("package_id", F.col("object").alias("_b")), "package_id")
    spare = whole.where(F.col("field").isin(project_fields) | F.col("_b").isNull()).select("package_id", "field", "value")
    return own.unionByName(spare.join(own.select("package_id", "field"), ["package_id", "field"], "left_anti"))


def matched_building(objects: DataFrame, titles: DataFrame) -> DataFrame:
    """The single building that the titles of other sections name: package_id, object; or the only one there is.

    objects: package_id, object, stems (array); titles: package_id, title.
    """
    counts = objects.groupBy("package_id").agg(F.count("*").alias("_n"), F.min("object").alias("_only"), F.collect_list(F.struct("object", "stems")).alias("_objects"))
    words = F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+")
    said = titles.join(counts, "package_id").withColumn("_w", words)
    hits = F.transform(F.filter("_objects", lambda o: F.exists(o["stems"], lambda s: F.exists("_w", lambda w: w.startswith(s)))), lambda o: o["object"])
    named = said.select("package_id", F.explode(hits).alias("object")).groupBy("package_id").agg(F.count_distinct("object").alias("k"), F.min("object").alias("object")).where("k = 1")
    single = counts.where("_n = 1").select("package_id", F.col("_only").alias("object"))
    return single.unionByName(named.join(single.select("package_id"), "package_id", "left_anti").select("package_id", "object"))


def plain_baseline(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The naive way: the first number after a label anywhere in the text: doc_id, field, value."""
    text = F.coalesce("text", F.lit(""))
    hits = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract(text, rf"(?ius){p}[^0-9]{{0,60}}({NUMBER})", 1).alias("raw")) for f, p in sorted(patterns.items())])
    rows = pages.select("doc_id", F.explode(F.filter(hits, lambda h: h["raw"] != "")).alias("h")).select("doc_id", "h.field", "h.raw")
    return rows.withColumn("value", F.get(number_readings("raw"), F.lit(0))).where("value is not null").select("doc_id", "field", "value")
