"""Tables to statements: tables of sections by their kind, and tables of indicators with fields across or down.

Rows of section tables are read one by one with expressions. Grids are cells (doc_id, table_no, page, row_no, col_no,
text); their labels are matched once per distinct label and unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cost_scale, norm_ws, number_readings, once, squash
from ..sources.lexicon import Lexicon, bare_text, begins_with, unit_at_end, unit_of
from ..session import kept, shuffled
from . import labels
from .wordings import Wordings, cell_number, first_named, says

TABLE = ["doc_id", "table_no"]
#: Units whose values are whole numbers.
WHOLE_UNITS = ("floor", "month")


def table_kind(header: Column, context: Column, words: Wordings) -> Column:
    """local, summary, object, estimate_unknown, explication, materials, tep or unknown, in this order."""
    heads, around = F.array_join(header, " "), F.coalesce(context, F.lit(""))
    return (
        F.when(says(heads, words.pattern("header", "price")), "local")
        .when(says(heads, words.pattern("header", "estimate_no")), F.when(says(around, words.pattern("context", "summary")), "summary").when(says(around, words.pattern("context", "object")), "object").otherwise("estimate_unknown"))
        .when(says(around, words.pattern("context", "explication")) | says(heads, words.pattern("header", "room_no")), "explication")
        .when(says(heads, words.pattern("header", "qty")) & says(F.concat_ws(" ", around, heads), words.pattern("context", "materials")), "materials")
        .when(says(heads, words.pattern("header", "value")), "tep")
        .otherwise("unknown")
    )


def header_place(header: Column, kind: str, words: Wordings) -> Column:
    """The place of the first header cell of a kind, from 0; null if there is none."""
    return F.get(F.filter(F.transform(header, lambda h, i: F.when(says(h, words.pattern("header", kind)), i)), lambda i: i.isNotNull()), F.lit(0))


def row_text(cells: Column) -> Column:
    """The cells that are no numbers, joined."""
    return F.array_join(F.filter(cells, lambda x: (F.coalesce(x, F.lit("")) != "") & cell_number(x).isNull()), " ")


def first_lettered(cells: Column) -> Column:
    """The first cell with a letter, else an empty text."""
    return F.coalesce(F.get(F.filter(cells, lambda x: F.coalesce(x.rlike(r"\p{L}"), F.lit(False))), F.lit(0)), F.lit(""))


def kinds_of_tables(headers: DataFrame, words: Wordings) -> DataFrame:
    """Adds kind and the places of columns to tables with header (array) and context."""
    places = {f"_{k}": header_place(F.col("header"), k, words) for k in ("value", "qty", "area", "estimate_no", "unit")}
    return headers.withColumn("kind", table_kind(F.col("header"), F.col("context"), words)).withColumns(places)


def section_rows(headers: DataFrame, rows: DataFrame, keys: list[str], words: Wordings) -> DataFrame:
    """What each row of a section's table states: the row's columns with kind, label, field, raw and value.

    headers: keys, header and context of each table; rows: keys and cells (array of text). A row states one value at
    most; rows that state nothing go.
    """
    known = kinds_of_tables(headers, words).drop("header", "context")
    said = once(rows, {"label": row_text(F.col("cells")), "_last": F.size("cells") - 1})
    read = once(said, {"_material": first_named(F.col("label"), words.patterns("material"))}).join(known, keys)
    read = read.withColumn("_ref", F.regexp_extract(F.coalesce(F.get("cells", F.col("_estimate_no")), F.lit("")), f"(?u)^{words.estimate_ref()}", 1))
    kind, total = F.col("kind"), lambda which: says(F.col("label"), words.pattern("totals", which))
    number = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    room = F.when(total("floor_subtotal"), F.lit(None)).when(total("explication_total"), F.lit("explication_total_area_m2")).when(number.rlike("^[0-9]{1,4}[а-яa-z]?$"), F.concat(F.lit("room."), number, F.lit(".area_m2")))
    has_qty = F.col("_material").isNotNull() & F.col("_qty").isNotNull()
    field = (
        F.when(kind == "tep", first_named(F.col("label"), words.patterns("row")))
        .when(kind == "explication", room)
        .when(kind == "materials", F.when(has_qty, F.col("_material")))
        .when(kind == "local", F.when(has_qty, F.concat(F.lit("local_qty."), F.col("_material"))).when(total("local_total"), F.lit("local.total_tg")))
        .when(kind == "object", F.when(total("object_total"), F.lit("os.total_ktg")))
        .when(kind == "summary", F.when(F.col("_ref") != "", F.concat(F.lit("ssr.ch2.os_"), F.col("_ref"), F.lit("_ktg"))).when(total("summary_total"), F.lit("ssr.total_ktg")))
    )
    at = F.when(kind == "tep", F.coalesce("_value", "_last")).when(kind == "explication", F.coalesce("_area", F.col("_last") - 1)).when(has_qty & kind.isin("materials", "local"), F.col("_qty")).otherwise(F.col("_last"))
    read = once(once(read, {"field": field, "_at": at.cast("int")}), {"raw": F.get("cells", F.col("_at"))})
    read = once(read, {"_v": cell_number(F.col("raw"))})
    stated_unit = F.coalesce(F.get("cells", F.col("_unit")), F.col("label"))
    scale = F.coalesce(cost_scale(F.concat(stated_unit, F.lit(" "), F.col("label"))), F.lit(1.0))
    value = F.when((kind == "tep") & (F.col("field") == "estimated_cost_ktg"), F.round(F.col("_v") * scale, 3)).when(F.col("field") == "floors", F.floor("_v").cast("double")).otherwise(F.col("_v"))
    helpers = [x for x in read.columns if x.startswith("_")]
    return read.withColumn("value", value).where("field is not null and value is not null").drop(*helpers)


# ---- grids of indicators


def grid_rows(cells: DataFrame) -> DataFrame:
    """Rows of grids: doc_id, table_no, page, row_no, cells (by col_no, gaps empty) and label."""
    whole = cells.groupBy(*TABLE, "row_no").agg(F.min("page").alias("page"), F.max("col_no").alias("_n"), F.map_from_entries(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("t")))).alias("_m"))
    texts = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("")))
    rows = whole.select(*TABLE, "page", "row_no", texts.alias("cells"))
    return rows.withColumn("label", first_lettered(F.col("cells")))


def indicator_value(text: Column, unit: Column) -> Column:
    """The first reading; floors and months only if it is a whole number."""
    value = F.get(number_readings(norm_ws(text)), F.lit(0))
    return F.when(unit.isin(*WHOLE_UNITS) & (value != F.floor(value)), F.lit(None)).otherwise(value)


def _matched(said: DataFrame, lexicon: Lexicon, stages) -> DataFrame:
    """label, unit and match of distinct pairs."""
    return labels.answers(said, lexicon, unit="unit", stages=stages).select("label", "unit", "match.field", "match.method", "match.score")


def _spellings(lexicon: Lexicon, kind: str) -> list[str]:
    return [s for k, s in lexicon.headers if k == kind]


def fields_across(cells: DataFrame, rows: DataFrame, lexicon: Lexicon, stages=labels.STAGES) -> DataFrame:
    """Of tables with a row among the first three that names two fields: header_no, col_no, field, method, score.

    A column's unit is at the end of its header, or in a row of units right below.
    """
    below = rows.where("row_no <= 3").where(begins_with("label", _spellings(lexicon, "units_row"))).select(*TABLE, (F.col("row_no") - 1).alias("row_no"), F.col("cells").alias("_units"))
    heads = cells.where("row_no < 3 and text <> ''").join(shuffled(below), [*TABLE, "row_no"], "left")
    unit = F.coalesce(unit_at_end("text", lexicon.units), unit_of(F.coalesce(F.get("_units", F.col("col_no")), F.lit("")), lexicon.units))
    heads = kept(heads.select(*TABLE, "row_no", "col_no", F.col("text").alias("label"), unit.alias("unit")))
    found = _matched(heads, lexicon, stages)
    named = kept(heads.alias("h").join(found.alias("f"), (F.col("h.label") == F.col("f.label")) & F.col("h.unit").eqNullSafe(F.col("f.unit"))).select(*[f"h.{c}" for c in (*TABLE, "row_no", "col_no")], "field", "method", "score"))
    header = named.groupBy(*TABLE, "row_no").agg(F.count_distinct("field").alias("n")).where("n >= 2").groupBy(*TABLE).agg(F.min("row_no").alias("row_no"))
    return named.join(shuffled(header), [*TABLE, "row_no"]).withColumnRenamed("row_no", "header_no")


def across(cells: DataFrame, lexicon: Lexicon, stages=labels.STAGES) -> DataFrame:
    """Values of tables with fields across: table, page, row_no, col_no, label, field, value, raw, method, score, n_rows.

    Rows of totals and units, and rows without any value, state nothing; n_rows counts the others of the table.
    """
    rows = kept(grid_rows(cells))
    named = fields_across(cells, rows, lexicon, stages)
    skipped = begins_with("label", _spellings(lexicon, "total_row")) | begins_with("label", _spellings(lexicon, "units_row"))
    units = F.try_element_at(F.create_map(*[F.lit(x) for pair in lexicon.units_of.items() for x in pair]), F.col("field"))
    body = rows.where(~((F.col("label") != "") & skipped)).join(shuffled(named), TABLE).where("row_no > header_no")
    values = kept(body.withColumn("raw", F.get("cells", F.col("col_no"))).withColumn("value", indicator_value(F.col("raw"), units)).where("value is not null"))
    counts = values.groupBy(*TABLE).agg(F.count_distinct("row_no").alias("n_rows"))
    return values.join(shuffled(counts), TABLE).select(*TABLE, "page", "row_no", "col_no", "label", "field", "value", "raw", "method", "score", "n_rows", "cells")


def with_row_objects(values: DataFrame, contexts: DataFrame, named: DataFrame) -> DataFrame:
    """Adds the object of each row: of a table's only row the context's; else the one named by the label; else the context's.

    contexts: doc_id, table_no, ctx; named: doc_id, label, object_id (one row a label that names one object).
    """
    placed = values.join(shuffled(contexts), TABLE, "left").join(shuffled(named), ["doc_id", "label"], "left")
    return placed.withColumn("object", F.when((F.col("n_rows") == 1) & F.col("ctx").isNotNull(), F.col("ctx")).otherwise(F.coalesce("object_id", "ctx"))).drop("object_id", "ctx")


def down(cells: DataFrame, lexicon: Lexicon, stages=labels.STAGES) -> DataFrame:
    """Values of tables with fields down a column: table, page, row_no, label, field, value, raw, method, score.

    Columns of row numbers are skipped; the last column with units in half of its cells gives units; of the others the
    one with most known labels (two at least) names fields, and of the rest the one with most numbers gives values; the
    leftmost wins ties.
    """
    rows = kept(grid_rows(cells))
    below_head = (F.col("row_no") > 0) & (F.coalesce("text", F.lit("")) != "")
    is_unit = unit_of(F.coalesce("text", F.lit("")), lexicon.units).isNotNull()
    bare_heads = [F.lit(s) for s in sorted({bare_text(s) for s in _spellings(lexicon, "number")})]
    columns = cells.groupBy(*TABLE, "col_no").agg(
        F.max(F.when(F.col("row_no") == 0, squash(F.coalesce("text", F.lit(""))).isin(*bare_heads))).alias("numbers_rows"),
        F.count_if(below_head).alias("n"),
        F.count_if(below_head & is_unit).alias("n_units"),
        F.count_if((F.col("row_no") > 0) & (F.size(number_readings(F.coalesce("text", F.lit("")))) > 0)).alias("n_numbers"),
    )
    columns = kept(columns.withColumn("numbers_rows", F.coalesce("numbers_rows", F.lit(False))).withColumn("units", ~F.col("numbers_rows") & (F.col("n") > 0) & (F.col("n_units") >= F.col("n") / 2)))
    unit_column = columns.where("units").groupBy(*TABLE).agg(F.max("col_no").alias("unit_col"))
    free = columns.where("not units and not numbers_rows").select(*TABLE, "col_no", "n_numbers")
    in_row = rows.join(shuffled(unit_column), TABLE, "left").select(*TABLE, "page", "row_no", "cells", unit_of(F.coalesce(F.get("cells", F.col("unit_col")), F.lit("")), lexicon.units).alias("unit"))
    said = cells.where("text <> ''").join(shuffled(free.select(*TABLE, "col_no")), [*TABLE, "col_no"], "left_semi").select(*TABLE, "row_no", "col_no", F.col("text").alias("label"))
    said = kept(said.join(shuffled(in_row), [*TABLE, "row_no"]))
    found = _matched(said, lexicon, stages)
    named = kept(said.alias("s").join(found.alias("f"), (F.col("s.label") == F.col("f.label")) & F.col("s.unit").eqNullSafe(F.col("f.unit"))).select(*[f"s.{c}" for c in (*TABLE, "page", "row_no", "col_no", "label", "cells")], "field", "method", "score"))
    hits = named.groupBy(*TABLE, "col_no").agg(F.count("*").alias("hits"))
    label_column = hits.groupBy(*TABLE).agg(F.max(F.struct("hits", -F.col("col_no"))).alias("b")).where("b.hits >= 2").select(*TABLE, (-F.col("b.col2")).alias("col_no"))
    value_column = free.join(shuffled(label_column), [*TABLE, "col_no"], "left_anti").groupBy(*TABLE).agg((-F.max(F.struct("n_numbers", -F.col("col_no")))["col2"]).alias("value_col"))
    units = F.try_element_at(F.create_map(*[F.lit(x) for pair in lexicon.units_of.items() for x in pair]), F.col("field"))
    values = named.join(shuffled(label_column), [*TABLE, "col_no"]).join(shuffled(value_column), TABLE).withColumn("raw", F.get("cells", F.col("value_col")))
    return values.withColumn("value", indicator_value(F.col("raw"), units)).where("value is not null").select(*TABLE, "page", "row_no", "label", "field", "value", "raw", "method", "score", "cells")


def table_values(cells: DataFrame, lexicon: Lexicon, stages=labels.STAGES) -> DataFrame:
    """Both forms, a table with fields across not being read down: adds source table_h or table_v."""
    wide = kept(across(cells, lexicon, stages))
    rest = kept(cells.join(shuffled(wide.select(*TABLE).distinct()), TABLE, "left_anti"))
    columns = [*TABLE, "page", "row_no", "label", "field", "value", "raw", "method", "score", "cells"]
    return wide.select(*columns, F.lit("table_h").alias("source")).unionByName(down(rest, lexicon, stages).select(*columns, F.lit("table_v").alias("source")))


def row_quote(cells: Column, page_text: Column, cell: Column) -> Column:
    """The row's cells joined if the page says them so, else the cell; null if the page says neither."""
    joined = norm_ws(F.array_join(F.filter(cells, lambda x: F.coalesce(x, F.lit("")) != ""), " "))
    return F.when(page_text.contains(joined), joined).when(page_text.contains(cell), cell)


def objects_of_rows(values: DataFrame, headings: DataFrame) -> DataFrame:
    """Names of objects: headings, and labels of tables with several data rows that no heading names.

    headings: doc_id, name, seq. Gives doc_id, name, object_id (obj1, obj2, ... headings first, then rows in order).
    """
    several = values.where("label <> ''").groupBy(*TABLE).agg(F.count_distinct("label").alias("n")).where("n >= 2").select(*TABLE)
    rows = values.join(shuffled(several), TABLE).select("doc_id", F.col("label").alias("name"), F.lit(1).alias("kind"), F.struct("table_no", "row_no").alias("at"))
    heads = headings.select("doc_id", "name", F.lit(0).alias("kind"), F.struct(F.col("seq").cast(values.schema["table_no"].dataType).alias("table_no"), F.lit(0).cast(values.schema["row_no"].dataType).alias("row_no")).alias("at"))
    once = heads.unionByName(rows).groupBy("doc_id", squash("name").alias("_k")).agg(F.min(F.struct("kind", "at", "name")).alias("f"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.kind", "f.at", "f.name"))
    return once.select("doc_id", F.col("f.name").alias("name"), F.concat(F.lit("obj"), number).alias("object_id"))
