"""A whole note in one plan: lines and tables of many documents to one chosen value of each object and field.

Every candidate carries where it comes from (source), which stage named it (method) and how its object was found (how:
row, mention, heading, single, project). Stages are a column of the candidates, so results of any prefix of stages are
filters of one run, and several configurations are scored from one reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import squash
from ..session import kept, shuffled
from ..sources.lexicon import Lexicon
from . import tables, texts
from .extract import choose_slots, discover_objects, headings, mentioned
from .ordered import heading_context
from .scoring import prf_by, value_counts

PROJECT = "project"
#: A result is that of these stages so far; exact and fuzzy name fields, anchor reads sentences by their numbers.
STAGES = ("exact", "anchor", "fuzzy", "embedding")
COLUMNS = ["doc_id", "object", "field", "value", "raw", "quote", "source", "method", "score", "how", "page", "seq"]


def note_objects(lines: DataFrame, wide: DataFrame, nouns: str) -> DataFrame:
    """doc_id, object_id, name, stems: headings with a building's noun, and row labels of tables of several buildings.

    wide: what `tables.across` reads of the documents.
    """
    heads = discover_objects(lines, nouns)
    numbered = heads.select("doc_id", "name", F.regexp_extract("object_id", r"(\d+)", 1).cast("int").alias("seq"))
    every = tables.objects_of_rows(wide, numbered)
    own = heads.select("doc_id", squash("name").alias("_k"), "stems")
    found = every.withColumn("_k", squash("name")).join(shuffled(own), ["doc_id", "_k"], "left")
    words = F.array_distinct(F.transform(F.filter(F.split("name", r"[\s\-–]+"), lambda w: F.length(w) >= 3), lambda w: F.lower(w)))
    return found.select("doc_id", "object_id", "name", F.coalesce("stems", words).alias("stems"))


def line_contexts(lines: DataFrame, objects: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The object that headings give each line (adds level and ctx) and each table (doc_id, table_no, ctx).

    lines: doc_id, page, line_no, text, top, in_table; boxes: doc_id, table_no, page, top. Lines and tables are scanned
    together in reading order, over pages: a table has the context of the last line above it.
    """
    named = objects.select("doc_id", squash("name").alias("_k"), F.col("object_id").alias("object"))
    marked = headings(lines).withColumn("_k", squash("title")).join(shuffled(named), ["doc_id", "_k"], "left")
    rows = marked.select("doc_id", "page", "top", F.lit(1).alias("kind"), F.col("line_no").alias("no"), "level", "object", "text", "in_table")
    every = rows.unionByName(boxes.select("doc_id", "page", "top", F.lit(0).alias("kind"), F.col("table_no").alias("no")), allowMissingColumns=True)
    scanned = kept(heading_context(every, ["doc_id"], ["page", "top", "kind", "no"]))
    of = lambda kind, *columns: scanned.where(F.col("kind") == kind).select("doc_id", *columns, "ctx")
    return of(1, "page", F.col("no").alias("line_no"), "text", "top", "in_table", "level"), of(0, F.col("no").alias("table_no"))


def note_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page, text (lines outside tables) and starts: where each line begins, and its context; a page is one row.

    lines: as line_contexts gives them. A heading ends with a semicolon, so no sentence goes on over it.
    """
    own = lines.where(~F.coalesce("in_table", F.lit(False)))
    page = own.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "line_no", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("level").isNotNull(), ";").otherwise("")).alias("text"), "ctx"))).alias("_l"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ctx:string>>").alias("all"))
    starts = F.aggregate("_l", first, lambda s, x: F.struct((s["at"] + F.length(x["text"]) + 1).alias("at"), F.concat(s["all"], F.array(F.struct(s["at"].alias("start"), x["ctx"].alias("ctx")))).alias("all")))["all"]
    return page.select("doc_id", "page", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"), starts.alias("starts"))


def candidates(lines: DataFrame, cells: DataFrame, boxes: DataFrame, lexicon: Lexicon, nouns: str) -> DataFrame:
    """All values that tables and sentences of notes state, each with its object: the columns of COLUMNS.

    Values of no object are the project's; where a document has one building, they are that building's.
    """
    wide = kept(tables.across(cells, lexicon))
    objects = kept(note_objects(lines, wide, nouns))
    of_lines, of_tables = line_contexts(lines, objects, boxes)

    tall = tables.down(kept(cells.join(shuffled(wide.select(*tables.TABLE).distinct()), tables.TABLE, "left_anti")), lexicon)
    by_name = objects.select("doc_id", squash("name").alias("_k"), F.col("object_id").alias("_row"))
    across = wide.withColumn("_k", squash("label")).join(shuffled(by_name), ["doc_id", "_k"], "left").join(shuffled(of_tables), tables.TABLE, "left")
    alone = (F.col("n_rows") == 1) & F.col("ctx").isNotNull()
    across = across.withColumn("object", F.when(alone, F.col("ctx")).otherwise(F.coalesce("_row", "ctx"))).withColumn("how", F.when(~alone & F.col("_row").isNotNull(), "row").when(F.col("ctx").isNotNull(), "heading"))
    down = tall.join(shuffled(of_tables), tables.TABLE, "left").withColumn("object", F.col("ctx")).withColumn("how", F.when(F.col("ctx").isNotNull(), "heading"))
    quote = F.array_join(F.filter("cells", lambda x: F.coalesce(x, F.lit("")) != ""), " ").alias("quote")
    place = F.struct("page", F.lit(0).alias("kind"), F.col("table_no").cast("long").alias("at"), F.col("row_no").cast("long").alias("row")).alias("seq")
    columns = ["doc_id", "object", "field", "value", "raw", quote]
    stated = across.select(*columns, F.lit("table_h").alias("source"), "method", "score", "how", "page", place)
    stated = stated.unionByName(down.select(*columns, F.lit("table_v").alias("source"), "method", "score", "how", "page", place))

    pages = kept(note_pages(of_lines))
    found = texts.anchored_values(pages.select("doc_id", "page", "text"), lexicon)
    said = mentioned(found, objects, "quote").join(shuffled(pages.select("doc_id", "page", "starts")), ["doc_id", "page"])
    above = F.try_element_at(F.filter("starts", lambda s: s["start"] <= F.col("start")), F.lit(-1))["ctx"]
    said = said.withColumn("object", F.coalesce("mentioned", above)).withColumn("how", F.when(F.col("mentioned").isNotNull(), "mention").when(above.isNotNull(), "heading"))
    place = F.struct("page", F.lit(1).alias("kind"), F.col("start").cast("long").alias("at"), F.lit(0).cast("long").alias("row")).alias("seq")
    stated = stated.unionByName(said.select("doc_id", "object", "field", "value", "raw", "quote", F.lit("text").alias("source"), "method", "score", "how", "page", place))

    single = objects.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("object_id").alias("_only")).where("_n = 1").drop("_n")
    placed = stated.join(shuffled(single), "doc_id", "left")
    how = F.coalesce("how", F.when(F.col("_only").isNotNull(), "single").otherwise(F.lit(PROJECT)))
    return placed.withColumn("how", how).withColumn("object", F.coalesce("object", "_only", F.lit(PROJECT))).select(*COLUMNS)


def of_stages(found: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """The candidates that a prefix of stages gives."""
    if tuple(stages) != STAGES[: len(stages)]:
        raise ValueError(f"stages are a beginning of {STAGES}")
    named = F.col("method").isin([s for s in stages if s != "anchor"])
    return found.where(named & ((F.col("source") != "text") | F.lit("anchor" in stages)))


def slots(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One value an object and field: tables before sentences, exact before fuzzy, higher scores, then reading order."""
    return choose_slots(found, [*(keys or []), "doc_id", "object", "field"])


def extract_notes(lines: DataFrame, cells: DataFrame, boxes: DataFrame, lexicon: Lexicon, nouns: str, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """doc_id, object, field, value and its reason (source, method, how, quote, page) of every note."""
    return slots(of_stages(candidates(lines, cells, boxes, lexicon, nouns), stages)).drop("seq")


def experiment(found: DataFrame, gold: DataFrame, runs: dict[str, tuple[str, ...]], by: list[str], within: float = 1e-6) -> DataFrame:
    """run, by..., tp, fp, fn, p, r, f1 of several prefixes of stages, all from one table of candidates.

    gold: doc_id, object, field, value and the columns of `by` (of documents). Each run is a row that a candidate is
    exploded to, so candidates are chosen and scored once for all runs.
    """
    of = lambda stages: [m for m in stages if m != "anchor"]
    fits = F.filter(F.array(*[F.struct(F.lit(n).alias("run"), F.array(*map(F.lit, of(s))).alias("methods"), F.lit("anchor" in s).alias("reads")) for n, s in runs.items()]), lambda r: F.array_contains(r["methods"], F.col("method")) & ((F.col("source") != "text") | r["reads"]))
    gold = kept(gold)
    chosen = slots(found.withColumn("_r", F.explode(fits)).withColumn("run", F.col("_r.run")).drop("_r"), ["run"])
    keys = ["run", "doc_id", "object", "field"]
    wanted = gold.select(F.explode(F.array(*map(F.lit, runs))).alias("run"), "doc_id", "object", "field", "value")
    counts = value_counts(wanted, chosen.select(*keys, "value"), keys, "value", within).join(shuffled(gold.select("doc_id", *by).distinct()), "doc_id")
    return prf_by(counts, [["run"], ["run", *by]], ["run", *by])


def dump(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, page, kind, no, text: pages as one looks at them: lines, and rows of tables with cells parted by bars."""
    rows = cells.groupBy("doc_id", "page", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("t")))).alias("_c"))
    row = rows.select("doc_id", "page", F.concat(F.lit("table "), "table_no").alias("kind"), F.col("row_no").alias("no"), F.array_join(F.transform("_c", lambda x: x["t"]), " | ").alias("text"))
    return lines.select("doc_id", "page", F.lit("line").alias("kind"), F.col("line_no").alias("no"), F.coalesce("text", F.lit("")).alias("text")).unionByName(row)


