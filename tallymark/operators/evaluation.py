"""Predictions against annotated documents: object names, findings, values, levels, scanned units, model answers."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import c, norm_ws, occurrences, stem
from .ordered import first_per
from .scoring import greedy_one_to_one

#: Objects that are no buildings; the levels of findings; points for equal names and abbreviations.
RESERVED = ("site", "document", "all")
LEVELS = ("numeric", "logical", "completeness", "expert", "formal")
SAME_NAME, SAME_SHORT = 10, 2
LEAST_LINE = 0.6


def name_words(name) -> Column:
    return F.filter(F.split(c(name), r"[\s\-–]+"), lambda w: w != "")


def name_stems(name) -> Column:
    return F.array_distinct(F.transform(F.filter(name_words(name), lambda w: F.length(w) >= 3), stem))


def short_name(name) -> Column:
    """First letters of a name of two words or more, else an empty text."""
    return F.when(F.size(name_words(name)) >= 2, F.lower(F.array_join(F.transform(name_words(name), lambda w: F.substring(w, 1, 1)), ""))).otherwise("")


def object_scores(said: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pid, gid, score of pairs that share word stems, a short name or the name. Both: keys, id, name.

    Pairs come from equi-joins on what they share, so objects that share nothing never meet.
    """
    side = lambda df, i: df.where(~F.col("id").isin(*RESERVED)).select(*keys, F.col("id").alias(i), "name")
    p, g = side(said, "pid"), side(known, "gid")
    stems = lambda df, i: df.select(*keys, i, F.explode(name_stems("name")).alias("on"))
    shared = stems(p, "pid").join(stems(g, "gid"), [*keys, "on"]).select(*keys, "pid", "gid", F.lit(1).alias("s"))
    short = p.select(*keys, "pid", short_name("name").alias("on")).where("on <> ''")
    shorts = g.select(*keys, "gid", F.explode(F.array_distinct(F.array(F.lower("gid"), short_name("name")))).alias("on"))
    abbreviated = short.join(shorts, [*keys, "on"]).select(*keys, "pid", "gid", F.lit(SAME_SHORT).alias("s")).distinct()
    whole = lambda df, i: df.select(*keys, i, F.lower(F.trim("name")).alias("on"))
    same = whole(p, "pid").join(whole(g, "gid"), [*keys, "on"]).select(*keys, "pid", "gid", F.lit(SAME_NAME).alias("s"))
    return shared.unionByName(abbreviated).unionByName(same).groupBy(*keys, "pid", "gid").agg(F.sum("s").cast("long").alias("score"))


def mapped_objects(said: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pid, gid: reserved objects to themselves, others one to one, the best score first."""
    reserved = said.where(F.col("id").isin(*RESERVED)).join(known, [*keys, "id"], "left_semi").select(*keys, F.col("id").alias("pid"), F.col("id").alias("gid"))
    return reserved.unionByName(greedy_one_to_one(object_scores(said, known, keys), keys, "pid", "gid", "score").select(*keys, "pid", "gid"))


def matched_findings(gold: DataFrame, said: DataFrame, objects: DataFrame) -> DataFrame:
    """doc_id, gold_seq, said_seq: each finding of the gold, in order, takes the first free one of its type and object
    with a page in common. Both: doc_id, seq, type, object, pages (array); objects: doc_id, pid, gid.

    No pairs are made: rows of a document, type and object come sorted to a task, which holds what is said of that key (a
    place a page) and reads the gold's rows in order. Serving in order can't be shared by tasks, so a key isn't split.
    """
    own = said.join(objects, (said.doc_id == objects.doc_id) & (said.object == objects.pid), "left").select(said.doc_id, "seq", "type", F.coalesce("gid", "object").alias("object"), "pages")
    keys, place = ["doc_id", "type", "object"], F.col("seq").asc_nulls_last()
    side = lambda df, n: df.select(*keys, F.lit(n).alias("side"), "seq", "pages").na.drop(subset=keys)
    rows = side(own.where("seq is not null"), 0).unionByName(side(gold, 1))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "side", place)
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, rows.schema["seq"].dataType) for n in ("gold_seq", "said_seq")]])
    chosen = dealt.mapInArrow(_first_free(to_arrow_schema(schema)), schema)
    return chosen.select("doc_id", F.col("gold_seq").cast(gold.schema["seq"].dataType), F.col("said_seq").cast(said.schema["seq"].dataType))


def _first_free(schema: pa.Schema):
    """Pairs of sorted rows (doc_id, type, object, side, seq, pages): of a key those said come first, then the gold's.

    What is said waits in a line on each of its pages; a finding of the gold looks at the heads of its pages' lines only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seqs, taken, lines, heads = None, [], bytearray(), {}, {}  # lines, heads by page: places in seqs, how many are done
        waiting: tuple | None = None  # the gold's finding, and the pages of all its rows
        out: list[tuple] = []

        def serve() -> None:
            first = None
            for page in waiting[1]:
                line, at = lines.get(page, ()), heads.get(page, 0)
                while at < len(line) and taken[line[at]]:
                    at += 1
                heads[page] = at
                if at < len(line) and (first is None or line[at] < first):
                    first = line[at]
            if first is not None:
                taken[first] = 1
                out.append((key[0], waiting[0], seqs[first]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for *of, side, seq, pages in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                own = set(pages or ()) - {None}
                if waiting and (of != key or waiting[0] != seq):
                    serve()
                    waiting = None
                if of != key:
                    key, seqs, taken, lines, heads = of, [], bytearray(), {}, {}
                if side:
                    waiting = (seq, own | waiting[1] if waiting else own)
                    continue
                if not seqs or seqs[-1] != seq:
                    seqs.append(seq)
                    taken.append(0)
                for page in own:
                    lines.setdefault(page, array("q")).append(len(seqs) - 1)
            yield batch_of(out)
            out.clear()
        if waiting:
            serve()
            yield batch_of(out)

    return run


def by_level(gold: DataFrame, said: DataFrame, pairs: DataFrame) -> DataFrame:
    """found, missed and false of every level, zeros included."""
    hits = lambda name: pairs.select("doc_id", F.col(name).alias("seq")).distinct().withColumn("_hit", F.lit(True))
    judged = gold.join(hits("gold_seq"), ["doc_id", "seq"], "left").select("level", F.when(F.col("_hit"), "found").otherwise("missed").alias("what"))
    rows = judged.unionByName(said.join(hits("said_seq"), ["doc_id", "seq"], "left_anti").select("level", F.lit("false").alias("what")))
    counts = rows.groupBy("level").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("found", "missed", "false")])
    every = gold.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    return every.join(counts, "level", "left").na.fill(0)


def value_verdicts(gold: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """ok, missing or wrong for every annotated value. gold: keys, values (the first is the table's); said: keys, value."""
    first = gold.withColumn("stated", F.get("values", F.lit(0))).join(said, keys, "left")
    verdict = F.when(F.col("value").isNull(), "missing").when(F.abs(F.col("value") - F.col("stated")) < 1e-6, "ok").otherwise("wrong")
    return first.select(*keys, "stated", "value", verdict.alias("verdict"))


def each_value(gold: DataFrame, keys: list[str]) -> DataFrame:
    """Values of lists with their place: the first is the table's."""
    return gold.select(*keys, F.posexplode("values").alias("nth", "value"))


def is_trivial(value) -> Column:
    """Small whole numbers are found anywhere and tell nothing."""
    return (c(value) == F.floor(c(value))) & (F.abs(c(value)) < 100)


def extractability_summary(hits: DataFrame) -> DataFrame:
    """Counters over hits: value, where (table, text, none), column_ok, ambiguous; trivial values apart."""
    trivial, telling = is_trivial("value"), ~is_trivial("value")
    at = lambda place: F.count_if(telling & (F.col("where") == place))
    return hits.agg(
        F.count("*").alias("n_values"), F.count_if(telling).alias("informative"), at("table").alias("in_table"), F.count_if(telling & F.col("column_ok")).alias("right_column"),
        at("text").alias("text_only"), at("none").alias("not_found"), F.count_if(F.col("ambiguous")).alias("n_ambiguous"), F.count_if(trivial).alias("n_trivial"),
    )


def gold_slots(gold: DataFrame) -> DataFrame:
    """The distinct (set, type, field) of a gold's discrepancies, a missing field as an empty text."""
    return gold.select("set_no", F.explode("discrepancies").alias("d")).select("set_no", "d.type", F.coalesce("d.field", F.lit("")).alias("field")).distinct()


def flattened(objects: DataFrame, keys: list[str], name: str = "tep") -> DataFrame:
    """keys, object, field, value of nested maps: the gold's form of values by object."""
    return objects.select(*keys, F.explode(name).alias("object", "m")).select(*keys, "object", F.explode("m").alias("field", "value")).where("value is not null")


def nested(values: DataFrame, keys: list[str]) -> DataFrame:
    """The same values as maps from `object/field`."""
    path = F.concat_ws("/", "object", "field")
    return values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(path, "value")))).alias("values"))


def stripped_units(text) -> Column:
    """A line without the signs that scans put for units, for comparing lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(c(text), r"(?iu)(?<!\p{L})[мm]\s?[23²³зЗ?*]?(?![\p{L}\p{N}])", ""), r"\s+", " "))


def masked_exponents(text) -> Column:
    return F.regexp_replace(c(text), "[²³]", "?")


def quote_problems(references: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds problem to references whose page doesn't say their quote: not found, found on pages [...], count n != m.

    references: ref_id, doc_id, page, quote, occurrences (null: any number); pages: doc_id, page, text. Spaces don't count.
    Only quotes that their own page lacks are looked for on the other pages of the document.
    """
    said = references.withColumn("_q", norm_ws("quote")).where("_q <> ''")
    texts = pages.select("doc_id", F.col("page").alias("_page"), norm_ws("text").alias("_t"))
    own = said.join(texts, (said["doc_id"] == texts["doc_id"]) & (F.col("page") == F.col("_page")), "left").drop(texts["doc_id"])
    counted = own.withColumn("_n", F.coalesce(occurrences("_t", "_q"), F.lit(0))).drop("_t", "_page")
    lacking = counted.where("_n = 0")
    other = lacking.select("ref_id", "doc_id", "_q").join(texts, "doc_id").where(F.col("_t").contains(F.col("_q")))
    found = other.groupBy("ref_id").agg(F.array_sort(F.collect_set("_page")).alias("_pages"))  # pages of a document
    odd = counted.where((F.col("_n") == 0) | (F.col("occurrences").isNotNull() & (F.col("_n") != F.col("occurrences")))).join(found, "ref_id", "left")
    elsewhere = F.concat(F.lit("found on pages ["), F.array_join(F.col("_pages").cast("array<string>"), ", "), F.lit("]"))
    problem = F.when((F.col("_n") == 0) & F.col("_pages").isNotNull(), elsewhere).when(F.col("_n") == 0, "not found").otherwise(F.concat(F.lit("count "), "_n", F.lit(" != "), "occurrences"))
    return odd.select(*references.columns, problem.alias("problem"))


#: Lines of a page that one task compares with as many of the other side; classes of letters that are counted.
LINE_BLOCK, LETTER_CLASSES = 256, 64


def _letters(texts: list[str]) -> np.ndarray:
    """How many letters of each class a text has: what two texts have in common is no more than the sum of least counts."""
    out = np.zeros((len(texts), LETTER_CLASSES), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.bincount(codes % LETTER_CLASSES, minlength=LETTER_CLASSES)
    return out


def most_similar(lines: list[str], others: list[str], least: float) -> list[tuple[int, float] | None]:
    """Of each line the first of the most similar others, if it is similar enough.

    No two texts are more alike than their letters' counts allow. Others are compared in the order of that bound, and no
    further than the best found, so none that could be as good is left out.
    """
    if not others:
        return [None] * len(lines)
    own, theirs = _letters(lines), _letters(others)
    total = own.sum(axis=1)[:, None] + theirs.sum(axis=1)[None, :]
    shared = np.zeros(total.shape, np.int64)
    for k in range(LETTER_CLASSES):
        shared += np.minimum(own[:, k][:, None], theirs[:, k][None, :])
    bound = np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)
    out: list[tuple[int, float] | None] = []
    for i, line in enumerate(lines):
        best: tuple[float, int] | None = None
        for j in np.argsort(-bound[i], kind="stable").tolist():
            if bound[i, j] < (best[0] if best else least):
                break
            ratio = SequenceMatcher(None, line, others[j], autojunk=False).ratio()
            if ratio >= least and (best is None or (ratio, -j) > (best[0], -best[1])):
                best = (ratio, j)
        out.append((best[1], best[0]) if best else None)
    return out


def aligned_lines(scanned: DataFrame, original: DataFrame, keys: list[str], least: float = LEAST_LINE) -> DataFrame:
    """Of each scanned line the most similar original line of its page, if similar enough: keys, line_no, other_no, ratio.

    The result is that of comparing all lines of a page; ties go to the smaller other_no. Pages are cut into blocks of
    lines, so a page of any length is compared by many tasks, a block with a block. Null texts count as empty.
    """
    names = [f"g{i}" for i in range(len(keys))]
    side = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("line_no").alias("no"), stripped_units(F.coalesce("text", F.lit(""))).alias("text"))
    left, right = side(scanned), side(original)
    blocks = lambda df, name: df.groupBy(*names).agg(F.ceil(F.count("*") / LINE_BLOCK).cast("int").alias(name))
    pages = blocks(left, "xs").join(blocks(right, "ys"), names)
    place = lambda n: F.pmod(F.xxhash64("no", "text"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(pages, names).withColumn("x", place("xs")).withColumn("y", every("ys")).withColumn("side", F.lit(1))
    right = right.join(pages, names).withColumn("y", place("ys")).withColumn("x", every("xs")).withColumn("side", F.lit(0))
    columns = [*names, "x", "y", "side", "no", "text"]
    both = left.select(*columns).unionByName(right.select(*columns))
    order = [*names, "x", "y"]
    dealt = both.repartition(*order).sortWithinPartitions(*order, "side", "no")
    schema = T.StructType([*[dealt.schema[n] for n in names], dealt.schema["no"], T.StructField("other", dealt.schema["no"].dataType), T.StructField("ratio", T.DoubleType())])

    def of_block(rows: list[tuple]) -> list[tuple]:
        lines, others = [r for r in rows if r[-3] == 1], [r for r in rows if r[-3] == 0]
        found = most_similar([r[-1] for r in lines], [r[-1] for r in others], least)
        return [(*r[: len(names)], r[-2], others[f[0]][-2], f[1]) for r, f in zip(lines, found, strict=True) if f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = len(names) + 2
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][:size] != row[:size]:
                    out += of_block(held)
                    held = []
                held.append(row)
            if out:
                yield as_batch(out)
        if held and (out := of_block(held)):
            yield as_batch(out)

    kinds = to_arrow_schema(schema)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], names=kinds.names)

    found = dealt.mapInArrow(run, schema)
    best = found.groupBy(*names, "no").agg(F.max("ratio").alias("ratio"), F.min_by("other", F.struct(-F.col("ratio"), "other")).alias("other"))
    return best.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("no").alias("line_no"), F.col("other").alias("other_no"), "ratio")


def unit_recovery(pairs: DataFrame, by: list[str] | None = None, **more: Column) -> DataFrame:
    """How often the unit of a scanned line is the original's: n, right before repair, right after, and other aggregates.

    Columns: was, made, want (null: the original has none).
    """
    counts = [F.count_if(F.col("want").isNotNull()).alias("n"), F.count_if(F.col("was") == F.col("want")).alias("before"), F.count_if(F.col("made") == F.col("want")).alias("after")]
    return pairs.groupBy(*by or []).agg(*counts, *[c.alias(n) for n, c in more.items()])


# ---- answers of models

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "field", "object", "quote")])


def answer_list(text: str | None) -> list | None:
    """The first list of objects only that a text holds, else its first list of anything; null if there is none."""
    decoder, spare, at = json.JSONDecoder(), None, 0
    while text and (at := text.find("[", at)) >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            found = None
        if found is not None:
            if all(isinstance(x, dict) for x in found):
                return found
            spare = found if spare is None else spare
        at += 1
    return spare


@pandas_udf(T.StructType([T.StructField("found", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("items", T.ArrayType(ITEM))]))
def answer_items(answers: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Whether an answer holds a list, its length, and its objects."""
    said = lambda v: v if isinstance(v, str) else None
    for batch in answers:
        lists = [answer_list(x) for x in batch]
        items = [[{n: said(i.get(n)) for n in ITEM.names} for i in found or [] if isinstance(i, dict)] for found in lists]
        yield pd.DataFrame({"found": [x is not None for x in lists], "n": [len(x or []) for x in lists], "items": items})


def known_items(answers: DataFrame, types: list[str], text: str = "answer") -> DataFrame:
    """Adds items of a known type and how many entries were dropped; an answer without a list counts as one."""
    read = answers.withColumn("_a", answer_items(text))
    items = F.filter("_a.items", lambda i: F.coalesce(i["type"].isin(types), F.lit(False)))
    return read.withColumn("items", items).withColumn("dropped", F.when(F.col("_a.found"), F.col("_a.n") - F.size(items)).otherwise(F.lit(1))).drop("_a")


def first_sets(sets: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first sets of each key, as a run's limit asks."""
    return sets.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
