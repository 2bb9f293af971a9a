"""Labels to fields: negative labels, exact containment, weighted coverage by inflected words, then vectors.

Every step is an expression over constants of the lexicon, whose size is checked where it is loaded: labels meet no join.
Callers match distinct labels (`answers`) and join the answers back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import let, squash, tokens, word_matches
from ..session import kept, shuffled, spread
from ..sources.lexicon import MOST_ENTRIES, Lexicon, bare_text
from .patterns import occurrences

#: Least share and lead over the next field or a negative label; the same of vectors, evidence and length.
FUZZY_LEAST, FUZZY_MARGIN = 0.85, 0.3
VECTOR_LEAST, VECTOR_MARGIN, VECTOR_EVIDENCE, VECTOR_CHARS = 0.88, 0.01, 0.3, 80
#: Words that name a kind of quantity, not which one.
QUANTITY_NOUNS = ("площадь", "объем", "количество", "число", "стоимость", "продолжительность", "срок", "аудан", "алаң", "көлем", "саны", "құн", "ұзақтығы", "мерзім")
#: Bytes of prototype vectors that a task multiplies with at once.
PROTOTYPE_BYTES = 8 << 20
#: Bytes of answers up to which they go to every task, so that very common labels are answered where their rows lie.
ANSWER_BYTES = 4 << 20
STAGES = ("exact", "fuzzy")
MATCH = "struct<field:string,score:double,method:string>"


def quantity_noun(word: Column) -> Column:
    return F.exists(F.array(*[F.lit(q) for q in QUANTITY_NOUNS]), lambda q: word_matches(word, F.lit(False), q))


def of_pairs(lexicon: DataFrame) -> Lexicon:
    """A lexicon of (field, known) rows, without units."""
    rows = lexicon.select("field", "known").distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a lexicon has at most {MOST_ENTRIES} entries")
    pairs = sorted((r["field"], r["known"]) for r in rows)
    return Lexicon({f: "" for f, _ in pairs}, [(f, "table", k) for f, k in pairs])


def prototypes(spark: SparkSession, lexicon: Lexicon) -> list[dict]:
    """Field (null: negative), words with weight and kind, of every label with words, in order.

    A word weighs ln(1 + fields / fields that have it by inflection). A single quantity noun is no prototype.
    """
    said = [(f, label) for f, kind, label in lexicon.labels if kind != "text_number_first"] + [(None, n) for n in lexicon.negatives]
    if not said:
        return []
    rows = spark.createDataFrame([(i, f, label) for i, (f, label) in enumerate(said)], "i int, field string, label string").coalesce(1)
    words = rows.select("i", "field", F.posexplode(tokens("label")).alias("k", "t")).select("i", "field", "k", "t.word", F.col("t.truncated").alias("cut"), quantity_noun(F.col("t.word")).alias("noun")).collect()
    fields = sorted({(r["field"], r["word"]) for r in words if r["field"] is not None})
    every = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(w).alias("w")) for f, w in fields])
    distinct = spark.createDataFrame([(w,) for w in sorted({r["word"] for r in words})], "word string").coalesce(1)
    having = F.size(F.array_distinct(F.transform(F.filter(every, lambda e: word_matches(F.col("word"), F.lit(False), e["w"])), lambda e: e["f"])))
    weight = {r["word"]: r["weight"] for r in distinct.select("word", F.log(1 + len(lexicon.units_of) / F.greatest(having, F.lit(1))).alias("weight")).collect()}
    out = []
    for i, (f, _) in enumerate(said):
        own = sorted((r["k"], r["word"], r["cut"], r["noun"]) for r in words if r["i"] == i)
        if own and not (f is not None and len(own) == 1 and own[0][3]):
            out.append({"field": f, "words": [(w, cut, noun, weight[w]) for _, w, cut, noun in own]})
    return out


KNOWN = "array<struct<field:string,unit:string,words:array<struct<word:string,cut:boolean,noun:boolean,weight:double>>>>"


def constant(value, schema: str) -> Column:
    """A nested constant."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def _share(said: Column, known: Column, order: Column) -> Column:
    """(field, unit, share, order, hits): the weighted share of a label's words that are said; earlier labels win ties.

    A word cut in the label needs its letters only; words of negatives must be said whole.
    """

    def met(w: Column) -> Column:
        whole = lambda t: word_matches(t["word"], t["truncated"] & known["field"].isNotNull(), w["word"])
        return F.exists(said, lambda t: F.when(w["cut"], t["word"].startswith(w["word"])).otherwise(whole(t)))

    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + w["weight"])
    found = F.filter(known["words"], met)
    return F.struct(known["field"].alias("field"), known["unit"].alias("unit"), (total(found) / total(known["words"])).alias("share"), (-order).alias("order"), F.size(F.filter(found, lambda w: ~w["noun"])).alias("hits"))


def match(said: DataFrame, lexicon: Lexicon, label: str = "label", unit: str | None = None, stages: Sequence[str] = STAGES, where: str = "table", name: str = "match") -> DataFrame:
    """Adds the match (field, score, method; null: none) of each label, of fields whose unit fits if a unit is given.

    A negative label that describes the text as well as any field rejects it before all else, where the fuzzy stage runs.
    The longest lexicon label contained in the text wins the exact stage. `<name>_asks_vector` marks what is left with
    evidence enough for the vector stage.
    """
    wanted_unit = F.lit(None).cast("string") if unit is None else F.col(unit)
    fits = lambda u: wanted_unit.isNull() | (u == wanted_unit)
    kinds = ("table",) if where == "table" else ("table", "text")
    bare = sorted({(-len(k), f, k) for f, kind, label_ in lexicon.labels if kind in kinds and (k := bare_text(label_))})
    contained = constant([{"known": k, "field": f, "unit": lexicon.units_of[f]} for _, f, k in bare], "array<struct<known:string,field:string,unit:string>>")
    fields = F.array(*[F.lit(f) for f in sorted(lexicon.units_of)])
    known = []
    if "fuzzy" in stages:
        known = [{"field": k["field"], "unit": lexicon.units_of.get(k["field"]), "words": [{"word": w, "cut": cut, "noun": noun, "weight": weight} for w, cut, noun, weight in k["words"]]} for k in prototypes(said.sparkSession, lexicon)]

    def exactly(squashed: Column) -> Column:
        if "exact" not in stages:
            return F.lit(None).cast(MATCH)
        return let(F.get(F.filter(contained, lambda k: fits(k["unit"]) & squashed.contains(k["known"])), F.lit(0))["field"], lambda f: F.when(f.isNotNull(), F.struct(f.alias("field"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"))))

    def shares(words: Column) -> Column:
        each = F.transform(constant(known, KNOWN), lambda k, i: _share(words, k, i))
        return F.filter(each, lambda s: s["field"].isNull() | fits(s["unit"]))

    def covers(of: Column) -> Column:
        """The best share of each field: share, order, hits and field."""
        best = lambda f: F.array_max(F.transform(F.filter(of, lambda s: s["field"] == f), lambda s: F.struct(s["share"].alias("share"), s["order"].alias("order"), s["hits"].alias("hits"), s["field"].alias("field"))))
        return F.filter(F.transform(fields, best), lambda x: x.isNotNull())

    def decided(first: Column, cover: Column, negative: Column, ranked: Column) -> Column:
        top, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1))["share"], F.lit(0.0))
        rejected = (negative >= FUZZY_LEAST) & (negative >= F.coalesce(top["share"], F.lit(0.0)))
        clear = (top["share"] >= FUZZY_LEAST) & (top["share"] - F.greatest(second, negative) >= FUZZY_MARGIN)
        found = F.coalesce(first, F.when(clear, F.struct(top["field"].alias("field"), F.round(top["share"], 3).alias("score"), F.lit("fuzzy").alias("method"))))
        evidence = F.coalesce(F.array_max(F.transform(F.filter(cover, lambda x: x["hits"] >= 1), lambda x: x["share"])), F.lit(0.0))
        return F.struct(F.when(~rejected, found).alias("match"), (~rejected & found.isNull() & (evidence >= VECTOR_EVIDENCE)).alias("asks"))

    def answered(text: Column) -> Column:
        first = exactly(squash(text))
        if not known:
            return F.struct(first.alias("match"), F.lit(False).alias("asks"))
        negative = lambda of: F.coalesce(F.array_max(F.transform(F.filter(of, lambda s: s["field"].isNull()), lambda s: s["share"])), F.lit(0.0))
        ranked = lambda cover: F.reverse(F.array_sort(F.transform(cover, lambda x: F.struct(x["share"].alias("share"), x["field"].alias("field")))))
        parts = let(shares(tokens(text)), lambda of: F.struct(covers(of).alias("c"), negative(of).alias("n")))
        return let(F.struct(first.alias("f"), parts.alias("p")), lambda x: let(ranked(x["p"]["c"]), lambda r: decided(x["f"], x["p"]["c"], x["p"]["n"], r)))

    has_letter = F.coalesce(F.col(label).rlike(r"\p{L}"), F.lit(False))
    out = said.withColumn("_answer", F.when(has_letter, answered(F.coalesce(label, F.lit("")))))
    asks = F.coalesce(F.col("_answer.asks"), F.lit(False)) & (F.length(label) <= VECTOR_CHARS)
    return out.withColumns({name: F.col("_answer.match").cast(MATCH), f"{name}_asks_vector": asks if where == "table" else F.lit(False)}).drop("_answer")


def answers(said: DataFrame, lexicon: Lexicon, label: str = "label", unit: str | None = None, stages: Sequence[str] = STAGES, where: str = "table") -> DataFrame:
    """Each distinct label (and unit) that has a match, with the match: label, unit, match.

    The distinct labels are a table before they are matched, and so are the answers: else the optimizer moves the test on
    the match under the distinct, and over a join to the other side, and all rows are matched instead of distinct labels.
    Rows are joined with up to ANSWER_BYTES of answers in their tasks, with more by shuffles.
    """
    columns = [label] if unit is None else [label, unit]
    distinct = kept(said.select(*columns).distinct())
    found = kept(match(spread(distinct, *columns), lexicon, label, unit, stages, where).where("match is not null").select(*columns, "match"))
    total = found.agg(F.sum(F.octet_length(label) + 100)).first()[0] or 0
    return F.broadcast(found) if total <= ANSWER_BYTES else shuffled(found)


def nearest_fields(asked: DataFrame, known: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, field, sim: of each vector the two fields with the nearest prototypes by cosine, and the nearest negative's (null).

    known: field (null: negative), vector. Prototypes are dealt by hash into blocks of about PROTOTYPE_BYTES, and each
    vector is multiplied with a block at a time; the two best fields of all are among the two best of their own blocks, so
    blocks are merged by a maximum. Vectors of another length than a prototype's, of zeros or null are not near it.
    """
    spark = asked.sparkSession
    protos = kept(known.where(F.col(vector).isNotNull()).select("field", F.col(vector).cast("array<double>").alias("v")).distinct())
    total = protos.agg(F.sum(F.size("v") * 8 + 40)).first()[0] or 0
    blocks = max(1, -(-total // PROTOTYPE_BYTES))
    picked = asked.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([picked.schema["k"], T.StructField("field", T.StringType()), T.StructField("sim", T.DoubleType())])
    found = []
    for block in range(blocks):
        some = protos.where(F.pmod(F.xxhash64("field", "v"), F.lit(blocks)) == block).collect()  # PROTOTYPE_BYTES, about
        if some:
            found.append(picked.mapInArrow(_two_nearest([(r["field"], r["v"]) for r in some]), schema))
    if not found:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    every = reduce(DataFrame.unionByName, found)
    if blocks > 1:
        merged = every.groupBy("k", "field").agg(F.max("sim").alias("sim"))
        w = Window.partitionBy("k", F.col("field").isNull()).orderBy(F.desc("sim"), "field")  # three rows a block
        every = merged.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= 2) & (F.col("field").isNotNull() | (F.col("_n") == 1))).drop("_n")
    return every.withColumnRenamed("k", key)


def _two_nearest(prototypes: list[tuple[str | None, list[float]]]):
    """Of each vector: the two best fields of a block, and the best negative."""
    by_length: dict[int, dict[str | None, list[np.ndarray]]] = {}
    for field, v in prototypes:
        x = np.array(v, np.float64)
        if len(x) and np.linalg.norm(x):
            by_length.setdefault(len(x), {}).setdefault(field, []).append(x / np.linalg.norm(x))
    sides = {n: (sorted(f, key=lambda x: (x is None, x or "")), f) for n, f in by_length.items()}
    stacked = {n: (fields, np.stack([x for f in fields for x in vs[f]]), np.cumsum([0, *[len(vs[f]) for f in fields]])[:-1]) for n, (fields, vs) in sides.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                lists = part.column(1).to_pylist()
                rows, names, sims = [], [], []
                for n, (fields, matrix, starts) in stacked.items():
                    some = [i for i, v in enumerate(lists) if len(v) == n and None not in v and any(v)]
                    if not some:
                        continue
                    x = np.array([lists[i] for i in some], np.float64)
                    near = np.maximum.reduceat((x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix.T, starts, axis=1)
                    own = len(fields) - (fields[-1] is None)
                    order = np.argsort(-near[:, :own], axis=1, kind="stable")[:, :2]
                    for j, i in enumerate(some):
                        at = [*order[j].tolist(), *range(own, len(fields))]
                        rows += [i] * len(at)
                        names += [fields[a] for a in at]
                        sims += near[j, at].tolist()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(sims, pa.float64())], names=["k", "field", "sim"])

    return run


def by_vector(asked: DataFrame, known: DataFrame, label: str = "label", vector: str = "vector", least: float = VECTOR_LEAST, margin: float = VECTOR_MARGIN) -> DataFrame:
    """label, field, score of labels whose vector is near enough to one field's prototypes, and nearer than to a negative.

    known: field (null: negative), vector, as many as there are. Vectors come from whatever provider the caller has;
    labels without one have no row.
    """
    near = nearest_fields(asked.select(label, vector).distinct(), known, label, vector)
    ranked = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct((-F.col("sim")).alias("s"), F.col("field").alias("f")))))  # two
    of = near.groupBy(label).agg(ranked.alias("_f"), F.max(F.when(F.col("field").isNull(), F.col("sim"))).alias("_against"))
    top, second = F.get("_f", F.lit(0)), -F.coalesce(F.get("_f", F.lit(1))["s"], F.lit(1.0))
    good = (-top["s"] >= least) & (-top["s"] - second >= margin) & (F.coalesce("_against", F.lit(-1.0)) <= -top["s"])
    return of.where(good).select(label, top["f"].alias("field"), F.round(-top["s"], 3).alias("score"))


def with_vectors(said: DataFrame, lexicon: Lexicon, vectors: DataFrame, known: DataFrame, label: str = "label", unit: str | None = None, stages: Sequence[str] = STAGES) -> DataFrame:
    """The whole cascade: exact, fuzzy, and vectors for the labels that earlier stages leave with evidence.

    vectors: label, vector, one row a label; known: field (null: negative), vector. Adds match, as `match` does.
    """
    first = kept(match(said, lexicon, label, unit, stages))
    asked = first.where("match is null and match_asks_vector").select(label).distinct().join(vectors, label)
    found = by_vector(asked, known, label).select(F.col(label).alias("_l"), F.struct("field", "score", F.lit("embedding").alias("method")).cast(MATCH).alias("_m"))
    out = first.join(found, F.col(label).eqNullSafe(F.col("_l")) & F.col("match").isNull() & F.col("match_asks_vector"), "left")
    return out.withColumn("match", F.coalesce("match", "_m")).drop("_l", "_m")


def exact(labels: DataFrame, lexicon: DataFrame, label: str = "label") -> DataFrame:
    """The longest lexicon label contained in the squashed text; ties to the smaller field. lexicon: field, known; any size."""
    said = labels.select(label, squash(label).alias("_bare")).distinct()
    known = lexicon.select("field", squash("known").alias("_known")).distinct()
    found = occurrences(said, known, "_bare", "_known", [label]).join(known, "_known")
    return found.groupBy(label).agg(F.min_by("field", F.struct(-F.length("_known"), "field")).alias("field"))


def fuzzy(labels: DataFrame, lexicon: DataFrame, label: str = "label") -> DataFrame:
    found = answers(labels, of_pairs(lexicon), label, stages=("fuzzy",))
    return found.select(label, "match.field", F.col("match.score").alias("share"))


def cascade(labels: DataFrame, lexicon: DataFrame, label: str = "label") -> DataFrame:
    """Exact, else fuzzy: label, field, method."""
    found = answers(labels, of_pairs(lexicon), label)
    return found.select(label, "match.field", "match.method")


def best_with_margin(scores: DataFrame, label: str, field: str, score: str, least: float, margin: float) -> DataFrame:
    """The best field where it is good enough and far enough ahead of the next."""
    w = Window.partitionBy(label).orderBy(F.desc(score), field)
    ranked = scores.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return ranked.where((F.col("_n") == 1) & (F.col(score) >= least) & (F.col(score) - F.col("_next") >= margin)).select(label, field, F.round(score, 3).alias(score))
