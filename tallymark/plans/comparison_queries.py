"""Systems side by side, anchors, and what packages are made of, over the driver's tables, with DuckDB's SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparison, labels, report
from ..sources import layout
from . import fixtures
from .document_queries import DOC, LABEL_CASES, LABEL_TRUTH, LEXICON, cases
from .registry import Tables, query

#: What the gold says of each label: the truth, but one label is held for floors and one for nothing.
GOLD_FIELD = cases("(p_partkey % 12)", ["!null" if i == 3 else "floors" if i == 9 else m[0] if m else "!null" for i, m in enumerate(LABEL_TRUTH)], "null")
SAID_FIELD = cases("(p_partkey % 12)", [m[0] if m else "!null" for m in LABEL_TRUTH], "null")
SAID_METHOD = cases("(p_partkey % 12)", [m[1] if m else "!null" for m in LABEL_TRUTH], "null")
LANG = "case when p_size % 2 = 0 then 'ru' else 'kz' end"
SHARES = "tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 5) as p, round(coalesce(tp / nullif(tp + fn, 0), 0), 5) as r, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 5) as f1"


@query(f"""
    with k as (select p_partkey, {LANG} as lang, {GOLD_FIELD} as g, {SAID_FIELD} as s, {SAID_METHOD} as m from part),
    x as (select 'exact' as stages, lang, p_partkey, g, case when m = 'exact' then s end as s from k union all select 'exact+fuzzy', lang, p_partkey, g, s from k),
    c as (select stages, lang, g as field, case when g = s then 1 else 0 end as tp, 0 as fp, case when g = s then 0 else 1 end as fn from x where g is not null
          union all select stages, lang, s, 0, 1, 0 from x where s is not null and s is distinct from g),
    n as (select stages, lang, field, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from c group by grouping sets ((stages, lang, field), (stages, lang)))
    select stages, lang, field, {SHARES} from n""")
def stage_ablation(t: Tables) -> DataFrame:
    """Each field by what the first stages of the label cascade find alone."""
    rows = t.part.select(F.col("p_partkey"), F.expr(LANG).alias("lang"), F.expr(GOLD_FIELD).alias("field"), F.expr(cases("(p_partkey % 12)", LABEL_CASES)).alias("label"))
    keys = ["p_partkey", "lang", "field"]

    def found(stages: tuple[str, ...]) -> DataFrame:
        known = labels.answers(rows, LEXICON, stages=stages).select("label", "match.field")
        return rows.drop("field").join(known, "label").select(keys)

    by_stage = {"+".join(labels.STAGES[: i + 1]): found(labels.STAGES[: i + 1]) for i in range(len(labels.STAGES))}
    return comparison.compared(rows.where("field is not null"), by_stage, keys, [["lang", "field"], ["lang"]], "stages")


SYSTEMS = {"S1": "o_totalprice > 150000", "S2": "o_orderkey % 3 <> 0"}
SLOT = "case when o_custkey % 2 = 0 then 'ru' else 'kz' end as lang, o_custkey as doc, o_orderpriority as type, 'f' || (o_orderkey % 4) as field"


@query(f"""
    with g as (select distinct {SLOT} from orders where o_orderstatus <> 'O'),
    s as (select 'S1' as system, * from (select distinct {SLOT} from orders where {SYSTEMS['S1']}) union all select 'S2', * from (select distinct {SLOT} from orders where {SYSTEMS['S2']})),
    e as (select * from g, (values ('S1'), ('S2')) v(system)),
    c as (select coalesce(e.system, s.system) as system, coalesce(e.lang, s.lang) as lang, coalesce(e.type, s.type) as type, coalesce(e.field, s.field) as field, cast(e.doc is not null and s.doc is not null as int) as tp, cast(e.doc is null as int) as fp, cast(s.doc is null as int) as fn
          from e full join s on e.system = s.system and e.lang = s.lang and e.doc = s.doc and e.type = s.type and e.field = s.field),
    n as (select system, lang, type, field, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from c group by grouping sets ((system, lang, type, field), (system, lang)))
    select system, lang, type, field, {SHARES} from n""")
def systems_compared(t: Tables) -> DataFrame:
    """Two detectors by type and field, and each in total, a language at a time."""
    slots = lambda where: t.orders.where(where).selectExpr(*SLOT.split(", "))
    systems = {name: slots(where) for name, where in SYSTEMS.items()}
    return comparison.compared(slots("o_orderstatus <> 'O'"), systems, ["lang", "doc", "type", "field"], [["lang", "type", "field"], ["lang"]])


OBJECT_VALUES = "o_custkey as doc_id, case o_orderkey % 3 when 0 then 'project' else 'b' || (o_orderkey % 3) end as object, case when o_custkey % 4 <> 0 then 'b1' end as building, o_orderpriority as field, o_totalprice as value"


@query(f"""
    with v as (select {OBJECT_VALUES} from orders),
    r as (select *, row_number() over (partition by doc_id, field order by case when object = coalesce(building, 'project') then 0 else 1 end, value) as n from v where (starts_with(field, '1-') or starts_with(field, '4-NOT')) and object in ('project', coalesce(building, 'project')))
    select doc_id, field, value from r where n = 1""")
def target_fields(t: Tables) -> DataFrame:
    """The fields that an evaluation asks for: the building's value, else the project's."""
    values = t.orders.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, "project").otherwise(F.concat(F.lit("b"), F.col("o_orderkey") % 3)).alias("object"), F.when(F.col("o_custkey") % 4 != 0, "b1").alias("building"), F.col("o_orderpriority").alias("field"), F.col("o_totalprice").alias("value"))
    return comparison.building_values(values, ["doc_id"], "building", ["1-", "4-NOT"])


@query("""
    select o_custkey, 'level' as what, o_orderpriority as value, count(*) as n from orders group by 1, 2, 3
    union all select o_custkey, 'confidence', o_orderstatus, count(*) from orders group by 1, 2, 3""")
def annotation_counts(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("confidence"))
    return comparison.annotation_counts(rows, ["o_custkey"], ["level", "confidence"])


REF_NAME = "case when o_orderkey % 2 = 0 then 'm' || (o_orderkey % 7) else 'S' || (o_orderkey % 2) || '.f' || (o_orderkey % 5) end"
ANCHOR_NAME = "case when l_linenumber % 2 = 0 then 'm' || (l_partkey % 7) else 'S' || (l_linenumber % 2) || '.f' || (l_partkey % 5) end"


@query(f"""
    with a as (select l_orderkey as k, {ANCHOR_NAME} as name, count(*) as n, string_agg(l_suppkey || ':' || l_linenumber, '|' order by l_suppkey, l_linenumber) as places from lineitem group by 1, 2)
    select o_orderkey, {REF_NAME} as name, coalesce(n, 0) as n, coalesce(places, '') as places from orders left join a on k = o_orderkey and a.name = {REF_NAME}""")
def anchored_references(t: Tables) -> DataFrame:
    """References with the places of what they speak of, by mention or by section and field."""
    key = F.col("o_orderkey")
    refs = t.orders.select(key, F.when(key % 2 == 0, F.concat(F.lit("m"), key % 7)).alias("mention"), F.concat(F.lit("S"), key % 2).alias("section"), F.concat(F.lit("f"), key % 5).alias("field"))
    anchors = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.expr(ANCHOR_NAME).alias("name"), F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("seq"))
    found = comparison.with_anchors(refs, anchors, ["o_orderkey"])
    return found.select("o_orderkey", "name", F.size("anchors").cast("long").alias("n"), F.array_join(F.transform("anchors", lambda a: F.concat_ws(":", a["page"], a["seq"])), "|").alias("places"))


@query(f"""
    with a as (select distinct l_orderkey as k, {ANCHOR_NAME} as name from lineitem),
    v as (select o_orderkey, {REF_NAME} as name, case when o_orderstatus = 'F' then o_totalprice end as value from orders)
    select o_orderkey, v.name, case when value is not null then 'not anchored' else 'missing but anchored' end as problem from v left join a on k = o_orderkey and a.name = v.name where (value is null) = (a.name is not null)""")
def anchor_problems(t: Tables) -> DataFrame:
    """Values that their document doesn't show, and values said to be missing that it does."""
    values = t.orders.select("o_orderkey", F.expr(REF_NAME).alias("name"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("value"))
    return comparison.anchor_problems(values, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.expr(ANCHOR_NAME).alias("name")), ["o_orderkey"])


MONEY = "decimal(18,2)"


@query(f"""
    with d as (select l_orderkey, l_linenumber, l_partkey, cast(l_extendedprice as {MONEY}) as direct, cast(8.5 + l_linenumber % 3 as decimal(4,1)) as pct from lineitem),
    o as (select *, cast(round(cast(direct * pct as decimal(28,3)) * 0.01, 2) as {MONEY}) as overhead from d),
    p as (select *, cast(round((direct + overhead) * 0.08, 2) as {MONEY}) as profit from o)
    select l_orderkey, l_linenumber, l_partkey, cast(overhead as double) as overhead, cast(profit as double) as profit, cast(direct + overhead + profit as double) as total from p""")
def local_estimates(t: Tables) -> DataFrame:
    """Estimates whose every line follows from the one before."""
    percent = (F.lit(8.5) + F.col("l_linenumber") % 3).cast("decimal(4,1)")
    made = fixtures.local_estimate(F.col("l_extendedprice").cast(MONEY), percent)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[v.cast("double").alias(k) for k, v in made.items()])


CHAPTER = "decimal(18,3)"


@query(f"""
    with s as (select l_orderkey, l_linenumber, l_partkey, cast(cast(l_extendedprice as {CHAPTER}) + cast(l_quantity as {CHAPTER}) as {CHAPTER}) as subtotal from lineitem),
    r as (select *, cast(round(subtotal * 0.02, 3) as {CHAPTER}) as reserve from s),
    w as (select *, cast(subtotal + reserve as {CHAPTER}) as with_reserve from r),
    v as (select *, cast(round(with_reserve * 0.12, 3) as {CHAPTER}) as tax from w)
    select l_orderkey, l_linenumber, l_partkey, cast(subtotal as double) as subtotal, cast(reserve as double) as reserve, cast(with_reserve as double) as with_reserve, cast(tax as double) as tax, cast(with_reserve + tax as double) as total from v""")
def summary_estimates(t: Tables) -> DataFrame:
    """Chapters, reserve, tax and total of summary estimates."""
    made = fixtures.summary_estimate([F.col("l_extendedprice").cast(CHAPTER), F.col("l_quantity").cast(CHAPTER)])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[v.cast("double").alias(k) for k, v in made.items()])


@query("""select l_orderkey, l_returnflag as field, cast(round(sum(cast(l_extendedprice as decimal(18,4))), 2) as double) as total from lineitem group by 1, 2""")
def summary_totals(t: Tables) -> DataFrame:
    return fixtures.summary_totals(t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("field"), F.col("l_extendedprice").alias("value")), ["l_orderkey"])


HEADERS = ["Этажность", "Площадь застройки, м²", "№ п/п", "Общая площадь здания", "Строительный объём м3"]


@query(f"""
    with h as (select p_partkey, string_split({cases('(p_partkey % 5)', HEADERS)}, ' ') as w, [1, 2, 2, 3][p_partkey % 4 + 1] as tail from part),
    l as (select *, list_filter(range(1, len(w) + 1), lambda i: regexp_full_match(w[i], '\\p{{L}}{{7,}}')) as places from h),
    k as (select *, case when len(places) > 0 then places[p_partkey % len(places) + 1] end as place from l)
    select p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: case when i = place then left(w[i], length(w[i]) - tail) || chr(10) || right(w[i], tail) else w[i] end), ' ') as header from k""")
def broken_headers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fixtures.broken_header(F.expr(cases("(p_partkey % 5)", HEADERS)), F.col("p_partkey")).alias("header"))


@query("""
    select p_partkey, 'Степень ' || p_brand || ' для здания ' || p_type || ', класс ' || p_size || '.' as text, 8 as first_at, length('Степень ' || p_brand || ' для здания ' || p_type || ', класс ') as second_at from part""")
def filled_templates(t: Tables) -> DataFrame:
    """Values at known places, also where the same text occurs elsewhere in the sentence."""
    made = fixtures.filled("Степень {a} для здания {name}, класс {b}.", {"a": F.col("p_brand"), "b": F.col("p_size").cast("string")}, {"name": F.col("p_type")})
    return t.part.select("p_partkey", made.alias("m")).select("p_partkey", "m.text", F.col("m.anchors")[0]["at"].cast("long").alias("first_at"), F.col("m.anchors")[1]["at"].cast("long").alias("second_at"))


@query("""select l_orderkey as doc_id, 'b' || l_linenumber as object, cast(l_quantity as int) as floors from lineitem where l_returnflag = 'R'""")
def floors_of_objects(t: Tables) -> DataFrame:
    slots = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("b"), "l_linenumber").alias("object"), F.when(F.col("l_returnflag") == "R", "floors").otherwise("other").alias("field"), F.col("l_quantity").alias("value"))
    return comparison.floors_of_objects(slots, ["doc_id"])


@query("""select p_partkey, case when p_partkey % 3 < 2 then 'n' || lpad(cast(p_partkey as varchar), 9, '0') end as annotation from part""")
def annotation_lookup(t: Tables) -> DataFrame:
    """The annotation of each file, however its path is written."""
    key = F.col("p_partkey")
    paths = lambda a, b: F.when(key % 2 == 0, F.concat(F.lit(a), key, F.lit(".pdf"))).otherwise(F.concat(F.lit(b), key, F.lit(".pdf")))
    notes = t.part.where("p_partkey % 3 < 2").select(F.concat(F.lit("n"), F.lpad(key.cast("string"), 9, "0")).alias("name"), paths("./data//real/", "data/x/../real/").alias("source_file"))
    return layout.annotations_of(notes, t.part.select("p_partkey", paths("data/real/", "data/./real/").alias("path"))).select("p_partkey", "annotation")


SCANNED = ["Площадь застройки здания", "Этажность", "БББ ШШШШШШШ", "", "юг", "Строительный объём"]


@query(f"""
    with t as (select p_partkey, {cases('(p_partkey % 6)', SCANNED)} as s, p_partkey % 3 as kind, p_partkey // 3 as c from part),
    p as (select *, list_filter(range(1, length(s) + 1), lambda i: contains('асеорхукі', lower(s[i]))) as looks, list_filter(range(1, length(s) + 1), lambda i: s[i] = ' ') as spaces, string_split(s, ' ') as w from t),
    l as (select *, list_filter(range(1, len(w) + 1), lambda i: length(w[i]) >= 6) as longs from p),
    d as (select *, looks[c % greatest(len(looks), 1) + 1] as look, spaces[c % greatest(len(spaces), 1) + 1] as space, longs[c % greatest(len(longs), 1) + 1] as long from l)
    select p_partkey, case when kind = 0 and look is not null then left(s, look - 1) || translate(s[look], 'асеорхукіАСЕОРХУКІ', 'aceopxykiACEOPXYKI') || substr(s, look + 1)
        when kind = 1 and space is not null then left(s, space - 1) || substr(s, space + 1)
        else array_to_string(list_transform(range(1, len(w) + 1), lambda i: case when i = long then left(w[i], 2 + c % (length(w[i]) - 3)) || ' ' || substr(w[i], 3 + c % (length(w[i]) - 3)) else w[i] end), ' ') end as text from d""")
def misread_texts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fixtures.misread(F.expr(cases("(p_partkey % 6)", SCANNED)), F.col("p_partkey")).alias("text"))


@query(f"""
    with q as (select p_partkey as ref_id, {DOC} as doc_id, case when p_partkey % 3 = 0 then p_size % 4 || ',0' else cast(p_size % 4 as varchar) end as raw, case when p_partkey % 2 = 0 then 'table' else 'text' end as source, p_size * 7 % 90 as top, p_size * 7 % 90 + 10 as bottom, p_size % 5 as x0 from part),
    v as (select {DOC} as doc_id, p_size % 4 || case when p_partkey % 4 = 0 then ',0' else '' end as raw, p_size * 11 % 90 as v_top, p_size * 11 % 90 + 8 as v_bottom, p_size * 3 % 50 as v_x0 from part),
    p as (select *, v_top >= top - 2 and v_bottom <= bottom + 2 as inside, abs(v_top - top) + abs(v_x0 - x0) / 4.0 as far from q left join v using (doc_id, raw)),
    n as (select *, row_number() over (partition by ref_id order by case when inside then 0 else 1 end, case when inside then v_top else far end, v_x0, v_top) as n from p)
    select ref_id, raw, source, v_top, v_bottom, v_x0 from n where n = 1""")
def report_extractions(t: Tables) -> DataFrame:
    """Chosen values as their quotes write them, else formatted, with their boxes."""
    key, size, page = F.col("p_partkey"), F.col("p_size"), F.lit(1).alias("page")
    number = (size % 4).cast("string")
    quote = F.when(key % 3 == 0, F.concat(F.lit("Всего "), number, F.lit(",0 м"))).otherwise("без числа")
    source = F.when(key % 2 == 0, "table_across").otherwise("sentence")
    slots = t.part.select(key.alias("ref_id"), F.expr(DOC).alias("doc_id"), F.lit("b1").alias("object"), F.lit("area").alias("field"), (size % 4).cast("double").alias("value"), page, quote.alias("quote"), source.alias("source"), (size * 7 % 90).alias("top"), (size * 7 % 90 + 10).alias("bottom"), (size % 5).alias("x0"))
    words = t.part.select(F.expr(DOC).alias("doc_id"), page, F.concat(number, F.when(key % 4 == 0, ",0").otherwise("")).alias("text"), (size * 11 % 90).alias("v_top"), (size * 11 % 90 + 8).alias("v_bottom"), (size * 3 % 50).alias("v_x0"))
    return report.extractions(slots, words).select("ref_id", "raw", "source", "v_top", "v_bottom", "v_x0")
