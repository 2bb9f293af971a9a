"""Matching with gold, reports and service lists over the driver's tables, with DuckDB's SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, report
from ..session import kept
from .document_queries import DOC, PRICE, ROW, cases
from .registry import Tables, query

FIRST, SECOND = ["Главный", "Производственный", "Складской", "Административный"], ["бытовой", "лабораторный", "ремонтный"]
SAID_NAME = f"concat({cases('(p_size % 4)', FIRST)}, ' ', {cases('(p_size % 3)', SECOND)}, ' корпус')"
GOLD_NAME = f"concat({cases('((p_size + p_partkey) % 4)', FIRST)}, case when p_size % 2 = 0 then ' ' else '-' end, {cases('(p_size % 3)', SECOND)}, case when p_size % 5 = 0 then ' корпус' else ' цех' end)"
SQL_WORDS = "list_filter(regexp_split_to_array(name, '[\\s\\-–]+'), lambda w: w <> '')"
SQL_SHORT = f"case when len({SQL_WORDS}) >= 2 then lower(array_to_string(list_transform({SQL_WORDS}, lambda w: substr(w, 1, 1)), '')) else '' end"


def objects(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.part.select(F.expr(DOC).alias("doc_id"), F.expr(ROW).alias("n"), F.expr(SAID_NAME).alias("s"), F.expr(GOLD_NAME).alias("g"))
    return tuple(kept(rows.where(f"n % 2 = {k}").select("doc_id", F.concat(F.lit(p), "n").alias("id"), F.col(c).alias("name"))) for k, p, c in ((0, "p", "s"), (1, "g", "g")))


@query(f"""
    with recursive n as (select {DOC} as doc_id, {ROW} as n, {SAID_NAME} as s, {GOLD_NAME} as g from part),
    o as (select doc_id, 'p' || n as id, s as name from n where n % 2 = 0 union all select doc_id, 'g' || n, g from n where n % 2 = 1),
    x as (select *, list_distinct(list_transform(list_filter({SQL_WORDS}, lambda w: length(w) >= 3), lambda w: substr(lower(w), 1, greatest(3, least(7, length(w) - 2))))) as stems, {SQL_SHORT} as short from o),
    s as (select p.doc_id, p.id as pid, g.id as gid, len(list_intersect(p.stems, g.stems)) + case when p.short <> '' and p.short in (lower(g.id), g.short) then 2 else 0 end + case when lower(trim(p.name)) = lower(trim(g.name)) then 10 else 0 end as score
          from x p join x g on p.doc_id = g.doc_id and p.id like 'p%' and g.id like 'g%'),
    k as (select *, row_number() over (partition by doc_id order by score desc, pid desc, gid desc) as k from s where score > 0),
    r as (select distinct doc_id, 0 as k, []::varchar[] as used, null::varchar as pid, null::varchar as gid from k
          union all select r.doc_id, k.k, case when list_contains(used, k.pid) or list_contains(used, k.gid) then used else list_concat(used, [k.pid, k.gid]) end, case when list_contains(used, k.pid) or list_contains(used, k.gid) then null else k.pid end, k.gid from r join k on k.doc_id = r.doc_id and k.k = r.k + 1)
    select doc_id, pid, gid from r where pid is not null""")
def object_mapping(t: Tables) -> DataFrame:
    """Objects of a reader to those of the annotation, one to one by shared stems, short names and names."""
    said, known = objects(t)
    return evaluation.mapped_objects(said, known, ["doc_id"]).select("doc_id", "pid", "gid")


FOUND = "select o_custkey % 200 as doc_id, o_orderkey as seq, o_orderpriority as type, 'b' || (o_orderkey % 3) as object, [o_orderkey % 5, 5 + o_orderkey % 3] as pages, case o_orderkey % 5 when 0 then 'numeric' when 1 then 'logical' when 2 then 'completeness' when 3 then 'expert' else 'numeric' end as level"
PAIRS = f"""
    with recursive g as ({FOUND} from orders where o_orderstatus = 'F'), s as ({FOUND} from orders where o_orderstatus = 'O'),
    c as (select g.doc_id, g.type, g.object, g.seq, list(s.seq order by s.seq) as cands from g join s on g.doc_id = s.doc_id and g.type = s.type and g.object = s.object and len(list_intersect(g.pages, s.pages)) > 0 group by 1, 2, 3, 4),
    k as (select *, row_number() over (partition by doc_id, type, object order by seq) as k from c),
    r as (select distinct doc_id, type, object, 0 as k, []::bigint[] as used, null::bigint as gold_seq, null::bigint as said_seq from k
          union all select k.doc_id, k.type, k.object, k.k, list_append(used, list_filter(cands, lambda x: not list_contains(used, x))[1]), k.seq, list_filter(cands, lambda x: not list_contains(used, x))[1] from r join k on k.doc_id = r.doc_id and k.type = r.type and k.object = r.object and k.k = r.k + 1),
    pairs as (select doc_id, gold_seq, said_seq from r where said_seq is not null)"""


def findings(t: Tables, status: str) -> DataFrame:
    key = F.col("o_orderkey")
    level = F.get(F.array(*[F.lit(x) for x in ("numeric", "logical", "completeness", "expert", "numeric")]), (key % 5).cast("int"))
    return t.orders.where(F.col("o_orderstatus") == status).select((F.col("o_custkey") % 200).alias("doc_id"), key.alias("seq"), F.col("o_orderpriority").alias("type"), F.concat(F.lit("b"), key % 3).alias("object"), F.array(key % 5, 5 + key % 3).alias("pages"), level.alias("level"))


def pairs_of_findings(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    gold, said = findings(t, "F"), findings(t, "O")
    none = t.spark.createDataFrame([], "doc_id long, pid string, gid string")
    return gold, said, evaluation.matched_findings(gold, said, none)


@query(PAIRS + " select doc_id, gold_seq, said_seq from pairs")
def finding_matching(t: Tables) -> DataFrame:
    """Each finding of the gold, in order, takes the first free one of its type and object on a common page."""
    return pairs_of_findings(t)[2]


@query(PAIRS + """, w as (select level, case when (doc_id, seq) in (select doc_id, gold_seq from pairs) then 'found' else 'missed' end as what from g
    union all select level, 'false' from s where (doc_id, seq) not in (select doc_id, said_seq from pairs))
    select l.level, count(*) filter (what = 'found') as found, count(*) filter (what = 'missed') as missed, count(*) filter (what = 'false') as "false"
    from (values ('numeric'), ('logical'), ('completeness'), ('expert'), ('formal')) l(level) left join w on w.level = l.level group by 1""")
def found_by_level(t: Tables) -> DataFrame:
    gold, said, pairs = pairs_of_findings(t)
    return evaluation.by_level(gold, said, kept(pairs))


@query("""
    with s as (select l_orderkey as k, max(l_extendedprice) as value from lineitem where l_linenumber = 1 group by 1)
    select o_orderkey as k, o_totalprice as stated, s.value, case when s.value is null then 'missing' when abs(s.value - o_totalprice) < 1e-6 then 'ok' else 'wrong' end as verdict from orders o left join s on s.k = o.o_orderkey""")
def value_verdicts(t: Tables) -> DataFrame:
    """ok, missing or wrong for every annotated value; of several the first is the table's."""
    gold = t.orders.select(F.col("o_orderkey").alias("k"), F.array("o_totalprice", F.lit(0.0)).alias("values"))
    said = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("value"))
    return evaluation.value_verdicts(gold, said, ["k"])


@query("""
    with h as (select case when p_partkey % 4 = 0 then p_size else p_retailprice end as value, case p_partkey % 3 when 0 then 'table' when 1 then 'text' else 'none' end as place, p_partkey % 6 = 0 as column_ok, p_size % 2 = 0 as ambiguous from part),
    k as (select *, value = floor(value) and abs(value) < 100 as trivial from h)
    select count(*) as n_values, count(*) filter (not trivial) as informative, count(*) filter (not trivial and place = 'table') as in_table, count(*) filter (not trivial and column_ok) as right_column,
           count(*) filter (not trivial and place = 'text') as text_only, count(*) filter (not trivial and place = 'none') as not_found, count(*) filter (ambiguous) as n_ambiguous, count(*) filter (trivial) as n_trivial from k""")
def extractability_summary(t: Tables) -> DataFrame:
    where = F.get(F.array(F.lit("table"), F.lit("text"), F.lit("none")), (F.col("p_partkey") % 3).cast("int"))
    hits = t.part.select(F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_retailprice")).alias("value"), where.alias("where"), (F.col("p_partkey") % 6 == 0).alias("column_ok"), (F.col("p_size") % 2 == 0).alias("ambiguous"))
    return evaluation.extractability_summary(hits)


@query("""
    with v as (select o_custkey as doc_id, 'b' || (o_orderkey % 2) as object, o_orderpriority as field, max(o_totalprice) as value from orders group by 1, 2, 3)
    select doc_id, string_agg(object || '/' || field, ',' order by object || '/' || field) as paths, count(*) as n, round(sum(value), 2) as total from v group by 1""")
def nested_values(t: Tables) -> DataFrame:
    """Values by object as a map from paths, and back."""
    v = t.orders.groupBy(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("b"), F.col("o_orderkey") % 2).alias("object"), F.col("o_orderpriority").alias("field")).agg(F.max("o_totalprice").alias("value"))
    maps = v.groupBy("doc_id", "object").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("object", "m"))).alias("tep"))
    nested = evaluation.nested(evaluation.flattened(maps, ["doc_id"]), ["doc_id"])
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda s, x: s + x)
    return nested.select("doc_id", F.array_join(F.map_keys("values"), ",").alias("paths"), F.size("values").cast("long").alias("n"), F.round(total, 2).alias("total"))


@query(f"""
    with q as (select p_partkey as ref_id, {DOC} as doc_id, p_size % 4 as raw, p_size * 7 % 90 as top, p_size * 7 % 90 + 10 as bottom, p_size % 5 as x0 from part),
    v as (select {DOC} as doc_id, p_size % 4 as raw, p_size * 11 % 90 as v_top, p_size * 11 % 90 + 8 as v_bottom, p_size * 3 % 50 as v_x0 from part),
    p as (select *, v_top >= top - 2 and v_bottom <= bottom + 2 as inside, abs(v_top - top) + abs(v_x0 - x0) / 4.0 as far from q join v using (doc_id, raw)),
    n as (select *, row_number() over (partition by ref_id order by case when inside then 0 else 1 end, case when inside then v_top else far end, v_x0, v_top) as n from p)
    select ref_id, v_top, v_bottom, v_x0 from n where n = 1""")
def value_boxes(t: Tables) -> DataFrame:
    """The box of each quote's value: in the quote's lines, else the nearest on the page."""
    size, page = F.col("p_size"), F.lit(1).alias("page")
    raw = (size % 4).cast("string")
    quotes = t.part.select(F.col("p_partkey").alias("ref_id"), F.expr(DOC).alias("doc_id"), page, raw.alias("raw"), (size * 7 % 90).alias("top"), (size * 7 % 90 + 10).alias("bottom"), (size % 5).alias("x0"))
    values = t.part.select(F.expr(DOC).alias("doc_id"), page, raw.alias("text"), (size * 11 % 90).alias("v_top"), (size * 11 % 90 + 8).alias("v_bottom"), (size * 3 % 50).alias("v_x0"))
    return report.boxes_of_values(quotes, values)


TEMPLATES = {"1-URGENT": "{object}: {a} и {b}", "2-HIGH": "Срочно: {b}", "3-MEDIUM": "{object}"}
SQL_SHOWN = "regexp_replace(regexp_replace(replace(replace(format('{:,.3f}', o_totalprice), ',', ' '), '.', ','), '(,[0-9]*?)0+$', '\\1'), ',$', '')"


@query(f"""
    with x as (select o_orderkey, o_orderpriority as p, case o_orderkey % 4 when 0 then 'Площадка' when 1 then 'Корпус' when 2 then 'b2' else '' end as object, {SQL_SHOWN} as a, case when o_orderkey % 3 = 0 then '8,5 × 24' else 'асфальтобетонная, 1500 мм' end as b from orders)
    select o_orderkey, case p when '1-URGENT' then object || ': ' || a || ' и ' || b when '2-HIGH' then 'Срочно: ' || b when '3-MEDIUM' then object else p end as message from x""")
def report_messages(t: Tables) -> DataFrame:
    """Texts of findings by type, with objects, numbers, axes and materials as a reader sees them."""
    key = F.col("o_orderkey")
    name = report.object_name(F.get(F.array(F.lit("site"), F.lit("b1"), F.lit("b2"), F.lit(None)), (key % 4).cast("int")), F.create_map(F.lit("b1"), F.lit("Корпус")))
    b = F.when(key % 3 == 0, report.shown_axes(F.lit("8.5 x 24"))).otherwise(report.shown_material(F.lit("asphalt, 1500 мм"), {"asphalt": "асфальтобетонная"}))
    return t.orders.select("o_orderkey", report.message("o_orderpriority", TEMPLATES, {"object": name, "a": report.shown_number("o_totalprice"), "b": b}).alias("message"))


@query("""
    select o_orderkey, coalesce(n, 0) as n, r as first_raw, coalesce(list, '') as list from orders left join
      (select l_orderkey, count(*) as n, string_agg(cast(l_linenumber as varchar) || ':' || l_linestatus, '|' order by l_linenumber, l_linestatus) as list, first(l_linestatus order by l_linenumber, l_linestatus) as r from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey""")
def finding_references(t: Tables) -> DataFrame:
    """Findings with their references as one list in order."""
    refs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq"), F.col("l_linestatus").alias("raw"))
    found = report.with_references(t.orders.select("o_orderkey"), refs, ["o_orderkey"])
    listed = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["seq"], r["raw"])), "|")
    return found.select("o_orderkey", F.size("refs").cast("long").alias("n"), F.get("refs", F.lit(0))["raw"].alias("first_raw"), listed.alias("list"))


@query("""select user_id, event_type as text, min(event_id) as seq from events group by 1, 2""")
def warnings_once(t: Tables) -> DataFrame:
    return report.warnings_in_order(t.events.select("user_id", F.col("event_type").alias("text"), F.col("event_id").alias("seq")), ["user_id"])


@query("""
    with f as (select distinct o_custkey as p, 'b' || (o_orderkey % 4) as object_id from orders where o_orderstatus = 'F'), s as (select distinct o_custkey as p, 'b' || (o_orderkey % 4) as object_id from orders where o_orderstatus = 'O')
    select p, object_id, 'heading' as name from f union all select p, object_id, 'row' from s where (p, object_id) not in (select p, object_id from f)""")
def names_merged(t: Tables) -> DataFrame:
    side = lambda status, name: t.orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("p"), F.concat(F.lit("b"), F.col("o_orderkey") % 4).alias("object_id"), F.lit(name).alias("name")).distinct()
    return report.names_merged(side("F", "heading"), side("O", "row"), ["p"])


@query(f"""
    with v as (select {DOC} as doc_id, p_size % 3 as object, case when p_partkey % 2 = 0 then 'room.' || p_partkey else 'f' || {ROW} end as field, p_size as value from part)
    select doc_id, object, coalesce(string_agg(field || '=' || value, ',' order by field, value) filter (field not like 'room.%'), '') as fields, count(*) filter (field like 'room.%') as n_rooms from v group by 1, 2""")
def values_by_object(t: Tables) -> DataFrame:
    field = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("room."), "p_partkey")).otherwise(F.concat(F.lit("f"), F.expr(ROW)))
    v = t.part.select(F.expr(DOC).alias("doc_id"), (F.col("p_size") % 3).alias("object"), field.alias("field"), F.col("p_size").alias("value"))
    shown = report.by_object(v, ["doc_id"])
    return shown.select("doc_id", "object", F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["field"], f["value"])), ",").alias("fields"), "n_rooms")


ANSWER = """concat('Ответ [см. ниже]: [1, 2] и ', case p_partkey % 4 when 0 then 'ничего' when 1 then concat('[{"type": "A", "field": "f', cast(p_size as string), '"}, {"type": "Z"}, {"type": 5}]') when 2 then '[]' else '[{"type": "B"}, {"field": null, "type": "A"}] [7]' end, ' конец ]')"""


@query("""select p_partkey, case p_partkey % 4 when 0 then 0 when 1 then 1 when 2 then 0 else 2 end as n_items, case p_partkey % 4 when 0 then 2 when 1 then 2 else 0 end as dropped, case p_partkey % 4 when 1 then 'f' || p_size end as field from part""")
def model_answers(t: Tables) -> DataFrame:
    """The list of objects in an answer's prose, its items of known types, and how many entries were dropped."""
    said = t.part.select("p_partkey", F.expr(ANSWER).alias("answer"))
    return evaluation.known_items(said, ["A", "B"]).select("p_partkey", F.size("items").cast("long").alias("n_items"), F.col("dropped").cast("long").alias("dropped"), F.get("items", F.lit(0))["field"].alias("field"))


@query(f"""select {DOC} as doc_id, p_partkey as line_no, p_partkey as other_no, 'm2' as unit from part where p_partkey % 5 > 0""")
def scanned_alignment(t: Tables) -> DataFrame:
    """Lines of a scan with the lines of the page that they were: units misread, a letter lost, a fifth not there."""
    original = F.concat(F.lit("строка "), F.col("p_partkey"), F.lit(" площадь "), F.expr(PRICE), F.lit(" м²"))
    page = F.expr(DOC).alias("doc_id")
    want = t.part.select(page, F.col("p_partkey").alias("line_no"), original.alias("text"))
    got = want.withColumn("text", F.when(F.col("line_no") % 5 == 0, F.lit("совсем другое")).otherwise(F.replace(F.replace("text", F.lit("²"), F.lit("?")), F.lit("площадь"), F.lit("плошадь"))))
    return evaluation.aligned_lines(got, want, ["doc_id"]).select("doc_id", "line_no", "other_no", F.lit("m2").alias("unit"))


@query("""select o_orderkey as check_id, o_totalprice as total from orders where o_custkey = (select min(o_custkey) from orders) order by o_orderdate desc, o_orderkey desc""")
def checks_listing(t: Tables) -> DataFrame:
    """An owner's checks, the newest first."""
    owner = str(t.orders.agg(F.min("o_custkey")).first()[0])
    checks = t.orders.select(F.col("o_orderkey").alias("check_id"), F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total"))
    return report.listing(checks, owner).select("check_id", "total")


@query("""select distinct user_id as check_id, event_type as name from events where event_id % 3 = 0 and (user_id, event_type) not in (select user_id, event_type from events where event_id % 3 > 0 and event_id % 7 = 0)""")
def unknown_files(t: Tables) -> DataFrame:
    named = t.events.select(F.col("user_id").alias("check_id"), F.col("event_type").alias("name"), "event_id")
    return report.unknown_files(named.where("event_id % 3 = 0").drop("event_id"), named.where("event_id % 3 > 0 and event_id % 7 = 0").drop("event_id"))


@query("""select event_type, count(*) as n from events where value is not null and case when event_id % 4 = 0 then 'http://x' when event_id % 4 = 1 then null else '' end is distinct from 'http://x' group by 1""")
def spam_filter(t: Tables) -> DataFrame:
    trap = F.when(F.col("event_id") % 4 == 0, "http://x").when(F.col("event_id") % 4 == 1, F.lit(None)).otherwise("")
    return report.not_spam(t.events.where("value is not null").withColumn("website", trap)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select o_orderkey, c.review, c.comment from orders left join (select c_custkey as k, 'ok' as review, c_mktsegment as comment from customer where c_custkey % 2 = 0) c on c.k = o_custkey""")
def findings_with_reviews(t: Tables) -> DataFrame:
    reviews = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("ok").alias("verdict"), F.col("c_mktsegment").alias("comment"))
    return report.with_reviews(t.orders.select("o_orderkey", "o_custkey"), reviews, ["o_custkey"]).select("o_orderkey", "review", "comment")


@query("""with s as (select lang, doc_id, row_number() over (partition by lang order by doc_id) as n from documents) select lang, doc_id, tool from s, (values ('hand'), ('engine')) t(tool) where n <= 3""")
def observation_sheet(t: Tables) -> DataFrame:
    """The first sets of each language, a row to fill in for every tool."""
    sets = evaluation.first_sets(t.documents.select("lang", "doc_id"), ["lang"], ["doc_id"], 3)
    return report.observation_template(sets, ["hand", "engine"]).select("lang", "doc_id", "tool")
