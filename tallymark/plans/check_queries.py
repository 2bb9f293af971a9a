"""The consistency checks and their joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks, ordered
from .registry import Tables, query

#: Sums of order lines and a stated total that is off by 0 to 0.6 % by the order's number; decimals until the last cast.
STATED = """
    with s as (select l_orderkey k, sum(cast(l_extendedprice as decimal(12,2))) sd from lineitem group by l_orderkey),
    u as (select k, cast(sd as decimal(16,2)) sd, cast(cast(sd as decimal(16,2)) * (1 + cast((k % 7) - 3 as decimal(4,0)) * 0.002) as decimal(22,5)) st from s),
    stated as (select k, cast(sd as double) rows_sum, cast(st as double) stated from u)
"""


def stated(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(16,2)").alias("sd"))
    factor = F.lit(1) + ((F.col("k") % 7) - 3).cast("decimal(4,0)") * F.lit("0.002").cast("decimal(4,3)")
    return s.select("k", F.col("sd").cast("double").alias("rows_sum"), (F.col("sd") * factor).cast("decimal(22,5)").cast("double").alias("stated"))


MATCHES = "abs({a} - {b}) <= greatest({abs}, {rel} * greatest(abs({a}), abs({b})))"


def sql_matches(a: str, b: str, kind: str) -> str:
    rel, absolute = S.TOLERANCES[kind]
    return MATCHES.format(a=a, b=b, rel=rel, abs=absolute)


@query(STATED + f"select k, rows_sum, stated, case when {sql_matches('stated', 'rows_sum', 'cross_section')} then 'MATCH' else 'MISMATCH' end as verdict, round(stated - rows_sum, 3) as delta_abs, round((stated - rows_sum) / nullif(rows_sum, 0), 5) as delta_rel from stated")
def tolerance_compare(t: Tables) -> DataFrame:
    return checks.compare(stated(t), "stated", "rows_sum", "cross_section")


@query(STATED + f", v as (select {sql_matches('stated', 'rows_sum', 'cross_section')} as ok from stated) select count(*) filter (not ok) as mismatch, cast(0 as bigint) as missing, count(*) filter (ok) as match from v")
def verdict_summary(t: Tables) -> DataFrame:
    v = checks.compare(stated(t), "stated", "rows_sum", "cross_section")
    return v.agg(*[F.count_if(F.col("verdict") == name).alias(name.lower()) for name in ("MISMATCH", "MISSING", "MATCH")])


@query(STATED + f"select k, case when k % 2 = 0 then stated else rows_sum end as compared, case when {sql_matches('rows_sum', '(case when k % 2 = 0 then stated else rows_sum end)', 'area')} then 'MATCH' else 'MISMATCH' end as verdict from stated join orders on o_orderkey = k")
def area_with_fallback(t: Tables) -> DataFrame:
    s = stated(t)
    totals = s.select("k", F.when(F.col("k") % 2 == 0, F.col("stated")).alias("total"))
    joined = checks.with_fallback(totals, s.select("k", "rows_sum"), ["k"], "total", "rows_sum").join(t.orders.select(F.col("o_orderkey").alias("k")), "k")
    return checks.compare(joined, "rows_sum", "compared", "area").select("k", "compared", "verdict")


@query("""
    with p as (select l_partkey, l_returnflag, sum(case when l_linestatus = 'F' then cast(l_quantity as bigint) end) as f, sum(case when l_linestatus = 'O' then cast(l_quantity as bigint) end) as o from lineitem group by 1, 2)
    select l_partkey, l_returnflag as material, cast(f as double) as drawn, cast(o as double) as estimated, case when abs(f - o) <= greatest(0.01, 0.01 * greatest(abs(f), abs(o))) then 'MATCH' else 'MISMATCH' end as verdict from p where f is not null and o is not null""")
def materials_pairs(t: Tables) -> DataFrame:
    keys = [F.col("l_partkey"), F.col("l_returnflag").alias("material")]
    side = lambda status, name: t.lineitem.where(F.col("l_linestatus") == status).groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias(name))
    return checks.compare(side("F", "drawn").join(side("O", "estimated"), ["l_partkey", "material"]), "drawn", "estimated", "material").select("l_partkey", "material", "drawn", "estimated", "verdict")


@query("""
    with one as (select l_orderkey, min(l_extendedprice) as line from lineitem group by 1 having count(*) = 1)
    select o_orderkey, o_totalprice, line, case when abs(o_totalprice - line) <= 0.001 then 'MATCH' else 'MISMATCH' end as verdict from orders join one on l_orderkey = o_orderkey""")
def single_line_guard(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("line"))
    return checks.compare(checks.single_right(t.orders.select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"]), "o_totalprice", "line", "cost").select("o_orderkey", "o_totalprice", "line", "verdict")


@query("""
    select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey) and exists (select 1 from customer where c_custkey = o_custkey)""")
def missing_mandatory(t: Tables) -> DataFrame:
    required = t.orders.select("o_orderkey", "o_custkey")
    without = checks.missing_with_evidence(required, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), required.select("o_orderkey"), ["o_orderkey"])
    return without.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_NEED = ", ".join(f"('{p}')" for p in PRIORITIES)


@query(f"""
    with need(p) as (values {_NEED}), c as (select distinct o_custkey from orders), h as (select distinct o_custkey, o_orderpriority as p from orders)
    select c.o_custkey, coalesce(string_agg(case when h.p is not null then need.p end, ',' order by need.p), '') as present, coalesce(string_agg(case when h.p is null then need.p end, ',' order by need.p), '') as missing
    from c cross join need left join h on h.o_custkey = c.o_custkey and h.p = need.p group by 1""")
def completeness(t: Tables) -> DataFrame:
    return checks.completeness(t.orders, "o_custkey", "o_orderpriority", PRIORITIES)


@query("""select o_custkey, o_orderpriority as section, o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) = 1 as is_first from orders""")
def first_doc_per_section(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("section"), "o_orderkey", "o_orderdate")
    return ordered.mark_first(rows, ["o_custkey", "section"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
    select l_partkey, l_returnflag, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey, l_returnflag order by case when l_linestatus = 'F' then 0 else 1 end, -l_quantity, l_orderkey, l_linenumber) as n from lineitem) where n = 1""")
def resolve_first(t: Tables) -> DataFrame:
    source = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    best = ordered.first_per(t.lineitem, ["l_partkey", "l_returnflag"], [source, -F.col("l_quantity"), "l_orderkey", "l_linenumber"])
    return best.select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")


def total_rows(t: Tables) -> DataFrame:
    """Order lines as table rows in blocks of an order, each with a total row that is sometimes off."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("table_no"), (F.col("l_linenumber") * 2).cast("bigint").alias("row_no"), F.lit(2).alias("col_no"), F.col("l_quantity").alias("value"), F.lit(False).alias("is_total"))
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("table_no")).agg((F.max("l_linenumber") * 2 + 1).cast("bigint").alias("row_no"), F.sum("l_quantity").alias("s"))
    total = F.when(F.col("table_no") % 5 == 0, F.col("s") + 1).otherwise(F.col("s"))
    return lines.unionByName(ends.select("table_no", "row_no", F.lit(2).alias("col_no"), total.alias("value"), F.lit(True).alias("is_total")))


@query("""
    select l_orderkey as table_no, cast(0 as bigint) as block, max(l_linenumber) * 2 + 1 as row_no, cast(sum(l_quantity) as double) as rows_sum, cast(sum(l_quantity) + 1 as double) as total, count(*) as n_rows, round(1.0 / sum(l_quantity), 5) as delta_rel
    from lineitem where l_orderkey % 5 = 0 group by l_orderkey""")
def table_totals(t: Tables) -> DataFrame:
    return checks.table_totals(total_rows(t), ["table_no"]).select("table_no", F.col("block").cast("bigint").alias("block"), "row_no", "rows_sum", "total", "n_rows", "delta_rel")


@query("""
    with s as (select l_partkey, l_orderkey * 10 + l_linenumber as seq, l_orderkey, l_tax as v from lineitem),
    b as (select l_partkey, min(seq) as base_order, arg_min(v, seq) as base_value, arg_min(l_orderkey, seq) as base_place from s group by 1),
    o as (select s.l_partkey, base_order, base_value, min(seq) as other_order, arg_min(v, seq) as other_value from s join b using (l_partkey) where seq > base_order and l_orderkey <> base_place and not (abs(base_value - v) <= greatest(0.03, 0.0)) group by 1, 2, 3)
    select l_partkey, base_order, base_value, other_order, other_value, round((base_value - other_value) / nullif(other_value, 0), 5) as delta_rel from o""")
def first_disagreement(t: Tables) -> DataFrame:
    s = t.lineitem.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_orderkey", F.col("l_tax").alias("v"))
    return checks.first_disagreement(s, ["l_partkey"], "seq", "v", ["l_orderkey"], 0.0, 0.03)


@query("""select o_custkey, count(distinct o_orderstatus) as n_values, string_agg(distinct o_orderstatus, ', ' order by o_orderstatus) as values from orders group by 1 having count(distinct o_orderstatus) > 1""")
def contradiction_distinct(t: Tables) -> DataFrame:
    return checks.distinct_contradiction(t.orders, ["o_custkey"], "o_orderstatus")


@query("""
    with c as (select n_regionkey, c_nationkey, c_mktsegment from customer join nation on n_nationkey = c_nationkey),
    site as (select n_regionkey, c_mktsegment from c where c_nationkey % 5 = 0 and c_mktsegment <> 'BUILDING'),
    sv as (select n_regionkey, count(distinct c_mktsegment) as n, string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) as v from site group by 1),
    own as (select distinct n_regionkey, c_nationkey, c_mktsegment from c where c_nationkey % 5 <> 0),
    b as (select n_regionkey, c_nationkey, count(*) as n, string_agg(c_mktsegment, ', ' order by c_mktsegment) as v, count(*) filter (not exists (select 1 from site where site.n_regionkey = own.n_regionkey and site.c_mktsegment = own.c_mktsegment)) as foreign_n from own group by 1, 2)
    select 'building' as scope, cast(c_nationkey as varchar) as object, b.v as values from b left join sv using (n_regionkey) where b.n > 1 or (sv.n > 0 and foreign_n > 0)
    union all select 'site', cast(n_regionkey as varchar), v from sv where n > 1""")
def site_vs_building(t: Tables) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).select("n_regionkey", "c_nationkey", "c_mktsegment")
    site = c.where((F.col("c_nationkey") % 5 == 0) & (F.col("c_mktsegment") != "BUILDING"))
    return checks.site_vs_building(site, c.where(F.col("c_nationkey") % 5 != 0), "n_regionkey", "c_nationkey", "c_mktsegment")


@query("""
    with g as (select p_brand as m, p_size as w from part where p_partkey = 1), o as (select p_type, p_brand as m, p_size as w from part where p_partkey > 1),
    u as (select * from o union all select distinct o.p_type, g.m, g.w from o cross join g)
    select p_type, string_agg(distinct m, ', ' order by m) as materials, min(w) as narrowest, max(w) as widest from u group by 1 having count(distinct m) > 1 or max(w) - min(w) > 0.01 * max(w)""")
def parameter_scope(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_type", F.col("p_brand").alias("m"), F.col("p_size").alias("w"))
    return checks.parameter_contradiction(rows.where("p_partkey > 1"), rows.where("p_partkey = 1"), "p_type", "m", "w")


@query("""
    with x as (select l_partkey, l_orderkey * 10 + l_linenumber as seq, min(l_quantity) as a, 30.0 as b from lineitem where l_returnflag = 'A' group by 1, 2), r as (select p_partkey, p_retailprice as area from part)
    select l_partkey, seq as axes_seq, a, round(a * b, 2) as axes_area, area from x join r on p_partkey = l_partkey
    where area < round(a * b, 2) and not (abs(area - round(a * b, 2)) <= greatest(0.1, 0.005 * greatest(abs(area), abs(round(a * b, 2)))))""")
def geometry_theta(t: Tables) -> DataFrame:
    axes = t.lineitem.where("l_returnflag = 'A'").groupBy("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("axes_seq")).agg(F.min("l_quantity").alias("a")).withColumn("b", F.lit(30.0))
    areas = t.part.select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("area_seq"), F.col("p_retailprice").alias("area"))
    return checks.smaller_than_axes(axes, areas, "l_partkey").select("l_partkey", "axes_seq", "a", "axes_area", "area")


@query("""
    with v as (select l_partkey, l_orderkey * 10 + l_linenumber as volume_seq, min(l_quantity) * 60 as volume from lineitem group by 1, 2), a as (select p_partkey, p_size as area from part),
    h(height_seq, height) as (values (1, 24.0), (2, 30.0), (3, 60.0), (4, 120.0)),
    x as (select l_partkey, volume_seq, volume, area, height, row_number() over (partition by l_partkey, volume_seq order by height_seq) as n from v join a on p_partkey = l_partkey cross join h where abs(area * height - volume) <= 0.005 * volume)
    select l_partkey, volume_seq, volume, area, cast(height as double) as height from x where n = 1""")
def volume_method(t: Tables) -> DataFrame:
    volumes = t.lineitem.groupBy("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("volume_seq")).agg((F.min("l_quantity") * 60).alias("volume"))
    areas = t.part.select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("area_seq"), F.col("p_size").alias("area"))
    heights = t.part.select(F.col("p_partkey").alias("l_partkey"), F.posexplode(F.array(*map(F.lit, (24.0, 30.0, 60.0, 120.0)))).alias("height_seq", "height"))
    return checks.volume_method(volumes, areas, heights, "l_partkey").select("l_partkey", "volume_seq", "volume", "area", "height")


@query("""
    with l as (select l_partkey as k, l_orderkey * 10 + l_linenumber as seq, cast(l_quantity as double) * 60 as volume, l_returnflag = 'R' as from_table from lineitem),
    a as (select p_partkey as k, cast(p_size as double) as area, p_partkey % 4 as floors from part),
    h as (select distinct l.k from l join a using (k) where abs(area * 30 - volume) <= 0.005 * volume),
    o as (select k, seq, volume, row_number() over (partition by k order by from_table desc, volume, seq) as n from l)
    select k as p_partkey, seq as volume_seq, volume, area, floors from o join a using (k) where n = 1 and floors > 0 and volume / (area * floors) < 2.8 and k not in (select k from h)""")
def volume_ratio(t: Tables) -> DataFrame:
    """The second rule of the volume check: parts whose volumes no clear height explains."""
    volumes = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("volume_seq"), (F.col("l_quantity").cast("double") * 60).alias("volume"), (F.col("l_returnflag") == "R").alias("from_table"))
    areas = t.part.select("p_partkey", F.lit(1).alias("area_seq"), F.col("p_size").cast("double").alias("area"))
    heights = t.part.select("p_partkey", F.lit(1).alias("height_seq"), F.lit(30.0).alias("height"))
    floors = t.part.select("p_partkey", (F.col("p_partkey") % 4).alias("floors"))
    found = checks.volume_method(volumes, areas, heights, "p_partkey")
    return checks.volume_ratio(volumes, areas, floors, "p_partkey", found).select("p_partkey", "volume_seq", "volume", "area", "floors")


@query("""
    with l as (select s_nationkey as k, min(s_acctbal) as low, max(s_acctbal) as high from supplier group by 1)
    select c_custkey, c_acctbal, low, high from customer join l on k = c_nationkey where c_acctbal < low - 3 or c_acctbal > high + 3""")
def outside_range(t: Tables) -> DataFrame:
    values = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    limits = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    return checks.outside_range(values, limits, "k", "v", 3.0).select("c_custkey", F.col("v").alias("c_acctbal"), "low", "high")


@query("""
    with o as (select p_name, arg_min(p_brand, p_partkey) as owned_by from part group by 1)
    select p_partkey, p_name, p_brand, owned_by from part join o using (p_name) where p_brand <> owned_by""")
def copied_label(t: Tables) -> DataFrame:
    return checks.copied_label(t.part.select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand", "p_partkey").select("p_partkey", "p_name", "p_brand", "owned_by")


FINDINGS = STATED + f""", f as (
    select 'CROSS_SECTION' as type, k as object, round((stated - rows_sum) / nullif(rows_sum, 0), 5) as delta_rel from stated where not ({sql_matches('stated', 'rows_sum', 'cross_section')})
    union all select 'TABLE_TOTAL', l_orderkey, round(1.0 / sum(l_quantity), 5) from lineitem where l_orderkey % 5 = 0 group by l_orderkey
    union all select 'MISSING', o_orderkey, null from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey))"""


@query(FINDINGS + " select 'P' || row_number() over (order by type, object) as id, type, object, delta_rel from f")
def findings_union(t: Tables) -> DataFrame:
    return ordered.numbered(findings(t), F.col("type"), "object").select(F.concat(F.lit("P"), F.col("number")).alias("id"), "type", "object", "delta_rel")


def findings(t: Tables) -> DataFrame:
    """The findings of three checks over all orders."""
    jobs = {
        "cross_section": lambda: checks.compare(stated(t), "stated", "rows_sum", "cross_section").where("verdict = 'MISMATCH'").select(F.lit("CROSS_SECTION").alias("type"), F.col("k").alias("object"), "delta_rel"),
        "table_total": lambda: checks.table_totals(total_rows(t), ["table_no"]).select(F.lit("TABLE_TOTAL").alias("type"), F.col("table_no").alias("object"), "delta_rel"),
        "missing": lambda: t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.lit("MISSING").alias("type"), F.col("o_orderkey").alias("object"), F.lit(None).cast("double").alias("delta_rel")),
    }
    return checks.run_checks(jobs)[0]


@query(FINDINGS + " select type, count(*) as n, count(delta_rel) as with_delta from f where type <> 'MISSING' and (delta_rel is null or abs(delta_rel) >= 0.005) group by type")
def filter_findings(t: Tables) -> DataFrame:
    kept = findings(t).where((F.col("type") != "MISSING") & (F.col("delta_rel").isNull() | (F.abs("delta_rel") >= 0.005)))
    return kept.groupBy("type").agg(F.count("*").alias("n"), F.count("delta_rel").alias("with_delta"))


@query(STATED + f", v as (select k, {sql_matches('stated', 'rows_sum', 'cross_section')} as ok from stated) select k, case when ok then 'MATCH' else 'MISMATCH' end as verdict, row_number() over (order by ok, k) as sheet_row from v")
def export_sheet(t: Tables) -> DataFrame:
    v = checks.compare(stated(t), "stated", "rows_sum", "cross_section").select("k", "verdict")
    return ordered.numbered(v, F.col("verdict") == "MATCH", "k", "sheet_row")


@query("""
    select 'o_totalprice' as rule, o_orderkey as key from orders where not (o_totalprice >= 0) union all select 'c_name', c_custkey from customer where length(trim(c_name)) not between 1 and 200
    union all select 'o_custkey', o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey) union all select 'l_linenumber', l_orderkey from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)""")
def constraints(t: Tables) -> DataFrame:
    return (
        t.orders.where(~(F.col("o_totalprice") >= 0)).select(F.lit("o_totalprice").alias("rule"), F.col("o_orderkey").alias("key"))
        .unionByName(t.customer.where(~F.length(F.trim("c_name")).between(1, 200)).select(F.lit("c_name").alias("rule"), F.col("c_custkey").alias("key")))
        .unionByName(t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select(F.lit("o_custkey").alias("rule"), F.col("o_orderkey").alias("key")))
        .unionByName(t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("l_linenumber").alias("rule"), F.col("l_orderkey").alias("key")))
    )
