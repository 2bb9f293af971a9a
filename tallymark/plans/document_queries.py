"""Reading of tables and sentences over documents made from the driver's tables, with DuckDB's SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..operators import labels, tables, texts
from ..operators.wordings import CELL_NUMBER, Wordings
from ..functions.scalars import once
from ..sources.lexicon import Lexicon, bare_text, field_for_display, material_in, unit_of, unit_of_field
from ..session import kept, shuffled, spread
from .registry import Tables, query

#: Eight rows of `part` are a document's table; the document's number says of which kind it is. Expressions of both dialects.
DOC, ROW = "cast(floor(p_partkey / 8) as bigint)", "cast(p_partkey % 8 + 1 as int)"
KIND = "(cast(floor(p_partkey / 8) as bigint) % 8)"


def cases(of: str, values: list[str], other: str = "''") -> str:
    quoted = [v if v.startswith("!") else "'" + v + "'" for v in values]
    return f"case {of} " + " ".join(f"when {i} then {v.removeprefix('!')}" for i, v in enumerate(quoted)) + f" else {other} end"


TEP_LABELS = ["Этажность", "Площадь застройки", "Общая площадь", "Строительный объем", "Сметная стоимость", "Продолжительность строительства", "Жалпы ауданы", "Прочее"]
ROOM_LABELS = ["Котельная", "Итого по 1 этажу", "Итого общая площадь", "Коридор", "Санузел", "Жалпы аудан", "Склад", "Тамбур"]
MATERIAL_LABELS = ["Арматура А500С", "Стальные конструкции", "Кирпичная кладка", "Бетон B25", "Бетон В 30", "Кірпіш", "Прочие работы", "Всего по локальной смете"]
TOTAL_LABELS = ["Итого по объектной смете", "Всего по сводному расчету", "Глава 2", "Корпус", "Сети", "Благоустройство", "Прочее", "Объектілік смета бойынша"]
HEADERS = [
    ["№", "Наименование показателя", "Ед. изм.", "Прим", "Значение"],
    ["№ пом.", "Наименование", "Кат.", "Площадь, м²", "Прим"],
    ["№", "Наименование", "Ед. изм.", "Кол-во", "Прим"],
    ["№", "Наименование", "Ед. изм.", "Кол-во", "Цена"],
    ["№ смет", "Наименование", "A", "B", "Стоимость"],
    ["№ смет", "Наименование", "A", "B", "Стоимость"],
    ["№ смет", "Наименование", "A", "B", "Стоимость"],
    ["A", "B", "C", "D", "E"],
]
CONTEXTS = ["Основные показатели", "Экспликация помещений", "Ведомость объемов работ", "Локальная смета", "Объектная смета", "Сводный сметный расчет", "Прочее", "Прочее"]
BY_KIND = [TEP_LABELS, ROOM_LABELS, MATERIAL_LABELS, MATERIAL_LABELS, TOTAL_LABELS, TOTAL_LABELS, TOTAL_LABELS, TEP_LABELS]
PRICE = "replace(cast(cast(p_retailprice as decimal(12,2)) as string), '.', ',')"
CELLS = [
    f"case when {KIND} = 5 and p_partkey % 2 = 0 then concat('ОС 02-0', cast({ROW} as string), ' корпус') else cast({ROW} as string) end",
    cases(KIND, ["!" + cases(f"({ROW} - 1)", labels_) for labels_ in BY_KIND]),
    f"case when {ROW} = 5 then case when p_size % 2 = 0 then 'млн тенге' else 'тыс. тенге' end else 'шт' end",
    f"case when {ROW} = 4 and p_size % 5 = 0 then 'нет' else cast(p_size as string) end",
    PRICE,
]


#: A small set of wordings of our own; the engine reads such sets from JSON.
WORDS = Wordings((
    ("header", "label", "Наименование"), ("header", "value", "Значение"), ("header", "qty", "Кол-во"), ("header", "price", "Цена"), ("header", "area", "Площадь"),
    ("header", "estimate_no", "№ смет"), ("header", "unit", "Ед. изм."), ("header", "room_no", "№ пом."),
    ("context", "explication", "Экспликация"), ("context", "materials", "Ведомость объемов"), ("context", "object", "Объектная смета"), ("context", "summary", "Сводный сметный"),
    ("totals", "explication_total", "Итого общая площадь"), ("totals", "explication_total", "Жалпы аудан"), ("totals", "floor_subtotal", "Итого по 1 этажу"), ("totals", "object_total", "Итого по объектной"),
    ("totals", "object_total", "Объектілік смета бойынша"), ("totals", "summary_total", "Всего по сводному"), ("totals", "local_total", "Всего по локальной"),
    ("row", "floors", "Этажность"), ("row", "building_area_m2", "Площадь застройки"), ("row", "total_area_m2", "Общая площадь"), ("row", "total_area_m2", "Жалпы ауданы"),
    ("row", "construction_volume_m3", "Строительный объем"), ("row", "estimated_cost_ktg", "Сметная стоимость"), ("row", "construction_duration_months", "Продолжительность строительства"),
    ("material", "rebar_a500c_t", "Арматура"), ("material", "steel_structures_t", "Стальные конструкции"), ("material", "brick_masonry_m3", "Кирпичная"), ("material", "brick_masonry_m3", "Кірпіш"),
    ("material", "concrete_b25_foundation_m3", "B25"), ("material", "concrete_b30_frame_m3", "В 30"),
    ("paragraph", "total_area_m2", "Общая площадь здания"), ("paragraph", "construction_volume_m3", "Строительный объем"), ("paragraph", "estimated_cost_ktg", "Сметная стоимость строительства"), ("paragraph", "concrete_total_m3", "Расход монолитного бетона"),
    ("storeys", "storeys", "этажный"), ("cost_unit", "cost_unit", "тыс. тенге"), ("cost_unit", "cost_unit", "тенге"), ("estimate", "estimate", "ОС"), ("site", "site", "площадка"), ("site", "site", "участок"),
))


def section_input(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tables with header and context, and their rows."""
    header = F.array(*[F.expr(cases(KIND, [h[i] for h in HEADERS])) for i in range(5)])
    headers = t.part.groupBy(F.expr(DOC).alias("doc_id")).agg(F.min("p_partkey").alias("p_partkey")).select("doc_id", header.alias("header"), F.expr(cases(KIND, CONTEXTS)).alias("context"))
    return kept(headers), t.part.select(F.expr(DOC).alias("doc_id"), F.expr(ROW).alias("row_no"), F.array(*[F.expr(x) for x in CELLS]).alias("cells"))


def sql_says(text: str, pattern: str) -> str:
    return f"regexp_matches(translate({text}, 'ёЁ', 'еЕ'), '(^|[^\\p{{L}}])({pattern})', 'i')"


def sql_first(text: str, patterns: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {sql_says(text, rx)} then '{name}'" for name, rx in patterns) + " end"


def sql_place(kind: str) -> str:
    return f"list_position(list_transform(header, lambda h: {sql_says('h', WORDS.pattern('header', kind))}), true)"


SECTIONS = f"""
    with r as (select {DOC} as doc_id, {ROW} as row_no, [{', '.join(cases(KIND, [h[i] for h in HEADERS]) for i in range(5))}] as header, {cases(KIND, CONTEXTS)} as context, [{', '.join(CELLS)}] as cells from part),
    a as (select *, array_to_string(header, ' ') as heads, array_to_string(list_filter(cells, lambda x: x <> '' and not regexp_full_match(trim(x), '{CELL_NUMBER}')), ' ') as label,
                 {sql_place('value')} as p_value, {sql_place('qty')} as p_qty, {sql_place('area')} as p_area, {sql_place('estimate_no')} as p_no, {sql_place('unit')} as p_unit from r),
    k as (select *, case when {sql_says('heads', WORDS.pattern('header', 'price'))} then 'local' when {sql_says('heads', WORDS.pattern('header', 'estimate_no'))} then case when {sql_says('context', WORDS.pattern('context', 'summary'))} then 'summary' when {sql_says('context', WORDS.pattern('context', 'object'))} then 'object' else 'estimate_unknown' end
                 when {sql_says('context', WORDS.pattern('context', 'explication'))} or {sql_says('heads', WORDS.pattern('header', 'room_no'))} then 'explication' when {sql_says('heads', WORDS.pattern('header', 'qty'))} and {sql_says("context || ' ' || heads", WORDS.pattern('context', 'materials'))} then 'materials' when {sql_says('heads', WORDS.pattern('header', 'value'))} then 'tep' else 'unknown' end as kind,
                 {sql_first('label', WORDS.patterns('material'))} as material, regexp_extract(coalesce(cells[p_no], ''), '^{WORDS.estimate_ref()}', 1) as ref from a),
    f as (select *, case kind when 'tep' then {sql_first('label', WORDS.patterns('row'))}
                 when 'explication' then case when {sql_says('label', WORDS.pattern('totals', 'floor_subtotal'))} then null when {sql_says('label', WORDS.pattern('totals', 'explication_total'))} then 'explication_total_area_m2' else 'room.' || cells[1] || '.area_m2' end
                 when 'materials' then material when 'local' then case when material is not null then 'local_qty.' || material when {sql_says('label', WORDS.pattern('totals', 'local_total'))} then 'local.total_tg' end
                 when 'object' then case when {sql_says('label', WORDS.pattern('totals', 'object_total'))} then 'os.total_ktg' end
                 when 'summary' then case when ref <> '' then 'ssr.ch2.os_' || ref || '_ktg' when {sql_says('label', WORDS.pattern('totals', 'summary_total'))} then 'ssr.total_ktg' end end as field from k),
    v as (select *, cells[case when kind = 'tep' then coalesce(p_value, len(cells)) when kind = 'explication' then coalesce(p_area, len(cells) - 1) when material is not null and kind in ('materials', 'local') then p_qty else len(cells) end] as raw from f where field is not null),
    n as (select *, try_cast(replace(raw, ',', '.') as double) as num from v)
    select doc_id, row_no, kind, field, raw, case when field = 'estimated_cost_ktg' then round(num * case when {sql_says('cells[p_unit] || label', 'млн')} then 1000 when {sql_says('cells[p_unit] || label', 'тыс')} then 1 else 0.001 end, 3) when field = 'floors' then floor(num) else num end as value
    from n where num is not null"""


@query(SECTIONS)
def section_tables(t: Tables) -> DataFrame:
    return tables.section_rows(*section_input(t), ["doc_id"], WORDS).select("doc_id", "row_no", "kind", "field", "raw", "value")


#: A small lexicon; the engine reads such lexicons from JSON.
UNITS_OF = {"building_area_m2": "m2", "construction_volume_m3": "m3", "floors": "floor", "total_area_m2": "m2"}
LABELS = [("building_area_m2", "Площадь застройки"), ("construction_volume_m3", "Строительный объем"), ("floors", "Этажность"), ("floors", "Количество этажей"), ("total_area_m2", "Общая площадь"), ("total_area_m2", "Площадь общая")]
UNITS = [("m2", "кв.м"), ("m2", "м²"), ("m3", "куб.м"), ("m3", "м³"), ("floor", "эт."), ("month", "мес.")]
LEXICON = Lexicon(UNITS_OF, [(f, "table", k) for f, k in LABELS], ["Площадь участка", "Объем бетона"], UNITS, [("number", "№ п/п"), ("units_row", "Ед. изм."), ("total_row", "Итого"), ("total_row", "Всего")])

#: Even documents have fields across (header in the first or second row, units below), odd ones down.
WIDE = f"{DOC} % 2 = 0"
GRID = {
    0: f"case when {WIDE} then case {ROW} when 1 then case when {DOC} % 4 = 0 then '№ п/п' else 'Таблица 1' end when 2 then case when {DOC} % 4 = 0 then '' else '№ п/п' end else cast({ROW} as string) end else case when {ROW} = 1 then '№ п/п' else cast({ROW} as string) end end",
    1: f"case when {WIDE} then case {ROW} when 1 then case when {DOC} % 4 = 0 then 'Наименование' else '' end when 2 then case when {DOC} % 4 = 0 then 'Ед. изм.' else 'Наименование' end when 8 then 'Итого' else concat('Корпус ', cast({ROW} as string)) end else {cases(f'({ROW} - 1)', ['Показатель', 'Этажность', 'Площадь застройки', 'Общая площадь здания', 'Строительный объем', 'Прочее', 'Участок', 'Стоянка'])} end",
    2: f"case when {WIDE} then case {ROW} when 1 then case when {DOC} % 4 = 0 then 'Площадь застройки' else '' end when 2 then case when {DOC} % 4 = 0 then 'кв.м' else 'Площадь застройки, м²' end else {PRICE} end else {cases(f'({ROW} - 1)', ['Ед. изм.', 'эт.', 'кв.м', 'м²', 'куб.м', 'шт', 'шт', 'м²'])} end",
    3: f"case when {WIDE} then case {ROW} when 1 then case when {DOC} % 4 = 0 then 'Строительный объем, м³' else '' end when 2 then case when {DOC} % 4 = 0 then 'куб.м' else 'Строительный объем (м²)' end else cast(p_size as string) end else case when {ROW} = 1 then 'Значение' when {ROW} = 2 and p_size % 2 = 0 then '2,5' else {PRICE} end end",
    4: f"case when {WIDE} then case {ROW} when 1 then case when {DOC} % 4 = 0 then 'Этажность' else '' end when 2 then case when {DOC} % 4 = 0 then 'эт.' else 'Количество этажей' end else case when p_size % 3 = 0 then '1,5' else '3' end end else '' end",
}


def grid(t: Tables) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("col_no"), F.expr(x).alias("text")) for i, x in GRID.items()])
    return t.part.select(F.expr(DOC).alias("doc_id"), F.lit(1).alias("table_no"), F.lit(1).alias("page"), (F.expr(ROW) - 1).alias("row_no"), F.explode(cells).alias("x")).select("doc_id", "table_no", "page", "row_no", "x.col_no", "x.text")


def sql_squash(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def sql_values(rows: list[tuple], names: str) -> str:
    return "(select * from (values " + ", ".join("(" + ", ".join("'" + v + "'" for v in r) + ")" for r in rows) + f") as x({names}))"


SQL_UNITS = sql_values([(u, bare_text(s)) for u, s in UNITS] + [("m2", "м2"), ("m3", "м3")], "unit, spelling")
SQL_LABELS = sql_values([(f, bare_text(k), UNITS_OF[f]) for f, k in LABELS], "field, known, unit")
TEP_TABLES = f"""
    with g as (select {DOC} as doc_id, {ROW} - 1 as row_no, unnest([{', '.join(f"struct_pack(col_no := {i}, text := {x})" for i, x in GRID.items())}]) as x from part),
    c as (select doc_id, row_no, x.col_no as col_no, x.text as text from g),
    labelled as (select doc_id, row_no, first(text order by col_no) as label from c where regexp_matches(text, '\\p{{L}}') group by 1, 2),
    l as (select distinct c.doc_id, c.row_no, coalesce(label, '') as label from c left join labelled using (doc_id, row_no)),
    u as (select distinct on (spelling) spelling, unit from {SQL_UNITS}),
    head as (select c.doc_id, c.row_no, c.col_no, c.text, coalesce(u1.unit, u2.unit) as unit from c left join l b on b.doc_id = c.doc_id and b.row_no = c.row_no + 1 and b.label = 'Ед. изм.'
             left join c d on d.doc_id = b.doc_id and d.row_no = b.row_no and d.col_no = c.col_no
             left join u u1 on u1.spelling = {sql_squash("regexp_extract(c.text, '[,(]\\s*([^,()]+?)\\s*\\)?\\s*$', 1)")} left join u u2 on u2.spelling = {sql_squash('d.text')}
             where c.row_no < 3 and c.text <> ''),
    hit as (select doc_id, row_no, col_no, first(field order by length(known) desc, field) as field from head h join {SQL_LABELS} k on contains({sql_squash('h.text')}, known) and (h.unit is null or h.unit = k.unit) group by 1, 2, 3),
    top as (select doc_id, min(row_no) as header_no from (select doc_id, row_no from hit group by 1, 2 having count(distinct field) >= 2) group by 1),
    wide as (select c.doc_id, c.row_no, l.label, hit.field, c.text as raw, 'table_h' as source from top join hit on hit.doc_id = top.doc_id and hit.row_no = header_no join c on c.doc_id = top.doc_id and c.row_no > header_no and c.col_no = hit.col_no join l on l.doc_id = c.doc_id and l.row_no = c.row_no where l.label not in ('Ед. изм.', 'Итого')),
    tall as (select c.doc_id, c.row_no, c.text as label, first(k.field order by length(known) desc, k.field) as field, any_value(v.text) as raw, 'table_v' as source
             from c join c un on un.doc_id = c.doc_id and un.row_no = c.row_no and un.col_no = 2 left join u on u.spelling = {sql_squash('un.text')} join c v on v.doc_id = c.doc_id and v.row_no = c.row_no and v.col_no = 3
             join {SQL_LABELS} k on contains({sql_squash('c.text')}, known) and (u.unit is null or u.unit = k.unit)
             where c.col_no = 1 and c.doc_id % 2 = 1 group by 1, 2, 3),
    fit as (select doc_id, count(*) as hits, count(*) filter (regexp_matches(raw, '^[0-9]')) as numbers from tall group by 1),
    every as (select * from wide union all select tall.* from tall join fit using (doc_id) where hits >= 2),
    num as (select *, try_cast(replace(raw, ',', '.') as double) as value from every)
    select doc_id, row_no, label, field, raw, value, source from num where value is not null and (field <> 'floors' or value = floor(value))"""


@query(TEP_TABLES)
def tep_tables(t: Tables) -> DataFrame:
    found = tables.table_values(kept(grid(t)), LEXICON, ("exact",))
    return found.select("doc_id", "row_no", "label", "field", "raw", "value", "source")


# ---- sentences: a part is a page; what it must say is known from how it is made

FULL = Lexicon(UNITS_OF, [*LEXICON.labels, ("floors", "text_number_first", "этажное")], LEXICON.negatives, UNITS, LEXICON.headers)
VOLUME = "cast(p_size + 100 as string)"
PAGE = f"""concat('Здание в осях. ', case when p_partkey % 2 = 0 then 'Площадь застройки здания составляет ' else 'Пл. застр. – ' end, {PRICE}, ' м². Строительный объём равен ', {VOLUME}, case when p_partkey % 3 = 0 then ' куб. м; ' else ' м3; ' end,
    'площадь участка ', cast(p_size as string), ' м2, ширина 5 м. Всего ', cast(p_size + 7 as string), ' кв.м общей площади. Корпус ', cast(p_size % 9 + 1 as string), '-этажное здание, длина 10 м')"""


def pages_of(t: Tables, text: str) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.expr(text).alias("text"))


@query("""
    select p_partkey as doc_id, 'building_area_m2' as field, cast(cast(p_retailprice as decimal(12,2)) as double) as value, case when p_partkey % 2 = 0 then 'exact' else 'fuzzy' end as method from part
    union all select p_partkey, 'construction_volume_m3', p_size + 100, 'exact' from part
    union all select p_partkey, 'total_area_m2', p_size + 7, 'fuzzy' from part
    union all select p_partkey, 'floors', p_size % 9 + 1, 'exact' from part""")
def anchored_sentences(t: Tables) -> DataFrame:
    """Numbers with units, named by the words before or after them; a negative label and lengths give nothing."""
    return texts.anchored_values(pages_of(t, PAGE), FULL).select("doc_id", "field", "value", "method")


COST = "case p_partkey % 3 when 0 then ' млн тенге' when 1 then ' тыс. тенге' else ' рублей' end"
PARAGRAPH = f"concat('Общая площадь здания по проекту ', {PRICE}, ' кв.м. Строительный объем не указан. Сметная стоимость строительства равна ', cast(p_size as string), {COST}, '. Расход монолитного бетона ', cast(p_size + 1 as string), ' м3. Это ', cast(p_size % 5 + 1 as string), '-этажный дом')"


@query("""
    select p_partkey as doc_id, 'total_area_m2' as field, cast(cast(p_retailprice as decimal(12,2)) as double) as value from part
    union all select p_partkey, 'construction_volume_m3', p_size from part
    union all select p_partkey, 'estimated_cost_ktg', case p_partkey % 3 when 0 then p_size * 1000 else p_size end from part where p_partkey % 3 < 2
    union all select p_partkey, 'concrete_total_m3', p_size + 1 from part
    union all select p_partkey, 'floors', p_size % 5 + 1 from part""")
def paragraph_values(t: Tables) -> DataFrame:
    """The first number after a label on the page; a cost counts only with its unit."""
    return texts.paragraph_values(pages_of(t, PARAGRAPH), WORDS).select("doc_id", "field", "value")


SECTION = "case p_partkey % 4 when 0 then 'PZ' when 1 then 'AR' when 2 then 'KR' else 'SMETA' end"
SCAN_LINE = f"""case p_partkey % 4
    when 0 then case when p_size % 2 = 0 then concat('3 | Этажность ', cast(p_size as string), ' эт') else concat('5 Сметная стоимость, млн тенге ', cast(p_size as string)) end
    when 1 then case when p_size % 2 = 0 then concat('Итого общая площадь ', {PRICE}) else concat('Итого по 1 этажу общая площадь ', {PRICE}) end
    when 2 then concat('2 Арматура класса ', {PRICE}, ' т 77')
    else case p_size % 4 when 0 then concat('Кирпичная кладка м3 | ', {PRICE}, ' 5') when 1 then concat('ОС 02-01 Корпус 12; ', {PRICE}) when 2 then concat('Итого по объектной смете ', {PRICE}) else concat('Всего по сводному расчету ', {PRICE}) end end"""


@query("""
    with p as (select *, cast(cast(p_retailprice as decimal(12,2)) as double) as v from part)
    select p_partkey as doc_id,
           case p_partkey % 4 when 0 then if(p_size % 2 = 0, 'floors', 'estimated_cost_ktg') when 1 then if(p_size % 2 = 0, 'explication_total_area_m2', 'total_area_m2') when 2 then 'rebar_a500c_t'
             else case p_size % 4 when 0 then 'local_qty.brick_masonry_m3' when 1 then 'ssr.ch2.os_02-01_ktg' when 2 then 'os.total_ktg' else 'ssr.total_ktg' end end as field,
           case when p_partkey % 4 = 0 then if(p_size % 2 = 0, p_size, p_size * 1000) else v end as value from p""")
def scanned_lines(t: Tables) -> DataFrame:
    """Lines of a scan: a label, then the first number after it."""
    lines = t.part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("line_no"), F.expr(SECTION).alias("section"), F.expr(SCAN_LINE).alias("text"))
    return texts.scanned_lines(lines, WORDS).select("doc_id", "field", "value")


HEIGHT = "replace(cast(cast(p_size / 10.0 as decimal(6,1)) as string), '.', ',')"
HEIGHT_PAGE = f"concat('Высота помещений в чистоте до потолка ', {HEIGHT}, 'м. Далее текст. Высота помещений не указана. Длина 9 м')"


@query("select p_partkey as doc_id, round(p_size / 10.0, 1) as value from part where p_size between 15 and 200")
def mention_heights(t: Tables) -> DataFrame:
    """Heights right after a mention, in its sentence, that a storey can have."""
    return texts.heights(pages_of(t, HEIGHT_PAGE), "высота помещени").select("doc_id", F.round("value", 1).alias("value"))


SEISMIC = "case p_partkey % 4 when 0 then 'Сейсмичность площадки 8 баллов' when 1 then 'Сейсмичность здания 9 баллов' when 2 then 'Котельная: сейсмичность 8' else 'Гараж и котельная, сейсмичность 7' end"


@query("select p_partkey as doc_id, case p_partkey % 4 when 2 then 'boiler' else 'site' end as scope from part")
def seismic_scope(t: Tables) -> DataFrame:
    """Sentences of one building, unless they speak of the site or name none or several."""
    said = t.part.select(F.col("p_partkey").alias("doc_id"), F.expr(SEISMIC).alias("s"))
    named = F.array_compact(F.array(F.when(F.lower("s").contains("котельн"), F.lit("boiler")), F.when(F.lower("s").contains("гараж"), F.lit("garage"))))
    return said.select("doc_id", texts.seismic_scope(F.col("s"), named, WORDS).alias("scope"))


LABEL_CASES = ["Пл. застр.", "Площадь участка", "Общая площадь здания, м²", "Строит. объем", "Этажность", "Объем засыпки", "Kол-во этажей", "Oбщая площaдь", "Объем бетона", "Прочее", "123", "Площадь общая квартир"]
LABEL_TRUTH = [("building_area_m2", "fuzzy"), None, ("total_area_m2", "exact"), ("construction_volume_m3", "fuzzy"), ("floors", "exact"), None, ("floors", "fuzzy"), ("total_area_m2", "fuzzy"), None, None, None, ("total_area_m2", "exact")]


@query(f"""
    select p_partkey, {cases('(p_partkey % 12)', [m[0] if m else '!null' for m in LABEL_TRUTH], 'null')} as field, {cases('(p_partkey % 12)', [m[1] if m else '!null' for m in LABEL_TRUTH], 'null')} as method from part where p_partkey % 12 in ({', '.join(str(i) for i, m in enumerate(LABEL_TRUTH) if m)})""")
def label_cascade(t: Tables) -> DataFrame:
    """Negative labels, exact containment, then coverage by inflected, shortened and misread words."""
    said = t.part.select("p_partkey", F.expr(cases("(p_partkey % 12)", LABEL_CASES)).alias("label"))
    known = labels.answers(said, LEXICON).select("label", "match.field", "match.method")
    return said.join(known, "label").select("p_partkey", "field", "method")


UNIT_CASES = ["кв.м", "КУБ. М", "эт", "мес.", "м2", "шт", "М³", ""]
MATERIAL_CASES = ["Отмостка бетонная", "отмостка асфальтобетонная шириной 1 м", "Кровля", "из бетона и асфальта", "небетонный", "АСФАЛЬТ", "бетонн", "асфальтобетон"]


@query(f"""
    select p_partkey, {cases('(p_size % 8)', ['m2', 'm3', 'floor', 'month', 'm2', '!null', 'm3', '!null'], 'null')} as unit,
           {cases('(p_size % 8)', ['concrete', 'mixed', '!null', 'asphalt', '!null', 'asphalt', 'concrete', 'mixed'], 'null')} as material,
           {cases('(p_size % 4)', ['m2', 'm3', 'kKZT', 'floor'], 'null')} as of_field, {cases('(p_size % 4)', ['Total area', 'volume_m3', 'room 12', 'Floors'], 'null')} as shown from part""")
def unit_spelling(t: Tables) -> DataFrame:
    """Units by spelling, materials by the longest prefix of a word, units and names of fields."""
    name = F.expr(cases("(p_size % 4)", ["total_area_m2", "local_qty.volume_m3", "room.12._ktg", "floors"]))
    material = material_in(F.expr(cases("(p_size % 8)", MATERIAL_CASES)), [("concrete", "бетон"), ("asphalt", "асфальт"), ("mixed", "асфальтобетон")])
    return t.part.select("p_partkey", unit_of(F.expr(cases("(p_size % 8)", UNIT_CASES)), UNITS).alias("unit"), material.alias("material"), unit_of_field(name).alias("of_field"), field_for_display(name, {"total_area_m2": "Total area", "floors": "Floors"}).alias("shown"))


@query("""
    with v as (select o_custkey as p, 'b' || (o_orderkey % 3) as object, o_orderpriority as field, o_totalprice as value from orders where o_orderkey % 4 > 0
               union all select o_custkey, 'project', o_orderpriority, -o_totalprice from orders where o_orderkey % 4 = 0),
    one as (select p, object, field, max(value) as value from v group by 1, 2, 3),
    b as (select distinct o_custkey as p, case when o_custkey % 5 > 0 then 'b' || (o_custkey % 3) end as object from orders),
    own as (select p, field, value from one join b using (p, object)),
    spare as (select one.p, field, value from one join b on b.p = one.p where one.object = 'project' and (b.object is null or field in ('1-URGENT', '2-HIGH')))
    select p as package_id, field, value from own union all select p, field, value from spare where (p, field) not in (select p, field from own)""")
def comparable_values(t: Tables) -> DataFrame:
    """A building's values, with the project's for project fields that it lacks."""
    whole = F.col("o_orderkey") % 4 == 0
    v = t.orders.select(F.col("o_custkey").alias("package_id"), F.when(whole, "project").otherwise(F.concat(F.lit("b"), F.col("o_orderkey") % 3)).alias("object"), F.col("o_orderpriority").alias("field"), F.when(whole, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("value"))
    v = v.groupBy("package_id", "object", "field").agg(F.max("value").alias("value"))
    b = t.orders.select(F.col("o_custkey").alias("package_id")).distinct().withColumn("object", F.when(F.col("package_id") % 5 > 0, F.concat(F.lit("b"), F.col("package_id") % 3)))
    return texts.comparable_values(v, b, ["1-URGENT", "2-HIGH"])


@query(f"""
    with d as (select {DOC} as doc_id, {ROW} as row_no, p_name, p_brand from part),
    w as (select doc_id, string_agg(case when row_no % 2 = 0 then p_name || ' ' || p_brand else p_brand end, ' | ' order by row_no, p_name) as page from d group by 1)
    select d.doc_id, row_no, p_name, case when contains(page, p_name || ' ' || p_brand) then p_name || ' ' || p_brand when contains(page, p_brand) then p_brand end as quote from d join w using (doc_id)""")
def row_quotes(t: Tables) -> DataFrame:
    """A row's cells as the page says them, else its cell."""
    rows = t.part.select(F.expr(DOC).alias("doc_id"), F.expr(ROW).alias("row_no"), "p_name", "p_brand")
    said = F.when(F.col("row_no") % 2 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_brand"))
    pages = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "p_name", said.alias("s")))), lambda x: x["s"]), " | ").alias("page"))
    return rows.join(pages, "doc_id").select("doc_id", "row_no", "p_name", tables.row_quote(F.array("p_name", "p_brand"), F.col("page"), F.col("p_brand")).alias("quote"))


# ---- scanned lines whose exponents were misread: each row of lineitem is a line with a planted misreading

SCAN_LABEL = cases("(l_partkey % 5)", ["Общая площадь", "Объём здания", "Расход", "жалпы ауданы", "Бетон класса B25"])
SCAN_TAIL = cases("(l_suppkey % 3)", ["", ", площадь участка", ", кладка"])
SCAN_GLYPH = cases("(l_linenumber % 7)", ["2", "3", "з", "?", "*", "", "²"])
SCAN_NUMBER = "replace(cast(cast(l_extendedprice as decimal(12,2)) as string), '.', ',')"
#: What the line is about: its label's unit, else its tail's, else an exponent that was drawn.
SCAN_TRUE = "case l_partkey % 5 when 2 then case l_suppkey % 3 when 0 then case l_orderkey % 2 when 0 then '²' else '³' end when 1 then '²' else '³' end when 1 then '³' when 4 then '³' else '²' end"
REPAIRED = f"""
    with l as (select l_orderkey, l_linenumber, {SCAN_LABEL} as label, {SCAN_TAIL} as tail, {SCAN_GLYPH} as glyph, {SCAN_NUMBER} as number, {SCAN_TRUE} as truth, l_partkey % 5 = 2 and l_suppkey % 3 = 0 as silent from lineitem),
    h as (select *, case when not silent then truth end as context, case when glyph in ('2', '²') then '²' when glyph in ('3', 'з') then '³' end as hint from l),
    r as (select *, case when glyph = '' then case when context is not null then 'context' end when context is not null then case when hint <> context then 'context_overrides_ocr' else 'context' end when hint is not null then 'ocr_hint' else 'unresolved' end as reason from h),
    m as (select *, case when reason is null or reason = 'unresolved' then 'м' || glyph else 'м' || coalesce(context, hint) end as made from r)"""


def scanned_units(t: Tables) -> DataFrame:
    """l_orderkey, l_linenumber, glyph, truth, text (the line as scanned) and r (what the repair makes of it)."""
    from ..functions.text import repaired_units

    parts = {"label": SCAN_LABEL, "tail": SCAN_TAIL, "glyph": SCAN_GLYPH, "number": SCAN_NUMBER, "truth": SCAN_TRUE}
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *[F.expr(x).alias(n) for n, x in parts.items()])
    rows = rows.withColumn("text", F.concat("label", F.lit(" "), "number", F.lit(" м"), "glyph", "tail"))
    return once(rows, {"r": repaired_units("text")})


@query(REPAIRED + " select l_orderkey, l_linenumber, label || ' ' || number || ' ' || made || tail as text, reason from m")
def unit_repair(t: Tables) -> DataFrame:
    """Lines of a scan with their exponents restored, and why."""
    return scanned_units(t).select("l_orderkey", "l_linenumber", "r.text", F.get("r.fixes", F.lit(0))["reason"].alias("reason"))


@query(REPAIRED + """ select glyph, count(*) as n, count(*) filter ('м' || glyph = 'м' || truth) as before, count(*) filter (made = 'м' || truth) as after,
    count(*) filter (reason = 'context_overrides_ocr') as overridden, count(*) filter (reason = 'unresolved') as unresolved from m group by glyph""")
def unit_recovery(t: Tables) -> DataFrame:
    """How many units each misreading leaves right, before and after the repair, and why others weren't."""
    from ..operators.evaluation import unit_recovery as recovered

    rows = scanned_units(t)
    fix = F.get("r.fixes", F.lit(0))
    sign = F.concat(F.lit("м"), "glyph")
    pairs = rows.select("glyph", sign.alias("was"), F.coalesce(fix["made"], sign).alias("made"), F.concat(F.lit("м"), "truth").alias("want"), fix["reason"].alias("reason"))
    why = lambda r: F.count_if(F.col("reason") == r)
    return recovered(pairs, ["glyph"], overridden=why("context_overrides_ocr"), unresolved=why("unresolved"))


# ---- the cascade with its vector stage: every row of embeddings is a label with a vector

VECTOR_CASES = ["Этажность", "Строительная часть", "Прочее", "Застройка"]


@query("""
    with p as (select label, arg_min(embedding, vec_id) as pv from embeddings group by 1), s as (select vec_id, 'f' || p.label as field, list_cosine_similarity(embedding::double[], pv::double[]) as sim from embeddings, p where vec_id % 4 in (1, 3)),
    r as (select vec_id, field, sim, row_number() over (partition by vec_id order by sim desc, field) as n, coalesce(lead(sim) over (partition by vec_id order by sim desc, field), -1) as next from s)
    select vec_id, 'floors' as field, 'exact' as method from embeddings where vec_id % 4 = 0
    union all select vec_id, field, 'embedding' from r where n = 1 and sim >= 0.88 and sim - next >= 0.01""")
def vector_cascade(t: Tables) -> DataFrame:
    """Labels by exact words, by coverage, and what these leave with evidence by the nearest prototype's vector."""
    said = t.embeddings.select("vec_id", F.concat(F.expr(cases("(vec_id % 4)", VECTOR_CASES)), F.lit(" "), "vec_id").alias("label"), F.col("embedding").alias("vector"))
    prototypes = t.embeddings.groupBy(F.concat(F.lit("f"), "label").alias("field")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    found = labels.with_vectors(said.select("label"), LEXICON, said.select("label", "vector"), prototypes)
    return found.where("match is not null").join(said.select("vec_id", "label"), "label").select("vec_id", "match.field", "match.method")


# ---- whole notes: a part is a note of two pages with one or two buildings, sentences and a table

SECOND = "p_partkey % 3 > 0"
NOTE_LINES = [
    (1, 1, "'Корпуса: 3-этажное здание'"),
    (1, 2, "'1 Котельная угольная'"),
    (1, 3, f"concat('Площадь застройки составляет ', {PRICE}, ' м².')"),
    (1, 4, f"case when {SECOND} then '2 Гараж на три машины' else 'Прочее' end"),
    (1, 5, f"concat('Строительный объем равен ', {VOLUME}, ' м3.')"),
    (2, 1, "concat('Общая площадь котельной ', cast(p_size + 7 as string), ' кв.м.')"),
    (2, 2, "'Показатели'"),
]
NOTE_TABLE = [["№ п/п", "Показатель", "Ед. изм.", "Значение"], ["1", "Общая площадь", "м²", "!cast(p_size + 9 as string)"], ["2", "Пл. застройки", "кв.м", "!cast(p_size as string)"]]
NOTES = f"""
    with d as (select p_partkey as doc_id, p_size, cast(cast(p_retailprice as decimal(12,2)) as double) as price, {SECOND} as two, case when {SECOND} then 'obj2' else 'obj1' end as later, case when p_size % 2 = 0 then 'ru' else 'kz' end as lang from part),
    c as (select doc_id, lang, case when two then 'project' else 'obj1' end as object, 'floors' as field, 3.0 as value, 'text' as source, 'exact' as method, case when two then 'project' else 'single' end as how from d
          union all select doc_id, lang, 'obj1', 'building_area_m2', price, 'text', 'exact', 'heading' from d
          union all select doc_id, lang, later, 'construction_volume_m3', p_size + 100, 'text', 'exact', 'heading' from d
          union all select doc_id, lang, 'obj1', 'total_area_m2', p_size + 7, 'text', 'exact', 'mention' from d
          union all select doc_id, lang, later, 'total_area_m2', p_size + 9, 'table_v', 'exact', 'heading' from d
          union all select doc_id, lang, later, 'building_area_m2', p_size, 'table_v', 'fuzzy', 'heading' from d)"""
CHOSEN = "row_number() over (partition by {keys}doc_id, object, field order by case source when 'text' then 1 else 0 end, case method when 'exact' then 0 else 1 end) as n"
RUNS = {"exact": ("exact",), "exact+anchor": ("exact", "anchor"), "exact+anchor+fuzzy": ("exact", "anchor", "fuzzy")}


def note_candidates(t: Tables) -> DataFrame:
    from ..operators import notes

    doc = F.col("p_partkey").alias("doc_id")
    said = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(n).alias("line_no"), F.expr(x).alias("text"), F.lit(10.0 * n).alias("top"), F.lit(False).alias("in_table")) for p, n, x in NOTE_LINES])
    part = spread(t.part, "p_partkey")  # a row of few bytes becomes a whole note
    lines = part.select(doc, F.explode(said).alias("x")).select("doc_id", "x.*")
    grid_ = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), (F.expr(x[1:]) if x.startswith("!") else F.lit(x)).alias("text")) for r, row in enumerate(NOTE_TABLE) for c, x in enumerate(row)])
    cells = part.select(doc, F.lit(1).alias("table_no"), F.lit(2).alias("page"), F.explode(grid_).alias("x")).select("doc_id", "table_no", "page", "x.*")
    boxes = t.part.select(doc, F.lit(1).alias("table_no"), F.lit(2).alias("page"), F.lit(25.0).alias("top"))
    return kept(notes.candidates(kept(lines), kept(cells), boxes, FULL, r"(?iu)котельн|гараж"))


@query(NOTES + f", r as (select *, {CHOSEN.format(keys='')} from c) select doc_id, object, field, value, source, method, how from r where n = 1")
def note_slots(t: Tables) -> DataFrame:
    """Chosen values of every object of whole notes, each with its reason."""
    from ..operators import notes

    return notes.slots(note_candidates(t)).select("doc_id", "object", "field", "value", "source", "method", "how")


@query(NOTES + f""", runs(run, fuzzy, reads) as (values ('exact', false, false), ('exact+anchor', false, true), ('exact+anchor+fuzzy', true, true)),
    x as (select run, c.*, {CHOSEN.format(keys='run, ')} from c, runs where (fuzzy or method = 'exact') and (reads or source <> 'text')),
    got as (select run, doc_id, object, field, value from x where n = 1),
    gold as (select run, doc_id, lang, object, field, case when field = 'floors' and doc_id % 4 = 0 then value + 1 else value end as value from (select *, {CHOSEN.format(keys='')} from c), runs where n = 1),
    k as (select coalesce(g.run, s.run) as run, coalesce(g.doc_id, s.doc_id) as doc_id, cast(coalesce(abs(g.value - s.value) <= 1e-6, false) as bigint) as hit, g.value as gv, s.value as sv from gold g full join got s on g.run = s.run and g.doc_id = s.doc_id and g.object = s.object and g.field = s.field),
    n as (select run, lang, cast(sum(hit) as bigint) as tp, cast(sum(case when sv is not null then 1 - hit else 0 end) as bigint) as fp, cast(sum(case when gv is not null then 1 - hit else 0 end) as bigint) as fn from k join (select doc_id, lang from d) using (doc_id) group by grouping sets ((run), (run, lang)))
    select run, lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 5) as p, round(tp / nullif(tp + fn, 0), 5) as r, round(2 * tp / nullif(2 * tp + fp + fn, 0), 5) as f1 from n""")
def stage_experiment(t: Tables) -> DataFrame:
    """Stage prefixes by language, scored from one reading of all notes; a quarter of the gold's floors is another."""
    from ..operators import notes

    found = note_candidates(t)
    lang = t.part.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, "ru").otherwise("kz").alias("lang"))
    gold = notes.slots(found).join(shuffled(lang), "doc_id").withColumn("value", F.when((F.col("field") == "floors") & (F.col("doc_id") % 4 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return notes.experiment(found, gold, RUNS, ["lang"])


@query("""
    with l as (select p_partkey as doc_id, unnest([struct_pack(page := 1, no := 1, text := p_name), struct_pack(page := 1, no := 2, text := p_brand)]) as x from part)
    select doc_id, x.page as page, 'line' as kind, x.no as no, x.text as text from l
    union all select p_partkey, 1, 'table 7', 0, p_type || ' | ' || p_size || ' | ' from part""")
def page_dump(t: Tables) -> DataFrame:
    """Lines and rows of tables as one looks at them."""
    from ..operators import notes

    doc, page = F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page")
    lines = t.part.select(doc, page, F.posexplode(F.array("p_name", "p_brand")).alias("no", "text")).select("doc_id", "page", (F.col("no") + 1).alias("line_no"), "text")
    cells = t.part.select(doc, page, F.lit(7).alias("table_no"), F.lit(0).alias("row_no"), F.posexplode(F.array(F.col("p_type"), F.col("p_size").cast("string"), F.lit(None).cast("string"))).alias("col_no", "text"))
    return notes.dump(lines, cells)
