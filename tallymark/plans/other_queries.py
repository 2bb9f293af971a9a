"""Ordered operators, windows, text, labels and scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import labels, ordered, patterns, scoring
from ..session import kept
from ..streaming import windows
from .registry import Tables, query

E_ORDER = "order by ts, event_id"


@query(f"""select event_id, nullif(last_value(case when event_type = 'error' then '' when event_type = 'signup' then cast(event_id as varchar) end ignore nulls) over (partition by user_id {E_ORDER} rows between unbounded preceding and current row), '') as ctx from events""")
def context_locf(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string"))
    return ordered.carried_forward(t.events, ["user_id"], ["ts", "event_id"], value, F.col("event_type") == "error", "ctx").select("event_id", "ctx")


LEVEL = "case event_type when 'signup' then 1 + user_id % 2 when 'purchase' then 1 when 'error' then 2 when 'click' then 3 end"


@query(f"""
    with l as (select event_id, user_id, ts, {LEVEL} as level, case when event_type = 'signup' then 'o' || event_id end as object from events),
    s as (select *, last_value(case when object is not null then level end ignore nulls) over (partition by user_id {E_ORDER} rows between unbounded preceding and 1 preceding) as seen from l),
    m as (select *, case when object is not null then object when level is not null and level <= seen then '' end as marker from s)
    select event_id, nullif(last_value(marker ignore nulls) over (partition by user_id {E_ORDER} rows between unbounded preceding and current row), '') as ctx from m""")
def heading_context(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", F.expr(LEVEL).alias("level"), F.when(F.col("event_type") == "signup", F.concat(F.lit("o"), F.col("event_id"))).alias("object"))
    return ordered.heading_context(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "ctx")


@query(f"""
    with b as (select event_id, user_id, ts, case when event_type is not distinct from lag(event_type) over (partition by user_id {E_ORDER}) and row_number() over (partition by user_id {E_ORDER}) > 1 then 0 else 1 end as b from events)
    select event_id, cast(sum(b) over (partition by user_id {E_ORDER} rows between unbounded preceding and current row) as bigint) as island from b""")
def continuation_islands(t: Tables) -> DataFrame:
    return ordered.islands(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "island")


L_ORDER = "order by l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""select l_orderkey, l_linenumber, l_partkey, case when l_returnflag <> 'R' then cast(sum(case when l_returnflag <> 'R' then 1 else 0 end) over (partition by l_orderkey {L_ORDER} rows between unbounded preceding and current row) as bigint) end as number from lineitem""")
def row_number_skip(t: Tables) -> DataFrame:
    return ordered.running_number(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag") != "R", "number").select("l_orderkey", "l_linenumber", "l_partkey", "number")


@query(f"""select event_id, coalesce(case when event_type <> 'view' then event_type end, lag(case when event_type <> 'view' then event_type end) over (partition by user_id {E_ORDER})) as label from events""")
def label_above(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("own"))
    return ordered.label_above(rows, ["user_id"], ["ts", "event_id"], "own", "label").select("event_id", "label")


@query("""
    select event_id, n from (select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n from events) where n > 5""")
def rate_limit(t: Tables) -> DataFrame:
    return ordered.rolling_count(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 86400, "n").where("n > 5").select("event_id", "n")


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1""")
def latest_review(t: Tables) -> DataFrame:
    return ordered.latest_per(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


#: Events as wishes for a status; the fold over a user's events runs in a grouped map.
WISH = {"view": "receiving", "signup": "uploaded", "click": "pending", "purchase": "done", "error": "error"}


MAY_FOLLOW = " or ".join(f"(s = '{a}' and w = '{b}')" for a, following in windows.TRANSITIONS.items() for b in sorted(following)) + " or (s = '' and w = 'receiving')"


@query(f"""
    with recursive e as (select cast(user_id as varchar) as check_id, ts, {' '.join(['case event_type', *[f"when '{k}' then '{v}'" for k, v in WISH.items()], 'end'])} as w from events),
    k as (select *, row_number() over (partition by check_id order by ts nulls last, w nulls last) as k from e),
    r as (select distinct check_id, 0 as k, '' as s, 0::bigint as taken, 0::bigint as refused from k
          union all select check_id, k, case when ok then w else s end, taken + ok::bigint, refused + (not ok)::bigint from (select k.check_id, k.k, k.w, r.s, r.taken, r.refused, coalesce({MAY_FOLLOW.replace("(s =", "(r.s =").replace("w =", "k.w =")}, false) as ok from r join k on k.check_id = r.check_id and k.k = r.k + 1))
    select check_id, s as status, taken, refused from (select *, row_number() over (partition by check_id order by k desc) as last from r) where last = 1""")
def lifecycle_state(t: Tables) -> DataFrame:
    wish = F.create_map(*[F.lit(x) for kv in WISH.items() for x in kv])
    events = t.events.select(F.col("user_id").cast("string").alias("check_id"), "ts", F.element_at(wish, F.col("event_type")).alias("wanted"))
    return windows.lifecycle(events)


NOW = "2024-02-01 00:00:00"


@query(f"""
    with c as (select user_id, max(ts) as changed_at from events group by 1)
    select user_id, case when user_id % 2 = 0 and epoch(timestamp '{NOW}') - epoch(date_trunc('second', changed_at)) > 330 then 'error' when user_id % 2 = 0 then 'pending' else 'done' end as status from c""")
def stale(t: Tables) -> DataFrame:
    checks = t.events.groupBy("user_id").agg(F.max("ts").alias("changed_at")).withColumn("status", F.when(F.col("user_id") % 2 == 0, "pending").otherwise("done"))
    return windows.stale(checks, NOW).select("user_id", "status")


@query(f"""select user_id, count(*) as n from events where ts + interval 7 day <= timestamp '{NOW}' group by 1""")
def retention(t: Tables) -> DataFrame:
    return windows.expired(t.events.withColumnRenamed("ts", "created_at"), NOW).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""select event_id, strftime(ts + interval 7 day, '%Y-%m-%d %H:%M') as expires_at from events""")
def expires(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format(F.col("ts") + F.make_interval(days=F.lit(7)), "yyyy-MM-dd HH:mm").alias("expires_at"))


@query("""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1, 2""")
def tumbling(t: Tables) -> DataFrame:
    e = t.events.withColumn("value", F.col("value").cast("decimal(18,4)"))
    w = windows.tumbling(e, "ts", "1 hour", ["event_type"])
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("""
    select strftime(date_trunc('hour', ts) - to_hours(cast(k as bigint)), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events, range(2) r(k) group by 1, 2""")
def sliding(t: Tables) -> DataFrame:
    return windows.sliding(t.events, "ts", "2 hours", "1 hour", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query(f"""
    with b as (select user_id, ts, event_id, case when ts >= lag(ts) over (partition by user_id {E_ORDER}) + interval 2 hour or lag(ts) over (partition by user_id {E_ORDER}) is null then 1 else 0 end as b from events),
    s as (select *, sum(b) over (partition by user_id {E_ORDER} rows between unbounded preceding and current row) as k from b)
    select user_id, cast(epoch_us(min(ts)) as bigint) as start_us, count(*) as n from s group by user_id, k""")
def session(t: Tables) -> DataFrame:
    return windows.sessions(t.events, "ts", "2 hours", ["user_id"]).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query("""
    with r as (select user_id, count(*) as reviews from events where event_type = 'purchase' group by 1), n as (select event_id, user_id, ts from events order by ts desc, event_id desc limit 200)
    select event_id, n.user_id, coalesce(reviews, 0) as reviews from n left join r using (user_id)""")
def list_latest(t: Tables) -> DataFrame:
    reviews = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("reviews"))
    newest = t.events.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return newest.join(reviews, "user_id", "left").select("event_id", "user_id", F.coalesce("reviews", F.lit(0)).alias("reviews"))


#: Function words of our own choice.
VOTES = {"de": ["der", "die", "das", "und", "ist", "nicht", "den", "zu"], "en": ["the", "and", "of", "to", "is", "that", "in", "it"], "es": ["el", "los", "que", "y", "por", "una", "las", "con"], "fr": ["le", "la", "les", "et", "des", "une", "est", "dans"]}
_vote = lambda k: f"len(list_filter(w, lambda x: x in ({', '.join(repr(v) for v in VOTES[k])})))"
DETECTED = f"""
    with w as (select doc_id, lang, string_split_regex(lower(text), '[^\\p{{L}}]+') as w from documents), v as (select doc_id, lang, {', '.join(f'{_vote(k)} as {k}' for k in VOTES)} from w),
    b as (select *, greatest(de, en, es, fr) as m from v),
    detected as (select doc_id, lang, case when m >= 5 and cast(de = m as int) + cast(en = m as int) + cast(es = m as int) + cast(fr = m as int) = 1 then case when de = m then 'de' when en = m then 'en' when es = m then 'es' else 'fr' end end as found from b)"""


def detected(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", S.language_by_votes("text", VOTES).alias("found"))


@query(DETECTED + " select doc_id, lang, found from detected")
def language_vote(t: Tables) -> DataFrame:
    return detected(t)


@query(DETECTED + f" select lang, {', '.join(f'''count(*) filter (found = '{k}') as {k}''' for k in VOTES)}, count(*) filter (found is null) as unknown from detected group by lang")
def language_confusion(t: Tables) -> DataFrame:
    return detected(t).groupBy("lang").agg(*[F.count_if(F.col("found") == k).alias(k) for k in VOTES], F.count_if(F.col("found").isNull()).alias("unknown"))


OWN_LETTERS = {"de": "äöüß", "es": "ñáíóú", "fr": "éèêàçœ"}
_share = lambda k: f"length(regexp_replace(letters, '[^{OWN_LETTERS[k]}]', '', 'g')) / nullif(length(letters), 0)"


@query(DETECTED + f""", t as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', '', 'g') as letters, found from documents join detected using (doc_id)),
    s as (select *, {', '.join(f'coalesce({_share(k)}, 0) as {k}' for k in OWN_LETTERS)} from t), m as (select *, greatest({', '.join(OWN_LETTERS)}) as m from s)
    select doc_id, case when m >= 0.05 then {' '.join(f"case when {k} = m then '{k}' else" for k in OWN_LETTERS)} null {'end ' * len(OWN_LETTERS)} else 'en' end as by_letters, found as by_votes from m""")
def language_letters(t: Tables) -> DataFrame:
    """The language of a text by the letters that only it has, where no words vote, and by its words."""
    no_votes = {k: ["\u0000"] for k in VOTES}
    return t.documents.select("doc_id", S.language_of("text", no_votes, OWN_LETTERS, 0.05, "en").alias("by_letters"), S.language_by_votes("text", VOTES).alias("by_votes"))


@query("""select p_partkey, regexp_replace(lower(translate(p_name, 'ёЁ', 'еЕ')), '[^\\p{L}\\p{N}]+', '', 'g') as squashed from part""")
def squash_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.squash("p_name").alias("squashed"))


@query("""select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) as digest from documents""")
def norm_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(S.norm_ws("text")).alias("digest"))


@query("""
    with p as (select o_orderkey, cast(o_totalprice as decimal(18,2)) as value, o_orderkey % 6 as style from orders),
    t as (select *, case when style = 4 then replace(cast(value as varchar), '.', ',') when style = 5 then cast(value as varchar)
                 else replace(replace(replace(format('{:,.2f}', cast(value as double)), ',', '_'), '.', ','), '_', chr(case style when 0 then 32 when 1 then 160 when 2 then 8239 else 8201 end)) end as text from p)
    select o_orderkey, text, cast(value as double) as value, 'всего ' || text || ' м' || chr(178) as line, cast(1 as bigint) as n, cast(value as double) as found from t""")
def number_roundtrip(t: Tables) -> DataFrame:
    """Numbers in six styles, four of them grouped by a plain, no-break, narrow or thin space, read alone and in a line."""
    styles = ["space_comma", "nbsp_comma", "narrow_comma", "thin_comma", "plain_comma", "plain_dot"]
    value = F.col("o_totalprice").cast("decimal(18,2)")
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, S.format_number(value, 2, style)) for i, style in enumerate(styles)])
    rows = t.orders.select("o_orderkey", text.alias("text")).withColumn("line", F.concat(F.lit("всего "), "text", F.lit(" м\u00b2")))
    rows = S.once(rows, {"found": S.find_numbers("line")})
    return rows.select("o_orderkey", "text", F.round(S.parse_number("text"), 2).alias("value"), "line", F.size("found").cast("long").alias("n"), F.round(F.get("found", F.lit(0))["value"], 2).alias("found"))


@query("""
    select p_partkey, case p_size % 3 when 0 then 'm2' when 1 then 'm3' end as unit, p_retailprice * case p_size % 2 when 0 then 1000.0 else 0.001 end as thousands from part""")
def unit_cost_scale(t: Tables) -> DataFrame:
    unit = F.when(F.col("p_size") % 3 == 0, "кв. м").when(F.col("p_size") % 3 == 1, "М³").otherwise("шт.")
    money = F.when(F.col("p_size") % 2 == 0, "млн тенге").otherwise("Тенге")
    return t.part.select("p_partkey", S.normalize_unit(unit).alias("unit"), (F.col("p_retailprice") * S.cost_scale(money)).alias("thousands"))


LEXICON = [("metal", "brass"), ("metal", "steel"), ("metal", "copper"), ("coat", "polished"), ("coat", "anodized"), ("coat", "plated"), ("grade", "economy"), ("grade", "standard"), ("grade", "promo")]
_LEX = ", ".join(f"('{f}', '{k}')" for f, k in LEXICON)


def lexicon(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(LEXICON, "field string, known string")


@query(f"""
    with x(field, known) as (values {_LEX}), p as (select distinct p_type as label from part),
    h as (select label, field, row_number() over (partition by label order by length(known) desc, field) as n from p join x on contains(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), known))
    select label, field from h where n = 1""")
def label_exact(t: Tables) -> DataFrame:
    return labels.exact(t.part.select(F.col("p_type").alias("label")), lexicon(t))


@query("""select * from (values ('Общей площади здания', 'area', 1.0), ('Пл. застр.', 'built', 1.0), ('Этажей', 'floors', 1.0), ('Строительного объёма', 'volume', 1.0)) x(label, field, share)""")
def label_fuzzy(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("area", "общая площадь"), ("built", "площадь застройки"), ("volume", "строительный объем"), ("floors", "этажность")], "field string, known string")
    said = t.part.select(F.element_at(F.array(*map(F.lit, ["Общей площади здания", "Пл. застр.", "Этажей", "Строительного объёма", "прочее"])), (F.col("p_partkey") % 5 + 1).cast("int")).alias("label"))
    return labels.fuzzy(said, known)


@query("""
    with p as (select label as field, arg_min(embedding, vec_id) as pv from embeddings group by 1), s as (select vec_id, field, round(list_cosine_similarity(embedding::double[], pv::double[]), 4) as sim from embeddings, p),
    r as (select vec_id, field, sim, row_number() over (partition by vec_id order by sim desc, field) as n, coalesce(lead(sim) over (partition by vec_id order by sim desc, field), 0) as next from s)
    select vec_id, field, sim from r where n = 1 and sim - next >= 0.01""")
def label_embedding(t: Tables) -> DataFrame:
    """The label whose prototype a vector is nearest to, ahead of the next: blocks of vectors times blocks of prototypes."""
    prototypes = t.embeddings.groupBy(F.col("label").cast("string").alias("field")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    near = labels.nearest_fields(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), prototypes, "vec_id")
    two = near.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("sim", 4)).alias("s"), "field"))).alias("x"))
    top, second = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    kind = t.embeddings.schema["label"].dataType
    return two.where(second["s"] - top["s"] >= 0.01).select("vec_id", top["field"].cast(kind).alias("field"), (-top["s"]).alias("sim"))


QUOTED = "case p_partkey % 5 when 0 then p_brand when 1 then 'nowhere ' || p_partkey when 2 then p_name else p_type end"


@query(f"""
    with p as (select p_partkey, cast(floor(p_partkey / 4) as bigint) as doc_id, cast(p_partkey % 4 + 1 as int) as page, p_name || ' ' || p_brand || ' and ' || p_brand as text, {QUOTED} as quote from part),
    r as (select *, case when p_partkey % 5 = 3 then cast(page % 4 + 1 as int) else page end as of_page, case p_partkey % 5 when 0 then case when p_partkey % 2 = 0 then 2 else 1 end end as occurrences from p),
    n as (select r.*, (length(q.text) - length(replace(q.text, r.quote, ''))) // length(r.quote) as n from r left join p q on q.doc_id = r.doc_id and q.page = r.of_page),
    e as (select r.p_partkey, list(q.page order by q.page) as pages from r join p q on q.doc_id = r.doc_id and contains(q.text, r.quote) group by 1)
    select p_partkey as ref_id, case when coalesce(n, 0) = 0 then case when pages is null then 'not found' else 'found on pages [' || array_to_string(pages, ', ') || ']' end when occurrences is not null and n <> occurrences then 'count ' || n || ' != ' || occurrences end as problem
    from n left join e using (p_partkey) where coalesce(n, 0) = 0 or n <> occurrences""")
def quote_problems(t: Tables) -> DataFrame:
    """Quotes that their page doesn't have, with the pages that do, and quotes that it has another number of times."""
    from ..operators import evaluation

    doc, page = F.floor(F.col("p_partkey") / 4).alias("doc_id"), (F.col("p_partkey") % 4 + 1).cast("int").alias("page")
    pages = t.part.select(doc, page, F.concat("p_name", F.lit(" "), "p_brand", F.lit(" and "), "p_brand").alias("text"))
    key = F.col("p_partkey")
    said = t.part.select(key.alias("ref_id"), doc, page, F.expr(QUOTED).alias("quote"), F.when(key % 5 == 0, F.when(key % 2 == 0, 2).otherwise(1)).alias("occurrences"))
    said = said.withColumn("page", F.when(F.col("ref_id") % 5 == 3, (F.col("page") % 4 + 1)).otherwise(F.col("page")).cast("int"))
    return evaluation.quote_problems(said, pages).select("ref_id", "problem")


@query("""
    with w as (select distinct unnest(string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^\\p{L}\\p{N}]+')) as w from part)
    select a.w as left_word, b.w as right_word from w a join w b on a.w < b.w and levenshtein(a.w, b.w) <= 1 where length(a.w) >= 2 and length(b.w) >= 2""")
def one_edit_pairs(t: Tables) -> DataFrame:
    """By deletion: words within one edit share themselves or a form with one letter less, so equal keys meet."""
    words = t.part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), r"[^\p{L}\p{N}]+")).alias("w")).distinct()
    forms = F.array_union(F.array("w"), F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w")))))
    keyed = words.where(F.length("w") >= 2).select("w", F.explode(forms).alias("k"))
    other = keyed.select(F.col("w").alias("right_word"), "k")
    return keyed.select(F.col("w").alias("left_word"), "k").join(other, "k").where(F.col("left_word") < F.col("right_word")).select("left_word", "right_word").distinct().where(S.one_edit(F.col("left_word"), F.col("right_word")))


@query("""
    select doc_id, item_id, cast((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) as bigint) as n from documents d join benchmark b on contains(d.text, b.text)""")
def quote_check(t: Tables) -> DataFrame:
    """Every text that a quote stands in, and how often: all quotes in one pass over the texts."""
    found = patterns.occurrences(t.documents, t.benchmark, "text", "text", ["doc_id"])
    quotes = t.benchmark.select("item_id", F.col("text").alias("quote")).where("length(quote) > 0")
    return found.join(quotes, found["text"] == quotes["quote"]).select("doc_id", "item_id", "n")


@query("""select doc_id, cast(len(string_split(text, '. ')) as bigint) as n, cast(length(string_split(text, '. ')[1]) as bigint) as first_length from documents""")
def sentence_split(t: Tables) -> DataFrame:
    s = F.split("text", r"\. ")
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n"), F.length(F.get(s, F.lit(0))).cast("long").alias("first_length"))


SIGNS = [("list", "<li>"), ("heading", "<h1"), ("paragraph", "<p>")]


@query(f"""
    select page_id, coalesce(case when least({', '.join(f"case when instr(html, '{p}') = 0 then 1000000000 else instr(html, '{p}') end" for _, p in SIGNS)}) = 1000000000 then null {' '.join(f"when least({', '.join(f'''case when instr(html, '{q}') = 0 then 1000000000 else instr(html, '{q}') end''' for _, q in SIGNS)}) = instr(html, '{p}') then '{n}'" for n, p in SIGNS)} end, case when contains(url, 'https') then 'secure' else 'unknown' end) as section from pages""")
def section_classify(t: Tables) -> DataFrame:
    """The sign that comes first, else the address, else unknown."""
    places = F.array(*[F.struct(F.nullif(F.instr("html", p), F.lit(0)).alias("at"), F.lit(n).alias("name")) for n, p in SIGNS])
    first = F.array_min(F.filter(places, lambda x: x["at"].isNotNull()))["name"]
    return t.pages.select("page_id", F.coalesce(first, F.when(F.contains("url", F.lit("https")), "secure").otherwise("unknown")).alias("section"))


@query("""select page_id, nullif(trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), '') as title from pages""")
def title_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.nullif(F.trim(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")).alias("title"))


@query("""
    with b as (select page_id, regexp_extract_all(html, '(?s)<(?:p|li)(?: [^>]*)?>(.*?)</(?:p|li)>', 1) as b from pages)
    select page_id, i - 1 as item_no, length(b[i]) as n_chars from b, unnest(range(1, len(b) + 1)) as r(i)""")
def layout_blocks(t: Tables) -> DataFrame:
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)<(?:p|li)(?: [^>]*)?>(.*?)</(?:p|li)>"), F.lit(1))
    return t.pages.select("page_id", F.posexplode(blocks).alias("item_no", "block")).select("page_id", F.col("item_no").cast("long").alias("item_no"), F.length("block").cast("long").alias("n_chars"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""select conv_id, turn, regexp_replace(case when turn % 3 = 0 then coalesce(nullif(role, 'system'), '') else 'local_qty.' || role end, '^local_qty\\.', '') as slot from conversations""")
def null_field_slot(t: Tables) -> DataFrame:
    field = F.when(F.col("turn") % 3 == 0, F.coalesce(F.nullif("role", F.lit("system")), F.lit(""))).otherwise(F.concat(F.lit("local_qty."), "role"))
    return t.conversations.select("conv_id", "turn", F.regexp_replace(field, r"^local_qty\.", "").alias("slot"))


HEURISTIC = "case when n_chars >= 400 then 1 else 0 end"


@query(f"select doc_id, coalesce(quality, {HEURISTIC}) as quality, quality is not null as overridden from documents left join labels using (doc_id)")
def override_coalesce(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.expr(HEURISTIC)).alias("quality"), F.col("quality").isNotNull().alias("overridden"))


SLOTS = f"""
    with d as (select doc_id, lang, source, quality, {HEURISTIC} as said from documents join labels using (doc_id)),
    s as (select lang, source, doc_id, cast(quality = 1 and said = 1 as bigint) as tp, cast(quality <> 1 and said = 1 as bigint) as fp, cast(quality = 1 and said <> 1 as bigint) as fn from d where quality = 1 or said = 1)"""


def slots(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "quality", F.expr(HEURISTIC).alias("said"))
    keys = ["lang", "source", "doc_id"]
    return scoring.slot_counts(d.where("quality = 1").select(keys), d.where("said = 1").select(keys), keys)


@query(SLOTS + " select lang, source, doc_id, tp, fp, fn from s")
def slot_scores(t: Tables) -> DataFrame:
    return slots(t)


@query(SLOTS + """, g as (select lang, source, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from s group by grouping sets ((lang), (lang, source), ()))
    select lang, source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 5) as p, round(tp / nullif(tp + fn, 0), 5) as r, round(2 * tp / nullif(2 * tp + fp + fn, 0), 5) as f1 from g""")
def prf_grouping_sets(t: Tables) -> DataFrame:
    return scoring.prf_by(slots(t), [["lang"], ["lang", "source"], []], ["lang", "source"])


@query("""
    with g as (select l_partkey, l_returnflag, sum(cast(l_quantity as bigint)) as v from lineitem where l_linestatus = 'F' group by 1, 2), s as (select l_partkey, l_returnflag, sum(cast(l_quantity as bigint)) as v from lineitem where l_linestatus = 'O' group by 1, 2)
    select l_partkey, l_returnflag, cast(coalesce(g.v = s.v, false) as bigint) as tp, cast(s.v is not null and not coalesce(g.v = s.v, false) as bigint) as fp, cast(g.v is not null and not coalesce(g.v = s.v, false) as bigint) as fn from g full join s using (l_partkey, l_returnflag)""")
def value_scores(t: Tables) -> DataFrame:
    side = lambda x: t.lineitem.where(F.col("l_linestatus") == x).groupBy("l_partkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))
    return scoring.value_counts(side("F"), side("O"), ["l_partkey", "l_returnflag"], "v")


@query("""
    with a as (select l_partkey, l_quantity, count(*) as n from lineitem where l_linestatus = 'F' group by 1, 2), b as (select l_partkey, l_quantity, count(*) as n from lineitem where l_linestatus = 'O' group by 1, 2)
    select l_partkey, cast(sum(least(a.n, b.n)) as bigint) as matched from a join b using (l_partkey, l_quantity) group by 1""")
def multiset_match(t: Tables) -> DataFrame:
    side = lambda x: t.lineitem.where(F.col("l_linestatus") == x).select("l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return scoring.multiset_matches(side("F"), side("O"), ["l_partkey", "l_quantity"], "seq").groupBy("l_partkey").agg(F.count("*").alias("matched"))


@query("""
    select 'both' as part, count(*) as n from (select o_orderkey from orders intersect select l_orderkey from lineitem) union all select 'only orders', count(*) from (select o_orderkey from orders except select l_orderkey from lineitem)
    union all select 'only lines', count(*) from (select l_orderkey from lineitem except select o_orderkey from orders)""")
def set_ops(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only orders")).unionByName(count(b.subtract(a), "only lines"))


@query("""select o_custkey, o_orderpriority as type from orders where o_orderstatus = 'F' union select o_custkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')""")
def hybrid_union(t: Tables) -> DataFrame:
    slot = t.orders.select("o_custkey", F.col("o_orderpriority").alias("type"), "o_orderstatus")
    return slot.where("o_orderstatus = 'F'").drop("o_orderstatus").unionByName(slot.where(F.col("type").isin("1-URGENT", "2-HIGH")).drop("o_orderstatus")).distinct()


@query("""select o_orderpriority as level, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1""")
def ceiling_pivot(t: Tables) -> DataFrame:
    pivoted = t.orders.groupBy(F.col("o_orderpriority").alias("level")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return pivoted.select("level", *[F.coalesce(k, F.lit(0)).cast("long").alias(k.lower()) for k in "FOP"])


@query("""with c as (select distinct user_id, event_type as cause from events where event_type in ('error', 'click') and user_id % 3 <> 0), u as (select distinct user_id from events) select coalesce(cause, 'unlabeled') as cause, count(*) as n from u left join c using (user_id) group by 1""")
def miss_causes(t: Tables) -> DataFrame:
    causes = t.events.where("event_type in ('error', 'click') and user_id % 3 <> 0").select("user_id", F.col("event_type").alias("cause")).distinct()
    return t.events.select("user_id").distinct().join(causes, "user_id", "left").groupBy(F.coalesce("cause", F.lit("unlabeled")).alias("cause")).agg(F.count("*").alias("n"))


@query("""select event_type, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as sd from events group by 1""")
def mean_sd(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"))


def sql_resamples(sets: str, slices: str, iterations: int = 1000) -> str:
    """Common tables w (slices, set, iteration, weight) and o (slices, sorted F1s) over a table of sets with a key of 32 bits."""
    mul, mask = "ubigint", 4294967296
    return f"""
    h0 as (select *, (key::ubigint * {scoring.MIX_KEY} + k::ubigint * {scoring.MIX_ITERATION}) % {mask} as h from {sets}, range({iterations}) it(k)),
    h1 as (select * replace (xor(h, h >> 16) * {scoring.MIX_1}::{mul} % {mask} as h) from h0),
    h2 as (select * replace (xor(h, h >> 13) * {scoring.MIX_2}::{mul} % {mask} as h) from h1),
    w as (select *, {' + '.join(f"(xor(h, h >> 16) >= {t})::int" for t in scoring.POISSON)} as weight from h2),
    f as (select {slices}, k, 2 * sum(weight * tp) / nullif(2 * sum(weight * tp) + sum(weight * fp) + sum(weight * fn), 0) as f1 from w group by all),
    o as (select {slices}, list(f1 order by f1) as s from f where f1 is not null group by {slices})"""


def sql_percentile(q: float) -> str:
    return f"s[cast(floor({q} * (len(s) - 1)) as int) + 1]"


#: A set's number in both dialects: 32 bits of a digest of its name.
SET_KEY = "('0x' || substr(md5(source), 1, 8))::bigint"


@query(SLOTS + f""", b as (select 1 as every, source, {SET_KEY} as key, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from s group by source), {sql_resamples('b', 'every')}
    select round({sql_percentile(0.025)}, 6) as low, round({sql_percentile(0.975)}, 6) as high, (select 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) from b) between {sql_percentile(0.025)} and {sql_percentile(0.975)} as brackets from o""")
def bootstrap_ci(t: Tables) -> DataFrame:
    """The interval of F1 over resampled sources, and whether F1 of all sources lies in it."""
    sets = slots(t).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    interval = scoring.bootstrap_f1(sets.withColumn("key", set_key("source")), "key")
    whole = sets.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(scoring.f1().alias("f1"))
    return interval.join(F.broadcast(whole), F.lit(True)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.col("f1").between(F.col("low"), F.col("high")).alias("brackets"))  # a row each


def set_key(name: str) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


@query(SLOTS + f""", e as (select source, unnest([lang, null]) as lang, tp, fp, fn from s),
    b as (select lang, source, {SET_KEY} as key, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from e group by 1, 2), {sql_resamples('b', 'lang')},
    g as (select lang, count(*) as sets, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from b group by 1)
    select g.lang, sets, tp, fp, fn, round(tp / nullif(tp + fp, 0), 5) as p, round(tp / nullif(tp + fn, 0), 5) as r, round(2 * tp / nullif(2 * tp + fp + fn, 0), 5) as f1,
           round({sql_percentile(0.025)}, 6) as low, round({sql_percentile(0.975)}, 6) as high, round(fp / sets, 5) as fp_per_set from g left join o on o.lang is not distinct from g.lang""")
def scoreboard(t: Tables) -> DataFrame:
    """Scores of each language and of all, with intervals over sources and false positives a source."""
    board = scoring.scoreboard(slots(t), "source", set_key("source"), ["lang"], [["lang"], []])
    return board.select("lang", "sets", "tp", "fp", "fn", *[F.round(c, n).alias(c) for c, n in (("p", 5), ("r", 5), ("f1", 5), ("low", 6), ("high", 6), ("fp_per_set", 5))])


@query("""select user_id, event_type, count(*) as n from events group by 1, 2 order by n desc, user_id, event_type limit 20""")
def top_errors(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id", "event_type").limit(20)


@query("""select * from (select p_type, p_partkey as pred, lead(p_partkey) over (partition by p_type order by p_size, p_partkey) as gold, cast(50 - p_size as bigint) as score from part) where gold is not null""")
def object_assignment(t: Tables) -> DataFrame:
    """Parts of one type in pairs of neighbours in size: the greedy one-to-one choice by score."""
    sized = t.part.select("p_type", F.col("p_partkey").alias("pred"), "p_size", F.lower("p_name").alias("name"))
    w = Window.partitionBy("p_type").orderBy("p_size", "pred")
    pairs = sized.withColumn("gold", F.lead("pred").over(w)).where("gold is not null").withColumn("score", (50 - F.col("p_size")).cast("long")).select("p_type", "pred", "gold", "score")
    return scoring.greedy_one_to_one(pairs, ["p_type"], "pred", "gold", "score")


PRICE = "replace(cast(cast(p_retailprice as decimal(12,2)) as string), '.', ',')"


@query("""select p_partkey as doc_id, case p_partkey % 4 when 0 then 'table' when 1 then 'text' else 'none' end as kind from part""")
def extractability(t: Tables) -> DataFrame:
    """Where a page says its value: in a cell, in a sentence among other numbers, or nowhere; cells and sentences are read."""
    from ..operators.wordings import cell_number
    from .package import extractable

    doc = F.col("p_partkey").alias("doc_id")
    gold = t.part.select(doc, F.lit("price").alias("field"), F.col("p_retailprice").cast("decimal(12,2)").cast("double").alias("value"))
    cells = t.part.select(doc, F.explode(F.array(F.lit("Цена"), F.expr(f"case when p_partkey % 4 = 0 then {PRICE} else 'нет' end"))).alias("x")).select("doc_id", cell_number(F.col("x")).alias("value")).where("value is not null")
    text = F.expr(f"concat('Этажей 3, цена ', case when p_partkey % 4 < 2 then {PRICE} else '0,07' end, ' тенге за 5 м2')")
    texts = t.part.select(doc, F.explode(S.find_numbers(text)).alias("n")).select("doc_id", "n.value")
    return extractable(gold, cells, texts).select("doc_id", F.col("where").alias("kind"))


@query("""
    with f as (select o_custkey as package_id, o_orderkey as file_no, case when o_orderkey % 7 = 0 then '1-URGENT' else o_orderpriority end as section, case when o_orderkey % 7 = 0 then 'user' else 'title' end as how from orders)
    select package_id, file_no, section, how, row_number() over (partition by package_id, section order by file_no) = 1 and section <> 'unknown' as used from f""")
def chosen_files(t: Tables) -> DataFrame:
    from .package import chosen_files as choose

    files = t.orders.select(F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("file_no"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("section"), F.lit("title").alias("how"))
    overrides = files.where("file_no % 7 = 0").select("package_id", "name", F.lit("1-URGENT").alias("section"))
    return choose(files, overrides).select("package_id", "file_no", "section", "how", "used")


@query("""
    with s as (select doc_id, lang from documents), k as (select doc_id % 50 as package_id, lang from s)
    select package_id, case when count(distinct lang) = 1 then min(lang) else 'mixed' end as lang from k group by 1""")
def package_language(t: Tables) -> DataFrame:
    rows = t.documents.select((F.col("doc_id") % 50).alias("package_id"), "lang")
    return rows.groupBy("package_id").agg(F.when(F.count_distinct("lang") == 1, F.min("lang")).otherwise("mixed").alias("lang"))


@query("""select p_partkey, lower(p_brand) as brand, substr(lower(p_brand), 1, greatest(3, least(7, length(p_brand) - 2))) as stem from part""")
def word_stems(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.lower("p_brand").alias("brand"), S.stem("p_brand").alias("stem"))


@query("""select page_id, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) as name, substr(sha1(url), 1, 20) as key from pages""")
def object_keys(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.path_name(F.regexp_replace("url", r"[?#].*$", "")).alias("name"), F.substring(F.sha1("url"), 1, 20).alias("key"))


@query("""
    select user_id, count(*) filter (event_type = 'purchase') as reviewed, count(*) as to_review, round(count(*) filter (event_type = 'purchase') / count(*), 4) as progress from events group by 1""")
def review_progress(t: Tables) -> DataFrame:
    done = F.count_if(F.col("event_type") == "purchase")
    return t.events.groupBy("user_id").agg(done.alias("reviewed"), F.count("*").alias("to_review"), F.round(done / F.count("*"), 4).alias("progress"))


@query("""
    with e as (select user_id % 20 as k, event_type as t from events where event_id % 2 = 0), g as (select user_id % 20 as k, event_type as t from events where event_id % 2 = 1)
    select t as type, count(*) filter (w and h) as tp, count(*) filter (h and not w) as fp, count(*) filter (w and not h) as fn
    from (select coalesce(a.k, b.k) as k, coalesce(a.t, b.t) as t, a.k is not null as w, b.k is not null as h from (select distinct * from e where k % 3 <> 0) a full join (select distinct * from g where k % 5 <> 0) b on a.k = b.k and a.t = b.t) group by 1""")
def by_type(t: Tables) -> DataFrame:
    side = lambda r, m: t.events.where((F.col("event_id") % 2 == r) & (F.col("user_id") % 20 % m != 0)).select((F.col("user_id") % 20).alias("k"), F.col("event_type").alias("type"))
    return scoring.slot_counts(side(0, 3), side(1, 5), ["k", "type"]).groupBy("type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


#: What is wrong in the package that an order stands for.
WRONG = {"area": "o_orderkey % 7 = 0", "material": "o_orderkey % 11 = 0", "cost": "o_orderkey % 5 = 0", "missing": "o_orderkey % 13 = 0"}


@query(f"""
    with v as (select o_orderkey as package_id, {', '.join(f'{w} as {k}' for k, w in WRONG.items())} from orders),
    f as (select package_id, 'AREA_PZ_VS_AR_EXPLICATION' as type, 'total_area_m2' as field, case when area then 'MISMATCH' else 'MATCH' end as verdict from v
          union all select package_id, 'MATERIAL_VOLUME_KR_VS_LOCAL_ESTIMATE', 'qty.' || m, case when material and m = 'concrete' then 'MISMATCH' else 'MATCH' end from v, (values ('concrete'), ('rebar'), ('brick')) x(m)
          union all select package_id, 'COST_OBJECT_ESTIMATE_VS_SUMMARY', 'object_estimate_ktg', case when cost then 'MISMATCH' else 'MATCH' end from v
          union all select package_id, 'MISSING_MANDATORY_TEP', 'cost_ktg', 'MISSING' from v where missing)
    select package_id, type, field, verdict, row_number() over (partition by package_id order by verdict = 'MATCH', type, field) as finding_no from f""")
def fixture_findings(t: Tables) -> DataFrame:
    """Packages made of orders with discrepancies put in: what the checks report of them, in report order."""
    from . import fixtures, package

    area, cost = F.round(F.col("o_totalprice") / 100 + 50, 2), F.col("o_totalprice").cast("double")
    rows = t.orders.select(F.col("o_orderkey").alias("package_id"), area.alias("area"), cost.alias("cost"), *[F.expr(w).alias(f"wrong_{k}") for k, w in WRONG.items()], *[(F.col("o_custkey") % 500 + 20.0 + i).alias(m) for i, m in enumerate(fixtures.MATERIALS)])
    off = lambda name, k: F.when(F.col(f"wrong_{k}"), F.col(name) * 1.03).otherwise(F.col(name)).alias(f"{name}_again")
    rows = rows.select("*", off("area", "area"), off("cost", "cost"), off("concrete", "material"), *[F.col(m).alias(f"{m}_again") for m in fixtures.MATERIALS[1:]])
    said = kept(fixtures.statements(rows))
    every = package.compared_findings(said).unionByName(package.missing_findings(said, fixtures.mandatory(t.spark), said.select("package_id", "section").distinct()))
    return package.report(every).select("package_id", "type", "field", "verdict", "finding_no")
