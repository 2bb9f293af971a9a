"""Checks and ordered operators on small pages, with a twin that finds nothing; row order must not matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions.scalars import TOTAL
from tallymark.operators import checks, labels, ordered, patterns, scoring


def shuffled(rows, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


def test_table_total(spark):
    rows = [("d", 1, 2, 700.0, False), ("d", 2, 2, 95.5, False), ("d", 3, 2, 790.0, True), ("d", 4, 2, None, False), ("d", 5, 2, 1.0, False), ("d", 6, 2, 1.04, True), ("d", 7, 2, 9.0, True)]
    cells = spark.createDataFrame(shuffled(rows), "t string, row_no int, col_no int, value double, is_total boolean")
    got = checks.table_totals(cells, ["t"]).collect()
    assert [(r["row_no"], r["rows_sum"], r["total"]) for r in got] == [(3, 795.5, 790.0)]


def test_heading_context(spark):
    lines = [(1, 1, "A"), (2, None, None), (3, 2, None), (4, None, None), (5, 1, None), (6, None, None), (7, 2, "B"), (8, 3, None), (9, 2, None), (10, None, None)]
    df = spark.createDataFrame(shuffled(lines), "n int, level int, object string").withColumn("doc", F.lit(1)).repartition(3)
    got = {r["n"]: r["ctx"] for r in ordered.heading_context(df, ["doc"], ["n"]).collect()}
    assert got == {1: "A", 2: "A", 3: "A", 4: "A", 5: None, 6: None, 7: "B", 8: "B", 9: None, 10: None}


def test_first_disagreement(spark):
    rows = [("o", 1, 3600.0, 1), ("o", 2, 3605.0, 2), ("o", 3, 4100.0, 1), ("o", 4, 4100.0, 3), ("p", 1, 5.0, 1), ("p", 2, 9.0, 1)]
    df = spark.createDataFrame(shuffled(rows), "object string, seq int, v double, page int")
    got = checks.first_disagreement(df, ["object"], "seq", "v", ["page"], 0.005, 0.1).collect()
    assert [(r["object"], r["base_value"], r["other_order"], r["other_value"]) for r in got] == [("o", 3600.0, 4, 4100.0)]


def test_site_and_building(spark):
    site = spark.createDataFrame([("s", "8")], "site string, v string")
    building = spark.createDataFrame([("s", "A", "9"), ("s", "B", "8")], "site string, b string, v string")
    assert [tuple(r) for r in checks.site_vs_building(site, building, "site", "b", "v").collect()] == [("building", "A", "9")]


def test_parameters(spark):
    own = spark.createDataFrame([("A", "asphalt", 1500.0), ("B", "concrete", 1000.0)], "o string, m string, w double")
    general = spark.createDataFrame([("concrete", 1000.0)], "m string, w double")
    assert [r["o"] for r in checks.parameter_contradiction(own, general, "o", "m", "w").collect()] == ["A"]


def test_volume_by_storeys(spark):
    """A: explained by a clear height; B: 400 / (100 x 2) = 2 m a storey; C: the table's 600, not the text's 100; D: no floors."""
    volumes = spark.createDataFrame([("A", 1, 260.0, True), ("B", 1, 900.0, True), ("B", 2, 400.0, True), ("C", 1, 600.0, True), ("C", 2, 100.0, False), ("D", 1, 1.0, True)], "o string, volume_seq int, volume double, from_table boolean")
    areas = spark.createDataFrame([("A", 1, 100.0), ("B", 1, 100.0), ("B", 2, 90.0), ("C", 1, 100.0), ("D", 1, 100.0)], "o string, area_seq int, area double")
    heights = spark.createDataFrame([("A", 1, 2.6)], "o string, height_seq int, height double")
    floors = spark.createDataFrame([("A", 1), ("B", 2), ("C", 2), ("D", 0)], "o string, floors int")
    found = checks.volume_method(volumes, areas, heights, "o")
    assert [r["o"] for r in found.collect()] == ["A"]
    got = checks.volume_ratio(volumes, areas, floors, "o", found).collect()
    assert [tuple(r) for r in got] == [("B", 2, 1, 400.0, 100.0, 2)]


def test_geometry_and_volume(spark):
    axes = spark.createDataFrame([("A", 1, 24.0, 18.0)], "o string, axes_seq int, a double, b double")
    areas = spark.createDataFrame([("A", 1, 410.0), ("A", 2, 431.5)], "o string, area_seq int, area double")
    assert checks.smaller_than_axes(axes, areas, "o").first()["area"] == 410.0
    assert checks.smaller_than_axes(axes, areas.where("area > 430"), "o").count() == 0
    one = lambda name, v: spark.createDataFrame([("A", 1, v)], f"o string, {name}_seq int, {name} double")
    assert checks.volume_method(one("volume", 518.7), one("area", 199.5), one("height", 2.6), "o").count() == 1
    assert checks.volume_method(one("volume", 760.0), one("area", 199.5), one("height", 2.6), "o").count() == 0


def test_geometry_and_volume_against_all_pairs(spark):
    """A third of the rows has one key; limits are met exactly, values repeat, some are zero, negative or missing."""
    rng = random.Random(6)
    key = lambda: "hot" if rng.random() < 1 / 3 else f"k{rng.randrange(12)}"
    rel, absolute = 0.005, 0.1
    axes = [(key(), i, rng.choice([4.0, 8.5, 12.0, 24.0, 0.0, -3.0]), rng.choice([6.0, 0.5, 18.0, 30.25])) for i in range(300)] + [("k1", 900, None, 2.0)]
    areas = []
    for i in range(300):
        k, size = key(), rng.choice(axes[:300])
        size = size[2] * size[3]
        areas.append((k, i, rng.choice([size, size - 0.1, size * 0.995, round(size - rng.random(), 2), size - 0.11, 0.0, -1.0])))
    areas.append(("hot", 901, None))
    odd = lambda a, b: a < b and not abs(a - b) <= max(absolute, rel * max(abs(a), abs(b)))
    want = {}
    for k, seq, x, y in axes:
        hits = [(s, v) for q, s, v in areas if q == k and v is not None and x is not None and odd(v, round(x * y, 2))]
        if hits:
            want[k, seq] = min(hits)
    got = checks.smaller_than_axes(spark.createDataFrame(axes, "o string, axes_seq int, a double, b double"), spark.createDataFrame(areas, "o string, area_seq int, area double").repartition(4), "o")
    assert {(r["o"], r["axes_seq"]): (r["area_seq"], r["area"]) for r in got.collect()} == want and len(want) > 100

    flat = [(key(), i, rng.choice([100.0, 199.5, 60.0, 0.0, -5.0, 33.3])) for i in range(200)]
    tall = [(key(), i, rng.choice([2.5, 2.6, 3.0, 0.0, -2.0])) for i in range(60)]
    volumes = [(key(), i, rng.choice([100.0, 199.5, 60.0, 33.3]) * rng.choice([2.5, 2.6, 3.0]) * rng.choice([1, 1.005, 0.995, 1.0049, 1.02, 0])) for i in range(200)] + [("hot", 999, None)]
    want = {}
    for k, seq, v in volumes:
        hits = [(s, n) for q, s, a in flat if q == k for p, n, h in tall if p == k and v is not None and abs(a * h - v) <= rel * v]
        if hits:
            want[k, seq] = min(hits)
    made = lambda rows, n: spark.createDataFrame(rows, f"o string, {n}_seq int, {n} double").repartition(3)
    got = checks.volume_method(made(volumes, "volume"), made(flat, "area"), made(tall, "height"), "o", rel).collect()
    assert {(r["o"], r["volume_seq"]): (r["area_seq"], r["height_seq"]) for r in got} == want
    assert len(got) == len(want) > 60


def test_range_and_copied_labels(spark):
    values = spark.createDataFrame([("d", 489.79), ("d", 315.0)], "d string, v double")
    relief = spark.createDataFrame([("d", 314.75), ("d", 315.04)], "d string, v double")
    assert [r["v"] for r in checks.outside_range(values, relief, "d", "v", 3.0).collect()] == [489.79]
    names = spark.createDataFrame([("x", "A", 1), ("x", "B", 2), ("y", "B", 3)], "label string, owner string, seq int")
    assert [(r["label"], r["owner"], r["owned_by"]) for r in checks.copied_label(names, "label", "owner", "seq").collect()] == [("x", "B", "A")]


def test_broken_check_stops_no_other(spark):
    found, warnings = checks.run_checks({"bad": lambda: 1 / 0, "good": lambda: spark.range(2)})
    assert found.count() == 2 and "ZeroDivisionError" in warnings["bad"]


def test_what_is_no_fault_of_a_check_is_raised(spark):
    def lost():
        raise OSError("no space left on device")

    with pytest.raises(OSError):
        checks.run_checks({"lost": lost, "good": lambda: spark.range(2)})
    with pytest.raises(ZeroDivisionError):
        checks.run_checks({"bad": lambda: 1 / 0, "worse": lambda: 1 / 0})


def test_many_patterns_in_many_texts(spark, monkeypatch):
    """20,000 labels in chunks, equal to contains; occurrences that overlap count once."""
    monkeypatch.setattr(patterns, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(patterns, "FLUSH_ROWS", 50)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("абвгде") for _ in range(rng.randrange(1, 7)))
    known = [word() + word() for _ in range(20_000)] + ["", None, "aa", "aa"]
    texts = ["".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "aaaaa", "aaaaa"]
    got = patterns.occurrences(spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3), spark.createDataFrame([(k,) for k in known], "p string"), "t", "p", ["i"])
    want = {(i, k, t.count(k)) for i, t in enumerate(texts) if t for k in {k for k in known if k} if k in t}
    assert sorted(map(tuple, got.collect())) == sorted(want) and (62, "aa", 2) in want
    assert patterns.occurrences(got.select(F.col("p").alias("t")), got.select("p").limit(0), "t", "p", ["t"]).count() == 0
    lexicon = spark.createDataFrame([("b", "Общая площадь"), ("a", "площадь"), ("c", "общая площадь")] + [(f"f{i}", k) for i, k in enumerate(known[:9000])], "field string, known string")
    said = spark.createDataFrame([("Общая площадь, м2",), ("ПЛОЩАДЬ",), ("zzz",), (None,)], "label string")
    assert {tuple(r) for r in labels.exact(said, lexicon).collect()} == {("Общая площадь, м2", "b"), ("ПЛОЩАДЬ", "a")}


def test_nearest_fields_in_blocks(spark, monkeypatch):
    """Blocks of prototypes give what all at once give: a plain loop over all of them."""
    rng = np.random.default_rng(4)
    protos = [(f"f{i % 40}" if i % 9 else None, rng.normal(size=8).tolist()) for i in range(300)] + [("odd", [1.0, 2.0]), ("zero", [0.0] * 8), ("none", None)]
    asked = [(i, rng.normal(size=8).tolist()) for i in range(50)] + [(90, [2.0, 4.0]), (91, None), (92, [0.0] * 8)]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {}
    for i, v in asked:
        if v is None or not any(v):
            continue
        best = {}
        for f, p in protos:
            if p is not None and len(p) == len(v) and any(p):
                best[f] = max(best.get(f, -2), cos(v, p))
        fields = sorted((-s, f) for f, s in best.items() if f is not None)[:2]
        want[i] = {(f, round(-s, 9)) for s, f in fields} | ({(None, round(best[None], 9))} if None in best else set())
    known = spark.createDataFrame(protos, "field string, vector array<double>")
    said = spark.createDataFrame(asked, "i int, vector array<double>").repartition(3)
    for size in (1 << 20, 3000):
        monkeypatch.setattr(labels, "PROTOTYPE_BYTES", size)
        got = {}
        for r in labels.nearest_fields(said, known, "i").collect():
            got.setdefault(r["i"], set()).add((r["field"], round(r["sim"], 9)))
        assert got == want
    assert labels.nearest_fields(said, known.limit(0), "i").count() == 0


def test_a_check_that_fails_while_it_runs_stops_no_other(spark):
    bad = spark.range(3).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    found, warnings = checks.run_checks({"bad": lambda: bad, "good": lambda: spark.range(2)})
    assert found.count() == 2 and "broken" in warnings["bad"]
    names = spark.createDataFrame([("x", "A", 1), ("x", "B", 2)], "label string, owner string, seq int")
    found, warnings = checks.run_registered({"copied_label": {"labels": names, "label": "label", "owner": "owner", "order": "seq"}, "volume_method": {"volumes": names}})
    assert found["copied_label"].count() == 1 and list(warnings) == ["volume_method"]


def test_parameters_of_their_own_package(spark):
    own = spark.createDataFrame([("p", "A", "asphalt", 1500.0), ("q", "B", "asphalt", 1500.0)], "k string, o string, m string, w double")
    general = spark.createDataFrame([("p", "concrete", 1000.0)], "k string, m string, w double")
    assert [r["o"] for r in checks.parameter_contradiction(own, general, "o", "m", "w", package="k").collect()] == ["A"]


def test_total_rows_are_whole_words(spark):
    rows = [("Итого", True), ("Итоговая ведомость", False), (" ЖИЫНТЫҒЫ: 5", True), ("Всего по смете", True), ("Барлығы", True), ("Тотал", False)]
    table = spark.createDataFrame(rows, "t string, want boolean")
    assert table.where(F.col("t").rlike(TOTAL) != F.col("want")).count() == 0


def test_numbers_over_wide_ranges(spark):
    rows = spark.range(500).selectExpr("id * id as v", "id % 3 as g")
    got = ordered.numbered(rows, F.col("g"), "v", width=4).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1, 501)) and [(r["g"], r["v"]) for r in got] == sorted((r["g"], r["v"]) for r in got)


def test_continuation_tables(spark):
    tables = spark.createDataFrame([("d", 1, "h"), ("d", 2, "h"), ("d", 3, "h"), ("d", 4, "k")], "doc_id string, table_no int, header string")
    between = spark.createDataFrame([("d", 3, 2)], "doc_id string, table_no int, n_lines int")
    assert {r["table_no"]: r["merged_no"] for r in ordered.continuation_tables(tables, between).collect()} == {1: 1, 2: 1, 3: 2, 4: 3}


def test_labels(spark):
    known = spark.createDataFrame([("area", "общая площадь"), ("built", "площадь застройки"), ("volume", "строительный объём")], "field string, known string")
    said = spark.createDataFrame([("Общая площадь здания",), ("Строительного объема",), ("Площадь участка",)], "label string")
    got = {r["label"]: (r["field"], r["method"]) for r in labels.cascade(said, known).collect()}
    assert got == {"Общая площадь здания": ("area", "exact"), "Строительного объема": ("volume", "fuzzy")}


def hot_rows(n=3000, seed=4):
    """Rows of which a third have one key, some have none, in no order; headings of levels 1 to 3, objects on some."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 1 / 3 else rng.choice([None, *[f"k{j}" for j in range(40)]])
        level = rng.choice([None, None, None, 1, 2, 3])
        rows.append((key, rng.randrange(n // 4), i, level, f"o{i}" if level and rng.random() < 0.3 else None, rng.choice(["a", "a", "b", None])))
    return rows


def scanned(rows):
    """What the scans must add, by a plain loop: context, carried value, island, number, label."""
    out, by = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        s = by.setdefault(r[0], {"seen": None, "ctx": None, "value": None, "island": 0, "n": 0, "last": (), "label": None})
        _, _, i, level, obj, kind = r
        if obj:
            s["ctx"] = obj
        elif level and s["seen"] is not None and level <= s["seen"]:
            s["ctx"] = None
        s["value"] = None if kind is None else obj or s["value"]
        s["island"] += s["last"] != (kind,)
        s["n"] += kind == "a"
        out[i] = (s["ctx"], s["value"], s["island"], s["n"] if kind == "a" else None, kind if kind is not None else s["label"])
        s["seen"], s["last"], s["label"] = level if obj else s["seen"], (kind,), kind
    return out


def test_scans_of_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, t int, i int, level int, object string, kind string").repartition(5)
    keys, order, shuffle = ["k"], ["t", "i"], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in ordered.in_ranges(df, keys, order).groupBy("_range").count().collect())
        assert len(sizes) >= 12 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        made = [
            ordered.heading_context(df, keys, order), ordered.carried_forward(df, keys, order, F.col("object"), F.col("kind").isNull(), "x"), ordered.islands(df, keys, order, ["kind"]),
            ordered.running_number(df, keys, order, F.col("kind") == "a", "x"), ordered.label_above(df, keys, order, "kind", "x"),
        ]
        got = [{r["i"]: r[c] for r in m.collect()} for m, c in zip(made, ["ctx", "x", "island", "x", "x"], strict=True)]
        want = scanned(rows)
        assert all(len(g) == len(rows) for g in got) and {i: tuple(g[i] for g in got) for i in want} == want
        timed = df.withColumn("ts", F.timestamp_seconds(F.col("t")))
        counts = {r["i"]: r["n"] for r in ordered.rolling_count(timed, keys, "ts", 60, "n").collect()}
        assert counts == {r[2]: sum(q[0] == r[0] and r[1] - 60 <= q[1] <= r[1] for q in rows) for r in rows}
        assert all(m.count() == 0 for m in (ordered.islands(df.limit(0), keys, order, ["kind"]), ordered.heading_context(df.limit(0), keys, order)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scores(spark):
    want = spark.createDataFrame([("ru", 1, "a"), ("ru", 1, "b")], "lang string, s int, t string")
    got = spark.createDataFrame([("ru", 1, "b"), ("kz", 2, "c")], "lang string, s int, t string")
    counts = scoring.slot_counts(want, got, ["lang", "s", "t"])
    by = {r["lang"]: r for r in scoring.prf_by(counts, [["lang"], []], ["lang"]).collect()}
    assert (by["ru"]["p"], by["ru"]["r"], by["kz"]["r"], by["kz"]["f1"]) == (1.0, 0.5, None, 0.0) and by[None]["tp"] == 1


def test_bootstrap_interval(spark):
    """Repeatable on any partitioning, no point, around F1, and near what drawing n of n sets gives."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(4, 12), rng.randrange(0, 9), rng.randrange(0, 5)) for i in range(60)]
    counts = spark.createDataFrame(rows, "set_no long, tp long, fp long, fn long")
    low, high = scoring.bootstrap_f1(counts).first()
    assert (low, high) == tuple(scoring.bootstrap_f1(counts.repartition(3)).first()) == tuple(scoring.bootstrap_f1(counts.orderBy(F.desc("tp")).coalesce(1)).first())
    score = lambda some: 2 * sum(r[1] for r in some) / sum(2 * r[1] + r[2] + r[3] for r in some)
    assert low < score(rows) < high
    drawn = sorted(score(rng.choices(rows, k=len(rows))) for _ in range(4000))
    assert abs(low - drawn[100]) < 0.01 and abs(high - drawn[3899]) < 0.01


def test_bootstrap_of_groups(spark):
    """Each group as if alone; nothing found gives 0, nothing expected or said gives nulls, no sets give no row."""
    rows = [("a", i, 5, i % 3, 1) for i in range(40)] + [("b", i, 0, 0, 1) for i in range(10)] + [("c", 1, 0, 0, 0)] + [(f"g{k}", k, 1, 1, 0) for k in range(90)]
    counts = spark.createDataFrame(rows, "lang string, set_no long, tp long, fp long, fn long").repartition(2)
    got = {r["lang"]: (r["low"], r["high"]) for r in scoring.bootstrap_f1(counts, by=["lang"], iterations=200).collect()}
    assert got["a"] == tuple(scoring.bootstrap_f1(counts.where("lang = 'a'"), iterations=200).first()) and got["a"][0] < got["a"][1]
    assert got["b"] == (0.0, 0.0) and got["c"] == (None, None) and len(got) == 93
    assert scoring.bootstrap_f1(counts.limit(0), by=["lang"]).count() == 0


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([("d", "p1", "g1", 3), ("d", "p1", "g2", 5), ("d", "p2", "g2", 4), ("d", "p2", "g1", 1)], "d string, p string, g string, score int")
    got = scoring.greedy_one_to_one(pairs, ["d"], "p", "g", "score").collect()
    assert sorted((r["p"], r["g"]) for r in got) == [("p1", "g2"), ("p2", "g1")]


def test_greedy_matching_of_rows_alike(spark, monkeypatch):
    """Of rows alike in sides and score, both ways keep the same one."""
    rng = random.Random(2)
    rows = [("d", rng.randrange(9), rng.randrange(9), rng.randrange(4), f"note {i}") for i in range(300)]
    pairs = spark.createDataFrame(rows, "d string, p int, g int, score int, note string")
    whole = sorted(map(tuple, scoring.greedy_one_to_one(pairs.repartition(3), ["d"], "p", "g", "score").collect()))
    monkeypatch.setattr(scoring, "GROUP_PAIRS", 10)
    assert sorted(map(tuple, scoring.greedy_one_to_one(pairs, ["d"], "p", "g", "score").collect())) == whole and len(whole) == 9


def test_greedy_matching_of_a_large_group(spark, monkeypatch):
    """A group above the bound goes by rounds and gives the same choice; no task gets more pairs than the bound."""
    rng = random.Random(9)
    rows = [("big", rng.randrange(60), rng.randrange(60), rng.randrange(30)) for _ in range(600)] + [("small", rng.randrange(5), rng.randrange(5), rng.randrange(9)) for _ in range(12)]
    pairs = spark.createDataFrame(rows, "d string, p int, g int, score int")
    whole = sorted(map(tuple, scoring.greedy_one_to_one(pairs, ["d"], "p", "g", "score").collect()))
    monkeypatch.setattr(scoring, "GROUP_PAIRS", 40)
    inner, seen = scoring.kept, []
    monkeypatch.setattr(scoring, "kept", lambda df: seen.append(df) or inner(df))
    got = sorted(map(tuple, scoring.greedy_one_to_one(pairs, ["d"], "p", "g", "score").collect()))
    assert got == whole and len(seen) > 4
    used, want = set(), []
    for d, p, g, score in sorted(set(rows), key=lambda r: (r[0], -r[3], -r[1], -r[2])):
        if not {(d, "p", p), (d, "g", g)} & used:
            used |= {(d, "p", p), (d, "g", g)}
            want.append((d, p, g, score))
    assert got == sorted(want)
