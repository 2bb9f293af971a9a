import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallymark.operators import comparison, evaluation
from tallymark.plans import fixtures
from tallymark.sources import layout


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_systems_with_nothing_said_or_expected(spark):
    slots = lambda items: spark.createDataFrame(items, "doc string, field string")
    gold = slots([("d1", "area"), ("d1", "floors"), ("d1", "floors")])
    out = comparison.compared(gold, {"a": slots([("d1", "area"), ("d2", "area")]), "b": slots([])}, ["doc", "field"], [["field"], []])
    got = {(r["system"], r["field"]): (r["tp"], r["fp"], r["fn"], r["p"], r["r"]) for r in out.collect()}
    assert got[("a", None)] == (1, 1, 1, 0.5, 0.5)
    assert got[("a", "area")] == (1, 1, 0, 0.5, 1.0)
    assert got[("b", None)] == (0, 0, 2, 0.0, 0.0)


def test_building_before_project(spark):
    values = spark.createDataFrame(
        [(1, "project", "b1", "floors", 9.0), (1, "b1", "b1", "floors", 5.0), (1, "project", "b1", "area", 7.0), (1, "b2", "b1", "area", 1.0), (1, "b1", "b1", "colour", 1.0), (2, "project", None, "area", 3.0), (2, "b1", None, "area", 4.0), (2, "project", None, None, 4.0)],
        "doc long, object string, building string, field string, value double",
    )
    assert rows(comparison.building_values(values, ["doc"], "building", ["floors", "area"])) == [(1, "area", 7.0), (1, "floors", 5.0), (2, "area", 3.0)]
    assert rows(comparison.building_values(values, ["doc"], "building", [])) == []


def test_anchors(spark):
    refs = spark.createDataFrame([(1, "m", "PZ", "area"), (1, None, "PZ", "area"), (2, None, "AR", "floors")], "doc long, mention string, section string, field string")
    anchors = spark.createDataFrame([(1, "PZ.area", 3, 2), (1, "PZ.area", 1, 9), (2, "m", 1, 1)], "doc long, name string, page int, seq int")
    got = {(r["doc"], r["name"]): [tuple(a) for a in r["anchors"]] for r in comparison.with_anchors(refs, anchors, ["doc"]).collect()}
    assert got == {(1, "m"): [], (1, "PZ.area"): [(1, 9), (3, 2)], (2, "AR.floors"): []}
    values = spark.createDataFrame([(1, "PZ.area", 5.0), (1, "x", 1.0), (2, "m", None), (2, "y", None)], "doc long, name string, value double")
    assert rows(comparison.anchor_problems(values, anchors, ["doc"])) == [(1, "x", "not anchored"), (2, "m", "missing but anchored")]


def test_counts_of_annotations(spark):
    said = spark.createDataFrame([(1, "numeric", "high"), (1, "numeric", None)], "doc long, level string, confidence string")
    assert rows(comparison.annotation_counts(said, ["doc"], ["level", "confidence"])) == [(1, "confidence", "high", 1), (1, "confidence", None, 1), (1, "level", "numeric", 2)]


def test_plain_paths(spark):
    cases = {"./a//b/c.pdf": "a/b/c.pdf", "a/../b": "b", "../a": "../a", "../../a": "../../a", "a/b/../../c": "c", "": "", ".": ""}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", layout.plain_path("p").alias("q")).collect()
    assert {r["p"]: r["q"] for r in got} == cases


def test_gold_survives_its_files(spark, tmp_path):
    made = fixtures.packages(spark, 30, inject="all")
    path = str(tmp_path / "gold")
    fixtures.write_gold(made, path)
    back = fixtures.read_gold(spark, path)
    assert rows(back.select("package_id", "type", "field")) == rows(fixtures.gold(made))
    assert {r["lang"] for r in back.select("lang").distinct().collect()} == {"ru", "kz"}


def test_filled_and_broken(spark):
    one = spark.range(1)
    r = one.select(fixtures.filled("{a} и {b}, {a}", {"a": F.lit("II"), "b": F.lit("II")}).alias("m")).first()["m"]
    assert r["text"] == "II и II, II"
    assert [(a["name"], a["value"], a["at"]) for a in r["anchors"]] == [("a", "II", 0), ("b", "II", 5), ("a", "II", 9)]
    broken = lambda text, draw: one.select(fixtures.broken_header(F.lit(text), F.lit(draw))).first()[0]
    assert broken("Этажность", 1) == "Этажнос\nть"
    assert broken("№ п/п м2", 3) == "№ п/п м2"
    assert broken("", 0) == ""


def test_estimate(spark):
    dec = lambda v, t: F.lit(v).cast(t)
    made = fixtures.local_estimate(dec("1000.00", "decimal(18,2)"), dec("8.5", "decimal(4,1)"))
    r = spark.range(1).select(*[v.cast("double").alias(k) for k, v in made.items()]).first()
    assert (r["overhead"], r["profit"], r["total"]) == (85.0, 86.8, 1171.8)


def test_misread_changes_one_place(spark):
    texts = ["Площадь застройки", "юг", "", "ббб", "Общая площадь"]
    drawn = spark.createDataFrame([(t, d) for t in texts for d in range(12)] + [(None, 0)], "t string, d long")
    got = {(r["t"], r["d"]): r["m"] for r in drawn.select("t", "d", fixtures.misread(F.col("t"), F.col("d")).alias("m")).collect()}
    assert got.pop((None, 0)) is None
    for (text, d), said in got.items():
        if d % 3 == 0 and any(ch in "асеорхукі" for ch in text.lower()):
            assert len(said) == len(text) and sum(a != b for a, b in zip(said, text, strict=True)) == 1
        elif d % 3 == 1 and " " in text:
            assert len(said) == len(text) - 1
        else:
            assert said.replace(" ", "") == text.replace(" ", "") and (len(said) == len(text) + any(len(w) >= 6 for w in text.split()))


def test_summary_estimate(spark):
    dec = lambda v: F.lit(v).cast("decimal(18,3)")
    made = fixtures.summary_estimate([dec("100.000"), dec("0.025"), dec("0")])
    r = spark.range(1).select(*[v.cast("double").alias(k) for k, v in made.items()]).first()
    assert r.asDict() == {"subtotal": 100.025, "reserve": 2.001, "with_reserve": 102.026, "tax": 12.243, "total": 114.269}


def test_most_similar_lines_are_those_of_all_pairs(spark, monkeypatch):
    """Every word misread, one page with a third of all lines: no line that brute force finds is lost."""
    monkeypatch.setattr(evaluation, "LINE_BLOCK", 16)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("оаеинтслвркмдпуяыьг") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(1, 8))) + rng.choice(["", " 12,5", " 7 м²"])
    original = [(rng.choice(["hot", *[f"p{k}" for k in range(6)]]) if i > 40 else "hot", i, line()) for i in range(140)] + [("p1", 900, None), ("p1", 901, ""), ("p2", 902, "дубль строки"), ("p2", 903, "дубль строки")]

    def noisy(text):
        words = (text or "").replace("²", "?").split(" ")
        return " ".join(w[:k] + rng.choice("бзхщ") + w[k + 1 :] if w else w for w in words for k in [rng.randrange(max(1, len(w)))])

    scanned = [(p, i, noisy(t)) for p, i, t in original] + [("hot", 950, "qwerty uiop"), ("p9", 951, "нет такой страницы")]
    rows = lambda x: spark.createDataFrame(x, "page string, line_no int, text string")
    bare = lambda x: {(r["page"], r["line_no"]): r["s"] for r in rows(x).select("page", "line_no", evaluation.stripped_units(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    left, right = bare(scanned), bare(original)
    want = {}
    for (page, i), a in left.items():
        rated = sorted((-SequenceMatcher(None, a, b, autojunk=False).ratio(), j) for (q, j), b in right.items() if q == page)
        if rated and -rated[0][0] >= 0.6:
            want[page, i] = (rated[0][1], -rated[0][0])
    got = evaluation.aligned_lines(rows(scanned).repartition(3), rows(original), ["page"]).collect()
    assert {(r["page"], r["line_no"]): (r["other_no"], r["ratio"]) for r in got} == want and len(want) > 90
    assert evaluation.aligned_lines(rows([]), rows(original), ["page"]).count() == 0
