"""From rows of pages to findings, on small documents of our own."""

from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import extract
from tallymark.plans import package
from tallymark.sources import layout


def test_glue_and_headers(spark):
    cells = spark.createDataFrame([("Площадь застрой-\nки, м²",), ("Этаж\nность",), ("Объём\nздания",), (None,), ("Кол\nшт",)], "c string")
    assert [r[0] for r in cells.select(T.glue_wrapped(F.col("c"))).collect()] == ["Площадь застройки, м²", "Этаж ность", "Объём здания", "", "Кол шт"]
    row = spark.createDataFrame([(["Площад", "ь", "Этажи"],)], "h array<string>")
    assert row.select(T.merge_split_header(F.col("h"))).first()[0] == ["Площадь", "Площадь", "Этажи"]


REPAIRS = [
    # what the line's nearest word says, before the sign first
    ("Площадь застройки 120,5 м?", "Площадь застройки 120,5 м²", ["context"]),
    ("Строительный объём 400 мз; площадь кровли — 61,2 м3.", "Строительный объём 400 м³; площадь кровли — 61,2 м².", ["context", "context_overrides_ocr"]),
    ("Бетон фундаментов 714,64 м2", "Бетон фундаментов 714,64 м³", ["context_overrides_ocr"]),
    ("Кладка из кирпича М 178,9", "Кладка из кирпича м³ 178,9", ["context"]),
    ("|3|кірпіш қалау м2 59,4", "|3|кірпіш қалау м³ 59,4", ["context_overrides_ocr"]),
    ("құрылыс көлемі 95,05 м3, ауданы 18,34 м? деп", "құрылыс көлемі 95,05 м³, ауданы 18,34 м² деп", ["context", "context"]),
    ("12 м* подземной части", "12 м³ подземной части", ["context"]),
    ("88 m2 — жалпы аудан", "88 м² — жалпы аудан", ["context"]),
    # a bare sign beside a number: upgraded only with such a word, the number before or after it
    ("Общая площадь м 1247,79", "Общая площадь м² 1247,79", ["context"]),
    ("Объем грунта 15 | м", "Объем грунта 15 | м³", ["context"]),
    ("Площадь стен, м", "Площадь стен, м", []),
    ("Площадь 5 m", "Площадь 5 m", []),
    ("Подвемной части м 83,2", "Подвемной части м 83,2", []),
    ("Этажи по 3,6 м, длина 29,9 м.", "Этажи по 3,6 м, длина 29,9 м.", []),
    # the glyph alone, and what says nothing
    ("Итого 500 м2", "Итого 500 м²", ["ocr_hint"]),
    ("Всего 7 м?", "Всего 7 м?", ["unresolved"]),
    # no signs: other units, marks of concrete, parts of words
    ("плита 900 мм, бетон М200, W/М6, домик", "плита 900 мм, бетон М200, W/М6, домик", []),
    ("бетон, М/6", "бетон, М/6", []),
    ("мм М25 м2а 5м2", "мм М25 м2а 5м²", ["ocr_hint"]),
    ("", "", []),
    ("площадь м2 м 5 м3 м?", "площадь м² м² 5 м² м²", ["context", "context", "context_overrides_ocr", "context"]),
]


def test_unit_repair(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(REPAIRS)], "i int, t string").orderBy("i")
    got = rows.select(T.repaired_units("t").alias("r")).collect()
    assert [(g["r"]["text"], [f["reason"] for f in g["r"]["fixes"]]) for g in got] == [(t, f) for _, t, f in REPAIRS]
    several = spark.createDataFrame([("Итого 4 м2\nкладка м2 9,45\nО 12 м?\n",), (None,)], "t string").select(T.repaired_units("t").alias("r")).collect()
    assert several[0]["r"]["text"] == "Итого 4 м²\nкладка м³ 9,45\nО 12 м?\n" and several[1]["r"] is None
    assert [tuple(f) for f in several[0]["r"]["fixes"]] == [(0, "м2", "м²", "ocr_hint"), (1, "м2", "м³", "context_overrides_ocr"), (2, "м?", "м?", "unresolved")]


ODD_TEXTS = [
    (None, None, None),
    ("\n\n", "\n\n", []),
    ("\nм2\n", "\nм²\n", ["ocr_hint"]),
    ("\tПлощадь 5|\r м\u2028", "\tПлощадь 5|\r м²\u2028", ["context"]),
    ("Объём 5    м", "Объём 5    м", []),
    ("ПЛОЩАДЬ м? КӨЛЕМ м3 аудан", "ПЛОЩАДЬ м² КӨЛЕМ м³ аудан", ["context", "context"]),
    ("м3 объемная площадь м", "м³ объемная площадь м", ["context"]),
    ("м?м 5 бетон", "м?м³ 5 бетон", ["context"]),
    ("площаᲁь 3 м2", "площаᲁь 3 м³", ["context_overrides_ocr"]),  # a letter whose capital is another's
    ("½м2 Ⅷм2 ٣м2 😀м2", "½м2 Ⅷм2 ٣м² 😀м²", ["ocr_hint", "ocr_hint"]),
    ("$0 \\ м2 $1", "$0 \\ м² $1", ["ocr_hint"]),
    ("кладкирпич 4 мЗ m", "кладкирпич 4 м³ m", ["context"]),
]


def test_unit_repair_of_odd_texts(spark):
    """Texts that come twice, have no signs or lines, or hold signs of patterns are repaired as ever."""
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ODD_TEXTS + ODD_TEXTS)], "i int, t string")
    got = [r["r"] for r in rows.select("i", T.repaired_units("t").alias("r")).orderBy("i").collect()]
    assert [(g and g["text"], g and [f["reason"] for f in g["fixes"]]) for g in got] == [(t, why) for _, t, why in ODD_TEXTS + ODD_TEXTS]


def test_units_are_found_without_compiling_a_pattern_for_a_line(spark):
    """F1 of round 5: lines are cut by a plain character, and what a word says is asked of one word a sign."""
    plan = spark.createDataFrame([("x",)], "t string").select(T.repaired_units("t").alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(") == 1 and "split(lambda" not in plan
    assert plan.count("lower(") == 1


def test_vectorised_and_table_functions(spark):
    T.register(spark)
    rows = spark.createDataFrame([("площадь 10 м*", "abcd", "abxd")], "t string, a string, b string")
    got = rows.select(T.repaired_units("t").alias("r"), T.similarity("a", "b").alias("s")).first()
    assert got["r"]["text"] == "площадь 10 м²" and got["s"] == 0.75
    rows.createOrReplaceTempView("tm_rows")
    found = spark.sql("select f.start, f.text from tm_rows, lateral tm_finditer(t, '[0-9]+') f").collect()
    assert [tuple(r) for r in found] == [(8, "10")]


LINES = [("d", 1, 1, "1 Котельная угольная", False), ("d", 1, 2, "Площадь застройки составляет 518,70 м².", False), ("d", 1, 3, "1.1 Стены", False), ("d", 2, 1, "2 Гараж на три машины", False), ("d", 2, 2, "3 Наружные сети", False), ("d", 2, 3, "1 Котельная угольная", True)]


def test_objects_and_context(spark):
    lines = spark.createDataFrame(LINES, "doc_id string, page int, line_no int, text string, in_table boolean")
    objects = extract.discover_objects(lines, r"(?iu)котельн|гараж")
    assert sorted((r["object_id"], r["name"]) for r in objects.collect()) == [("obj1", "Котельная угольная"), ("obj2", "Гараж на три машины")]
    texts = spark.createDataFrame([("d", "объём котельной"), ("d", "гараж и котельная"), ("d", "сети")], "doc_id string, t string")
    assert [r["mentioned"] for r in extract.mentioned(texts, objects, "t").collect()] == ["obj1", None, None]


def test_sentences_give_statements(spark):
    pages = spark.createDataFrame([("d", 1, "Площадь застройки здания составляет 518,70 м². Объём 4 330,23 м³ здания.\nИ 1200 м² площади застройки без цены")], "doc_id string, page int, text string")
    got = extract.sentence_statements(pages, {"building_area_m2": [r"площад\p{L}*\s+застройки"]}, {"building_area_m2": "m2"}).collect()
    assert sorted(r["value"] for r in got) == [518.7, 1200.0]


def test_tables_give_statements(spark):
    rows = [["№", "Наименование", "Площадь застройки, м²", "Строительный объём, м³", "Этажность, м²"], ["1", "Котельная", "518,70", "4 330,23", "2"], ["2", "Гараж", "-", "100", "1"], ["", "Итого", "518,70", "4 430,23", ""]]
    cells = spark.createDataFrame([("d", 1, 1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], layout.CELL)
    lexicon = spark.createDataFrame([("building_area_m2", "площадь застройки"), ("volume_m3", "строительный объём"), ("floors", "этажность")], "field string, known string")
    got = extract.table_statements(cells, lexicon, {"building_area_m2": "m2", "volume_m3": "m3", "floors": "none"}).collect()
    assert sorted((r["row_label"], r["field"], r["value"]) for r in got) == [("Гараж", "volume_m3", 100.0), ("Котельная", "building_area_m2", 518.7), ("Котельная", "volume_m3", 4330.23)]


def test_sections(spark):
    lines = spark.createDataFrame([("a", 1, 1, "Лист"), ("a", 1, 2, "Пояснительная записка"), ("a", 2, 1, "Архитектурные решения"), ("01-КР.pdf", 1, 1, "x"), ("z", 1, 1, "y")], "doc_id string, page int, line_no int, text string")
    got = {r["doc_id"]: (r["section"], r["how"]) for r in extract.classify_section(lines, [("PZ", "(?iu)пояснительная записка"), ("AR", "(?iu)архитектурные решения")], [("KR", r"-КР\b")]).collect()}
    assert got == {"a": ("PZ", "title"), "01-КР.pdf": ("KR", "code"), "z": ("unknown", "none")}


def test_package(spark):
    s = [("p", "PZ", "total_area_m2", 1000.0, "table", 2), ("p", "PZ", "total_area_m2", 5.0, "text", 1), ("p", "AR", "room.1", 600.0, "table", 1), ("p", "AR", "room.2", 300.0, "table", 2), ("p", "KR", "qty.concrete", 50.0, "table", 1), ("p", "SMETA", "local_qty.concrete", 50.2, "ocr", 1), ("p", "SMETA", "object_estimate_ktg", 10.0, "table", 1), ("p", "SMETA", "summary_line.1", 10.0, "table", 2), ("q", "SMETA", "object_estimate_ktg", 10.0, "table", 1), ("q", "SMETA", "summary_line.1", 11.0, "table", 2), ("q", "SMETA", "summary_line.2", 10.0, "table", 3)]
    statements = spark.createDataFrame(s, "package_id string, section string, field string, value double, source string, seq int")
    found = package.compared_findings(statements)
    assert sorted((r["package_id"], r["type"][:4], r["verdict"], r["low_confidence"]) for r in found.collect()) == [("p", "AREA", "MISMATCH", False), ("p", "COST", "MATCH", False), ("p", "MATE", "MATCH", True)]
    mandatory = spark.createDataFrame([("PZ", "cost_ktg", "SMETA", "object_estimate_ktg"), ("AR", "floors", "PZ", "floors")], "section string, field string, shown_by string, shown_field string")
    uploaded = statements.select("package_id", "section").distinct()
    missing = package.missing_findings(statements, mandatory, uploaded)
    assert [(r["package_id"], r["field"]) for r in missing.collect()] == [("p", "cost_ktg")]
    reported = package.report(found.unionByName(missing)).orderBy("finding_no").collect()
    assert [r["verdict"] for r in reported] == ["MISMATCH", "MISSING", "MATCH", "MATCH"] and reported[0]["level"] == "numeric"
    files = package.chosen_files(spark.createDataFrame([("p", 1, "a", "PZ", "title"), ("p", 2, "b", "PZ", "title"), ("p", 3, "c", "unknown", "none")], "package_id string, file_no int, name string, section string, how string"), spark.createDataFrame([("p", "c", "AR")], "package_id string, name string, section string"))
    assert {r["name"]: (r["section"], r["used"], r["how"]) for r in files.collect()} == {"a": ("PZ", True, "title"), "b": ("PZ", False, "title"), "c": ("AR", True, "user")}
    row = package.summary(found, files, spark.createDataFrame([("p", "ru"), ("p", "kz")], "package_id string, lang string")).first()
    assert (row["present"], row["absent"], row["mismatch"], row["match"], row["lang"]) == ("AR,PZ", "KR,SMETA", 1, 2, "mixed")
    assert package.as_json(package.report(found)).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\fthree")
    pages = layout.read_texts(spark, str(tmp_path / "t"))
    assert [(r["page"], r["text"]) for r in pages.orderBy("page").collect()] == [(1, "one\ntwo"), (2, "three")]
    assert layout.lines_of_pages(pages).count() == 3
    upload = layout.read_uploads(spark, str(tmp_path / "t"), 5).first()
    assert not upload["accepted"] and upload["key"].endswith(".txt") and len(upload["key"]) == 24
    layout.append_log(spark.createDataFrame([("a@b.c", "o", None, None)], layout.ACCESS_REQUEST), str(tmp_path / "log"))
    layout.append_log(spark.createDataFrame([("d@b.c", "o", None, None)], layout.ACCESS_REQUEST), str(tmp_path / "log"))
    assert layout.read_rows(spark, str(tmp_path / "log"), "access_request").count() == 2
    lines = spark.createDataFrame([("d", 1, 1, "x", 10.0, 20.0), ("d", 1, 2, "y", 100.0, 110.0), ("d", 1, 3, "z", 790.0, 800.0)], "doc_id string, page int, line_no int, text string, top double, bottom double")
    kept = layout.without_furniture(lines, spark.createDataFrame([("d", 1, 842.0)], "doc_id string, page int, height double"))
    assert [r["text"] for r in kept.collect()] == ["y"]
    boxes = spark.createDataFrame([("d", 1, 95.0, 120.0)], "doc_id string, page int, top double, bottom double")
    assert [r["in_table"] for r in layout.lines_outside_tables(lines, boxes).orderBy("line_no").collect()] == [False, True, False]


def test_annotations(spark):
    ref = (9, "q", None, None, None, None, None, None, None, None)
    rows = [("d", "ru", 3, {"b1": "x"}, [("R1", "numeric", "T", "f", "b1", "high", [ref]), ("R1", "logical", "T", "f", "b9", "high", [])])]
    found = layout.annotation_problems(spark.createDataFrame(rows, layout.ANNOTATION), {"T": "numeric"})
    assert sorted((r["problem"]) for r in found.collect()) == ["id used twice", "level does not fit type", "page out of range", "unknown object"]


def test_extractable(spark):
    gold = spark.createDataFrame([("d", "a", 10.0), ("d", "b", 20.004), ("d", "c", 30.0)], "doc_id string, field string, value double")
    cells = spark.createDataFrame([("d", 10.0)], "doc_id string, value double")
    texts = spark.createDataFrame([("d", 20.0), ("d", 10.0), ("e", 30.0)], "doc_id string, value double")
    assert {r["field"]: r["where"] for r in package.extractable(gold, cells, texts).collect()} == {"a": "table", "b": "text", "c": "none"}
