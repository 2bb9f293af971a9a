"""Whole notes of our own: objects, contexts over pages, quotes, and what stages add."""

import pytest

from tallymark.operators import notes
from tallymark.sources.lexicon import Lexicon

LEXICON = Lexicon(
    {"area": "m2", "volume": "m3", "floors": "floor"},
    [("area", "table", "Площадь застройки"), ("volume", "table", "Строительный объем"), ("floors", "table", "Этажность"), ("floors", "text_number_first", "этажное")],
    ["Площадь участка"], [("m2", "кв.м"), ("m2", "м²"), ("m3", "куб.м"), ("floor", "эт.")], [("number", "№ п/п"), ("units_row", "Ед. изм."), ("total_row", "Итого")],
)
LINES = [
    # two buildings: the second is named by a heading on page 1 and goes on over page 2
    ("two", 1, 1, "1 Котельная угольная", 10.0, False), ("two", 1, 2, "Площадь застройки равна 518,70 м². Площадь участка 9 м²", 20.0, False), ("two", 1, 3, "2 Гараж", 30.0, False),
    ("two", 2, 1, "Строительный объем 1 200 куб.м", 10.0, False), ("two", 2, 2, "Площадь застройки котельной 7 кв.м", 20.0, False), ("two", 2, 3, "3 Сети и площадки", 90.0, False), ("two", 2, 4, "Строительный объем 5 куб.м", 95.0, False),
    # one building, and a table's line that isn't read as a sentence
    ("one", 1, 1, "Корпус 2-этажное здание", 5.0, False), ("one", 1, 2, "1 Гараж", 10.0, False), ("one", 1, 3, "Площадь застройки 99 м²", 50.0, True),
    # no building: values are the project's; rows of a summary name two
    ("rows", 1, 1, "Площадь застройки 11 м²", 5.0, False), ("none", 1, 1, None, 5.0, False), ("none", 1, 2, "Площадь застройки 12 м²", 6.0, False),
]
TABLES = {
    ("two", 1, 2, 50.0): [["№ п/п", "Показатель", "Ед. изм.", "Значение"], ["1", "Площадь застройки", "кв.м", "60"], ["2", "Этажность", "эт.", "1"]],
    ("one", 1, 1, 40.0): [["Наименование", "Площадь застройки, м²", "Этажность"], ["Гараж", "77,5", "4"]],
    ("rows", 1, 1, 40.0): [["Наименование", "Площадь застройки, м²", "Этажность"], ["Склад", "100", "1"], ["Цех", "200", "2"], ["Итого", "300", ""]],
}


@pytest.fixture(scope="module")
def found(spark):
    lines = spark.createDataFrame(LINES, "doc_id string, page int, line_no int, text string, top double, in_table boolean")
    cells = [(d, n, p, r, c, x) for (d, n, p, _), rows in TABLES.items() for r, row in enumerate(rows) for c, x in enumerate(row)]
    boxes = spark.createDataFrame([k for k in TABLES], "doc_id string, table_no int, page int, top double")
    made = notes.candidates(lines, spark.createDataFrame(cells, "doc_id string, table_no int, page int, row_no int, col_no int, text string"), boxes, LEXICON, r"(?iu)котельн|гараж")
    return notes.kept(made)


def chosen(df):
    return {(r["doc_id"], r["object"], r["field"]): (r["value"], r["source"], r["how"]) for r in df.collect()}


def test_slots_of_notes(found):
    assert chosen(notes.slots(found)) == {
        ("two", "obj1", "area"): (518.7, "text", "heading"),
        ("two", "obj2", "volume"): (1200.0, "text", "heading"),
        ("two", "obj2", "area"): (60.0, "table_v", "heading"),
        ("two", "obj2", "floors"): (1.0, "table_v", "heading"),
        ("two", "project", "volume"): (5.0, "text", "project"),
        ("one", "obj1", "floors"): (4.0, "table_h", "heading"),
        ("one", "obj1", "area"): (77.5, "table_h", "heading"),
        ("rows", "obj1", "area"): (100.0, "table_h", "row"),
        ("rows", "obj1", "floors"): (1.0, "table_h", "row"),
        ("rows", "obj2", "area"): (200.0, "table_h", "row"),
        ("rows", "obj2", "floors"): (2.0, "table_h", "row"),
        ("rows", "project", "area"): (11.0, "text", "project"),
        ("none", "project", "area"): (12.0, "text", "project"),
    }


def test_mentions_and_quotes(found):
    rows = {(r["doc_id"], r["value"]): r for r in found.collect()}
    assert (rows["two", 7.0]["object"], rows["two", 7.0]["how"]) == ("obj1", "mention")
    assert rows["one", 2.0]["how"] == "single" and rows["one", 2.0]["object"] == "obj1"
    assert rows["two", 60.0]["quote"] == "1 Площадь застройки кв.м 60" and ("one", 99.0) not in rows


def test_stages_are_a_column(found):
    tables_only = chosen(notes.slots(notes.of_stages(found, ("exact",))))
    assert {v[1] for v in tables_only.values()} == {"table_v", "table_h"} and len(tables_only) == 8
    with pytest.raises(ValueError):
        notes.of_stages(found, ("anchor",))
    gold = notes.slots(found).select("doc_id", "object", "field", "value")
    gold = gold.withColumn("lang", gold["doc_id"])
    got = {(r["run"], r["lang"]): (r["tp"], r["fp"], r["fn"]) for r in notes.experiment(found, gold, {"tables": ("exact",), "all": notes.STAGES}, ["lang"]).collect()}
    assert got["all", None] == (13, 0, 0) and got["tables", None] == (8, 0, 5) and got["tables", "none"] == (0, 0, 1)
