"""Generated packages: what was put in is what is found, for any partitioning, and nothing else."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import checks, extract
from tallymark.plans import fixtures, package


def found(spark, rows):
    said = fixtures.statements(rows)
    every = package.compared_findings(said).unionByName(package.missing_findings(said, fixtures.mandatory(spark), said.select("package_id", "section").distinct()))
    return every.where("verdict <> 'MATCH'").select("package_id", "type", "field")


@pytest.mark.parametrize("inject", ["random", "all", "none", ["cost", "missing"]])
def test_found_is_what_was_put_in(spark, inject):
    rows = fixtures.packages(spark, 40, seed=3, inject=inject)
    got, want = {tuple(r) for r in found(spark, rows).collect()}, {tuple(r) for r in fixtures.gold(rows).collect()}
    assert got == want and (inject != "none" or not want)


def test_same_rows_for_the_same_seed(spark):
    a, b = fixtures.packages(spark, 30, 5), fixtures.packages(spark, 60, 5).repartition(7).where(F.substring_index("package_id", "-", -1).cast("int") < 30)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert fixtures.packages(spark, 30, 6).exceptAll(a).count() == 30


def test_sentences_and_totals(spark):
    rows = fixtures.packages(spark, 24, 7)
    labels = {"total_area_m2": [r"общая\s+площадь", r"жалпы\s+аудан\p{L}*"]}
    got = extract.sentence_statements(fixtures.note_pages(rows), labels, {"total_area_m2": "m2"})
    assert got.join(rows, F.col("doc_id") == F.col("package_id")).where("abs(value - area) < 1e-9").count() == 24 == got.count()
    odd = checks.table_totals(fixtures.sheet_cells(rows), ["doc_id", "table_no"])
    assert {r["doc_id"] for r in odd.collect()} == {r["package_id"] for r in rows.where("wrong_area").collect()}
