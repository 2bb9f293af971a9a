"""Plans and steps that must stay small on larger tables."""

import random

from pyspark.sql import functions as F

from tallymark.operators import evaluation, labels, texts
from tallymark.plans.comparison_queries import stage_ablation
from tallymark.plans.document_queries import FULL, label_cascade
from tallymark.plans.evaluation_queries import found_by_level
from tallymark.plans.other_queries import extractability
from tallymark.plans.registry import Tables
from tallymark.sources.lexicon import Lexicon

SMALLEST = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_match_distinct_words_only(spark, monkeypatch):
    """distinct words are a table before they are matched, so no test on the match moves to the rows."""
    plans, match = [], labels.match
    monkeypatch.setattr(labels, "match", lambda said, *rest, **named: plans.append(optimized(said)) or match(said, *rest, **named))
    pages = spark.createDataFrame([(i, 1, "Общая площадь равна 12 м2, Строительный объем 5 м3") for i in range(40)], "doc_id int, page int, text string")
    found = texts.anchored_values(pages, FULL)
    assert plans and not any("Aggregate" in p for p in plans)
    assert found.groupBy("field", "value").count().count() == 2


def matching(df):
    return "lambdafunction" in optimized(df)


def test_label_cascade_matches_distinct_labels_only(spark):
    """F7"""
    assert not matching(label_cascade(Tables(spark, SMALLEST)))


def test_stage_ablation_matches_distinct_labels_only(spark):
    """F8"""
    assert not matching(stage_ablation(Tables(spark, SMALLEST)))


def test_fuzzy_labels_are_matched_once_each(spark):
    """F10"""
    said = spark.range(100).select(F.element_at(F.array(F.lit("Общей площади"), F.lit("прочее")), (F.col("id") % 2 + 1).cast("int")).alias("label"))
    known = spark.createDataFrame([("area", "общая площадь")], "field string, known string")
    for found in (labels.fuzzy(said, known), labels.cascade(said, known)):
        assert not matching(found)
        assert [r["field"] for r in found.collect()] == ["area"]


def test_answers_by_unit_keep_null_units(spark):
    said = spark.createDataFrame([("Общая площадь", None), ("Общая площадь", "m2"), ("Общая площадь", "m3"), ("Общая площадь", None), (None, None)], "label string, unit string")
    lexicon = Lexicon({"area": "m2"}, [("area", "table", "общая площадь")])
    got = labels.answers(said, lexicon, unit="unit")
    assert sorted((str(r["unit"]), r["match"]["field"]) for r in got.collect()) == [("None", "area"), ("m2", "area")]


def test_extractability_sends_no_texts_to_the_driver(spark):
    """F3"""
    found = extractability(Tables(spark, SMALLEST))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_findings_are_served_in_order_without_pairs(spark):
    """brute force over one large key and some small ones, with repeated rows, null and empty pages."""
    rng = random.Random(3)

    def made(n):
        pages = lambda: rng.choice([None, [], [None], [rng.randrange(4), rng.randrange(9)], [rng.randrange(9)]])
        return [(rng.choice([1, 1, 1, 2, None]), rng.randrange(n), rng.choice("aab"), rng.choice(["x", None, "x"]), pages()) for _ in range(n)]

    gold, said = made(400), made(300)
    said.append((1, None, "a", "x", [1]))
    schema = "doc_id int, seq {}, type string, object string, pages array<int>"
    found = evaluation.matched_findings(spark.createDataFrame(gold, schema.format("long")), spark.createDataFrame(said, schema.format("int")), spark.createDataFrame([], "doc_id int, pid string, gid string"))
    assert "arrays_overlap" not in optimized(found)
    wanted, used = [], set()
    of = lambda rows, key: sorted({r[1] for r in rows if (r[0], r[2], r[3]) == key and r[1] is not None})
    pages_of = lambda rows, key, seq: {p for r in rows if (r[0], r[2], r[3]) == key and r[1] == seq for p in r[4] or []} - {None}
    for key in {(r[0], r[2], r[3]) for r in gold if None not in (r[0], r[3])}:
        for g in of(gold, key):
            free = [s for s in of(said, key) if (key, s) not in used and pages_of(gold, key, g) & pages_of(said, key, s)]
            if free:
                used.add((key, free[0]))
                wanted.append((key[0], g, free[0]))
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    assert found.dtypes == [("doc_id", "int"), ("gold_seq", "bigint"), ("said_seq", "int")]


def test_levels_are_counted_without_pairs(spark, monkeypatch):
    """the pairs that are counted come from no join of gold and said."""
    plans = []
    monkeypatch.setattr("tallymark.plans.evaluation_queries.kept", lambda df: plans.append(optimized(df)) or df)
    assert found_by_level(Tables(spark, SMALLEST)).count() == 5
    assert plans and "arrays_overlap" not in plans[0]


def test_blocks_of_words_come_in_bounded_batches():
    """op13: a block's output isn't one batch, which both sides of a task would hold."""
    import pyarrow as pa

    from tallymark.llm import phrases

    class Texts:
        def mapInArrow(self, run, schema):
            text = " ".join(f"w{i}" for i in range(120_000))
            return [b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"])], names=["text", "lang"])]))]

    def rows_of(block, again):
        hashes, _ = block.keys(0)
        for some in phrases._parts(hashes):
            yield [phrases._signed(some)]

    assert phrases._over_blocks(Texts(), 1, ["h"], rows_of) == [50_000, 50_000, 20_001]


def test_labels_of_tables_are_matched_once_each(spark):
    """what is joined back to the rows of tables plans no matching."""
    from tallymark.operators import tables

    said = spark.createDataFrame([("Общая площадь", "m2"), ("Общая площадь", None), ("Прочее", "m2")], "label string, unit string")
    found = tables._matched(said, FULL, labels.STAGES)
    assert not matching(found)
    assert found.count() == 2


def test_notes_come_in_as_many_tasks_as_shuffles(spark, monkeypatch):
    """lines and cells made of one small file are read by more than one task."""
    from tallymark.operators import notes
    from tallymark.plans.document_queries import note_candidates

    files = []

    def counted(lines, cells, boxes, *rest):
        files.extend([len(lines.inputFiles()), len(cells.inputFiles())])
        return lines.select("doc_id")

    monkeypatch.setattr(notes, "candidates", counted)
    note_candidates(Tables(spark, SMALLEST))
    assert files == [4, 4]


def test_rows_of_grids_are_put_together_once(spark):
    """what is read across or down plans no putting together of rows again."""
    from tallymark.operators import tables

    cells = spark.createDataFrame([(1, 1, 1, r, c, x) for r, row in enumerate([["Показатель", "Значение"], ["Общая площадь, м2", "7"], ["Строительный объем, м3", "8"]]) for c, x in enumerate(row)], "doc_id int, table_no int, page int, row_no int, col_no int, text string")
    assert "collect_list" not in optimized(tables.across(cells, FULL))
    found = tables.down(cells, FULL)
    assert "collect_list" not in optimized(found)
    assert found.count() == 2


def test_phrases_keep_neither_projections_nor_rare_words(spark, monkeypatch):
    """op13: words are counted by hash before any is kept as text, and what follows prefixes is shuffled once, not kept."""
    from tallymark.llm import phrases

    tables, written = {}, phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    docs = spark.createDataFrame([("a b c d e", "en")] * 3 + [(f"rare{i}", "de") for i in range(50)], "text string, lang string")
    found = phrases.collocations(docs, 3)
    assert "projections" not in tables and tables["frequent-hashes"].columns == ["h", "f"]
    assert tables["words"].where("k.word like 'rare%'").count() == 0
    assert {(r["lang"], r["phrase"], r["a"], r["n"]) for r in found.collect()} == {("en", "a b c d", 3, 15), ("en", "b c d e", 3, 15)}


def test_gold_is_joined_with_pairs_once(spark):
    """found and missed come from one join; repeated rows of the gold count each, null keys are missed."""
    gold = spark.createDataFrame([(1, 1, "numeric"), (1, 1, "numeric"), (1, 2, "logical"), (None, 3, "expert")], "doc_id long, seq long, level string")
    said = spark.createDataFrame([(1, 7, "numeric"), (1, 8, "expert")], "doc_id long, seq long, level string")
    pairs = spark.createDataFrame([(1, 1, 7), (1, 1, 7)], "doc_id long, gold_seq long, said_seq long")
    found = evaluation.by_level(gold, said, pairs)
    assert {tuple(r) for r in found.collect()} == {("numeric", 2, 0, 0), ("logical", 0, 1, 0), ("completeness", 0, 0, 0), ("expert", 0, 1, 1), ("formal", 0, 0, 0)}
    assert optimized(found).count("LeftSemi") == 0 and optimized(found).count("LeftAnti") == 1


def test_packages_are_dealt_once_and_never_by_section(spark):
    """what is chosen of a package's statements is chosen where the package lies; few sections don't make few tasks."""
    import re

    from tallymark.plans import fixtures, package

    rows = [(i, s, f, 1.0 + i, "table", 1) for i in range(3) for s, f in (("PZ", "total_area_m2"), ("AR", "total_area_m2"))]
    said = spark.createDataFrame(rows, "package_id long, section string, field string, value double, source string, seq int")
    compared = package.compared_findings(said)
    missing = package.missing_findings(said, fixtures.mandatory(spark), said.select("package_id", "section").distinct())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(package_id#\d+L?, section", plan(compared))
    assert not re.search(r"hashpartitioning\((section|shown_by)", plan(missing))
    assert compared.count() == 3


def test_comparisons_read_statements_four_times(spark):
    """F3 of round 5: areas and materials are read once each and not joined, a cost and its lines once each."""
    from tallymark.plans import package

    said = spark.createDataFrame([], "package_id long, section string, field string, value double, source string, seq int")
    plan = optimized(package.compared_findings(said))
    assert plan.count("LogicalRDD") == 4 and plan.count("Join ") == 1
    physical = package.compared_findings(said)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Sort [") == 4 and physical.count("Exchange ") == 4  # groups come in the order of the choice


def test_comparisons_of_odd_statements(spark):
    """F3 of round 5: nulls, rows that come twice, one side only, rooms without a total, scans."""
    from tallymark.plans import package

    area, cost, one = "total_area_m2", "object_estimate_ktg", "summary_line.1"
    rows = [
        (1, "PZ", area, 100.0, "table", 1), (1, "PZ", area, 100.0, "table", 1), (1, "PZ", area, 7.0, "text", 0), (1, "AR", "room.1", 60.0, "ocr", 1), (1, "AR", "room.2", 40.0, None, 1), (1, "AR", "room.3", None, None, 1),
        (2, "PZ", area, None, "ocr", 1), (2, "AR", area, 5.0, "text", None), (2, "AR", "room.1", 9.0, "table", 1),
        (3, "PZ", area, 5.0, "text", 1), (3, "AR", area, None, "ocr", 1), (3, "AR", "room.1", 9.0, "table", 1),
        (4, "PZ", area, 5.0, None, 1), (4, "AR", "room.1", 0.0, "table", 1),
        (5, "PZ", area, 5.0, "text", 1), (5, "AR", area, None, "table", 1),
        (6, "AR", area, 5.0, "text", 1), (6, "KR", area, 5.0, "text", 1),
        (None, "PZ", area, 5.0, "text", 1), (None, "AR", area, 5.0, "text", 1), (None, "SMETA", cost, 5.0, "text", 1), (None, "SMETA", one, 5.0, "text", 1),
        (7, "KR", "qty.x", None, "table", 1), (7, "SMETA", "local_qty.x", 3.0, "ocr", 1), (7, "KR", "qty.y", 3.0, "table", 1), (7, "SMETA", "local_qty.y", None, "table", 1),
        (7, "KR", "qty.z", 3.0, "table", 1), (7, "SMETA", "qty.z", 3.0, "table", 1), (7, "SMETA", "local_qty.w", 3.0, "table", 1), (7, None, "qty.z", 1.0, "table", 1), (7, "KR", None, 1.0, "table", 1),
        (7, "KR", "qty." + area, 2.0, "table", 1), (7, "SMETA", "local_qty." + area, 2.5, "table", 1), (7, "SMETA", "local_" + area, 2.0, "table", 1),
        (8, "SMETA", cost, 5.0, "text", 1), (8, "SMETA", one, 5.0, "ocr", 1), (9, "SMETA", cost, 5.0, "text", 1), (9, "SMETA", one, 5.0, "text", 1), (9, "SMETA", "summary_line.2", 5.0, "text", 1),
        (10, "SMETA", cost, None, "text", 1), (10, "SMETA", one, 0.0, "table", 1), (11, "SMETA", cost, float("nan"), "table", 1), (11, "SMETA", one, 5.0, "table", 1),
    ]
    said = spark.createDataFrame(rows, "package_id long, section string, field string, value double, source string, seq int")
    found = {(r["package_id"], r["type"].split("_")[0], r["field"], r["verdict"], r["delta_abs"], r["delta_rel"], r["low_confidence"]) for r in package.compared_findings(said).where("package_id < 11").collect()}
    assert found == {
        (1, "AREA", area, "MATCH", 0.0, 0.0, False), (2, "AREA", area, "MISSING", None, None, True), (3, "AREA", area, "MISMATCH", -4.0, -0.44444, True),
        (7, "MATERIAL", "qty.x", "MISSING", None, None, True), (7, "MATERIAL", "qty.y", "MISSING", None, None, False), (7, "MATERIAL", "qty." + area, "MISMATCH", -0.5, -0.2, False),
        (8, "COST", cost, "MATCH", 0.0, 0.0, True), (10, "COST", cost, "MISSING", None, None, False),
    }
    assert package.compared_findings(said).count() == len(found) + 1


def unhinted(plans):
    """Joins that Spark may turn into broadcasts by what it takes for a table's size."""
    import re

    return [j for p in plans for j in re.findall(r"Join (?:Inner|LeftOuter|LeftSemi|LeftAnti).*", p) if "strategy=" not in j]


def planned(monkeypatch, *modules):
    """The plans of what these modules keep from now on."""
    from tallymark.session import kept

    plans = []
    for module in modules:
        monkeypatch.setattr(module, "kept", lambda df: plans.append(optimized(df)) or kept(df))
    return plans


def test_notes_send_no_rows_to_the_driver(spark, monkeypatch):
    """F1 of round 4: packed files of many notes are small, their rows aren't."""
    from tallymark.operators import extract, notes, tables
    from tallymark.plans import document_queries

    plans = planned(monkeypatch, extract, labels, notes, tables, texts, document_queries)
    found = document_queries.note_slots(Tables(spark, SMALLEST))
    assert sum(p.count("Join ") for p in plans) >= 15
    assert not unhinted([*plans, optimized(found)])


def test_many_answers_meet_rows_in_shuffles(spark, monkeypatch):
    """F1 of round 4: few answers go to every task, many don't; the answers are the same."""
    said = spark.createDataFrame([("Общая площадь", i) for i in range(5)] + [("Этажность", 9)], "label string, id int")
    met = lambda: said.join(labels.answers(said, FULL), "label").select("id", "match.field")
    few = met()
    monkeypatch.setattr(labels, "ANSWER_BYTES", 0)
    many = met()
    assert "strategy=broadcast" in optimized(few) and "strategy=merge" in optimized(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 6


def test_stages_are_scored_without_sending_gold_to_the_driver(spark, monkeypatch):
    """F2 of round 4"""
    from tallymark.operators import notes
    from tallymark.plans import document_queries

    found = spark.createDataFrame([(2, "obj1", "floors", 3.0, "3", "q", "text", "exact", 1.0, "single", 1, 1), (2, "obj1", "total_area_m2", 7.0, "7", "q", "table_v", "fuzzy", 0.9, "single", 1, 2)], ", ".join(f"{c} {k}" for c, k in zip(notes.COLUMNS, ["long", "string", "string", "double", "string", "string", "string", "string", "double", "string", "int", "int"], strict=True)))
    monkeypatch.setattr(document_queries, "note_candidates", lambda t: found)
    plans = planned(monkeypatch, notes)
    scored = document_queries.stage_experiment(Tables(spark, SMALLEST))
    assert sum(p.count("Join ") for p in [*plans, optimized(scored)]) >= 3
    assert not unhinted([*plans, optimized(scored)])
    assert {(r["run"], r["tp"], r["fp"], r["fn"]) for r in scored.where("lang is null").collect()} == {("exact", 0, 0, 2), ("exact+anchor", 1, 0, 1), ("exact+anchor+fuzzy", 2, 0, 0)}


def test_volumes_send_no_parts_to_the_driver(spark):
    """F3 of round 4"""
    from tallymark.plans.check_queries import volume_method, volume_ratio

    for found in (volume_method(Tables(spark, SMALLEST)), volume_ratio(Tables(spark, SMALLEST))):
        assert optimized(found).count("Join ") >= 6
        assert not unhinted([optimized(found)])


def test_volumes_at_the_least_and_largest_area(spark):
    """F3 of round 4: objects of one area or two, volumes at the limits, against all pairs."""
    from tallymark.operators import checks

    rng, rel = random.Random(4), 0.005
    areas = [(i, n, s * rng.uniform(0.01, 5000)) for i in range(60) for n, s in enumerate([1, -1, 1][: 1 + i % 3])]
    heights = [(i, n, h) for i in range(60) for n, h in enumerate([2.6, -3.1, 0.0])]
    volumes = [(k, 100 * n + m, a * h * f) for k, n, a in areas for m, (h, f) in enumerate((h, f) for h in (2.6, -3.1) for f in (1, 1 / (1 - rel), 1 / (1 + rel), 1.0052, 0.9949))]
    made = lambda rows, n: spark.createDataFrame(rows, f"o int, {n}_seq int, {n} double")
    got = checks.volume_method(made(volumes, "volume"), made(areas, "area"), made(heights, "height"), "o", rel)
    want = {}
    for k, seq, v in volumes:
        hits = [(s, n) for q, s, a in areas if q == k for p, n, h in heights if p == k and abs(a * h - v) <= rel * v]
        if hits:
            want[k, seq] = min(hits)
    assert {(r["o"], r["volume_seq"]): (r["area_seq"], r["height_seq"]) for r in got.collect()} == want
    assert len(volumes) > len(want) > 300
