"""A package of documents from rows to a report: statements, checks, findings, completeness, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TOLERANCES, tolerance_matches
from ..operators import checks
from ..operators.ordered import first_per, mark_first

SECTIONS = ["PZ", "AR", "KR", "SMETA"]
#: Type and level of the findings that rules give.
LEVELS = {
    "AREA_PZ_VS_AR_EXPLICATION": "numeric", "MATERIAL_VOLUME_KR_VS_LOCAL_ESTIMATE": "numeric", "COST_OBJECT_ESTIMATE_VS_SUMMARY": "numeric", "TABLE_TOTAL_MISMATCH": "numeric", "TEP_CROSS_SECTION_MISMATCH": "numeric",
    "MISSING_MANDATORY_TEP": "categorical", "PARAMETER_CONTRADICTION": "categorical", "VALUE_CROSS_SECTION_MISMATCH": "logical", "GEOMETRY_INCONSISTENCY": "domain_rule", "TEP_CALCULATION_METHOD": "domain_rule", "COPY_PASTE_LABEL": "artifact",
}
NEEDS_EXPERT = ["GEOMETRY_INCONSISTENCY", "VALUE_CROSS_SECTION_MISMATCH", "TEP_CALCULATION_METHOD"]


def chosen_files(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One file a section: the user's choice before the found one, the first file before later ones.

    files: package_id, file_no, name, section, how; overrides: package_id, name, section. Adds used.
    """
    if overrides is not None:
        files = files.join(overrides.select("package_id", "name", F.col("section").alias("_s")), ["package_id", "name"], "left")
        files = files.withColumn("how", F.when(F.col("_s").isNotNull(), "user").otherwise(F.col("how"))).withColumn("section", F.coalesce("_s", "section")).drop("_s")
    return mark_first(files, ["package_id", "section"], ["file_no"], "used").withColumn("used", F.col("used") & (F.col("section") != "unknown"))


def compared_findings(statements: DataFrame) -> DataFrame:
    """The comparisons over sections of every package: package_id, type, field, verdict, delta_abs, delta_rel, low_confidence.

    statements: package_id, section, field, value, source, seq. One value a field and section: tables before sentences.
    """
    ranked = statements.withColumns({"_rank": F.when(F.col("source") == "table", 0).otherwise(1), "_ocr": F.coalesce(F.col("source") == "ocr", F.lit(False))}).where("package_id is not null")
    best = lambda of, *dealt: first_per(of.repartition(*dealt), ["package_id", "field", "section"], ["_rank", "seq"])
    keys, area = ["package_id"], "total_area_m2"
    section, field, value = F.col("section"), F.col("field"), F.col("value")
    one = lambda side: F.max(F.when(side, F.struct("value", "_ocr")))  # noqa: E731  a side has one row; the groups come in the order of the choice, so none are held

    in_areas = (section == "PZ") & (field == area) | (section == "AR") & ((field == area) | field.startswith("room."))
    rooms = F.nullif(F.round(F.sum(F.when(field != area, value)), 2), F.lit(0.0))
    areas = best(ranked.where(in_areas), "package_id").groupBy(*keys).agg(one(section == "PZ").alias("_a"), one((section == "AR") & (field == area)).alias("_b"), rooms.alias("rooms"))
    areas = areas.withColumns({"field": F.lit(area), "b": F.coalesce("_b.value", "rooms")}).where("_a is not null and b is not null")

    in_materials = (section == "KR") & field.startswith("qty.") | (section == "SMETA") & field.startswith("local_qty.")
    named = ranked.where(in_materials).withColumn("field", F.regexp_replace("field", "^local_", ""))
    materials = best(named, "package_id", "field").groupBy(*keys, "field").agg(one(section == "KR").alias("_a"), one(section == "SMETA").alias("_b")).where("_a is not null and _b is not null").withColumn("b", F.col("_b.value"))

    estimate = best(ranked.where(section == "SMETA"), "package_id").select(*keys, "field", F.struct("value", "_ocr").alias("_s"))
    total, lines = estimate.where(field == "object_estimate_ktg").select(*keys, F.col("_s").alias("_a")), estimate.where(field.startswith("summary_line.")).select(*keys, F.col("_s").alias("_b"))
    costs = checks.single_right(total, lines, keys).withColumns({"field": F.lit("object_estimate_ktg"), "b": F.col("_b.value")})

    out = None
    for kind, tolerance, pairs in (("AREA_PZ_VS_AR_EXPLICATION", "area", areas), ("MATERIAL_VOLUME_KR_VS_LOCAL_ESTIMATE", "material", materials), ("COST_OBJECT_ESTIMATE_VS_SUMMARY", "cost", costs)):
        judged = checks.compare(pairs.withColumn("a", F.col("_a.value")), "a", "b", tolerance)
        low = F.coalesce("_a._ocr", F.lit(False)) | F.coalesce("_b._ocr", F.lit(False))
        row = judged.select(*keys, F.lit(kind).alias("type"), "field", "verdict", "delta_abs", "delta_rel", low.alias("low_confidence"))
        out = row if out is None else out.unionByName(row)
    return out


def missing_findings(statements: DataFrame, mandatory: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Mandatory values that a section lacks although another section shows that they exist; scans aren't judged.

    mandatory: section, field, shown_by (section), shown_field; configuration, so it is broadcast. Only fields that it names
    are looked for.
    """
    scanned = statements.where("source = 'ocr'").select("package_id", "section").distinct()
    due = uploaded.join(F.broadcast(mandatory.select("section")), "section", "left_semi").select("package_id", "section").distinct().join(F.broadcast(mandatory), "section").join(scanned, ["package_id", "section"], "left_anti")
    named = mandatory.select("section", "field").unionByName(mandatory.select(F.col("shown_by").alias("section"), F.col("shown_field").alias("field")))
    present = statements.join(F.broadcast(named), ["section", "field"], "left_semi").select("package_id", "section", "field").distinct()
    absent = due.join(present, ["package_id", "section", "field"], "left_anti")
    evidence = present.select("package_id", F.col("section").alias("shown_by"), F.col("field").alias("shown_field"))
    shown = absent.join(evidence, ["package_id", "shown_by", "shown_field"], "left_semi")
    return shown.select("package_id", F.lit("MISSING_MANDATORY_TEP").alias("type"), "field", F.lit("MISSING").alias("verdict"), F.lit(None).cast("double").alias("delta_abs"), F.lit(None).cast("double").alias("delta_rel"), F.lit(False).alias("low_confidence"))


def report(findings: DataFrame) -> DataFrame:
    """Findings numbered in each package, mismatches first, with level, expert flag and message."""
    from pyspark.sql import Window

    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    number = F.row_number().over(Window.partitionBy("package_id").orderBy(F.col("verdict") == "MATCH", "type", "field"))
    message = F.when(F.col("verdict") == "MISSING", F.concat(F.col("field"), F.lit(" is not stated"))).when(F.col("verdict") == "MISMATCH", F.concat(F.col("field"), F.lit(" differs by "), F.format_number(F.col("delta_abs"), 3))).otherwise(F.concat(F.col("field"), F.lit(" agrees")))
    return findings.withColumns({"finding_no": number, "level": F.try_element_at(level, F.col("type")), "needs_expert": F.col("type").isin(NEEDS_EXPERT), "message": message})


def summary(findings: DataFrame, files: DataFrame, languages: DataFrame) -> DataFrame:
    """One row a package: counts of verdicts, sections present and missing, language or mixed."""
    counts = findings.groupBy("package_id").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("MISMATCH", "MISSING", "MATCH")])
    have = checks.completeness(files.where("used"), "package_id", "section", SECTIONS)
    lang = languages.groupBy("package_id").agg(F.when(F.count_distinct("lang") == 1, F.first("lang")).otherwise("mixed").alias("lang"))
    return have.withColumnRenamed("missing", "absent").join(counts, "package_id", "left").join(lang, "package_id", "left").na.fill(0, ["mismatch", "missing", "match"])


def as_json(reported: DataFrame) -> DataFrame:
    """One JSON document a package; a package has few findings."""
    return reported.groupBy("package_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("finding_no", "type", "field", "verdict", "delta_abs", "delta_rel", "message")))).alias("findings"))


def extractable(gold: DataFrame, cells: DataFrame, texts: DataFrame, within: float = 0.005) -> DataFrame:
    """Where each gold value can be read: table, text or none. gold: doc_id, field, value; cells, texts: doc_id, value."""
    cents = lambda c: F.round(F.col(c) / (2 * within)).cast("long")
    near = gold.select("doc_id", "field", "value", F.explode(F.array(cents("value") - 1, cents("value"), cents("value") + 1)).alias("_k"))
    place = lambda df, n: df.select("doc_id", cents("value").alias("_k"), F.col("value").alias("_v"), F.lit(n).alias("_p"))
    said = place(cells, 0).unionByName(place(texts, 1))
    # numbers of texts are many more than the texts' size lets Spark expect: neither side is sent to the driver
    hits = near.hint("merge").join(said.hint("merge"), ["doc_id", "_k"]).where(F.abs(F.col("_v") - F.col("value")) <= within)
    where = hits.groupBy("doc_id", "field").agg(F.min("_p").alias("_p"))
    out = gold.join(where.hint("merge"), ["doc_id", "field"], "left")
    return out.select("doc_id", "field", "value", F.when(F.col("_p") == 0, "table").when(F.col("_p") == 1, "text").otherwise("none").alias("where"))


__all__ = ["TOLERANCES", "tolerance_matches", "chosen_files", "compared_findings", "missing_findings", "report", "summary", "as_json", "extractable"]
