"""Consistency checks: DataFrame in, findings out. Each is a builder that a registry can run for itself."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException, PySparkAttributeError, PySparkTypeError, PySparkValueError, PythonException, SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TOLERANCES, delta_abs, delta_rel, tolerance_matches, verdict
from ..session import kept, shuffled
from .ordered import first_per, in_ranges, running_min


def compare(pairs: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """Verdict and deltas of two values; a missing side gives MISSING."""
    rel, absolute = TOLERANCES[kind]
    judged = F.when(F.col(a).isNull() | F.col(b).isNull(), "MISSING").otherwise(verdict(a, b, rel, absolute))
    return pairs.withColumns({"verdict": judged, "delta_abs": delta_abs(a, b), "delta_rel": delta_rel(a, b)})


def with_fallback(left: DataFrame, right: DataFrame, keys: list[str], total: str, parts_sum: str) -> DataFrame:
    """The stated total where there is one, else the sum of the parts."""
    return left.join(right, keys).withColumn("compared", F.coalesce(F.col(total), F.col(parts_sum)))


def single_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Joins only rows whose right side is the one row of its key."""
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys]).where("_n = 1").drop("_n")
    return left.join(one, keys)


def missing_with_evidence(required: DataFrame, present: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Required, not there, but shown by evidence to be due."""
    return required.join(present, keys, "left_anti").join(evidence, keys, "left_semi")


def completeness(have: DataFrame, owner: str, item: str, required: list[str]) -> DataFrame:
    """Present and missing items of each owner, as sorted lists in a string."""
    need = F.array(*[F.lit(x) for x in sorted(required)])
    return have.groupBy(owner).agg(F.sort_array(F.collect_set(item)).alias("_have")).select(owner, F.array_join(F.array_intersect(need, "_have"), ",").alias("present"), F.array_join(F.array_except(need, "_have"), ",").alias("missing"))


def table_totals(cells: DataFrame, keys: list[str], kind: str = "table_total") -> DataFrame:
    """Total rows against the sum of the rows above them, column by column; every total begins a new block.

    cells: keys, row_no, col_no, value (null: no number), is_total. Row 0 is the header and isn't passed.
    """
    rel, absolute = TOLERANCES[kind]
    # cells of total rows above: equal inside a block, more in the next; blocks and sums share one shuffle by the keys
    above = Window.partitionBy(*keys).orderBy("row_no").rangeBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("block", F.coalesce(F.sum(F.col("is_total").cast("int")).over(above), F.lit(0))).where("value is not null")
    total, row = F.col("is_total"), ~F.col("is_total")
    sums = placed.groupBy(*keys, "block", "col_no").agg(
        F.max(F.when(total, F.col("row_no"))).alias("row_no"), F.max(F.when(total, F.col("value"))).alias("total"), F.round(F.sum(F.when(row, F.col("value"))), 6).alias("rows_sum"), F.count_if(row).alias("n_rows")
    )
    judged = sums.where(F.col("row_no").isNotNull() & (F.col("n_rows") > 0) & ~tolerance_matches("rows_sum", "total", rel, absolute))
    return judged.withColumn("delta_rel", F.round(F.try_divide(F.col("total") - F.col("rows_sum"), F.col("rows_sum")), 5))


def first_disagreement(statements: DataFrame, keys: list[str], order: str, value: str, place: list[str], rel: float, absolute: float) -> DataFrame:
    """Of each key, the base (first) statement and the first later one elsewhere that disagrees."""
    base = statements.groupBy(*keys).agg(F.min(F.struct(F.col(order), F.col(value), *[F.col(p) for p in place])).alias("_base"))
    joined = statements.join(base, keys)
    elsewhere = F.lit(False)
    for p in place:
        elsewhere = elsewhere | (F.col(p) != F.col(f"_base.{p}"))
    odd = joined.where((F.col(order) > F.col(f"_base.{order}")) & elsewhere & ~tolerance_matches(F.col(f"_base.{value}"), value, rel, absolute))
    found = odd.groupBy(*keys).agg(F.min(F.struct(F.col(order), F.col(value))).alias("_o"), F.first(F.col(f"_base.{value}")).alias("base_value"), F.first(F.col(f"_base.{order}")).alias("base_order"))
    return found.select(*keys, "base_order", "base_value", F.col(f"_o.{order}").alias("other_order"), F.col(f"_o.{value}").alias("other_value"), F.round(F.try_divide(F.col("base_value") - F.col(f"_o.{value}"), F.col(f"_o.{value}")), 5).alias("delta_rel"))


def distinct_contradiction(statements: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, the values sorted."""
    return statements.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("_v")).where(F.size("_v") > 1).select(*keys, F.size("_v").cast("long").alias("n_values"), F.array_join("_v", ", ").alias("values"))


def site_vs_building(site: DataFrame, building: DataFrame, site_key: str, building_key: str, value: str) -> DataFrame:
    """Buildings with several values, or with a value that their site doesn't have; and sites with several values."""
    of_site = site.groupBy(site_key).agg(F.collect_set(value).alias("_site"))
    of_building = building.groupBy(site_key, building_key).agg(F.sort_array(F.collect_set(value)).alias("_own"))
    odd = of_building.join(of_site, site_key, "left").withColumn("_site", F.coalesce("_site", F.array().cast("array<string>")))
    odd = odd.where((F.size("_own") > 1) | ((F.size("_site") > 0) & (F.size(F.array_except("_own", "_site")) > 0)))
    sites = of_site.where(F.size("_site") > 1)
    rows = odd.select(F.lit("building").alias("scope"), F.col(building_key).cast("string").alias("object"), F.array_join("_own", ", ").alias("values"))
    return rows.unionByName(sites.select(F.lit("site").alias("scope"), F.col(site_key).cast("string").alias("object"), F.array_join(F.sort_array("_site"), ", ").alias("values")))


def parameter_contradiction(own: DataFrame, general: DataFrame, key: str, material: str, width: str, slack: float = 0.01, package: str | None = None) -> DataFrame:
    """Objects whose statements, with the general ones, name several materials or widths further apart than the slack.

    package: the column by which general statements belong to objects; without it both are of one package.
    """
    within = [package] if package else []
    shared = general.groupBy(*within).agg(F.collect_set(material).alias("_gm"), F.max(width).alias("_gw"), F.min(width).alias("_gn"))
    mine = own.groupBy(*within, key).agg(F.collect_set(material).alias("_m"), F.max(width).alias("_w"), F.min(width).alias("_n"))
    both = mine.join(shared, within, "left") if package else mine.join(F.broadcast(shared), F.lit(True))  # one row
    none = F.array().cast(mine.schema["_m"].dataType)
    both = both.select(*within, key, F.sort_array(F.array_union("_m", F.coalesce("_gm", none))).alias("_m"), F.least("_n", "_gn").alias("narrowest"), F.greatest("_w", "_gw").alias("widest"))
    return both.where((F.size("_m") > 1) | (F.col("widest") - F.col("narrowest") > slack * F.col("widest"))).select(*within, key, F.array_join("_m", ", ").alias("materials"), "narrowest", "widest")


def _level(x: Column) -> Column:
    """A monotone scale on which equal distances are equal relative ones."""
    return F.signum(x) * F.log1p(F.abs(x))


#: On that scale: what rounding of a limit may be, and the width of a bucket in which values this near meet.
NEAR, NEAR_BUCKET = 1e-9, 1e-8


def smaller_than_axes(axes: DataFrame, areas: DataFrame, key: str, kind: str = "geometry") -> DataFrame:
    """The first area of an object that is smaller than its axes allow. axes: key, axes_seq, a, b; areas: key, area_seq, area.

    Axes allow every area from a limit on, so areas and limits are sorted together and each limit takes the first of the
    areas below it: no areas are paired with axes but those so near a limit that the exact comparison has to decide.
    """
    rel, absolute = TOLERANCES[kind]
    known = axes.withColumn("axes_area", F.round(F.col("a") * F.col("b"), 2)).where(F.col("axes_area").isNotNull())
    large = F.col("axes_area").cast("double")
    limit = large - F.greatest(F.lit(absolute), F.when(large >= 0, rel * large).otherwise(-rel * large / (1 - rel)))
    known = known.withColumn("_at", _level(limit))
    one = areas.where(F.col("area").isNotNull()).groupBy(key, "area").agg(F.min_by(F.struct(*[c for c in areas.columns if c != key]), "area_seq").alias("_area"))
    one = one.withColumn("_at", _level(F.col("area").cast("double")))
    first = F.struct("_area.area_seq", "_area")
    of_axes = known.select(key, (F.col("_at") - NEAR).alias("_at"), F.lit(0).alias("_kind"), F.struct(*[c for c in known.columns if c not in (key, "_at")]).alias("_axes"))
    of_areas = one.select(key, "_at", F.lit(1).alias("_kind"), first.alias("_first"))
    order = ["_at", "_kind"]
    below = running_min(in_ranges(of_axes.unionByName(of_areas, allowMissingColumns=True), [key], order), [key], order, F.col("_first"), "_best").where("_kind = 0 and _best is not null")
    found = below.select(key, "_axes", F.col("_best._area").alias("_area"))

    bucket = lambda x: F.floor(x / NEAR_BUCKET).cast("long")
    ends = F.array_distinct(F.array(bucket(F.col("_at") - 2 * NEAR), bucket(F.col("_at") + 2 * NEAR)))
    at_limit = known.withColumn("_bucket", F.explode(ends)).join(one.withColumn("_bucket", bucket(F.col("_at"))).drop("_at"), [key, "_bucket"])
    odd = at_limit.where((F.col("area") < F.col("axes_area")) & ~tolerance_matches("area", "axes_area", rel, absolute))
    found = found.unionByName(odd.select(key, F.struct(*[c for c in known.columns if c not in (key, "_at")]).alias("_axes"), "_area"))
    best = found.groupBy(key, F.col("_axes.axes_seq").alias("_seq")).agg(F.min_by(F.struct("_axes", "_area"), "_area.area_seq").alias("_b"))
    return best.select(key, "_b._axes.*", "_b._area.*")


def volume_method(volumes: DataFrame, areas: DataFrame, heights: DataFrame, key: str, rel: float = 0.005) -> DataFrame:
    """Volumes that are an area times a clear height: the first such area and height of each volume.

    A volume over a height says which area it takes, to a factor: logarithms of areas lie in buckets as wide as that
    factor, and only areas of the two buckets that can fit are looked at; nothing is looked for beyond an object's least
    and largest area. Equal values of an object count once, for the first of them. Volumes of zero take the first area and
    height of which one is zero.
    """
    width = max(math.log((1 + rel) / (1 - rel)), 1e-9)
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x).cast("double")) < float("inf"))
    fields = lambda df: F.struct(*[c for c in df.columns if c != key])
    once = lambda df, value, seq: df.where(finite(value)).groupBy(key, value).agg(F.min_by(fields(df), seq).alias(f"_{value}"))
    log = lambda x: F.log(F.abs(F.col(x).cast("double")))
    a, h = once(areas, "area", "area_seq"), once(heights, "height", "height_seq")
    v = volumes.where(finite("volume")).select(key, "volume").distinct()
    edges = areas.where(finite("area")).where("area <> 0").groupBy(key).agg(F.min(log("area")).alias("_low"), F.max(log("area")).alias("_high"))
    ratio = log("volume") - log("height")
    fits = (ratio + math.log(1 + rel) + NEAR >= F.col("_low")) & (ratio + math.log(1 - rel) - NEAR <= F.col("_high"))
    asked = v.where("volume > 0").join(shuffled(h.where("height <> 0").join(shuffled(edges), key)), key).where(fits).drop("_low", "_high")
    bucket = lambda x: F.floor(x / width).cast("long")
    asked = asked.withColumn("_bucket", F.explode(F.array_distinct(F.array(*[bucket(ratio + math.log(f) + s) for f, s in ((1 - rel, -NEAR), (1, 0), (1 + rel, NEAR))]))))
    met = asked.join(shuffled(a.where("area <> 0").withColumn("_bucket", bucket(log("area")))), [key, "_bucket"])
    hit = met.where(F.abs(F.col("area") * F.col("height") - F.col("volume")) <= rel * F.col("volume")).select(key, "volume", "_area", "_height")

    ends = lambda df, value, seq: df.where(finite(value)).groupBy(key).agg(F.min_by(fields(df), seq).alias(f"_{value}"), F.min_by(fields(df), F.when(F.col(value) == 0, F.col(seq))).alias(f"_{value}_0"))
    zero = v.where("volume = 0").join(shuffled(ends(areas, "area", "area_seq")), key).join(shuffled(ends(heights, "height", "height_seq")), key)
    either = F.array(*[F.struct(F.col(x).alias("_area"), F.col(y).alias("_height")) for x, y in (("_area_0", "_height"), ("_area", "_height_0"))])
    zero = zero.select(key, "volume", F.explode(either).alias("x")).select(key, "volume", "x._area", "x._height").where("_area is not null and _height is not null")
    best = hit.unionByName(zero).groupBy(key, "volume").agg(F.min_by(F.struct("_area", "_height"), F.struct("_area.area_seq", "_height.height_seq")).alias("_b"))
    return volumes.join(shuffled(best), [key, "volume"]).select(*volumes.columns, "_b._area.*", "_b._height.*")


def volume_ratio(volumes: DataFrame, areas: DataFrame, floors: DataFrame, key: str, found: DataFrame, least: float = 2.8) -> DataFrame:
    """Objects without a row in found whose least volume by largest area and floors is under the least storey height.

    volumes: key, volume_seq, volume, from_table (a text may repeat a volume wrongly: where tables state one, only they
    count); areas: key, area_seq, area; floors: key, floors; found: what volume_method has given.
    """
    v = volumes.where("volume is not null").groupBy(key).agg(F.min(F.struct((~F.coalesce("from_table", F.lit(False))).alias("text"), "volume", "volume_seq")).alias("_v"))
    a = areas.where("area is not null").groupBy(key).agg(F.min(F.struct((-F.col("area")).alias("_a"), "area_seq", "area")).alias("_s"))
    f = floors.groupBy(key).agg(F.max("floors").alias("floors")).where("floors > 0")
    rest = v.join(shuffled(found.select(key).distinct()), key, "left_anti").join(shuffled(a), key).join(shuffled(f), key)
    rows = rest.select(key, "_v.volume_seq", "_s.area_seq", "_v.volume", "_s.area", "floors")
    return rows.where(F.try_divide(F.col("volume"), F.col("area") * F.col("floors")) < least)


def outside_range(values: DataFrame, limits: DataFrame, key: str, value: str, slack: float) -> DataFrame:
    """Values outside the range that other statements give. limits: key, value; one range a key."""
    edges = limits.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return values.join(edges, key).where((F.col(value) < F.col("low") - slack) | (F.col(value) > F.col("high") + slack))


def copied_label(labels: DataFrame, label: str, owner: str, order: str) -> DataFrame:
    """Labels that were used before by another owner: the first user owns a label."""
    owned = labels.groupBy(label).agg(F.min_by(owner, F.struct(order, owner)).alias("owned_by"))
    return labels.join(owned, label).where(F.col(owner) != F.col("owned_by"))


Check = Callable[..., DataFrame]
#: Checks by name; a new one is an entry here.
REGISTRY: dict[str, Check] = {
    "table_totals": table_totals,
    "first_disagreement": first_disagreement,
    "distinct_contradiction": distinct_contradiction,
    "site_vs_building": site_vs_building,
    "parameter_contradiction": parameter_contradiction,
    "smaller_than_axes": smaller_than_axes,
    "volume_method": volume_method,
    "volume_ratio": volume_ratio,
    "outside_range": outside_range,
    "copied_label": copied_label,
}


#: What a check's own plan or its data cause; anything else, as a lost executor or a full disk, stops the run.
BROKEN = (
    AnalysisException, ParseException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException,
    PySparkTypeError, PySparkValueError, PySparkAttributeError, ZeroDivisionError, TypeError, ValueError, KeyError, AttributeError,
)


def run_checks(jobs: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of what checks find. A check that can't be built, or that fails on its data, becomes a warning and stops no
    other: each is run by itself and what it finds is kept, so nothing runs twice. If all fail, the last failure is raised.
    """
    out, warnings, last = None, {}, None
    for name, job in jobs.items():
        try:
            found = kept(job())
        except BROKEN as e:
            warnings[name], last = f"{type(e).__name__}: {e}", e
            continue
        out = found if out is None else out.unionByName(found)
    if out is None and last is not None and len(jobs) > 1:
        raise last
    return out, warnings


def run_registered(inputs: dict[str, dict]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """What each check of the registry finds in its inputs (arguments by name of check), and warnings of those that fail."""
    found, warnings = {}, {}
    for name, arguments in inputs.items():
        one, failed = run_checks({name: lambda name=name, arguments=arguments: REGISTRY[name](**arguments)})
        warnings |= failed
        if one is not None:
            found[name] = one
    return found, warnings
