"""Component-group operators on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.measures import as_measures, histogram_rows
from faultline.operators import taxonomy as ops
from faultline.operators.profile import component_rows, profile_scalars
from faultline.plans.checks import views
from faultline.plans.checks.registry import check
from faultline.plans.checks.views import BASE, BREAKDOWN, sql_slug

TOTALS = (*BASE, "group_totals")


def _measures(spark, sf_dir):
    return as_measures(views.reports(spark, sf_dir))


def _totals(spark, sf_dir):
    return ops.group_totals(_measures(spark, sf_dir))


@check("SELECT component_group, complaint_count, with_mileage FROM group_totals", TOTALS)
def taxonomy(spark, sf_dir):
    return _totals(spark, sf_dir).select("component_group", "complaint_count", "with_mileage")


@check(
    """
SELECT g.component_group, b.bin AS bin, b.bin * 25000 AS miles_from,
       CASE WHEN b.bin < 10 THEN (b.bin + 1) * 25000 END AS miles_to,
       (SELECT count(*) FROM reports r WHERE r.component_group = g.component_group AND r.bin = b.bin)
           AS count
FROM group_totals g, bins b
""",
    (*TOTALS, "bins"),
)
def taxonomy_histogram(spark, sf_dir):
    return histogram_rows(_totals(spark, sf_dir), "component_group")


@check("SELECT DISTINCT component_group, top_level FROM reports WHERE top_level IS NOT NULL")
def taxonomy_top_levels(spark, sf_dir):
    return ops.group_top_levels(_measures(spark, sf_dir))


_TOP_MAKES = """
SELECT * FROM (
    SELECT component_group, make, count(*) AS count, CAST(row_number() OVER (
               PARTITION BY component_group ORDER BY count(*) DESC, make) AS INT) AS position
    FROM reports GROUP BY component_group, make) WHERE position <= 12
"""
_TOP_VEHICLES = """
SELECT component_group, position, vehicle_key, make, model, model_year, make_slug, model_slug, n AS count,
       total_complaints
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY component_group ORDER BY n DESC, vehicle_key) AS INT)
             AS position FROM breakdown)
JOIN profiles USING (vehicle_key) WHERE position <= 12
"""


@check(_TOP_MAKES)
def taxonomy_top_makes(spark, sf_dir):
    return ops.group_top_makes(_measures(spark, sf_dir))


@check(
    f"""
SELECT component_group, position, vehicle_key, make, model, model_year, count, total_complaints
FROM ({_TOP_VEHICLES})
""",
    BREAKDOWN,
)
def taxonomy_top_vehicles(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.group_top_vehicles(component_rows(measures), profile_scalars(measures))


@check(
    f"""
SELECT g.component_group, complaint_count, with_mileage,
       (SELECT count(DISTINCT top_level) FROM reports r WHERE r.component_group = g.component_group)
           AS levels,
       m.make AS leading_make, m.count AS leading_make_count,
       v.vehicle_key AS leading_vehicle, v.count AS leading_vehicle_count
FROM group_totals g
LEFT JOIN ({_TOP_MAKES}) m ON m.component_group = g.component_group AND m.position = 1
LEFT JOIN ({_TOP_VEHICLES}) v ON v.component_group = g.component_group AND v.position = 1
""",
    (*BREAKDOWN, "group_totals"),
)
def taxonomy_table(spark, sf_dir):
    """The nested component table, summarised from its arrays."""
    measures = _measures(spark, sf_dir)
    nested = ops.component_taxonomy(measures, component_rows(measures), profile_scalars(measures))
    make, vehicle = F.get("top_makes", F.lit(0)), F.get("top_vehicles", F.lit(0))
    return nested.select(
        "component_group", "complaint_count", "with_mileage",
        F.size("top_levels").cast("bigint").alias("levels"),
        make["make"].alias("leading_make"), make["count"].alias("leading_make_count"),
        vehicle["vehicle_key"].alias("leading_vehicle"),
        vehicle["count"].alias("leading_vehicle_count"),
    )


@check(
    f"SELECT component_group, {sql_slug('component_group')} AS slug, complaint_count FROM group_totals",
    TOTALS,
)
def group_ranking(spark, sf_dir):
    return ops.group_ranking(_totals(spark, sf_dir))


@check(
    f"""
SELECT component_group, {sql_slug('component_group')} AS slug, complaint_count, with_mileage
FROM group_totals WHERE {sql_slug('component_group')} IN (
    SELECT {sql_slug("concat(substr(o_orderpriority, 3), ' train')")} FROM orders
    UNION SELECT {sql_slug("p_name")} FROM part UNION SELECT 'power-train' FROM region
    UNION SELECT 'air-bags' FROM region)
""",
    TOTALS,
)
def group_detail(spark, sf_dir):
    """Groups asked for by slug; most of the asked slugs do not exist."""
    orders, part = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "part")
    region = views.table(spark, sf_dir, "region")
    asked = (
        orders.select(ops.slug(F.expr("concat(substr(o_orderpriority, 3), ' train')")).alias("slug"))
        .union(part.select(ops.slug(F.col("p_name"))))
        .union(region.select(F.explode(F.array(F.lit("power-train"), F.lit("air-bags")))))
    )
    return ops.group_by_slug(_totals(spark, sf_dir), asked).select(
        "component_group", "slug", "complaint_count", "with_mileage"
    )


@check(
    """
SELECT vehicle_key, component_group, n AS count, total_complaints,
       n * 100::DOUBLE / total_complaints AS share
FROM breakdown JOIN profiles USING (vehicle_key)
""",
    BREAKDOWN,
)
def group_share(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.vehicle_group_share(component_rows(measures), profile_scalars(measures))


@check(
    f"""
SELECT component_group, {sql_slug('component_group')} AS slug, complaint_count,
       complaint_count * 100::DOUBLE / sum(complaint_count) OVER () AS share,
       CAST(round(complaint_count * 100::DOUBLE / max(complaint_count) OVER ()) AS INT) AS width,
       CAST(round(sum(CASE WHEN position <= 5 THEN complaint_count END) OVER () * 100::DOUBLE
                  / sum(complaint_count) OVER ()) AS INT) AS leading_share
FROM (SELECT *, row_number() OVER (ORDER BY complaint_count DESC, component_group) AS position
      FROM group_totals)
""",
    TOTALS,
)
def component_index(spark, sf_dir):
    return ops.group_index(_totals(spark, sf_dir))


@check(
    """
SELECT component_group, complaint_count, with_mileage, early_share, high_share, mileage_coverage,
       peak_bin, CASE peak_bin WHEN 10 THEN '250k+'
                 ELSE concat(peak_bin * 25, '–', (peak_bin + 1) * 25, 'k') END AS peak_label,
       CASE WHEN early_share >= 30 THEN 'near' WHEN high_share >= 30 THEN 'far' ELSE 'broad' END AS shape,
       with_mileage BETWEEN 1 AND 199 AS thin_sample
FROM (SELECT component_group, count(*) AS complaint_count, count(miles) AS with_mileage,
             count(*) FILTER (bin = 0) * 100::DOUBLE / count(miles) AS early_share,
             count(*) FILTER (bin >= 4) * 100::DOUBLE / count(miles) AS high_share,
             count(miles) * 100::DOUBLE / count(*) AS mileage_coverage
      FROM reports GROUP BY component_group)
JOIN (SELECT component_group, arg_min(bin, (-n, bin)) AS peak_bin
      FROM (SELECT component_group, bin, count(*) AS n FROM reports WHERE bin IS NOT NULL GROUP BY ALL)
      GROUP BY component_group) USING (component_group)
"""
)
def component_shape(spark, sf_dir):
    return ops.group_shape(_totals(spark, sf_dir))


@check(
    f"""
SELECT m.component_group, position, make, {sql_slug('make')} AS make_slug, count,
       count * 100::DOUBLE / complaint_count AS group_share,
       CAST(round(count * 100::DOUBLE / max(count) OVER (PARTITION BY m.component_group)) AS INT) AS width
FROM ({_TOP_MAKES}) m JOIN group_totals USING (component_group)
""",
    TOTALS,
)
def group_make_shares(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.group_make_shares(ops.group_top_makes(measures), ops.group_totals(measures))


@check(
    f"""
SELECT v.component_group, position, vehicle_key, make_slug, model_slug, model_year, count,
       count * 100::DOUBLE / complaint_count AS group_share,
       count * 100::DOUBLE / total_complaints AS vehicle_share,
       CAST(round(count * 100::DOUBLE / max(count) OVER (PARTITION BY v.component_group)) AS INT) AS width
FROM ({_TOP_VEHICLES}) v JOIN group_totals USING (component_group)
""",
    (*BREAKDOWN, "group_totals"),
)
def group_vehicle_shares(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    winners = ops.group_top_vehicles(component_rows(measures), profile_scalars(measures))
    return ops.group_vehicle_shares(winners, ops.group_totals(measures))
