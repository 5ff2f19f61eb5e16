"""Recall operators on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import recalls as ops
from faultline.plans.checks import views
from faultline.plans.checks.registry import check
from faultline.plans.checks.views import RECALL_ROW, RECALLS

ROW = ", ".join(RECALL_ROW)
NEWEST = f"report_received_date DESC NULLS LAST, {ROW}"


def _order():
    return [F.col(name) for name in RECALL_ROW]


def _rank():
    """Tie-breaks for 'newest wins' where the earlier row counts as newer."""
    return [(-F.col(name)).alias(name) for name in RECALL_ROW]


@check(
    f"""
SELECT vehicle_key, campaign_number, report_received_date, component_group, do_not_drive, park_outside,
       potentially_affected
FROM recalls ORDER BY vehicle_key, {NEWEST}
""",
    RECALLS,
)
def vehicle_recalls(spark, sf_dir):
    keep = [
        "campaign_number", "report_received_date", "component_group", "do_not_drive", "park_outside",
        "potentially_affected",
    ]
    return ops.vehicle_recalls(views.recalls(spark, sf_dir), keep, _order())


@check(
    f"""
SELECT f.campaign_number, manufacturer, component_name, component_group, defect_description, consequence,
       corrective_action, report_received_date, owners_notified_date, a.do_not_drive, a.park_outside,
       a.potentially_affected, a.vehicle_count
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_number ORDER BY {ROW}, component_name,
                                   report_received_date) AS rn FROM recalls) f
JOIN (SELECT campaign_number, bool_or(do_not_drive) AS do_not_drive,
             bool_or(park_outside) AS park_outside, max(potentially_affected) AS potentially_affected,
             count(DISTINCT vehicle_key) AS vehicle_count
      FROM recalls GROUP BY campaign_number) a ON a.campaign_number = f.campaign_number
WHERE rn = 1
""",
    RECALLS,
)
def campaign_detail(spark, sf_dir):
    return ops.campaign_detail(views.recalls(spark, sf_dir), _order())


_CAMPAIGN_VEHICLES = """
SELECT campaign_number, CAST(row_number() OVER (PARTITION BY campaign_number ORDER BY make, model,
           model_year DESC NULLS LAST, vehicle_key) AS INT) AS position,
       make, model, model_year, vehicle_key, split_part(vehicle_key, '|', 1) AS make_slug,
       split_part(vehicle_key, '|', 2) AS model_slug
FROM (SELECT campaign_number, vehicle_key, min(make) AS make, min(model) AS model,
             min(model_year) AS model_year
      FROM recalls GROUP BY campaign_number, vehicle_key)
"""


@check(_CAMPAIGN_VEHICLES, RECALLS)
def campaign_vehicles(spark, sf_dir):
    return ops.campaign_vehicles(views.recalls(spark, sf_dir))


@check(
    f"""
SELECT campaign_number, model_row, make, model,
       CAST(row_number() OVER (PARTITION BY campaign_number, make, model
                               ORDER BY model_year DESC NULLS LAST, vehicle_key) AS INT) AS year_position,
       model_year, vehicle_key
FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY campaign_number ORDER BY make, model) AS INT)
                    AS model_row
      FROM ({_CAMPAIGN_VEHICLES}))
""",
    RECALLS,
)
def recall_coverage(spark, sf_dir):
    return ops.recall_coverage(ops.campaign_vehicles(views.recalls(spark, sf_dir)))


@check(
    """
SELECT campaign_number, min(make) AS make, min(component_name) AS component_name,
       bool_or(do_not_drive) AS do_not_drive, bool_or(park_outside) AS park_outside,
       max(report_received_date) AS report_received_date, count(DISTINCT vehicle_key) AS vehicle_count
FROM recalls WHERE do_not_drive OR park_outside GROUP BY campaign_number
ORDER BY max(report_received_date) DESC NULLS LAST, campaign_number LIMIT 5
""",
    RECALLS,
)
def latest_advisories(spark, sf_dir):
    return ops.latest_advisories(views.recalls(spark, sf_dir))


_FIRST = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_key, upper(campaign_number)
                                            ORDER BY {NEWEST}, campaign_number DESC) AS rn FROM recalls)
WHERE rn = 1
"""


@check(
    f"""
SELECT vehicle_key, count(*) AS campaign_count, count(*) FILTER (do_not_drive) AS do_not_drive_count,
       count(*) FILTER (park_outside) AS park_outside_count,
       count(*) FILTER (do_not_drive OR park_outside) AS urgent_count,
       count(DISTINCT upper(component_group)) AS group_count,
       CAST(min(year(report_received_date)) AS INT) AS earliest_year,
       CAST(max(year(report_received_date)) AS INT) AS latest_year
FROM ({_FIRST}) GROUP BY vehicle_key
""",
    RECALLS,
)
def recall_summary(spark, sf_dir):
    return ops.recall_summary(views.recalls(spark, sf_dir), _rank())


@check(
    f"SELECT vehicle_key, campaign_number FROM ({_FIRST}) WHERE do_not_drive OR park_outside", RECALLS
)
def urgent_campaigns(spark, sf_dir):
    return ops.urgent_campaigns(views.recalls(spark, sf_dir), _rank())


@check(
    f"""
SELECT vehicle_key, min(component_group) AS component_group, count(*) AS campaign_count
FROM ({_FIRST}) GROUP BY vehicle_key, upper(component_group)
""",
    RECALLS,
)
def recall_groups(spark, sf_dir):
    return ops.recall_groups(views.recalls(spark, sf_dir), _rank())


@check(
    f"""
SELECT vehicle_key, campaign_number,
       CAST(row_number() OVER (PARTITION BY vehicle_key ORDER BY do_not_drive OR park_outside DESC,
            report_received_date DESC NULLS LAST, campaign_number) AS INT) AS position,
       component_group, component_names, component_name_count, report_received_date,
       potentially_affected, do_not_drive, park_outside, do_not_drive OR park_outside AS urgent,
       CASE WHEN do_not_drive AND park_outside THEN 'do not drive, and park outside'
            WHEN do_not_drive THEN 'do not drive' WHEN park_outside THEN 'park outside'
            ELSE 'none' END AS advisory
FROM (SELECT vehicle_key, campaign_number, max(report_received_date) AS report_received_date,
             max(potentially_affected) AS potentially_affected, bool_or(do_not_drive) AS do_not_drive,
             bool_or(park_outside) AS park_outside,
             string_agg(DISTINCT component_name, ' / ' ORDER BY component_name) AS component_names,
             count(DISTINCT component_name) AS component_name_count
      FROM recalls GROUP BY vehicle_key, campaign_number)
JOIN (SELECT vehicle_key, campaign_number, component_group
      FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_key, campaign_number
                                         ORDER BY {NEWEST}) AS rn FROM recalls) WHERE rn = 1)
USING (vehicle_key, campaign_number)
""",
    RECALLS,
)
def recall_fold(spark, sf_dir):
    folded = ops.recall_fold(views.recalls(spark, sf_dir), _rank())
    return folded.withColumns(
        {
            "component_name_count": F.size("component_names").cast("bigint"),
            "component_names": F.array_join("component_names", " / "),
        }
    )


@check(
    f"""
SELECT campaign_number, count(DISTINCT make) AS makes, count(DISTINCT (make, model)) AS models,
       count(*) AS years
FROM ({_CAMPAIGN_VEHICLES}) GROUP BY campaign_number
""",
    RECALLS,
)
def recall_coverage_nested(spark, sf_dir):
    """Coverage nested as makes > models > years, counted from its arrays."""
    coverage = ops.covered_vehicles(views.recalls(spark, sf_dir))
    zero = F.lit(0).cast("bigint")
    return ops.nested_coverage(coverage).select(
        "campaign_number",
        F.size("makes").cast("bigint").alias("makes"),
        F.aggregate("makes", zero, lambda n, m: n + F.size(m["models"])).alias("models"),
        F.aggregate(
            "makes", zero,
            lambda n, m: n + F.aggregate(m["models"], zero, lambda k, r: k + F.size(r["years"])),
        ).alias("years"),
    )
