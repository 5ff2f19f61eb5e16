"""Catalogue operators on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.measures import as_measures
from faultline.operators import catalog as ops
from faultline.operators.profile import profile_scalars
from faultline.operators.taxonomy import group_totals
from faultline.plans.checks import views
from faultline.plans.checks.registry import check
from faultline.plans.checks.views import PROFILES


def _measures(spark, sf_dir):
    return as_measures(views.reports(spark, sf_dir))


def _vehicles(spark, sf_dir):
    return ops.vehicle_entries(_measures(spark, sf_dir))


@check(
    """
SELECT vehicle_key, make, make_slug, model, model_slug, model_year,
       total_complaints AS complaint_count FROM profiles
""",
    PROFILES,
)
def catalog(spark, sf_dir):
    return _vehicles(spark, sf_dir)


@check(
    """
SELECT p.vehicle_key, total_complaints AS complaint_count, coalesce(recall_count, 0) AS recall_count
FROM profiles p
LEFT JOIN (SELECT vehicle_key, count(DISTINCT campaign_number) AS recall_count
           FROM recalls GROUP BY vehicle_key) r USING (vehicle_key)
""",
    (*PROFILES, "recalls"),
)
def catalog_recall_counts(spark, sf_dir):
    return ops.vehicle_catalog(_measures(spark, sf_dir), views.recalls(spark, sf_dir)).select(
        "vehicle_key", "complaint_count", "recall_count"
    )


_OVERVIEW = """
SELECT (SELECT count(*) FROM reports) AS complaints, (SELECT count(*) FROM recalls) AS recalls,
       count(*) AS vehicles, sum(total_complaints)::BIGINT AS complaints_in_catalogue,
       count(DISTINCT make) AS makes, (SELECT count(DISTINCT make) FROM reports) AS canonical_makes,
       sum(with_mileage)::BIGINT AS complaints_with_mileage, min(model_year) AS earliest_model_year,
       max(model_year) AS latest_model_year
FROM profiles
"""


def _overview(spark, sf_dir):
    reports = views.reports(spark, sf_dir)
    measures = as_measures(reports)
    return ops.overview(
        spark, reports, views.recalls(spark, sf_dir), ops.vehicle_entries(measures),
        profile_scalars(measures),
    )


@check(_OVERVIEW, (*PROFILES, "recalls"))
def overview(spark, sf_dir):
    return _overview(spark, sf_dir)


@check(
    f"""
SELECT complaints - complaints_in_catalogue AS without_model_year,
       canonical_makes - makes AS makes_outside_catalogue,
       complaints_with_mileage * 100::DOUBLE / complaints AS mileage_coverage
FROM ({_OVERVIEW})
""",
    (*PROFILES, "recalls"),
)
def coverage_gap(spark, sf_dir):
    return ops.coverage_gap(_overview(spark, sf_dir))


@check("SELECT make_slug, make, complaint_count, model_count FROM makes", (*PROFILES, "makes"))
def make_ranking(spark, sf_dir):
    return ops.make_ranking(_vehicles(spark, sf_dir))


@check(
    """
SELECT *, complaint_count * 100::DOUBLE / make_complaint_count AS share
FROM (SELECT make_slug, model_slug, min(make) AS make, min(model) AS model,
             sum(total_complaints)::BIGINT AS complaint_count, min(model_year) AS earliest_model_year,
             max(model_year) AS latest_model_year,
             CAST(sum(sum(total_complaints)) OVER (PARTITION BY make_slug) AS BIGINT)
                 AS make_complaint_count,
             min(min(model_year)) OVER (PARTITION BY make_slug) AS make_earliest_year,
             max(max(model_year)) OVER (PARTITION BY make_slug) AS make_latest_year
      FROM profiles GROUP BY make_slug, model_slug)
""",
    PROFILES,
)
def make_models(spark, sf_dir):
    return ops.make_models(_vehicles(spark, sf_dir))


@check(
    """
SELECT make_slug, model_slug, model_year, vehicle_key, total_complaints AS complaint_count FROM profiles
""",
    PROFILES,
)
def model_years(spark, sf_dir):
    return ops.model_years(_vehicles(spark, sf_dir))


@check(
    """
SELECT r.make_slug, r.model_slug, r.model_year, p.vehicle_key, p.make, p.model
FROM (SELECT DISTINCT q.make_slug, q.model_slug, CAST(year(o_orderdate) + 3 AS INT) AS model_year
      FROM parts q JOIN orders ON o_orderkey = p_partkey) r
LEFT JOIN profiles p ON p.vehicle_key = concat(r.make_slug, '|', r.model_slug, '|', r.model_year)
""",
    PROFILES,
)
def resolve_vehicles(spark, sf_dir):
    """Requests reach three years ahead, so some of them have no vehicle."""
    parts, orders = views.parts(spark, sf_dir), views.table(spark, sf_dir, "orders")
    requests = (
        parts.join(orders, F.col("p_partkey") == F.col("o_orderkey"))
        .select("make_slug", "model_slug", (F.year("o_orderdate") + 3).alias("model_year"))
        .distinct()
    )
    return ops.resolve_vehicles(requests, _vehicles(spark, sf_dir))


@check(
    """
SELECT vehicle_key, make, make_slug, model, model_slug, model_year, total_complaints, with_mileage
FROM profiles ORDER BY total_complaints DESC, vehicle_key LIMIT 10
""",
    PROFILES,
)
def most_reported(spark, sf_dir):
    return ops.most_reported(profile_scalars(_measures(spark, sf_dir)))


@check(
    """
SELECT make_slug, make, complaint_count, model_count,
       CASE WHEN complaint_count >= 1600 THEN 'leader' ELSE 'tail' END AS tier,
       complaint_count < 1300 AS single_figure,
       complaint_count * 100::DOUBLE / sum(complaint_count) OVER () AS share
FROM makes
""",
    (*PROFILES, "makes"),
)
def make_tiers(spark, sf_dir):
    """Thresholds are set where the stand-in makes, which are all of similar size, fall apart."""
    return ops.make_tiers(_vehicles(spark, sf_dir), leader_from=1600, single_figure_below=1300)


@check(
    """
SELECT count(*) AS total_makes, sum(complaint_count)::BIGINT AS total_complaints,
       count(*) FILTER (complaint_count >= 1600) AS leaders,
       count(*) FILTER (complaint_count < 1300) AS single_figure_makes,
       coalesce(sum(complaint_count) FILTER (complaint_count >= 1600), 0)::BIGINT AS leader_complaints,
       coalesce(sum(complaint_count) FILTER (complaint_count >= 1600), 0) * 100::DOUBLE
           / sum(complaint_count) AS leader_share
FROM makes
""",
    (*PROFILES, "makes"),
)
def make_index_summary(spark, sf_dir):
    return ops.make_index_summary(_vehicles(spark, sf_dir), leader_from=1600, single_figure_below=1300)


@check(
    """
SELECT make_slug, make, complaint_count,
       round(complaint_count * 100::DOUBLE / (SELECT max(complaint_count) FROM makes), 1) AS bar_width
FROM makes ORDER BY complaint_count DESC, make_slug LIMIT 12
""",
    (*PROFILES, "makes"),
)
def top_makes(spark, sf_dir):
    return ops.top_makes(_vehicles(spark, sf_dir))


@check(
    "SELECT make_slug, make, complaint_count FROM makes WHERE complaint_count >= 1500",
    (*PROFILES, "makes"),
)
def frequent_makes(spark, sf_dir):
    return ops.frequent_makes(_vehicles(spark, sf_dir), at_least=1500)


@check(
    """
SELECT component_group, complaint_count,
       round(complaint_count * 100::DOUBLE / (SELECT max(complaint_count) FROM group_totals), 1)
           AS bar_width,
       complaint_count * 100::DOUBLE / (SELECT count(*) FROM reports) AS dataset_share
FROM group_totals ORDER BY complaint_count DESC, component_group LIMIT 10
""",
    ("parts", "reports", "group_totals"),
)
def top_groups(spark, sf_dir):
    reports = views.reports(spark, sf_dir)
    return ops.top_groups(group_totals(as_measures(reports)), reports.agg(F.count("*")))
