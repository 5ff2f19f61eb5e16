"""Profile operators on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import measures
from faultline.functions.measures import as_measures, histogram_rows
from faultline.operators import profile as ops
from faultline.plans.checks import views
from faultline.plans.checks.registry import check
from faultline.plans.checks.views import BREAKDOWN, HISTOGRAM, PROFILES, TIMELINE


def _measures(spark, sf_dir):
    return as_measures(views.reports(spark, sf_dir))


def _profiles(spark, sf_dir):
    return ops.profile_scalars(_measures(spark, sf_dir))


@check(
    """
SELECT vehicle_key, min(make) AS make, min(model) AS model, min(model_year) AS model_year,
       count(*) AS total_complaints, count(miles) AS with_mileage,
       CAST(round_even(sum(miles)::DOUBLE / nullif(count(miles), 0), 0) AS INT) AS average_miles_at_failure,
       CAST(sum(crash) AS BIGINT) AS crashes, CAST(sum(fire) AS BIGINT) AS fires,
       CAST(sum(injured) AS BIGINT) AS injured, CAST(sum(deaths) AS BIGINT) AS deaths,
       CAST(sum(police_report) AS BIGINT) AS police_reports,
       CAST(sum(vehicle_towed) AS BIGINT) AS vehicles_towed,
       CAST(sum(medical_attention) AS BIGINT) AS medical_attention
FROM reports WHERE model_year IS NOT NULL GROUP BY vehicle_key
"""
)
def profile_scalars(spark, sf_dir):
    return _profiles(spark, sf_dir).drop(*[f"bin_{i}" for i in range(11)])


@check(
    """
SELECT vehicle_key, with_mileage, b.bin AS bin, b.bin * 25000 AS miles_from,
       CASE WHEN b.bin < 10 THEN (b.bin + 1) * 25000 END AS miles_to,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM histogram h
        WHERE h.vehicle_key = p.vehicle_key AND h.bin = b.bin) AS count
FROM profiles p, bins b
""",
    HISTOGRAM,
)
def profile_histogram(spark, sf_dir):
    return histogram_rows(_profiles(spark, sf_dir), "vehicle_key", "with_mileage")


@check("SELECT vehicle_key, component_group, n AS count FROM breakdown", BREAKDOWN)
def profile_components(spark, sf_dir):
    return ops.component_rows(_measures(spark, sf_dir))


@check("SELECT vehicle_key, year, n AS count FROM timeline", TIMELINE)
def profile_timeline(spark, sf_dir):
    return ops.timeline_rows(_measures(spark, sf_dir))


@check(
    """
SELECT vehicle_key, signal, label, n AS count, critical, critical AND n > 0 AS highlighted,
       deaths > 0 OR fires > 0 AS severe_outcome, total_complaints
FROM signals JOIN (SELECT vehicle_key, deaths, fires FROM profiles) USING (vehicle_key)
""",
    (*PROFILES, "signals"),
)
def profile_severity(spark, sf_dir):
    return ops.severity_summary(_profiles(spark, sf_dir))


@check(
    """
SELECT vehicle_key, make, model, model_year, component_group, top_level, received_year,
       count(*) AS complaints, count(miles) AS with_mileage,
       coalesce(sum(miles), 0)::BIGINT AS mileage_total, sum(injured)::BIGINT AS injured,
       count(*) FILTER (bin = 0) AS bin_0, count(*) FILTER (bin = 10) AS bin_10
FROM reports GROUP BY ALL
"""
)
def report_cells(spark, sf_dir):
    return measures.report_cells(views.reports(spark, sf_dir)).select(
        *measures.DIMENSIONS, "complaints", "with_mileage", "mileage_total", "injured", "bin_0", "bin_10"
    )


@check(
    """
SELECT vehicle_key, p.total_complaints, p.with_mileage, p.crashes,
       t.years, t.first_year, t.received, b.groups, b.leading_group, b.leading_count
FROM profiles p
JOIN (SELECT vehicle_key, count(*) AS years, min(year) AS first_year, sum(n)::BIGINT AS received
      FROM timeline GROUP BY vehicle_key) t USING (vehicle_key)
JOIN (SELECT vehicle_key, count(*) AS groups, max(n) AS leading_count,
             arg_min(component_group, (-n, component_group)) AS leading_group
      FROM breakdown GROUP BY vehicle_key) b USING (vehicle_key)
""",
    (*BREAKDOWN, "timeline"),
)
def profile_table(spark, sf_dir):
    """The nested profile table, summarised from its arrays."""
    nested = ops.vehicle_profiles(_measures(spark, sf_dir))
    return nested.select(
        "vehicle_key", "total_complaints", "with_mileage", F.col("severity.crashes").alias("crashes"),
        F.size("timeline").cast("bigint").alias("years"),
        F.col("timeline")[0]["year"].alias("first_year"),
        F.aggregate("timeline", F.lit(0).cast("bigint"), lambda n, e: n + e["count"]).alias("received"),
        F.size("components").cast("bigint").alias("groups"),
        F.col("components")[0]["group"].alias("leading_group"),
        F.col("components")[0]["count"].alias("leading_count"),
    )


@check(
    """
SELECT vehicle_key, total_complaints, with_mileage
FROM profiles p
WHERE EXISTS (SELECT 1 FROM orders, parts r
              WHERE o_orderkey = r.p_partkey
                AND p.vehicle_key = concat(r.make_slug, '|', r.model_slug, '|', year(o_orderdate)))
""",
    PROFILES,
)
def profile_by_key(spark, sf_dir):
    """Profiles of a request list: every part, for the year of the order with its number."""
    parts, orders = views.parts(spark, sf_dir), views.table(spark, sf_dir, "orders")
    keys = parts.join(orders, F.col("p_partkey") == F.col("o_orderkey")).select(
        F.concat_ws("|", "make_slug", "model_slug", F.year("o_orderdate").cast("string")).alias(
            "vehicle_key"
        )
    )
    return ops.profiles_by_key(_profiles(spark, sf_dir), keys).select(
        "vehicle_key", "total_complaints", "with_mileage"
    )


@check(
    """
SELECT vehicle_key, position, received_date, l_orderkey, l_linenumber, l_partkey, miles,
       component_group
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vehicle_key ORDER BY received_date DESC,
             l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS position
      FROM reports)
WHERE position <= 6
"""
)
def recent_reports(spark, sf_dir):
    tie = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    keep = ["received_date", "l_orderkey", "l_linenumber", "l_partkey", "miles_at_failure", "component"]
    return ops.recent_reports(views.reports(spark, sf_dir), keep, tie).select(
        "vehicle_key", "position", "received_date", "l_orderkey", "l_linenumber", "l_partkey",
        F.col("miles_at_failure").alias("miles"), F.col("component.group").alias("component_group"),
    )


@check(
    """
SELECT s.vehicle_key, s.year, coalesce(t.n, 0) AS count,
       CAST(round(coalesce(t.n, 0) * 100::DOUBLE / s.scale) AS INT) AS width, s.year = s.peak AS is_peak
FROM (SELECT vehicle_key, max(n) AS scale, arg_min(year, (-n, year)) AS peak,
             CAST(unnest(range(min(year), max(year) + 1)) AS INT) AS year
      FROM timeline GROUP BY vehicle_key) s
LEFT JOIN timeline t ON t.vehicle_key = s.vehicle_key AND t.year = s.year
""",
    TIMELINE,
)
def timeline_dense(spark, sf_dir):
    return ops.dense_timeline(ops.timeline_rows(_measures(spark, sf_dir)))


@check(
    """
SELECT vehicle_key, arg_min(year, (-n, year)) AS peak_year, max(n) AS peak_count,
       min(year) AS first_year, max(year) AS last_year, max(year) = 2001 AS last_year_is_partial
FROM timeline GROUP BY vehicle_key
""",
    TIMELINE,
)
def timeline_peak(spark, sf_dir):
    today = F.to_date(F.lit("2001-08-01"))
    return ops.timeline_peaks(ops.timeline_rows(_measures(spark, sf_dir)), today)


@check(
    """
SELECT b.vehicle_key, component_group, n AS count,
       CAST(row_number() OVER (PARTITION BY b.vehicle_key ORDER BY n DESC, component_group) AS INT)
           AS position,
       n * 100::DOUBLE / total_complaints AS share,
       CAST(round(n * 100::DOUBLE / total_complaints) AS INT) AS share_label,
       CAST(round(n * 100::DOUBLE / max(n) OVER (PARTITION BY b.vehicle_key)) AS INT) AS width,
       total_complaints, CAST(sum(n) OVER (PARTITION BY b.vehicle_key) AS BIGINT) AS classified
FROM breakdown b JOIN profiles USING (vehicle_key)
""",
    BREAKDOWN,
)
def component_shares(spark, sf_dir):
    rows = _measures(spark, sf_dir)
    return ops.component_shares(ops.component_rows(rows), ops.profile_scalars(rows))


@check(
    """
SELECT vehicle_key, bin, bin * 25000 AS miles_from,
       CASE WHEN bin < 10 THEN (bin + 1) * 25000 END AS miles_to, n AS count, with_mileage,
       CASE WHEN with_mileage > 0 THEN n * 100::DOUBLE / with_mileage ELSE 0 END AS share,
       CAST(round(CASE WHEN with_mileage > 0 THEN n * 100::DOUBLE / with_mileage ELSE 0 END) AS INT)
           AS share_label,
       CAST(CASE WHEN top > 0 THEN round(n * 100::DOUBLE / top) ELSE 0 END AS INT) AS width,
       with_mileage BETWEEN 1 AND 19 AS thin_sample
FROM (SELECT p.vehicle_key, b.bin, p.with_mileage, coalesce(h.n, 0) AS n,
             max(coalesce(h.n, 0)) OVER (PARTITION BY p.vehicle_key) AS top
      FROM profiles p CROSS JOIN bins b
      LEFT JOIN histogram h ON h.vehicle_key = p.vehicle_key AND h.bin = b.bin)
""",
    HISTOGRAM,
)
def histogram_shares(spark, sf_dir):
    return ops.histogram_shares(_profiles(spark, sf_dir))


@check(
    """
SELECT p.vehicle_key, make, model, model_year, total_complaints, with_mileage,
       with_mileage * 100::DOUBLE / total_complaints AS mileage_share,
       CAST(round_even(avg_miles, 0) AS INT) AS average_miles_at_failure,
       (SELECT count(*) FROM breakdown b WHERE b.vehicle_key = p.vehicle_key) AS component_groups,
       (SELECT min(year) FROM timeline t WHERE t.vehicle_key = p.vehicle_key) AS first_report_year,
       (SELECT max(year) FROM timeline t WHERE t.vehicle_key = p.vehicle_key) AS last_report_year,
       total_complaints < 25 AS small_sample, with_mileage < 20 AS thin_mileage
FROM profiles p
JOIN (SELECT vehicle_key, sum(miles)::DOUBLE / nullif(count(miles), 0) AS avg_miles
      FROM reports GROUP BY vehicle_key) m USING (vehicle_key)
""",
    (*BREAKDOWN, "timeline"),
)
def profile_summary(spark, sf_dir):
    rows = _measures(spark, sf_dir)
    return ops.profile_summary(ops.profile_scalars(rows), ops.component_rows(rows), ops.timeline_rows(rows))


