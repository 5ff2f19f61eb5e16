"""Comparison operators on the stand-in tables.

Every vehicle is compared with the next model year of its model, and the last year with itself.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions.measures import as_measures
from faultline.operators import compare as ops
from faultline.operators.catalog import vehicle_entries
from faultline.operators.profile import component_rows, profile_scalars
from faultline.plans.checks import views
from faultline.plans.checks.registry import check
from faultline.plans.checks.views import BREAKDOWN, HISTOGRAM, PROFILES

_PAIRS = """
SELECT vehicle_key AS pair_id, vehicle_key AS key_a,
       coalesce(lead(vehicle_key) OVER (PARTITION BY make_slug, model_slug ORDER BY model_year),
                vehicle_key) AS key_b
FROM profiles
"""
views.SQL_VIEWS["pairs"] = _PAIRS
views.SQL_VIEWS["sides"] = """
SELECT pair_id, 'a' AS side, key_a AS vehicle_key FROM pairs
UNION ALL SELECT pair_id, 'b', key_b FROM pairs
"""


def _measures(spark, sf_dir):
    return as_measures(views.reports(spark, sf_dir))


def _pairs(measures):
    following = Window.partitionBy("make_slug", "model_slug").orderBy("model_year")
    later = F.coalesce(F.lead("vehicle_key").over(following), F.col("vehicle_key"))
    return vehicle_entries(measures).select(
        F.col("vehicle_key").alias("pair_id"), F.col("vehicle_key").alias("key_a"), later.alias("key_b")
    )


@check(
    """
WITH ranked AS (
    SELECT *, row_number() OVER (PARTITION BY vehicle_key ORDER BY n DESC, component_group) AS rank
    FROM breakdown),
grouped AS (
    SELECT pair_id, component_group, min(rank) > 8 AS is_remainder,
           coalesce(sum(n) FILTER (side = 'a'), 0) AS a, coalesce(sum(n) FILTER (side = 'b'), 0) AS b
    FROM sides JOIN ranked USING (vehicle_key) GROUP BY pair_id, component_group),
labelled AS (
    SELECT pair_id, CASE WHEN is_remainder THEN 'All other groups' ELSE component_group END AS label,
           is_remainder, sum(a)::BIGINT AS count_a, sum(b)::BIGINT AS count_b
    FROM grouped GROUP BY ALL),
shared AS (
    SELECT l.*, count_a * 100::DOUBLE / pa.total_complaints AS share_a,
           count_b * 100::DOUBLE / pb.total_complaints AS share_b
    FROM labelled l JOIN pairs USING (pair_id)
    JOIN profiles pa ON pa.vehicle_key = key_a JOIN profiles pb ON pb.vehicle_key = key_b),
scaled AS (SELECT *, max(greatest(share_a, share_b)) OVER (PARTITION BY pair_id) AS scale FROM shared)
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY is_remainder,
           share_a + share_b DESC, label) AS INT) AS position, label, is_remainder,
       count_a, share_a, CAST(round(share_a * 100::DOUBLE / scale) AS INT) AS width_a,
       count_b, share_b, CAST(round(share_b * 100::DOUBLE / scale) AS INT) AS width_b
FROM scaled
""",
    (*BREAKDOWN, "pairs", "sides"),
)
def compare_components(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.compare_components(_pairs(measures), component_rows(measures), profile_scalars(measures))


@check(
    """
WITH counted AS (
    SELECT pair_id, b.bin,
           coalesce((SELECT n FROM histogram h WHERE h.vehicle_key = key_a AND h.bin = b.bin), 0) AS count_a,
           coalesce((SELECT n FROM histogram h WHERE h.vehicle_key = key_b AND h.bin = b.bin), 0) AS count_b,
           pa.with_mileage AS sample_a, pb.with_mileage AS sample_b
    FROM pairs JOIN profiles pa ON pa.vehicle_key = key_a JOIN profiles pb ON pb.vehicle_key = key_b, bins b),
shared AS (
    SELECT *, CASE WHEN sample_a > 0 THEN count_a * 100::DOUBLE / sample_a ELSE 0 END AS share_a,
           CASE WHEN sample_b > 0 THEN count_b * 100::DOUBLE / sample_b ELSE 0 END AS share_b
    FROM counted),
scaled AS (SELECT *, max(greatest(share_a, share_b)) OVER (PARTITION BY pair_id) AS scale FROM shared)
SELECT pair_id, bin, count_a, share_a,
       CAST(CASE WHEN scale > 0 THEN round(share_a * 100::DOUBLE / scale) ELSE 0 END AS INT) AS width_a,
       count_b, share_b,
       CAST(CASE WHEN scale > 0 THEN round(share_b * 100::DOUBLE / scale) ELSE 0 END AS INT) AS width_b
FROM scaled
""",
    (*HISTOGRAM, "pairs"),
)
def compare_mileage(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.compare_mileage(_pairs(measures), profile_scalars(measures))


@check(
    """
SELECT pair_id, a.signal, a.label, a.n AS count_a, a.n * 100::DOUBLE / a.total_complaints AS rate_a,
       b.n AS count_b, b.n * 100::DOUBLE / b.total_complaints AS rate_b,
       a.critical AND (a.n > 0 OR b.n > 0) AS highlighted
FROM pairs JOIN signals a ON a.vehicle_key = key_a
JOIN signals b ON b.vehicle_key = key_b AND b.signal = a.signal
""",
    (*PROFILES, "pairs", "signals"),
)
def compare_severity(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.compare_severity(_pairs(measures), profile_scalars(measures))


@check(
    """
SELECT pair_id, key_a, key_b, a.total_complaints AS total_a, b.total_complaints AS total_b,
       greatest(a.total_complaints, b.total_complaints)
           >= 10 * least(a.total_complaints, b.total_complaints) AS lopsided,
       greatest(a.total_complaints, b.total_complaints)::DOUBLE
           / least(a.total_complaints, b.total_complaints) AS volume_ratio,
       a.total_complaints < 25 OR b.total_complaints < 25 AS small_sample,
       a.with_mileage > 0 OR b.with_mileage > 0 AS has_mileage,
       a.with_mileage < 20 OR b.with_mileage < 20 AS thin_mileage, key_a = key_b AS same_vehicle
FROM pairs JOIN profiles a ON a.vehicle_key = key_a JOIN profiles b ON b.vehicle_key = key_b
""",
    (*PROFILES, "pairs"),
)
def compare_caveats(spark, sf_dir):
    measures = _measures(spark, sf_dir)
    return ops.compare_caveats(_pairs(measures), profile_scalars(measures))


_REQUESTS = (
    "o_orderkey AS request_id",
    """CASE o_orderkey % 7
    WHEN 0 THEN concat(' ', make_slug, '|', upper(model_slug), '|', year(o_orderdate), ' ')
    WHEN 1 THEN concat(make_slug, '|', model_slug)
    WHEN 2 THEN concat(make_slug, '|', model_slug, '|soon')
    WHEN 3 THEN '  ' END AS key""",
    "CASE WHEN o_orderkey % 7 IN (4, 5) THEN upper(make_slug) END AS make",
    "CASE o_orderkey % 7 WHEN 4 THEN model_slug WHEN 5 THEN ' ' END AS model",
    """CASE WHEN o_orderkey % 7 IN (4, 5) THEN
        CAST(year(o_orderdate) + o_orderkey % 2 * 20 AS INT) END AS year""",
)


@check(
    f"""
WITH requests AS (
    SELECT {', '.join(_REQUESTS)}, make_slug, model_slug, CAST(year(o_orderdate) AS INT) AS order_year
    FROM orders JOIN parts ON p_partkey = o_custkey),
asked AS (
    SELECT request_id, key, make, model, year,
           CASE WHEN request_id % 7 IN (0, 4) OR request_id % 7 = 5 THEN make_slug END AS make_slug,
           CASE WHEN request_id % 7 IN (0, 4) THEN model_slug END AS model_slug,
           CAST(CASE request_id % 7 WHEN 0 THEN order_year WHEN 4 THEN year WHEN 5 THEN year END AS INT)
               AS model_year,
           CASE WHEN request_id % 7 IN (0, 1, 2) THEN trim(key) END AS raw_key
    FROM requests),
keyed AS (
    SELECT *, CASE WHEN request_id % 7 IN (0, 4) THEN
                   concat(make_slug, '|', model_slug, '|', model_year) END AS request_key
    FROM asked)
SELECT k.*, CASE WHEN request_id % 7 IN (0, 4) THEN
                     CASE WHEN p.vehicle_key IS NULL THEN 'unknown' ELSE 'resolved' END
                 WHEN request_id % 7 IN (1, 2) THEN 'unknown' WHEN request_id % 7 = 5 THEN 'incomplete'
                 ELSE 'empty' END AS status
FROM keyed k LEFT JOIN profiles p ON p.vehicle_key = k.request_key
""",
    PROFILES,
)
def request_status(spark, sf_dir):
    """Requests in every form: readable and unreadable keys, parts, gaps and nothing at all."""
    orders, parts = views.table(spark, sf_dir, "orders"), views.parts(spark, sf_dir)
    requests = orders.join(parts, F.col("p_partkey") == F.col("o_custkey")).selectExpr(*_REQUESTS)
    measures = _measures(spark, sf_dir)
    return ops.request_status(requests, vehicle_entries(measures), profile_scalars(measures))
