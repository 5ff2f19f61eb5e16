"""Complaint, recall and narrative tables seen in the TPC-H-like tables, in Spark and in SQL.

A line item stands for a complaint and also for a recall row, its part for the vehicle, its order for
the dates. All rows are used; spellings, gaps and oddities are derived from their values.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import vehicle_key
from faultline.operators.records import with_make, with_model
from faultline.sources.dimensions import alias_dimension, group_dimension
from faultline.sources.tables import read_table

# Lookup tables for the stand-in data. Aliases include a chain and a self reference.
ALIASES = {"brand#7": "Brand#17", "Brand#8": "BRAND#7", "Brand#9": "Brand#9"}
GROUPS = {
    "Low A": "POWER TRAIN",
    "LOW N": "POWER TRAIN",
    "LOW R": "ENGINE",
    "MEDIUM A": "BRAKES",
    "MEDIUM N": "STEERING",
    "MEDIUM R": "BRAKES",
    "HIGH A": "LIGHTING",
    "HIGH N": "SEATS",
    "HIGH R": "AIR BAGS",
    "URGENT A": "TIRES",
    "URGENT N": "WHEELS",
    "URGENT R": "SUSPENSION",
    "NOT SPECIFIED A": "ELECTRICAL SYSTEM",
    "NOT SPECIFIED N": "VISIBILITY",
}

MAKE_RAW = """
concat(p_brand, CASE p_size % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ',  L.L.C.' WHEN 2 THEN ' CO, INC'
                                ELSE '' END)
"""
TOP_LEVEL = """
CASE WHEN l_quantity = 1 THEN NULL
     WHEN l_linenumber = 3 THEN lower(concat(substr(o_orderpriority, 3), ' ', l_returnflag))
     ELSE concat(substr(o_orderpriority, 3), ' ', l_returnflag) END
"""
MODEL_YEAR = "CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INT) END"


# A view is a plan, not data: each is built once per session and folder and shared by the queries.
view = lru_cache(maxsize=64)


@view
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


@view
def aliases(spark: SparkSession) -> DataFrame:
    return alias_dimension(spark, ALIASES)


@view
def groups(spark: SparkSession) -> DataFrame:
    return group_dimension(spark, GROUPS)


@view
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles: make and model are made canonical on the parts, before they meet the line items."""
    named = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand", "p_name", "p_type", "p_size", f"{MAKE_RAW} AS make_raw"
    )
    return with_model(with_make(named, F.col("make_raw"), aliases(spark)), F.col("p_type"))


@view
def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("model_year", F.expr(MODEL_YEAR))
        .withColumn("top_level", F.expr(TOP_LEVEL))
        .join(groups(spark), F.upper("top_level") == F.col("category"), "left")
        .withColumn(
            "component_group",
            F.expr("CASE WHEN top_level IS NULL THEN 'UNKNOWN' ELSE coalesce(mapped_group, 'OTHER') END"),
        )
        .withColumn(
            "vehicle_key",
            vehicle_key(F.col("make_slug"), F.col("model_slug"), F.col("model_year")),
        )
    )


@view
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as complaint rows. (order, line) is not unique, so there is no real id."""
    return joined(spark, sf_dir).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_orderkey * 10 + l_linenumber AS id",
        "make", "make_raw", "model", "p_type AS model_raw", "model_year", "vehicle_key",
        """named_struct('raw', coalesce(concat(top_level, ':', p_type), ''), 'group', component_group,
               'levels', CASE WHEN top_level IS NULL THEN cast(array() AS array<string>)
                              ELSE array(top_level, p_type) END) AS component""",
        "CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_extendedprice * 3) AS INT) END"
        " AS miles_at_failure",
        "CAST(l_shipdate AS DATE) AS received_date",
        "l_returnflag = 'R' AS crash",
        "l_linestatus = 'F' AND l_linenumber = 7 AS fire",
        "CAST(l_quantity AS INT) % 3 AS injured",
        "CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS deaths",
        "l_linenumber = 1 AS police_report",
        "l_discount >= 0.08 AS vehicle_towed",
        "l_tax <= 0.01 AS medical_attention",
    )


@view
def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recall rows: the supplier is the campaign."""
    return joined(spark, sf_dir).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax",
        "concat(CASE WHEN l_linenumber = 5 THEN 'c' ELSE 'C' END, l_suppkey) AS campaign_number",
        "concat('Maker ', p_brand) AS manufacturer",
        "make", "model", "model_year", "vehicle_key",
        "coalesce(concat(top_level, ':', p_type), '') AS component_name",
        "component_group",
        "CASE WHEN l_linenumber <> 6 THEN CAST(floor(o_totalprice) AS INT) END AS potentially_affected",
        "CAST(l_shipdate AS DATE) AS owners_notified_date",
        "CASE WHEN l_quantity <> 2 THEN CAST(o_orderdate AS DATE) END AS report_received_date",
        "p_name AS defect_description", "o_orderpriority AS consequence",
        "l_linestatus AS corrective_action",
        "l_discount >= 0.09 AS do_not_drive", "l_tax >= 0.07 AS park_outside",
    )


RECALL_ROW = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax",
)


@view
def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as complaint rows with a whole narrative each."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "upper(source) AS make", "upper(lang) AS model",
        "CASE WHEN n_chars % 7 <> 0 THEN CAST(2000 + n_chars % 20 AS INT) END AS model_year",
        """concat(source, '|', lang, '|', CASE WHEN n_chars % 7 <> 0 THEN
               CAST(2000 + n_chars % 20 AS STRING) ELSE 'unknown' END) AS vehicle_key""",
        """named_struct('raw', concat(lang, ':', source), 'group', upper(lang),
               'levels', array(lang, source)) AS component""",
        "CASE WHEN n_chars % 2 = 0 THEN CAST(n_chars AS INT) END AS miles_at_failure",
        "date_add(DATE '2020-01-01', CAST(doc_id % 1000 AS INT)) AS received_date",
        "n_chars % 11 = 0 AS crash", "n_chars % 13 = 0 AS fire",
        "CAST(n_chars % 3 AS INT) AS injured",
        "CASE WHEN n_chars % 17 = 0 THEN 1 ELSE 0 END AS deaths",
        "text AS description",
    )


_SUFFIXES = "INC|LLC|LTD|LP|LLP|CORP|CORPORATION|CO|COMPANY|GMBH|PLC|AG|NV|SA"
SQL_SUFFIX_TAIL = "|".join(r"\.*".join(word) for word in _SUFFIXES.split("|"))


def sql_normalise(text: str) -> str:
    return f"upper(trim(regexp_replace({text}, '[[:space:]]+', ' ', 'g')))"


def sql_slug(text: str) -> str:
    return (
        "coalesce(nullif(lower(regexp_replace(regexp_replace("
        f"{text}, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), ''), 'unknown')"
    )


def sql_strip(text: str) -> str:
    return f"regexp_extract({text}, '^(.*?)(?:[ ,]* \\.*(?:{SQL_SUFFIX_TAIL})\\.*)*[ ,]*$', 1)"


def sql_alias(name: str) -> str:
    return f"CASE WHEN {name} IN ('BRAND#7', 'BRAND#8') THEN 'BRAND#17' ELSE {name} END"


def sql_group(top: str) -> str:
    cases = " ".join(f"WHEN '{key.upper()}' THEN '{value}'" for key, value in GROUPS.items())
    return (
        f"CASE WHEN {top} IS NULL THEN 'UNKNOWN' "
        f"ELSE coalesce(CASE upper({top}) {cases} END, 'OTHER') END"
    )


_STRIPPED = sql_strip(sql_normalise(MAKE_RAW))

SQL_VIEWS = {
    "parts": f"""
SELECT p_partkey, p_brand, p_name, p_type, p_size, {MAKE_RAW} AS make_raw,
       {sql_alias(_STRIPPED)} AS make, {sql_slug(sql_alias(_STRIPPED))} AS make_slug,
       {sql_normalise('p_type')} AS model, {sql_slug('p_type')} AS model_slug
FROM part
""",
    "joined": f"""
SELECT j.*, {sql_group('top_level')} AS component_group,
       concat(make_slug, '|', model_slug, '|', coalesce(CAST(model_year AS VARCHAR), 'unknown'))
           AS vehicle_key
FROM (SELECT lineitem.*, orders.*, parts.*, {MODEL_YEAR} AS model_year, {TOP_LEVEL} AS top_level
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey) j
""",
}
SQL_VIEWS["reports"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       make, make_raw, make_slug, model, model_slug, model_year, vehicle_key, component_group, top_level,
       coalesce(top_level || ':' || p_type, '') AS component_raw,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_extendedprice * 3) AS INT) END AS miles,
       CAST(l_shipdate AS DATE) AS received_date, CAST(year(l_shipdate) AS INT) AS received_year,
       CASE WHEN l_linenumber % 2 = 0 THEN
            CAST(least(greatest(floor(floor(l_extendedprice * 3) / 25000), 0), 10) AS INT) END AS bin,
       CAST(l_returnflag = 'R' AS INT) AS crash,
       CAST(l_linestatus = 'F' AND l_linenumber = 7 AS INT) AS fire,
       CAST(l_quantity AS INT) % 3 AS injured,
       CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS deaths,
       CAST(l_linenumber = 1 AS INT) AS police_report, CAST(l_discount >= 0.08 AS INT) AS vehicle_towed,
       CAST(l_tax <= 0.01 AS INT) AS medical_attention
FROM ({SQL_VIEWS['joined']}) joined
"""
SQL_VIEWS["recalls"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
       concat(CASE WHEN l_linenumber = 5 THEN 'c' ELSE 'C' END, l_suppkey) AS campaign_number,
       concat('Maker ', p_brand) AS manufacturer, make, model, model_year, vehicle_key,
       coalesce(top_level || ':' || p_type, '') AS component_name, component_group,
       CASE WHEN l_linenumber <> 6 THEN CAST(floor(o_totalprice) AS INT) END AS potentially_affected,
       CAST(l_shipdate AS DATE) AS owners_notified_date,
       CASE WHEN l_quantity <> 2 THEN CAST(o_orderdate AS DATE) END AS report_received_date,
       p_name AS defect_description, o_orderpriority AS consequence, l_linestatus AS corrective_action,
       l_discount >= 0.09 AS do_not_drive, l_tax >= 0.07 AS park_outside
FROM ({SQL_VIEWS['joined']}) joined
"""
SQL_VIEWS["narratives"] = """
SELECT doc_id AS id, upper(source) AS make, upper(lang) AS model,
       CASE WHEN n_chars % 7 <> 0 THEN CAST(2000 + n_chars % 20 AS INT) END AS model_year,
       concat(source, '|', lang, '|', CASE WHEN n_chars % 7 <> 0 THEN
           CAST(2000 + n_chars % 20 AS VARCHAR) ELSE 'unknown' END) AS vehicle_key,
       upper(lang) AS component_group,
       CASE WHEN n_chars % 2 = 0 THEN CAST(n_chars AS INT) END AS miles,
       n_chars % 11 = 0 AS crash, n_chars % 13 = 0 AS fire, CAST(n_chars % 3 AS INT) AS injured,
       CASE WHEN n_chars % 17 = 0 THEN 1 ELSE 0 END AS deaths, text AS description
FROM documents
"""
# Sums that several oracles share.
SQL_VIEWS["profiles"] = """
SELECT vehicle_key, min(make) AS make, min(model) AS model, min(make_slug) AS make_slug,
       min(model_slug) AS model_slug, min(model_year) AS model_year, count(*) AS total_complaints,
       count(miles) AS with_mileage, CAST(sum(crash) AS BIGINT) AS crashes,
       CAST(sum(fire) AS BIGINT) AS fires, CAST(sum(injured) AS BIGINT) AS injured,
       CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(police_report) AS BIGINT) AS police_reports,
       CAST(sum(vehicle_towed) AS BIGINT) AS vehicles_towed,
       CAST(sum(medical_attention) AS BIGINT) AS medical_attention
FROM reports WHERE model_year IS NOT NULL GROUP BY vehicle_key
"""
SQL_VIEWS["breakdown"] = """
SELECT vehicle_key, component_group, count(*) AS n
FROM reports WHERE model_year IS NOT NULL GROUP BY ALL
"""
SQL_VIEWS["timeline"] = """
SELECT vehicle_key, received_year AS year, count(*) AS n
FROM reports WHERE model_year IS NOT NULL GROUP BY ALL
"""
SQL_VIEWS["bins"] = "SELECT CAST(range AS INT) AS bin FROM range(11)"
SQL_VIEWS["histogram"] = """
SELECT vehicle_key, bin, count(*) AS n
FROM reports WHERE model_year IS NOT NULL AND bin IS NOT NULL GROUP BY ALL
"""
SQL_VIEWS["signals"] = """
SELECT vehicle_key, total_complaints, signal, label, critical, n
FROM (SELECT vehicle_key, total_complaints,
             unnest(['crashes','fires','injured','deaths','police_reports','vehicles_towed',
                     'medical_attention']) AS signal,
             unnest(['Crashes','Fires','Injured','Deaths','Police reports','Vehicles towed',
                     'Medical attention']) AS label,
             unnest([false, true, true, true, false, false, false]) AS critical,
             unnest([crashes, fires, injured, deaths, police_reports, vehicles_towed,
                     medical_attention]) AS n
      FROM profiles)
"""
SQL_VIEWS["group_totals"] = """
SELECT component_group, count(*) AS complaint_count, count(miles) AS with_mileage
FROM reports GROUP BY component_group
"""
SQL_VIEWS["makes"] = """
SELECT make_slug, min(make) AS make, sum(total_complaints)::BIGINT AS complaint_count,
       count(DISTINCT model_slug) AS model_count
FROM profiles GROUP BY make_slug
"""
BASE = ("parts", "reports")
PROFILES = (*BASE, "profiles")
BREAKDOWN = (*PROFILES, "breakdown")
TIMELINE = (*PROFILES, "timeline")
HISTOGRAM = (*PROFILES, "bins", "histogram")
RECALLS = ("parts", "recalls")
