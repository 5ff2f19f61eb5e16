"""Flat-file parsing, record mapping, upserts and load reports on lines derived from the tables.

Every line item is written out as a raw complaint line and as a raw recall line, with gaps, junk and
odd spellings that follow from its values. The oracles start from the same field texts, not from lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.fixed_values import (
    COMPLAINT_FIELD_COUNT,
    COMPLAINT_POSITIONS,
    RECALL_FIELD_COUNT,
    RECALL_POSITIONS,
)
from faultline.functions import fields as parse
from faultline.functions.measures import as_measures
from faultline.functions.text import (
    collapse_ws,
    normalise,
    slug,
    strip_corporate_suffixes,
    trim_ws,
)
from faultline.operators import maintain as ops
from faultline.operators import records
from faultline.operators.profile import profile_scalars
from faultline.plans.checks import views
from faultline.plans.checks.registry import check
from faultline.plans.checks.views import (
    MAKE_RAW,
    PROFILES,
    TOP_LEVEL,
    sql_alias,
    sql_group,
    sql_normalise,
    sql_slug,
    sql_strip,
)
from faultline.sources.flat import read_recall_lines, split_lines
from faultline.sources.shared import checkpointed, forget, release, shared_folder


def _day(column: str) -> str:
    return f"replace(CAST(CAST({column} AS DATE) AS STRING), '-', '')"


COMPLAINT_TEXT = {
    "id": "CASE WHEN l_quantity = 13 THEN concat('X', l_orderkey)"
    " ELSE concat(' ', l_orderkey * 10 + l_linenumber) END",
    "odi_number": "CASE WHEN l_quantity = 14 THEN '-7' ELSE CAST(l_orderkey AS STRING) END",
    "manufacturer": "concat('  Maker ', p_brand, ' ')",
    "make": f"CASE WHEN l_linenumber = 2 THEN lower({MAKE_RAW}) WHEN l_linenumber = 3 THEN ' . '"
    f" ELSE {MAKE_RAW} END",
    "model": "concat(p_type, '   ', p_name)",
    "model_year": "CASE WHEN o_orderstatus = 'P' THEN '9999' WHEN l_linenumber = 4 THEN '20I9'"
    " ELSE CAST(year(o_orderdate) AS STRING) END",
    "crash": "CASE l_returnflag WHEN 'R' THEN 'y ' WHEN 'A' THEN 'YES' ELSE 'N' END",
    "failure_date": "CASE WHEN l_linenumber = 5 THEN CAST(CAST(l_shipdate AS DATE) AS STRING)"
    f" WHEN l_linenumber = 6 THEN '20130229' ELSE {_day('l_shipdate')} END",
    "fire": "CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE '' END",
    "injured": "CASE l_linenumber WHEN 1 THEN '-3' WHEN 2 THEN 'NONE'"
    " ELSE CAST(CAST(l_quantity AS INT) % 3 AS STRING) END",
    "deaths": "CASE WHEN l_quantity = 50 THEN '+1' ELSE '' END",
    "component": "CASE WHEN l_quantity = 1 THEN ' : '"
    f" ELSE concat(' ', {TOP_LEVEL}, ' : ', p_type, '::', p_name) END",
    "date_added": f"CASE WHEN l_quantity = 15 THEN '' ELSE {_day('o_orderdate')} END",
    "received_date": f"CASE WHEN l_quantity IN (15, 16) THEN 'NOTADATE' ELSE {_day('l_shipdate')} END",
    "miles": "CASE l_linenumber WHEN 1 THEN '0' WHEN 3 THEN '9999999' WHEN 5 THEN '52,000'"
    " WHEN 7 THEN '' ELSE concat('000', CAST(floor(l_extendedprice) AS INT), ' ') END",
    "description": "concat(' the ', p_name, ' failed \"badly  ')",
    "police_report": "CASE WHEN l_linenumber = 1 THEN 'Y' ELSE '1' END",
    "cylinders": "CASE WHEN p_size % 4 = 0 THEN 'SIX' WHEN p_size % 4 = 1 THEN '0'"
    " ELSE CAST(p_size AS STRING) END",
    "drive_train": "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE concat(lower(p_type), ' wd') END",
    "fuel_type": "concat(' ', lower(l_returnflag))",
    "transmission_type": "CASE WHEN l_linestatus = 'F' THEN 'auto' ELSE '' END",
    "product_type": "CASE WHEN l_linenumber = 7 THEN 'T' WHEN l_linenumber = 6 THEN ' v '"
    " WHEN l_suppkey % 10 = 0 THEN '' ELSE 'V' END",
    "medical_attention": "CASE WHEN l_tax <= 0.01 THEN 'Y' ELSE 'N' END",
    "vehicle_towed": "CASE WHEN l_discount >= 0.08 THEN ' Y' ELSE 'N' END",
}
RECALL_TEXT = {
    "id": "CASE WHEN l_quantity = 13 THEN '12 34' ELSE CAST(l_orderkey * 10 + l_linenumber AS STRING) END",
    "campaign_number": "CASE WHEN l_quantity = 14 THEN '  ' ELSE concat(' C', l_suppkey) END",
    "make": MAKE_RAW,
    "model": "p_type",
    "model_year": "CASE WHEN o_orderstatus = 'P' THEN '1899' ELSE CAST(year(o_orderdate) AS STRING) END",
    "component": f"CASE WHEN l_quantity = 1 THEN '' ELSE concat({TOP_LEVEL}, ':', p_type) END",
    "manufacturer": "concat('Maker ', p_brand)",
    "recall_type": "CASE l_linenumber WHEN 7 THEN 'E' WHEN 6 THEN 'v' ELSE 'V' END",
    "potentially_affected": "CASE l_linenumber WHEN 1 THEN '1,200' WHEN 2 THEN '0'"
    " ELSE CAST(CAST(floor(o_totalprice) AS INT) AS STRING) END",
    "owners_notified_date": f"CASE WHEN l_linenumber = 3 THEN '0000{'0101'}' ELSE {_day('l_shipdate')} END",
    "report_received_date": f"CASE WHEN l_quantity = 2 THEN '2024' ELSE {_day('o_orderdate')} END",
    "defect_description": "concat(p_name, ' ')",
    "consequence": "o_orderpriority",
    "corrective_action": "l_linestatus",
    "do_not_drive": "CASE WHEN l_discount >= 0.09 THEN ' yes' WHEN l_discount >= 0.05 THEN 'Y' ELSE 'No' END",
    "park_outside": "CASE WHEN l_tax >= 0.07 THEN 'YES' ELSE '' END",
}
BLANK, SHORT = "l_quantity = 49", "l_quantity = 48"
#: Order keys whose line items make one file of lines.
PER_FILE = 1000
#: Lines whose files are written in one round, and rounds at most: each reads the line items again.
LINES_PER_ROUND, MOST_ROUNDS = 800_000, 8
#: Cells of a line that one step computes. The JVM leaves methods above 8 000 bytes uncompiled, and Spark generates one
#: for each step.
PER_STEP = 8


def _with_line(spark, sf_dir, text, positions, count):
    """Line items with their raw line as `value`; some are blank and some lack their last field."""
    by_position = {position: text[name] for name, position in positions.items()}
    joined = (
        views.table(spark, sf_dir, "lineitem")
        .join(views.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(views.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    cells = [F.expr(by_position.get(i, "'-'")) for i in range(count)]
    steps = [cells[at : at + PER_STEP] for at in range(0, count - 1, PER_STEP)]
    steps[-1] = steps[-1][: (count - 2) % PER_STEP + 1]
    names = [f"cells{n}" for n in range(len(steps))]
    # Generated, since projections would be merged into one again.
    for name, step in zip(names, steps, strict=True):
        joined = joined.select("*", F.explode(F.array(F.array(*step))).alias(name))
    value = (
        F.when(F.expr(BLANK), F.lit("   "))
        .when(F.expr(SHORT), F.concat_ws("\t", *names))
        .otherwise(F.concat_ws("\t", *names, cells[-1]))
    )
    return joined.withColumn("value", value).drop(*names)


def _lines(spark, sf_dir, text, positions, count):
    # Generated rows keep the line a plain column, as if it had been read from a file.
    lines = _with_line(spark, sf_dir, text, positions, count).select(F.explode(F.array("value")).alias("value"))
    return split_lines(lines, count)


def _complaint_lines(spark, sf_dir):
    return _lines(spark, sf_dir, COMPLAINT_TEXT, COMPLAINT_POSITIONS, COMPLAINT_FIELD_COUNT)


def _recall_lines(spark, sf_dir):
    return _lines(spark, sf_dir, RECALL_TEXT, RECALL_POSITIONS, RECALL_FIELD_COUNT)


def _complaints(spark, sf_dir):
    return records.map_complaints(
        _complaint_lines(spark, sf_dir), views.aliases(spark), views.groups(spark)
    )


def _recalls(spark, sf_dir):
    return records.map_recalls(_recall_lines(spark, sf_dir), views.aliases(spark), views.groups(spark))


def _sql_fields(text: dict[str, str]) -> str:
    columns = ", ".join(f"{expression} AS {name}" for name, expression in text.items())
    return f"""
SELECT {columns} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE NOT ({BLANK}) AND NOT ({SHORT})
"""


def _sql_int(text: str, low: int = 0, high: int = 2147483647) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({text}), '^[0-9]+$') "
        f"AND try_cast(trim({text}) AS INT) BETWEEN {low} AND {high} THEN try_cast(trim({text}) AS INT) END"
    )


def _sql_date(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({text}), '^[0-9]{{8}}$') AND trim({text})[1:4] <> '0000' "
        f"THEN try_cast(concat(trim({text})[1:4], '-', trim({text})[5:6], '-', trim({text})[7:8]) AS DATE) END"
    )


def _sql_count(text: str) -> str:
    return (
        f"greatest(CASE WHEN regexp_matches(trim({text}), '^[+-]?[0-9]+$') "
        f"THEN coalesce(try_cast(trim({text}) AS INT), 0) ELSE 0 END, 0)"
    )


def _sql_is(text: str, word: str) -> str:
    return f"upper(trim({text})) = '{word}'"


def _sql_make(raw: str) -> str:
    return sql_alias(sql_strip(sql_normalise(raw)))


def _sql_named(name: str) -> str:
    return f"CASE WHEN {sql_slug(name)} = 'unknown' THEN 'UNKNOWN' ELSE {name} END"


def _sql_key(make: str, model: str, year: str) -> str:
    return (
        f"concat({sql_slug(_sql_make(make))}, '|', {sql_slug(sql_normalise(model))}, '|', "
        f"coalesce(CAST({_sql_int(year, 1900, 2035)} AS VARCHAR), 'unknown'))"
    )


_SQL_TOP = "nullif(trim(split_part(component, ':', 1)), '')"
views.SQL_VIEWS["complaint_fields"] = _sql_fields(COMPLAINT_TEXT)
views.SQL_VIEWS["recall_fields"] = _sql_fields(RECALL_TEXT)
views.SQL_VIEWS["complaint_records"] = f"""
SELECT {_sql_int('id')} AS id, {_sql_int('odi_number')} AS odi_number, trim(id) AS raw_id,
       trim(manufacturer) AS manufacturer, {_sql_named(_sql_make('make'))} AS make,
       trim(make) AS make_raw, {_sql_named(sql_normalise('model'))} AS model, trim(model) AS model_raw,
       {_sql_int('model_year', 1900, 2035)} AS model_year,
       trim(component) AS component_raw, {sql_group(_SQL_TOP)} AS component_group,
       CASE WHEN trim(component) = ':' THEN ''
            ELSE regexp_replace(trim(component), ' *:[: ]*', ' > ', 'g') END AS component_levels,
       {_SQL_TOP} AS top_level,
       {_sql_int('miles', 1, 999999)} AS miles_at_failure, trim(description) AS description,
       {_sql_date('failure_date')} AS failure_date,
       coalesce({_sql_date('received_date')}, {_sql_date('date_added')}) AS received_date,
       {_sql_is('crash', 'Y')} AS crash, {_sql_is('fire', 'Y')} AS fire,
       {_sql_count('injured')} AS injured, {_sql_count('deaths')} AS deaths,
       {_sql_is('police_report', 'Y')} AS police_report, {_sql_is('vehicle_towed', 'Y')} AS vehicle_towed,
       {_sql_is('medical_attention', 'Y')} AS medical_attention,
       nullif(upper(trim(drive_train)), '') AS drive_train, nullif(upper(trim(fuel_type)), '') AS fuel_type,
       nullif(upper(trim(transmission_type)), '') AS transmission_type,
       {_sql_int('cylinders', 1)} AS cylinders, {_sql_key('make', 'model', 'model_year')} AS vehicle_key
FROM complaint_fields WHERE {_sql_is('product_type', 'V')}
"""
views.SQL_VIEWS["recall_records"] = f"""
SELECT {_sql_int('id')} AS id, trim(id) AS raw_id, trim(campaign_number) AS campaign_number,
       trim(manufacturer) AS manufacturer, {_sql_named(_sql_make('make'))} AS make,
       trim(make) AS make_raw, {_sql_named(sql_normalise('model'))} AS model, trim(model) AS model_raw,
       {_sql_int('model_year', 1900, 2035)} AS model_year, trim(component) AS component_name,
       {sql_group(_SQL_TOP)} AS component_group, {_SQL_TOP} AS top_level, trim(recall_type) AS recall_type,
       {_sql_int('potentially_affected')} AS potentially_affected,
       {_sql_date('owners_notified_date')} AS owners_notified_date,
       {_sql_date('report_received_date')} AS report_received_date,
       trim(defect_description) AS defect_description, trim(consequence) AS consequence,
       trim(corrective_action) AS corrective_action, {_sql_is('do_not_drive', 'YES')} AS do_not_drive,
       {_sql_is('park_outside', 'YES')} AS park_outside,
       {_sql_key('make', 'model', 'model_year')} AS vehicle_key
FROM recall_fields WHERE {_sql_is('recall_type', 'V')}
"""
_COMPLAINT_OK = "id IS NOT NULL AND odi_number IS NOT NULL AND received_date IS NOT NULL"
_RECALL_OK = "id IS NOT NULL AND campaign_number <> ''"
COMPLAINTS = ("complaint_fields", "complaint_records")
RECALLS = ("recall_fields", "recall_records")


@check(
    f"""
SELECT count(*) FILTER (NOT ({BLANK}) AND NOT ({SHORT})) AS records,
       count(*) FILTER ({BLANK}) AS blank_lines, count(*) FILTER ({SHORT}) AS malformed_lines
FROM lineitem
""",
    (),
)
def flat_split(spark, sf_dir):
    return _complaint_lines(spark, sf_dir).counts()


@check(
    f"SELECT 29 AS expected, 28 AS actual, count(*) AS lines FROM lineitem WHERE {SHORT}", ()
)
def flat_malformed(spark, sf_dir):
    malformed = _recall_lines(spark, sf_dir).malformed
    return malformed.groupBy("expected", "actual").agg(F.count("*").alias("lines"))


@check(
    f"""
SELECT part, line, 29 AS expected, 28 AS actual
FROM (
    SELECT l_orderkey // {PER_FILE} AS part, l_quantity,
           row_number() OVER (PARTITION BY l_orderkey // {PER_FILE} ORDER BY l_orderkey, l_linenumber, l_quantity) AS line
    FROM lineitem
) WHERE {SHORT}
""",
    (),
)
def malformed_line_numbers(spark, sf_dir):
    """Recall lines of a range of orders make a file; its malformed lines come back with their numbers. Files are written,
    numbered and deleted in rounds, so that a share of all lines, and of what is shuffled for them, is on disk at a time."""
    count = views.table(spark, sf_dir, "lineitem").count()
    rounds = max(1, min(MOST_ROUNDS, -(-count // LINES_PER_ROUND)))
    lines = _with_line(spark, sf_dir, RECALL_TEXT, RECALL_POSITIONS, RECALL_FIELD_COUNT)
    lines = lines.withColumn("part", F.expr(f"l_orderkey DIV {PER_FILE}"))
    found = [_numbered_in_files(lines.filter(F.pmod("part", F.lit(rounds)) == turn)) for turn in range(rounds)]
    return reduce(DataFrame.unionByName, found)


def _numbered_in_files(lines):
    """part, line, expected, actual of the malformed lines, each part written to a file and read again."""
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/recall-lines-{uuid.uuid4().hex}"
    ordered = lines.repartition("part").sortWithinPartitions("part", "l_orderkey", "l_linenumber", "l_quantity")
    ordered.select("part", "value").write.partitionBy("part").text(folder)
    part = F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("long")
    found = read_recall_lines(spark, folder).numbered_malformed().select(part.alias("part"), "line", "expected", "actual")
    found = checkpointed(found)
    forget(spark, folder)
    release(spark)
    return found


@check(f"SELECT * EXCLUDE (raw_id, top_level) FROM complaint_records WHERE {_COMPLAINT_OK}", COMPLAINTS)
def complaint_rows(spark, sf_dir):
    return _complaints(spark, sf_dir).good.withColumns(
        {
            "component_raw": F.col("component.raw"),
            "component_group": F.col("component.group"),
            "component_levels": F.array_join("component.levels", " > "),
        }
    ).drop("component")


@check(
    f"""
SELECT raw_id, CASE WHEN id IS NULL THEN 'complaint id is not a number'
                    WHEN odi_number IS NULL THEN 'odi number is not a number'
                    ELSE 'no usable received or added date' END AS reject_reason
FROM complaint_records WHERE NOT ({_COMPLAINT_OK})
""",
    COMPLAINTS,
)
def complaint_rejects(spark, sf_dir):
    return _complaints(spark, sf_dir).rejected.drop("file")


@check(
    f"""
SELECT l.records AS lines_read, l.blank_lines, l.malformed_lines, l.records - r.vehicle AS non_vehicle,
       r.vehicle - r.accepted AS mapping_failures, r.accepted
FROM (SELECT count(*) FILTER (NOT ({BLANK}) AND NOT ({SHORT})) AS records,
             count(*) FILTER ({BLANK}) AS blank_lines, count(*) FILTER ({SHORT}) AS malformed_lines
      FROM lineitem) l,
     (SELECT count(*) AS vehicle, count(*) FILTER ({_COMPLAINT_OK}) AS accepted FROM complaint_records) r
""",
    COMPLAINTS,
)
def ingest_metrics(spark, sf_dir):
    return ops.complaint_metrics(_complaint_lines(spark, sf_dir), _complaints(spark, sf_dir))


@check(f"SELECT make, count(*) AS count FROM complaint_records WHERE {_COMPLAINT_OK} GROUP BY make", COMPLAINTS)
def canonical_make_counts(spark, sf_dir):
    return ops.make_counts(_complaints(spark, sf_dir).good)


@check(f"SELECT * EXCLUDE (raw_id, top_level) FROM recall_records WHERE {_RECALL_OK}", RECALLS)
def recall_rows(spark, sf_dir):
    return _recalls(spark, sf_dir).good


@check(
    f"""
SELECT l.records AS lines_read, l.blank_lines, l.malformed_lines, l.records - r.vehicle AS non_vehicle,
       r.vehicle - r.accepted AS mapping_failures, r.accepted, r.do_not_drive_rows, r.park_outside_rows
FROM (SELECT count(*) FILTER (NOT ({BLANK}) AND NOT ({SHORT})) AS records,
             count(*) FILTER ({BLANK}) AS blank_lines, count(*) FILTER ({SHORT}) AS malformed_lines
      FROM lineitem) l,
     (SELECT count(*) AS vehicle, count(*) FILTER ({_RECALL_OK}) AS accepted,
             count(*) FILTER ({_RECALL_OK} AND do_not_drive) AS do_not_drive_rows,
             count(*) FILTER ({_RECALL_OK} AND park_outside) AS park_outside_rows
      FROM recall_records) r
""",
    RECALLS,
)
def recall_metrics(spark, sf_dir):
    return ops.recall_metrics(_recall_lines(spark, sf_dir), _recalls(spark, sf_dir))


@check(
    f"""
SELECT make_raw, count(*) AS count FROM complaint_records WHERE {_COMPLAINT_OK}
GROUP BY make_raw HAVING count(*) < 150
""",
    COMPLAINTS,
)
def rare_makes(spark, sf_dir):
    """The bound is raised to where the stand-in spellings fall apart."""
    return ops.rare_makes(_complaints(spark, sf_dir).good, below=150)


@check(
    f"""
SELECT min(top_level) AS top_level, count(*) AS count
FROM (SELECT top_level, component_group FROM complaint_records WHERE {_COMPLAINT_OK}
      UNION ALL SELECT top_level, component_group FROM recall_records WHERE {_RECALL_OK})
WHERE component_group = 'OTHER' GROUP BY upper(top_level)
""",
    (*COMPLAINTS, *RECALLS),
)
def unmapped_levels(spark, sf_dir):
    """One count shared by accepted complaints and recalls."""
    complaints, recalls = _complaints(spark, sf_dir), _recalls(spark, sf_dir)
    levels = records.component_levels(F.col("raw_component")).alias("levels")
    accepted = [m.parsed.filter("reject_reason IS NULL").select(levels) for m in (complaints, recalls)]
    return records.unmapped_top_levels(accepted[0].unionByName(accepted[1]), views.groups(spark))


@check(
    f"""
SELECT * EXCLUDE (rn) FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY incoming DESC, l_shipdate DESC,
                              l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
    FROM (SELECT *, l_linestatus = 'F' AS incoming FROM lineitem)) WHERE rn = 1
""",
    (),
)
def upsert_latest(spark, sf_dir):
    """Shipped lines arrive into the open ones; neither side has unique keys."""
    order = [F.col(c) for c in ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")]
    keys = ["l_orderkey", "l_linenumber"]
    items = views.table(spark, sf_dir, "lineitem").select(
        *keys, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_linestatus"
    )
    current = ops.latest_per_key(items.filter("l_linestatus <> 'F'"), keys, order)
    incoming = items.filter("l_linestatus = 'F'")
    return ops.upsert(current, incoming, keys, order).drop("l_linestatus")


@check(
    """
SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name AS name,
       CASE WHEN o_custkey IS NOT NULL THEN balance ELSE c_acctbal END AS balance, orders
FROM customer FULL JOIN (
    SELECT o_custkey + 100 AS o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS balance,
           count(*) AS orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""",
    (),
)
def merge_fields(spark, sf_dir):
    """Updates replace the balance, also by null; some keys exist on one side only."""
    target = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS custkey", "c_name AS name", "c_acctbal AS balance"
    )
    updates = views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 100).alias("custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("balance"),
        F.count("*").alias("orders"),
    )
    return ops.merge_fields(target, updates, ["custkey"])


@check(
    """
SELECT c_custkey AS custkey, c_name AS name,
       CASE WHEN o_custkey IS NOT NULL THEN balance ELSE c_acctbal END AS balance, orders
FROM customer LEFT JOIN (
    SELECT o_custkey + 100 AS o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS balance,
           count(*) AS orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
""",
    (),
)
def merge_fields_discard(spark, sf_dir):
    target = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS custkey", "c_name AS name", "c_acctbal AS balance"
    )
    updates = views.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 100).alias("custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("balance"),
        F.count("*").alias("orders"),
    )
    return ops.merge_fields(target, updates, ["custkey"], insert_unmatched=False)


@check(
    """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1
""",
    (),
)
def duplicate_keys(spark, sf_dir):
    return ops.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@check(
    """
SELECT component_group, b.range_from, b.range_to,
       count(*) FILTER (miles >= b.range_from AND miles < b.range_to) AS count
FROM reports, (SELECT unnest([0, 20000, 50000, 125000]) AS range_from,
                      unnest([20000, 50000, 125000, 250000]) AS range_to) b
GROUP BY ALL
"""
)
def range_histogram(spark, sf_dir):
    reports = views.reports(spark, sf_dir).select(
        F.col("component.group").alias("component_group"), "miles_at_failure"
    )
    bounds = [0, 20_000, 50_000, 125_000, 250_000]
    return ops.range_histogram(reports, "miles_at_failure", bounds, by=["component_group"])


@check(
    """
SELECT e.make, expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - expected AS difference
FROM (SELECT upper(p_brand) AS make, count(*) * 30 AS expected FROM part GROUP BY ALL) e
LEFT JOIN (SELECT make, count(*) AS actual FROM reports GROUP BY make) a ON a.make = e.make
"""
)
def reconcile_counts(spark, sf_dir):
    """Expects thirty reports per part of a raw brand; folded brands have none."""
    expected = (
        views.table(spark, sf_dir, "part")
        .groupBy(F.upper("p_brand").alias("make"))
        .agg((F.count("*") * 30).alias("expected"))
    )
    return ops.reconcile_counts(ops.make_counts(views.reports(spark, sf_dir)), expected)


@check(
    """
SELECT unnest(['complaints', 'canonical makes', 'profile brand-17|small|1998', 'mileage histogram',
               'personal data']) AS "check",
       unnest([n::VARCHAR, makes::VARCHAR, found::VARCHAR, bins, 'none']) AS value,
       unnest([n > 50000, makes < 24, found > 0, bins = '0/0/0', true]) AS passed
FROM (SELECT count(*) AS n, count(DISTINCT make) AS makes,
             (SELECT count(*) FROM profiles WHERE vehicle_key = 'brand-17|small|1998') AS found,
             concat_ws('/', count(*) FILTER (s AND miles < 25000),
                       count(*) FILTER (s AND miles >= 25000 AND miles < 50000),
                       count(*) FILTER (s AND miles >= 50000 AND miles < 75000)) AS bins
      FROM (SELECT *, make = 'BRAND#17' AND component_group = 'BRAKES' AS s FROM reports))
""",
    PROFILES,
)
def acceptance_checks(spark, sf_dir):
    reports = views.reports(spark, sf_dir)
    return ops.acceptance_checks(
        spark, reports, profile_scalars(as_measures(reports)),
        complaints_above=50_000, makes_below=24, profile_key="brand-17|small|1998",
        histogram={"make": "BRAND#17", "component_group": "BRAKES", "counts": (0, 0, 0)},
    )


@check(
    f"""
SELECT conv_id, turn, {sql_slug('text')} AS slug,
       trim(regexp_replace(text, '[[:space:]]+', ' ', 'g')) AS collapsed
FROM conversations
""",
    (),
)
def slugs(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", slug(F.col("text")).alias("slug"), collapse_ws(F.col("text")).alias("collapsed")
    )


_NAMES = """
concat(CASE c_custkey % 5 WHEN 0 THEN '  ' ELSE '' END, lower(c_mktsegment), '   ', substr(c_name, 10),
       CASE c_custkey % 8 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' l.l.c' WHEN 2 THEN ' co., ltd.' WHEN 3 THEN ' gmbh,'
                          WHEN 4 THEN ' Inco' WHEN 5 THEN ' CO INC' WHEN 6 THEN ',inc' ELSE ' ' END)
"""


@check(
    f"""
SELECT c_custkey, {sql_normalise(_NAMES)} AS name, {sql_strip(sql_normalise(_NAMES))} AS stripped
FROM customer
""",
    (),
)
def suffix_strip(spark, sf_dir):
    name = normalise(F.expr(_NAMES))
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey", name.alias("name"), strip_corporate_suffixes(name).alias("stripped")
    )


_PATHS = "concat(' ', replace(url, '/', ' : '), ':')"


@check(
    f"""
SELECT page_id, trim(regexp_replace(regexp_replace(trim({_PATHS}), '[ :]*:[ :]*', ' > ', 'g'),
                                    '^ > | > $', '', 'g')) AS levels
FROM pages
""",
    (),
)
def component_paths(spark, sf_dir):
    levels = records.component_levels(F.expr(_PATHS))
    return views.table(spark, sf_dir, "pages").select("page_id", F.array_join(levels, " > ").alias("levels"))


_NUMBER = """
CASE event_id % 6 WHEN 0 THEN concat(' ', user_id * 1000, ' ') WHEN 1 THEN concat('-', user_id)
     WHEN 2 THEN CAST(user_id AS STRING) WHEN 3 THEN concat('000', user_id * 40000)
     WHEN 4 THEN concat(user_id, '000000000000') ELSE concat(user_id, '.5') END
"""
_DAY_TEXT = """
CASE event_id % 5 WHEN 0 THEN concat(1900 + user_id % 200, '0229') WHEN 1 THEN concat('0000', '0101')
     WHEN 2 THEN concat('2024', 10 + user_id % 6, 10 + user_id % 25) WHEN 3 THEN '2024-01-05'
     ELSE concat(' 199912', 10 + user_id % 25, ' ') END
"""


@check(
    f"""
SELECT event_id, {_sql_int(_NUMBER)} AS whole, {_sql_int(_NUMBER, 1900, 2035)} AS year,
       {_sql_int(_NUMBER, 1, 999999)} AS miles, {_sql_count(_NUMBER)} AS casualties
FROM events
""",
    (),
)
def safe_ints(spark, sf_dir):
    text = trim_ws(F.expr(_NUMBER))
    number = parse.whole_number(text)
    return views.table(spark, sf_dir, "events").select(
        "event_id", number.alias("whole"), parse.model_year(number).alias("year"),
        parse.mileage(number).alias("miles"),
        parse.casualties(parse.signed_number(text)).alias("casualties"),
    )


@check(f"SELECT event_id, {_sql_date(_DAY_TEXT)} AS day FROM events", ())
def strict_dates(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id", parse.strict_date(trim_ws(F.expr(_DAY_TEXT))).alias("day")
    )


@check(
    f"SELECT make_raw, make, count(*) AS count FROM complaint_records WHERE {_COMPLAINT_OK} GROUP BY make_raw, make",
    COMPLAINTS,
)
def spelling_counts(spark, sf_dir):
    return ops.spelling_counts(_complaints(spark, sf_dir).good)


@check(
    f"""
SELECT count(*) AS accepted, count(DISTINCT make_raw) AS raw_makes, count(DISTINCT make) AS canonical_makes
FROM complaint_records WHERE {_COMPLAINT_OK}
""",
    COMPLAINTS,
)
def load_summary(spark, sf_dir):
    return ops.load_summary(ops.spelling_counts(_complaints(spark, sf_dir).good), 0.0).drop("duration_seconds")
