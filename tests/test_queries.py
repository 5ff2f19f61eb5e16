"""Every registered query: same rows as its SQL, and a plan that scales."""

import os
import re

import duckdb
import pytest

from faultline.plans import checks as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(entry.oracles()) == set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_rows_equal_the_oracle(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    cursor = duck.execute(entry.oracles()[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    order = [named.index(c) for c in columns]
    expected = sorted(repr([row[i] for i in order]) for row in cursor.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in found.collect()) == expected


BAD_OPERATORS = re.compile(
    r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups"
)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not BAD_OPERATORS.search(plan)


@needs_data
def test_top_rows_per_group_are_cut_before_the_shuffle(spark):
    plan = entry.queries()["recent_reports"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning(vehicle_key")[1]


@needs_data
def test_reports_are_hashed_not_sorted_before_the_shuffle(spark):
    for name in ("profile_scalars", "catalog", "profile_components", "taxonomy"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        aggregates = [line for line in plan.splitlines() if "Aggregate(key" in line]
        assert "HashAggregate" in aggregates[-1], name


@needs_data
def test_refreshed_catalog_counts_recalls_once(spark):
    plan = entry.queries()["refreshed_catalog"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


@needs_data
def test_scans_read_only_the_needed_columns(spark):
    plan = entry.queries()["profile_timeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scanned = re.search(r"FileScan parquet \[([^\]]*l_orderkey[^\]]*)\]", plan).group(1)
    assert "l_shipdate" in scanned
    assert not re.search("l_extendedprice|l_discount|l_tax|l_suppkey", scanned)
