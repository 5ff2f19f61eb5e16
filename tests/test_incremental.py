"""Derived tables after random updates equal a rebuild."""

import random

import pytest
import samples
from pyspark.sql import functions as F

from faultline.operators.deltas import apply_deltas, signed_cells
from faultline.functions.measures import report_cells
from faultline.plans.incremental import derive, update
from faultline.sources.ranged import RangedTable, StaleBase


def random_reports(rng, ids):
    makes, groups = ["OPAL", "Opal", "JET"], ["ENGINE", "BRAKES", "OTHER"]
    return [
        samples.report(
            i, make=rng.choice(makes), model=rng.choice(["RIVER", "HILL"]), year=rng.choice([2015, 2016, None]),
            group=rng.choice(groups), top=rng.choice(["A", "B", ""]), miles=rng.choice([None, 10, 30_000, 400_000]),
            year_received=rng.choice([2019, 2020]), crash=rng.random() < 0.3, injured=rng.choice([0, 2]),
        )
        for i in ids
    ]


def content(frame):
    return sorted(map(repr, frame.drop("computed_at").collect()))


@pytest.fixture
def recalls(spark):
    rows = [("opal|river|2015", "C1"), ("opal|river|2015", "C1"), ("jet|hill|2016", "C2"), ("none|none|2000", "C3")]
    return spark.createDataFrame(rows, "vehicle_key string, campaign_number string")


def test_tables_after_random_updates_equal_a_rebuild(spark, recalls, tmp_path):
    rng = random.Random(7)
    first = samples.reports(spark, random_reports(rng, range(40)))
    table = RangedTable(spark, str(tmp_path / "reports"), "id", first.schema, 10)
    table.replace(first, ["received_date"])
    derived = derive(table.read(), recalls)
    for _ in range(2):
        batch = samples.reports(spark, random_reports(rng, [rng.randrange(55) for _ in range(12)]))
        derived = update(table, derived, batch, ["received_date", "make_raw", F.xxhash64("make", "model", "component", "miles_at_failure")], recalls)
    rebuilt = derive(table.read(), recalls)
    for name in ("cells", "vehicles", "profiles", "components"):
        assert content(getattr(derived, name)) == content(getattr(rebuilt, name)), name


def test_a_vehicle_without_reports_vanishes_with_its_names(spark):
    old = [samples.report(1), samples.report(2, make="Opal"), samples.report(3, model="HILL", top="X")]
    cells = report_cells(samples.reports(spark, old))
    deltas = signed_cells(samples.reports(spark, [samples.report(3, make="Opal")]), samples.reports(spark, [old[0], old[2]]))
    after = apply_deltas(cells, deltas)
    assert content(after) == content(report_cells(samples.reports(spark, [old[1], samples.report(3, make="Opal")])))
    assert {r.vehicle_key for r in after.collect()} == {"opal|river|2015"}


def test_unchanged_reports_touch_nothing(spark, recalls, tmp_path):
    rows = samples.reports(spark, random_reports(random.Random(1), range(20)))
    table = RangedTable(spark, str(tmp_path / "reports"), "id", rows.schema, 10)
    table.replace(rows, ["received_date"])
    changed, replaced = table.changes(rows.filter("id < 5"), ["received_date"])
    assert changed.isEmpty() and replaced.isEmpty()
    assert signed_cells(changed, replaced).isEmpty()


def test_a_slower_writer_commits_nothing(spark, recalls, tmp_path):
    rows = samples.reports(spark, random_reports(random.Random(2), range(10)))
    table = RangedTable(spark, str(tmp_path / "reports"), "id", rows.schema, 10)
    table.replace(rows, ["received_date"])
    changed, _ = table.changes(samples.reports(spark, [samples.report(3, injured=9)]), ["received_date"])
    table.upsert(samples.reports(spark, [samples.report(4, injured=8)]), ["received_date"])
    with pytest.raises(StaleBase):
        table.apply(changed, 1)
    assert {r.injured for r in table.read().filter("id IN (3, 4)").collect()} >= {8} and table.version() == 2
