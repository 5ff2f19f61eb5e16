from pyspark.sql import functions as F

from faultline.functions.measures import as_measures
from faultline.operators import maintain as ops
from faultline.operators.profile import profile_scalars
from samples import report, reports, rows


def table(spark, *data):
    return spark.createDataFrame(list(data), "id int, v string, seq int")


def test_upsert_replaces_inserts_and_is_idempotent(spark):
    current = table(spark, (1, "a", 9), (2, "b", 9))
    incoming = table(spark, (2, None, 1), (3, "x", 1), (3, "y", 2))
    once = ops.upsert(current, incoming, ["id"], [F.col("seq")])
    assert rows(once) == [(1, "a", 9), (2, None, 1), (3, "y", 2)]
    assert rows(ops.upsert(once, incoming, ["id"], [F.col("seq")])) == rows(once)
    assert ops.duplicate_keys(once, ["id"]).count() == 0
    assert rows(ops.duplicate_keys(incoming, ["id"])) == [(3, 2)]


def test_merge_fields(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, kept int")
    updates = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, v string, extra string")
    assert rows(ops.merge_fields(target, updates, ["id"])) == [
        (1, "a", 1, None), (2, None, 2, "n"), (3, "c", None, "m"),
    ]
    assert rows(ops.merge_fields(target, updates, ["id"], insert_unmatched=False)) == [
        (1, "a", 1, None), (2, None, 2, "n"),
    ]


def test_rare_makes_in_order(spark):
    raw = [("B",)] * 2 + [("A",)] * 2 + [("C",)] + [("D",)] * 3
    found = ops.rare_makes(spark.createDataFrame(raw, "make_raw string"), below=3)
    assert [tuple(r) for r in found.collect()] == [("A", 2), ("B", 2), ("C", 1)]


def test_range_histogram_drops_overflow(spark):
    values = spark.createDataFrame([(0,), (9,), (10,), (29,), (30,), (-1,), (None,)], "v int")
    assert rows(ops.range_histogram(values, "v", [0, 10, 20, 30])) == [(0, 10, 2), (10, 20, 1), (20, 30, 1)]


def test_reconciliation_counts_absent_makes_as_zero(spark):
    counts = spark.createDataFrame([("FORD", 382_000)], "make string, count bigint")
    found = {r.make: r.difference for r in ops.reconcile_counts(counts, ops.expected_counts(spark)).collect()}
    assert found["FORD"] == -512 and found["VOLVO"] == -15_161 and len(found) == 15


def test_acceptance_checks(spark):
    made = reports(spark, [report(1, miles=5), report(2, miles=30_000), report(3, miles=26_000), report(4)])
    found = ops.acceptance_checks(
        spark, made, profile_scalars(as_measures(made)), complaints_above=3, makes_below=1,
        profile_key="opal|river|2015",
        histogram={"make": "OPAL", "component_group": "ENGINE", "counts": (1, 2)},
    )
    assert {r["check"]: (r.value, r.passed) for r in found.collect()} == {
        "complaints": ("4", True), "canonical makes": ("1", False), "profile opal|river|2015": ("1", True),
        "mileage histogram": ("1/2", True), "personal data": ("none", True),
    }
