import datetime as dt
import re

from pyspark.sql import functions as F

from faultline.functions.measures import as_measures
from faultline.operators import compare
from faultline.operators import recalls as ops
from faultline.operators.catalog import vehicle_entries
from faultline.operators.profile import component_rows, profile_scalars
from samples import recall, recalls, report, reports, rows


def days(n):
    return dt.date(2020, 1, n)


def seeded(spark):
    return recalls(
        spark,
        [
            recall(4, "C1", day=days(3), affected=900, name="ENGINE:HOSE", park_outside=True),
            recall(2, "C1", day=days(1), affected=1200, do_not_drive=True),
            recall(3, "C1", model="LAKE", year=2017, day=days(2)),
            recall(1, "c1", day=days(9), affected=None),
            recall(5, "C2", day=None, group="SEATS"),
            recall(6, "C3", make="BERYL", day=days(5), do_not_drive=True),
        ],
    )


def newest():
    return [(-F.col("id")).alias("id")]


def test_campaign_detail_takes_text_from_the_first_row_and_flags_from_all(spark):
    found = {r.campaign_number: r for r in ops.campaign_detail(seeded(spark), [F.col("id")]).collect()}
    c1 = found["C1"]
    assert (c1.defect_description, c1.do_not_drive, c1.park_outside) == ("defect 2", True, True)
    assert (c1.potentially_affected, c1.vehicle_count, c1.report_received_date) == (1200, 2, days(1))


def test_campaign_vehicles_and_coverage(spark):
    listed = ops.campaign_vehicles(seeded(spark), limit=1)
    assert rows(listed.filter("campaign_number = 'C1'"), "vehicle_key") == [("opal|lake|2017",)]
    coverage = ops.recall_coverage(ops.campaign_vehicles(seeded(spark)), model_rows=1)
    assert rows(coverage.filter("campaign_number = 'C1'"), "model", "model_year") == [("LAKE", 2017)]
    nested = ops.nested_coverage(ops.recall_coverage(ops.campaign_vehicles(seeded(spark))))
    c1 = nested.filter("campaign_number = 'C1'").first()
    assert [(m.model, m.years) for m in c1.makes[0].models] == [("LAKE", [2017]), ("RIVER", [2015])]


def test_nested_coverage_needs_no_places(spark):
    made = [recall(k, "C1", year=y) for k, y in enumerate([2015, None, 2017, 2016, 2017])] + [recall(9, "C1", model="LAKE")]
    nested = ops.nested_coverage(ops.covered_vehicles(recalls(spark, made)))
    assert not re.search("Window|Join", nested._jdf.queryExecution().executedPlan().toString())
    found = [(m.model, m.years) for m in nested.first().makes[0].models]
    assert found == [("LAKE", [2015]), ("RIVER", [2017, 2016, 2015, None])]


def test_advisories_count_flagged_rows_only(spark):
    found = ops.latest_advisories(seeded(spark), limit=5).collect()
    assert [(r.campaign_number, r.vehicle_count, r.report_received_date) for r in found] == [
        ("C3", 1, days(5)), ("C1", 1, days(3)),
    ]


def test_summary_sees_the_newest_row_only_while_fold_sees_all(spark):
    summary = ops.recall_summary(seeded(spark), newest()).filter("vehicle_key = 'opal|river|2015'").first()
    # C1 and c1 are one campaign here, and its newest row carries no flag.
    assert (summary.campaign_count, summary.urgent_count, summary.group_count) == (2, 0, 2)
    assert (summary.earliest_year, summary.latest_year) == (2020, 2020)
    fold = ops.recall_fold(seeded(spark), newest()).filter("vehicle_key = 'opal|river|2015'")
    found = [tuple(r) for r in fold.orderBy("position").select(
        "campaign_number", "component_names", "potentially_affected", "urgent", "advisory").collect()]
    assert found == [
        ("C1", ["ENGINE", "ENGINE:HOSE"], 1200, True, "do not drive, and park outside"),
        ("c1", ["ENGINE"], None, False, "none"),
        ("C2", ["SEATS"], None, False, "none"),
    ]
    assert rows(ops.urgent_campaigns(seeded(spark), newest())) == [("beryl|river|2015", "C3")]


def test_fold_shuffles_rows_once_and_campaigns_once(spark):
    fold = ops.recall_fold(seeded(spark), newest())
    plan = fold._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2


def test_fold_of_null_dates_and_names(spark):
    made = [recall(1, "C1", day=None, affected=3), recall(2, "C1", day=days(2), group="SEATS"), recall(3, "C1", day=days(1)),
            recall(4, "C2", day=None)]
    made[2] = (*made[2][:7], None, *made[2][8:])
    fold = ops.recall_fold(recalls(spark, made), newest()).orderBy("position")
    found = [tuple(r) for r in fold.select("campaign_number", "component_group", "component_names", "report_received_date").collect()]
    assert found == [("C1", "SEATS", ["ENGINE", "SEATS"], days(2)), ("C2", "ENGINE", ["ENGINE"], None)]


def test_vehicle_recalls_newest_first(spark):
    found = ops.vehicle_recalls(seeded(spark), ["id"], [F.col("id")]).filter("vehicle_key = 'opal|river|2015'")
    assert [r.id for r in found.collect()] == [1, 4, 2, 5]


def compared(spark):
    groups_a = {f"G{i}": 10 - i for i in range(10)}
    made = [report(1, group=g) for g, n in groups_a.items() for _ in range(n)]
    made += [report(1, model="LAKE", group=g) for g in ("G9", "Z", "Z")]
    measures = as_measures(reports(spark, made))
    pairs = spark.createDataFrame(
        [(1, "opal|river|2015", "opal|lake|2015")], "pair_id int, key_a string, key_b string"
    )
    return pairs, component_rows(measures), profile_scalars(measures)


def test_compare_components_unites_top_groups_and_adds_the_remainder(spark):
    pairs, groups, profiles = compared(spark)
    found = compare.compare_components(pairs, groups, profiles).orderBy("position").collect()
    assert [r.label for r in found] == ["Z", "G9", "G0", "G1", "G2", "G3", "G4", "G5", "G6", "G7", "All other groups"]
    assert (found[-1].count_a, found[-1].count_b, found[-1].is_remainder) == (2, 0, True)
    assert sum(r.count_a for r in found) == 55 and sum(r.count_b for r in found) == 3
    assert found[0].width_b == 100


def test_compare_other_tables(spark):
    pairs, _, profiles = compared(spark)
    assert compare.compare_mileage(pairs, profiles).count() == 11
    assert compare.compare_severity(pairs, profiles).count() == 7
    caveats = compare.compare_caveats(pairs, profiles).first()
    assert (caveats.lopsided, caveats.small_sample, caveats.thin_mileage, caveats.has_mileage) == (
        True, True, True, False,
    )


def test_request_status(spark):
    measures = as_measures(reports(spark, [report(1), report(2, model="LAKE")]))
    profiles = profile_scalars(measures).filter("model = 'RIVER'")
    asked = [
        (1, None, None, None, None), (2, "  ", " ", None, None), (3, "opal|river|2015", None, None, None),
        (4, " Opal|RIVER|2015 ", None, None, None), (5, None, "OPAL", "river", 2015),
        (6, "opal|river|1999", None, None, None), (7, "opal|river", None, None, None),
        (8, "opal|river|soon", None, None, None), (9, None, "opal", None, 2015),
        (10, "opal|lake|2015", None, None, None), (11, "junk", "opal", "river", 2015),
        (12, None, "opal", "river", 0),
    ]
    requests = spark.createDataFrame(asked, "i int, key string, make string, model string, year int")
    found = dict(rows(compare.request_status(requests, vehicle_entries(measures), profiles), "i", "status"))
    assert found == {
        1: "empty", 2: "empty", 3: "resolved", 4: "resolved", 5: "resolved", 6: "unknown", 7: "unknown",
        8: "unknown", 9: "incomplete", 10: "missing", 11: "resolved", 12: "incomplete",
    }
