from pyspark.sql import functions as F

from faultline.functions.measures import as_measures
from faultline.operators import catalog, taxonomy
from faultline.operators.profile import component_rows, profile_scalars
from samples import recall, recalls, report, reports, rows


def seeded(spark):
    return reports(
        spark,
        [
            report(1, group="ENGINE", top="ENGINE", miles=1_000),
            report(2, group="ENGINE", top="ENGINE AND COOLING", miles=30_000),
            report(3, make="BERYL", model="HILL", year=2016, group="ENGINE", top="ENGINE", miles=120_000),
            report(4, make="BERYL", model="HILL", year=None, group="ENGINE", top="ENGINE"),
            report(5, model="LAKE", group="BRAKES"),
            report(6, group="UNKNOWN", top=""),
        ],
    )


def test_catalogue_counts_campaigns_once(spark):
    recall_table = recalls(
        spark,
        [
            recall(1, "C1"), recall(2, "C1", group="SEATS"), recall(3, "C2"), recall(4, "C1", model="LAKE"),
            recall(5, "C9", make="NOWHERE"),
        ],
    )
    found = catalog.vehicle_catalog(as_measures(seeded(spark)), recall_table)
    assert rows(found, "vehicle_key", "make_slug", "complaint_count", "recall_count") == [
        ("beryl|hill|2016", "beryl", 1, 0), ("opal|lake|2015", "opal", 1, 1), ("opal|river|2015", "opal", 3, 2),
    ]


def test_overview_and_coverage(spark):
    table = seeded(spark)
    measures = as_measures(table)
    totals = catalog.overview(
        spark, table, recalls(spark, [recall(1, "C1")]), catalog.vehicle_entries(measures),
        profile_scalars(measures),
    )
    assert tuple(totals.first()) == (6, 1, 3, 5, 2, 2, 3, 2015, 2016)
    assert tuple(catalog.coverage_gap(totals).first()) == (1, 0, 50.0)


def test_empty_tables_have_an_overview(spark):
    empty = reports(spark, [])
    measures = as_measures(empty)
    totals = catalog.overview(
        spark, empty, recalls(spark, []), catalog.vehicle_entries(measures), profile_scalars(measures)
    )
    assert tuple(totals.first()) == (0, 0, 0, 0, 0, 0, 0, None, None)


def test_rankings(spark):
    vehicles = catalog.vehicle_entries(as_measures(seeded(spark)))
    assert [tuple(r) for r in catalog.make_ranking(vehicles).collect()] == [
        ("opal", "OPAL", 4, 2), ("beryl", "BERYL", 1, 1),
    ]
    models = catalog.make_models(vehicles)
    assert rows(models, "model_slug", "complaint_count", "make_complaint_count", "share") == [
        ("hill", 1, 1, 100.0), ("lake", 1, 4, 25.0), ("river", 3, 4, 75.0),
    ]
    tiers = catalog.make_tiers(vehicles, leader_from=4, single_figure_below=2)
    assert rows(tiers, "make_slug", "tier", "single_figure", "share") == [
        ("beryl", "tail", True, 20.0), ("opal", "leader", False, 80.0),
    ]
    requests = spark.createDataFrame(
        [("opal", "lake", 2015), ("opal", "lake", 1990)], "make_slug string, model_slug string, model_year int"
    )
    assert rows(catalog.resolve_vehicles(requests, vehicles), "model_year", "vehicle_key") == [
        (1990, None), (2015, "opal|lake|2015"),
    ]


def test_taxonomy(spark):
    measures = as_measures(seeded(spark))
    table = taxonomy.component_taxonomy(measures, component_rows(measures), profile_scalars(measures))
    found = {r.component_group: r for r in table.collect()}
    engine = found["ENGINE"]
    assert (engine.complaint_count, engine.with_mileage) == (4, 3)
    assert engine.top_levels == ["ENGINE", "ENGINE AND COOLING"]
    assert [tuple(m) for m in engine.top_makes] == [("BERYL", 2), ("OPAL", 2)]
    assert [(v.vehicle_key, v["count"], v.total_complaints) for v in engine.top_vehicles] == [
        ("opal|river|2015", 2, 3), ("beryl|hill|2016", 1, 1),
    ]
    assert found["UNKNOWN"].top_levels == []
    unknown_only = taxonomy.component_taxonomy(
        measures, component_rows(measures).filter(F.lit(False)), profile_scalars(measures)
    )
    assert {len(r.top_vehicles) for r in unknown_only.collect()} == {0}


def test_group_reads(spark):
    totals = taxonomy.group_totals(as_measures(seeded(spark)))
    assert [r.slug for r in taxonomy.group_ranking(totals).collect()] == ["engine", "brakes", "unknown"]
    asked = spark.createDataFrame([("brakes",), ("flux-capacitor",)], "slug string")
    assert rows(taxonomy.group_by_slug(totals, asked), "component_group") == [("BRAKES",)]
    shape = {r.component_group: r for r in taxonomy.group_shape(totals).collect()}
    assert (shape["ENGINE"].shape, shape["ENGINE"].peak_label, shape["ENGINE"].thin_sample) == (
        "near", "0–25k", True,
    )
    assert (shape["BRAKES"].shape, shape["BRAKES"].early_share) == ("broad", 0.0)
