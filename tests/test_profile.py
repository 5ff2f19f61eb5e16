from pyspark.sql import functions as F

from faultline.functions.measures import as_measures, histogram_rows, report_cells
from faultline.operators import profile as ops
from samples import report, reports, rows

BOUNDARIES = (0, 24_999, 25_000, 250_000, 400_000, None)


def test_histogram_boundaries(spark):
    table = reports(spark, [report(i, miles=m) for i, m in enumerate(BOUNDARIES)])
    profile = ops.vehicle_profiles(as_measures(table)).first()
    assert [b["count"] for b in profile.mileage_histogram] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert (profile.mileage_histogram[0]["from"], profile.mileage_histogram[0].to) == (0, 25_000)
    assert (profile.mileage_histogram[10]["from"], profile.mileage_histogram[10].to) == (250_000, None)
    assert (profile.total_complaints, profile.with_mileage) == (6, 5)


def test_average_rounds_half_to_even_and_is_null_without_sample(spark):
    table = reports(
        spark,
        [
            report(1, miles=10), report(2, miles=11),
            report(3, model="LAKE", miles=11), report(4, model="LAKE", miles=12),
            report(5, model="HILL"),
        ],
    )
    found = rows(ops.profile_scalars(as_measures(table)), "model", "average_miles_at_failure")
    assert found == [("HILL", None), ("LAKE", 12), ("RIVER", 10)]


def seeded(spark):
    return reports(
        spark,
        [
            report(1, group="ENGINE", year_received=2018, crash=True, injured=2),
            report(2, group="BRAKES", year_received=2018, fire=True, vehicle_towed=True),
            report(3, group="BRAKES", year_received=2021, deaths=1, police_report=True),
            report(4, group="SEATS", year_received=2021, medical_attention=True),
            report(5, year=None, group="SEATS"),
            report(6, model="LAKE", year_received=2010),
        ],
    )


def test_nested_profile(spark):
    table = ops.vehicle_profiles(as_measures(seeded(spark)), F.lit("2024-01-01").cast("timestamp"))
    found = {r.vehicle_key: r for r in table.collect()}
    assert sorted(found) == ["opal|lake|2015", "opal|river|2015"]
    river = found["opal|river|2015"]
    assert [tuple(c) for c in river.components] == [("BRAKES", 2), ("ENGINE", 1), ("SEATS", 1)]
    assert [tuple(t) for t in river.timeline] == [(2018, 2), (2021, 2)]
    assert tuple(river.severity) == (1, 1, 2, 1, 1, 1, 1)


def test_cells_give_the_same_tables_as_reports(spark):
    direct, cells = as_measures(seeded(spark)), report_cells(seeded(spark))
    for operator in (ops.profile_scalars, ops.component_rows, ops.timeline_rows):
        assert rows(operator(direct)) == rows(operator(cells))


def test_stored_profiles_read_back_flat(spark):
    measures = as_measures(seeded(spark))
    nested = ops.vehicle_profiles(measures)
    flat = ops.profile_scalars(measures)
    assert rows(ops.flat_profiles(nested)) == rows(flat.select(ops.flat_profiles(nested).columns))
    assert rows(ops.stored_component_rows(nested)) == rows(ops.component_rows(measures))
    assert rows(ops.stored_timeline_rows(nested)) == rows(ops.timeline_rows(measures))


def test_sums_agree(spark):
    measures = as_measures(seeded(spark))
    totals = dict(rows(ops.profile_scalars(measures), "vehicle_key", "total_complaints"))
    for table in (ops.component_rows(measures), ops.timeline_rows(measures)):
        summed = dict(rows(table.groupBy("vehicle_key").agg(F.sum("count"))))
        assert summed == totals
    bins = histogram_rows(ops.profile_scalars(measures), "vehicle_key").agg(F.sum("count")).first()[0]
    assert bins == 0


def test_dense_timeline_and_peak(spark):
    timeline = ops.timeline_rows(as_measures(seeded(spark)))
    dense = ops.dense_timeline(timeline).filter("vehicle_key = 'opal|river|2015'")
    assert rows(dense, "year", "count", "width", "is_peak") == [
        (2018, 2, 100, True), (2019, 0, 0, False), (2020, 0, 0, False), (2021, 2, 100, False),
    ]
    peaks = ops.timeline_peaks(timeline, F.lit("2021-03-01").cast("date"))
    assert rows(peaks, "vehicle_key", "peak_year", "last_year_is_partial") == [
        ("opal|lake|2015", 2010, False), ("opal|river|2015", 2018, True),
    ]


def test_recent_reports_keep_the_newest(spark):
    table = reports(spark, [report(i, year_received=2000 + i % 4) for i in range(10)])
    found = ops.recent_reports(table, ["id"], [F.col("id")], limit=3)
    assert rows(found, "position", "id") == [(1, 3), (2, 7), (3, 2)]


def test_shares_and_summary(spark):
    measures = as_measures(seeded(spark))
    scalars, groups = ops.profile_scalars(measures), ops.component_rows(measures)
    shares = ops.component_shares(groups, scalars).filter("vehicle_key = 'opal|river|2015'")
    assert rows(shares, "position", "component_group", "share", "width", "classified") == [
        (1, "BRAKES", 50.0, 100, 4), (2, "ENGINE", 25.0, 50, 4), (3, "SEATS", 25.0, 50, 4),
    ]
    summary = ops.profile_summary(scalars, groups, ops.timeline_rows(measures))
    assert rows(
        summary, "vehicle_key", "component_groups", "first_report_year", "last_report_year", "small_sample"
    ) == [("opal|lake|2015", 1, 2010, 2010, True), ("opal|river|2015", 3, 2018, 2021, True)]
    highlighted = ops.severity_summary(scalars).filter("highlighted")
    assert rows(highlighted, "signal") == [("deaths",), ("fires",), ("injured",)]
    thin = ops.histogram_shares(scalars).agg(F.max("thin_sample"), F.max("share")).first()
    assert tuple(thin) == (False, 0.0)
