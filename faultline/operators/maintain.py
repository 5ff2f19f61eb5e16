"""Keyed table maintenance, load reports and acceptance checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.fixed_values import (
    ACCEPTED_COMPLAINTS_ABOVE,
    ACCEPTED_MAKES_BELOW,
    EXPECTED_HISTOGRAM,
    EXPECTED_MAKE_COUNTS,
    EXPECTED_PROFILE_KEY,
    MILEAGE_BIN_WIDTH,
    RARE_MAKE_BELOW,
)
from faultline.operators.records import MappedRecords, personal_data_columns
from faultline.sources.flat import FlatLines


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of every key that is last in `order`.

    Keys that occur more than once are found by a narrow count; rows of other keys pass as they are, so only
    repeated ones are compared. Among these an aggregate, not a window: duplicates of a hot key shrink to one row
    per task before the shuffle.
    """
    rest = [name for name in rows.columns if name not in keys]
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(
        *[F.col(key).alias(f"_twice_{key}") for key in keys]
    )
    same = [F.col(key).eqNullSafe(F.col(f"_twice_{key}")) for key in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    compared = rows.join(repeated, same, "left_semi").groupBy(*keys).agg(newest).select(*keys, "newest.*")
    return rows.join(repeated, same, "left_anti").unionByName(compared.select(*rows.columns))


def upsert(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Whole-row replacement by key; new keys are inserted. Running it again changes nothing.

    The winner among rows with one key inside `incoming` is the last in `order`. Current rows are only
    filtered by the incoming keys, which Spark broadcasts when they are small enough.
    """
    newest = latest_per_key(incoming, keys, order)
    kept = current.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest)


def merge_fields(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], insert_unmatched: bool = True
) -> DataFrame:
    """Overwrite the updated fields of matching rows, keep the others.

    A matched row takes the new value even when it is null. Unmatched updates become rows, with nulls
    in the fields they lack, or are dropped when `insert_unmatched` is false.
    """
    keys = list(keys)
    fresh = [name for name in updates.columns if name not in keys]
    renamed = updates.select(
        *keys, *[F.col(name).alias(f"_new_{name}") for name in fresh], F.lit(True).alias("_matched")
    )
    joined = target.join(renamed, keys, "full" if insert_unmatched else "left")

    def value(name: str) -> Column:
        if name in keys or name not in fresh:
            return F.col(name)
        if name not in target.columns:
            return F.col(f"_new_{name}").alias(name)
        return F.when(F.col("_matched"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    names = [*target.columns, *[name for name in fresh if name not in target.columns]]
    return joined.select(*[value(name) for name in names])


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; empty for a sound table."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def spelling_counts(reports: DataFrame) -> DataFrame:
    """Accepted complaints per raw spelling of a make and the make it became: one row a spelling, summed before it moves."""
    return reports.groupBy("make_raw", "make").agg(F.count("*").alias("count"))


def load_summary(spellings: DataFrame, seconds: float) -> DataFrame:
    """One row: accepted complaints, how many raw and canonical makes they name, and how long the load took."""
    return spellings.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("accepted"),
        F.count_distinct("make_raw").alias("raw_makes"),
        F.count_distinct("make").alias("canonical_makes"),
        F.lit(seconds).alias("duration_seconds"),
    )


def rare_makes(reports: DataFrame, below: int = RARE_MAKE_BELOW) -> DataFrame:
    """Raw make spellings with few complaints, most frequent first."""
    counted = reports.groupBy("make_raw").agg(F.count("*").alias("count"))
    return rare_spellings(counted, below)


def rare_spellings(spellings: DataFrame, below: int = RARE_MAKE_BELOW) -> DataFrame:
    """The same from counts per spelling."""
    counted = spellings.groupBy("make_raw").agg(F.sum("count").alias("count"))
    return counted.filter(F.col("count") < below).orderBy(F.desc("count"), "make_raw")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, sorted as given."""
    rows.write.mode("overwrite").json(path)


def _counters(**more: Column) -> list[Column]:
    """Load counters of judged lines: lines, blanks, other products, mapping failures, accepted rows, and more of these."""
    record, vehicle, failed = F.col("is_record"), F.col("is_vehicle"), F.col("reject_reason").isNotNull()
    return [
        F.count_if(record).alias("lines_read"),
        F.count_if("is_blank").alias("blank_lines"),
        F.count_if(~F.col("is_blank") & ~record).alias("malformed_lines"),
        F.count_if(record & ~vehicle).alias("non_vehicle"),
        F.count_if(record & vehicle & failed).alias("mapping_failures"),
        F.count_if(record & vehicle & ~failed).alias("accepted"),
        *[F.count_if(record & vehicle & ~failed & flag).alias(name) for name, flag in more.items()],
    ]


def complaint_metrics(lines: FlatLines, mapped: MappedRecords) -> DataFrame:
    """One row of load counters, in one pass over the lines, which are those that `mapped` judges."""
    return mapped.judged.agg(*_counters())


def recall_metrics(lines: FlatLines, mapped: MappedRecords) -> DataFrame:
    """The same for recalls, with the number of accepted rows that carry each advisory."""
    return mapped.judged.agg(*_counters(do_not_drive_rows=F.col("do_not_drive"), park_outside_rows=F.col("park_outside")))


def make_counts(reports: DataFrame, column: str = "make") -> DataFrame:
    """Accepted complaints per raw or canonical make."""
    return reports.groupBy(column).agg(F.count("*").alias("count"))


def range_histogram(values: DataFrame, value: str, boundaries: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Counts per half-open range between explicit boundaries; values outside all ranges are left out.

    Every range is present. `by` gives one histogram per group.
    """
    ranges = list(zip(boundaries[:-1], boundaries[1:]))
    column = F.col(value)
    counted = values.groupBy(*by).agg(
        *[
            F.count_if((column >= low) & (column < high)).alias(f"_range_{i}")
            for i, (low, high) in enumerate(ranges)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(low).alias("range_from"),
                F.lit(high).alias("range_to"),
                F.col(f"_range_{i}").alias("count"),
            )
            for i, (low, high) in enumerate(ranges)
        ]
    )
    return counted.select(*by, F.inline(rows))


def expected_counts(
    spark: SparkSession, expected: Mapping[str, int] = EXPECTED_MAKE_COUNTS
) -> DataFrame:
    return spark.createDataFrame(
        pa.table(
            {
                "make": pa.array(list(expected.keys()), pa.string()),
                "expected": pa.array(list(expected.values()), pa.int64()),
            }
        )
    )


def reconcile_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against actual complaints per make, with the difference; absent makes count 0."""
    actual = F.coalesce("count", F.lit(0).cast("bigint"))
    return expected.join(counts, "make", "left").select(
        "make", "expected", actual.alias("actual"), (actual - F.col("expected")).alias("difference")
    )


def acceptance_checks(
    spark: SparkSession,
    reports: DataFrame,
    profiles: DataFrame,
    complaints_above: int = ACCEPTED_COMPLAINTS_ABOVE,
    makes_below: int = ACCEPTED_MAKES_BELOW,
    profile_key: str = EXPECTED_PROFILE_KEY,
    histogram: Mapping = EXPECTED_HISTOGRAM,
) -> DataFrame:
    """Pass or fail of a load, one row per check, with the measured value as text."""
    totals = reports.agg(
        F.struct(F.count("*").alias("complaints"), F.count_distinct("make").alias("makes"))
    ).scalar()
    found = profiles.filter(F.col("vehicle_key") == profile_key).agg(F.count("*")).scalar()
    expected = list(histogram["counts"])
    bounds = [i * MILEAGE_BIN_WIDTH for i in range(len(expected) + 1)]
    chosen = reports.filter(
        (F.col("make") == histogram["make"])
        & (F.col("component.group") == histogram["component_group"])
        & F.col("miles_at_failure").isNotNull()
    )
    miles = F.col("miles_at_failure")
    bins = chosen.agg(
        F.array(*[F.count_if((miles >= a) & (miles < b)) for a, b in zip(bounds[:-1], bounds[1:])])
    ).scalar()
    leaked = personal_data_columns(reports.schema)
    measured = spark.range(1).select(
        totals.alias("totals"), found.alias("found"), bins.alias("bins")
    )
    wanted_bins = F.array(*[F.lit(n).cast("bigint") for n in expected])
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"), value.cast("string").alias("value"), passed.alias("passed")
            )
            for name, value, passed in (
                (
                    "complaints", F.col("totals.complaints"),
                    F.col("totals.complaints") > complaints_above,
                ),
                ("canonical makes", F.col("totals.makes"), F.col("totals.makes") < makes_below),
                (f"profile {profile_key}", F.col("found"), F.col("found") > 0),
                (
                    "mileage histogram", F.array_join(F.col("bins").cast("array<string>"), "/"),
                    F.col("bins") == wanted_bins,
                ),
                (
                    "personal data", F.lit(",".join(leaked) or "none"), F.lit(not leaked),
                ),
            )
        ]
    )
    return measured.select(F.inline(checks))
