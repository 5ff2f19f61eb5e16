"""Additive measures of a report and the fixed mileage histogram.

`as_measures` turns report rows into columns that only ever need summing. Every derived table is built
from sums of these, so it can be computed from raw reports or from pre-aggregated cells alike.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.fixed_values import MILEAGE_BIN_WIDTH, MILEAGE_LAST_BIN, SEVERITY_SIGNALS

BINS = tuple(range(MILEAGE_LAST_BIN + 1))
BIN_COLUMNS = tuple(f"bin_{i}" for i in BINS)
SIGNALS = tuple(name for name, _, _ in SEVERITY_SIGNALS)
MEASURES = ("complaints", "with_mileage", "mileage_total", *SIGNALS, *BIN_COLUMNS)
DIMENSIONS = (
    "vehicle_key",
    "make",
    "model",
    "model_year",
    "component_group",
    "top_level",
    "received_year",
)


def bin_index(miles: str) -> str:
    """SQL for the histogram bin of a reading, null without one.

    The guard matters: `least` and `greatest` skip nulls, so a missing reading would land in a bin.
    """
    floored = f"cast(floor({miles} / {MILEAGE_BIN_WIDTH}) AS int)"
    return f"CASE WHEN {miles} IS NOT NULL THEN least(greatest({floored}, 0), {MILEAGE_LAST_BIN}) END"


def bin_bounds(index: int) -> tuple[int, int | None]:
    low = index * MILEAGE_BIN_WIDTH
    return low, None if index == MILEAGE_LAST_BIN else low + MILEAGE_BIN_WIDTH


def bin_label(index: int) -> str:
    low, high = bin_bounds(index)
    return f"{low // 1000}k+" if high is None else f"{low // 1000}–{high // 1000}k"


def as_measures(reports: DataFrame) -> DataFrame:
    """Dimensions and additive measures of every report. A projection: no shuffle, prunable."""

    def flag(condition: str) -> str:
        return f"CASE WHEN {condition} THEN 1L ELSE 0L END"

    index = bin_index("miles_at_failure")
    measures = {
        "complaints": "1L",
        "with_mileage": flag("miles_at_failure IS NOT NULL"),
        "mileage_total": "cast(coalesce(miles_at_failure, 0) AS bigint)",
        "crashes": flag("crash"),
        "fires": flag("fire"),
        "injured": "cast(injured AS bigint)",
        "deaths": "cast(deaths AS bigint)",
        "police_reports": flag("police_report"),
        "vehicles_towed": flag("vehicle_towed"),
        "medical_attention": flag("medical_attention"),
        **{f"bin_{i}": flag(f"mileage_bin = {i}") for i in BINS},
    }
    return reports.selectExpr("*", f"{index} AS mileage_bin").selectExpr(
        "vehicle_key",
        "make",
        "model",
        "model_year",
        "component.group AS component_group",
        "get(component.levels, 0) AS top_level",
        "year(received_date) AS received_year",
        *[f"{column} AS {name}" for name, column in measures.items()],
    )


def report_cells(reports: DataFrame) -> DataFrame:
    """Measures summed per distinct combination of dimensions.

    One scan and one shuffle with map-side combine. The number of cells is bounded by vehicles x groups
    x years, not by reports, so tables rebuilt together share it instead of rescanning the reports.
    """
    return as_measures(reports).groupBy(*DIMENSIONS).agg(*summed(MEASURES))


def summed(names: Iterable[str]) -> list[Column]:
    return [F.expr(f"sum({name}) AS {name}") for name in names]


def vehicle_sums(measures: DataFrame, names: Iterable[str]) -> DataFrame:
    """Sums per vehicle with a known model year, under its smallest make and model name.

    Names are grouped along with the key first: sums of numbers are aggregated in hash maps, while a
    minimum of text would make Spark sort all reports before combining them.
    """
    names = list(names)
    known = measures.filter(F.col("model_year").isNotNull())
    per_name = known.groupBy("vehicle_key", "make", "model", "model_year").agg(*summed(names))
    return per_name.groupBy("vehicle_key").agg(
        F.min("make").alias("make"),
        F.min("model").alias("model"),
        F.min("model_year").alias("model_year"),
        *summed(names),
    )


def histogram_array() -> Column:
    """The eleven bins of a row as an array of (from, to, count); every bin is present."""

    def cell(i: int) -> str:
        low, high = bin_bounds(i)
        upper = "cast(NULL AS int)" if high is None else str(high)
        return f"named_struct('from', {low}, 'to', {upper}, 'count', bin_{i})"

    return F.expr(f"array({', '.join(cell(i) for i in BINS)})")


def histogram_rows(table: DataFrame, *keep: str) -> DataFrame:
    """One row per bin: the kept columns, then `bin`, `miles_from`, `miles_to` and `count`."""
    bins = F.posexplode(histogram_array()).alias("bin", "cell")
    return table.select(*keep, bins).select(
        *keep,
        "bin",
        F.col("cell.from").alias("miles_from"),
        F.col("cell.to").alias("miles_to"),
        F.col("cell.count").alias("count"),
    )


def severity_rows(table: DataFrame, *keep: str) -> DataFrame:
    """One row per severity signal: the kept columns, then `signal`, `label`, `critical`, `count`."""
    signals = F.array(
        *[
            F.struct(
                F.lit(name).alias("signal"),
                F.lit(label).alias("label"),
                F.lit(critical).alias("critical"),
                F.col(name).alias("count"),
            )
            for name, label, critical in SEVERITY_SIGNALS
        ]
    )
    return table.select(*keep, F.inline(signals))


def share(part: Column, whole: Column) -> Column:
    """Percentage of the whole, 0 when there is no whole."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def width(part: Column, leader: Column) -> Column:
    """Whole percentage of the leader, halves away from zero, 0 without a leader."""
    return F.when(leader > 0, F.round(part * F.lit(100.0) / leader)).otherwise(F.lit(0.0)).cast("int")
