"""Failure profiles per vehicle, and what a profile page derives from them.

Functions named `*_rows` and the ones below them take `measures`: the output of `as_measures` or of
`report_cells`. Only vehicles with a known model year have a profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.fixed_values import RECENT_REPORTS, SMALL_SAMPLE_BELOW, THIN_MILEAGE_BELOW
from faultline.functions.measures import (
    BIN_COLUMNS,
    MEASURES,
    SIGNALS,
    histogram_array,
    histogram_rows,
    severity_rows,
    share,
    vehicle_sums,
    width,
)


def known_year(measures: DataFrame) -> DataFrame:
    return measures.filter(F.col("model_year").isNotNull())


def average_miles() -> Column:
    """Mean reading as a whole number, halves to even, null without a sample."""
    mean = F.col("mileage_total") / F.nullif(F.col("with_mileage"), F.lit(0).cast("bigint"))
    return F.bround(mean).cast("int")


def profile_scalars(measures: DataFrame) -> DataFrame:
    """One row per vehicle: names, counts, average mileage, severity counts and bin counts.

    Two spellings can share a vehicle key; the smaller name is shown.
    """
    return vehicle_sums(measures, MEASURES).select(
        "vehicle_key", "make", "model", "model_year",
        F.col("complaints").alias("total_complaints"),
        "with_mileage", average_miles().alias("average_miles_at_failure"), *SIGNALS, *BIN_COLUMNS,
    )


def component_rows(measures: DataFrame) -> DataFrame:
    """Complaints per vehicle and component group."""
    return (
        known_year(measures)
        .groupBy("vehicle_key", "component_group")
        .agg(F.sum("complaints").alias("count"))
    )


def timeline_rows(measures: DataFrame) -> DataFrame:
    """Complaints per vehicle and year of receipt."""
    return (
        known_year(measures)
        .groupBy("vehicle_key", F.col("received_year").alias("year"))
        .agg(F.sum("complaints").alias("count"))
    )


def _components(rows: DataFrame) -> DataFrame:
    """Breakdown array per vehicle, largest first. At most one element per component group."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("down"), "component_group")))
    plain = F.transform(
        ranked, lambda e: F.struct(e.component_group.alias("group"), (-e.down).alias("count"))
    )
    return rows.groupBy("vehicle_key").agg(plain.alias("components"))


def _timeline(rows: DataFrame) -> DataFrame:
    """Timeline array per vehicle, oldest first. At most one element per year."""
    return rows.groupBy("vehicle_key").agg(
        F.array_sort(F.collect_list(F.struct("year", "count"))).alias("timeline")
    )


def vehicle_profiles(measures: DataFrame, computed_at: Column | None = None) -> DataFrame:
    """The stored profile table: scalars plus breakdown, histogram, timeline and severity, nested.

    Only sums are nested, never reports, so the size of a row does not depend on the number of reports.
    """
    scalars = profile_scalars(measures)
    return (
        scalars.join(_components(component_rows(measures)), "vehicle_key")
        .join(_timeline(timeline_rows(measures)), "vehicle_key")
        .select(
            "vehicle_key", "make", "model", "model_year", "total_complaints", "with_mileage",
            "average_miles_at_failure", "components",
            histogram_array().alias("mileage_histogram"),
            "timeline",
            F.struct(*SIGNALS).alias("severity"),
            (F.current_timestamp() if computed_at is None else computed_at).alias("computed_at"),
        )
    )


def flat_profiles(profiles: DataFrame) -> DataFrame:
    """Stored profiles back in the flat form of `profile_scalars`."""
    return profiles.select(
        "vehicle_key", "make", "model", "model_year", "total_complaints", "with_mileage",
        "average_miles_at_failure",
        *[F.col(f"severity.{name}").alias(name) for name in SIGNALS],
        *[F.col("mileage_histogram")[i]["count"].alias(name) for i, name in enumerate(BIN_COLUMNS)],
    )


def stored_component_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select("vehicle_key", F.inline("components")).withColumnRenamed(
        "group", "component_group"
    )


def stored_timeline_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select("vehicle_key", F.inline("timeline"))


def profiles_by_key(profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """The profiles of the requested keys; a literal filter on `vehicle_key` serves a single one."""
    return profiles.join(keys.select("vehicle_key").distinct(), "vehicle_key", "left_semi")


def recent_reports(
    reports: DataFrame, keep: list[str], tie_break: list[Column], limit: int = RECENT_REPORTS
) -> DataFrame:
    """The newest reports of every vehicle.

    The rank filter lets Spark cut each vehicle to `limit` rows before the shuffle, so a vehicle that
    holds a large part of all reports costs no more than any other.
    """
    newest = Window.partitionBy("vehicle_key").orderBy(F.desc("received_date"), *tie_break)
    return (
        reports.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
        .select("vehicle_key", "position", *keep)
    )


def dense_timeline(timeline: DataFrame) -> DataFrame:
    """Every year between the first and the last of a vehicle, zero where nothing was received.

    Adds `width`, the percentage of the busiest year, and `is_peak`, the earliest busiest year.
    """
    per_year = timeline.groupBy("vehicle_key", "year").agg(F.sum("count").alias("count"))
    nested = per_year.groupBy("vehicle_key").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "count"))).alias("counts"),
        F.min("year").alias("first"),
        F.max("year").alias("last"),
        F.max("count").alias("scale"),
        F.max_by("year", F.struct(F.col("count"), (-F.col("year")).alias("down"))).alias("peak"),
    )
    years = nested.select(
        "vehicle_key", "counts", "scale", "peak", F.explode(F.sequence("first", "last")).alias("year")
    )
    count = F.coalesce(F.try_element_at("counts", F.col("year")), F.lit(0).cast("bigint"))
    return years.select(
        "vehicle_key", "year", count.alias("count"),
        width(count, F.col("scale")).alias("width"),
        (F.col("year") == F.col("peak")).alias("is_peak"),
    )


def timeline_peaks(timeline: DataFrame, today: Column) -> DataFrame:
    """Busiest year per vehicle, and whether its last year is the current, unfinished one."""
    earliest_busiest = F.struct(F.col("count"), (-F.col("year")).alias("down"))
    return timeline.groupBy("vehicle_key").agg(
        F.max_by("year", earliest_busiest).alias("peak_year"),
        F.max("count").alias("peak_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        (F.max("year") == F.year(today)).alias("last_year_is_partial"),
    )


def component_shares(components: DataFrame, totals: DataFrame) -> DataFrame:
    """Breakdown with share of the vehicle total, width of the leading group and classified total.

    `totals` has `vehicle_key` and `total_complaints`. The window covers one vehicle's groups only.
    """
    vehicle = Window.partitionBy("vehicle_key")
    ranked = vehicle.orderBy(F.desc("count"), "component_group")
    return (
        components.join(totals.select("vehicle_key", "total_complaints"), "vehicle_key")
        .withColumn("leader", F.max("count").over(vehicle))
        .select(
            "vehicle_key", "component_group", "count",
            F.row_number().over(ranked).alias("position"),
            share(F.col("count"), F.col("total_complaints")).alias("share"),
            F.round(share(F.col("count"), F.col("total_complaints"))).cast("int").alias("share_label"),
            width(F.col("count"), F.col("leader")).alias("width"),
            "total_complaints",
            F.sum("count").over(vehicle).alias("classified"),
        )
    )


def histogram_shares(profiles: DataFrame) -> DataFrame:
    """Histogram bins with share of the mileage sample, width of the tallest bin, thin-sample flag."""
    rows = histogram_rows(
        profiles.withColumn("tallest", F.greatest(*BIN_COLUMNS)), "vehicle_key", "with_mileage", "tallest"
    )
    return rows.select(
        "vehicle_key", "bin", "miles_from", "miles_to", "count", "with_mileage",
        share(F.col("count"), F.col("with_mileage")).alias("share"),
        F.round(share(F.col("count"), F.col("with_mileage"))).cast("int").alias("share_label"),
        width(F.col("count"), F.col("tallest")).alias("width"),
        F.col("with_mileage").between(1, THIN_MILEAGE_BELOW - 1).alias("thin_sample"),
    )


def severity_summary(profiles: DataFrame) -> DataFrame:
    """One row per vehicle and signal; a critical signal is highlighted as soon as it occurs."""
    return severity_rows(profiles, "vehicle_key", "total_complaints", "deaths", "fires").select(
        "vehicle_key", "signal", "label", "count", "critical",
        (F.col("critical") & (F.col("count") > 0)).alias("highlighted"),
        ((F.col("deaths") > 0) | (F.col("fires") > 0)).alias("severe_outcome"),
        "total_complaints",
    )


def profile_summary(profiles: DataFrame, components: DataFrame, timeline: DataFrame) -> DataFrame:
    """Headline figures of a vehicle: sample size, report span, groups touched, mileage share."""
    touched = components.groupBy("vehicle_key").agg(F.count("*").alias("component_groups"))
    span = timeline.groupBy("vehicle_key").agg(
        F.min("year").alias("first_report_year"), F.max("year").alias("last_report_year")
    )
    return (
        profiles.join(touched, "vehicle_key", "left")
        .join(span, "vehicle_key", "left")
        .select(
            "vehicle_key", "make", "model", "model_year", "total_complaints", "with_mileage",
            share(F.col("with_mileage"), F.col("total_complaints")).alias("mileage_share"),
            "average_miles_at_failure",
            F.coalesce("component_groups", F.lit(0).cast("bigint")).alias("component_groups"),
            "first_report_year", "last_report_year",
            (F.col("total_complaints") < SMALL_SAMPLE_BELOW).alias("small_sample"),
            (F.col("with_mileage") < THIN_MILEAGE_BELOW).alias("thin_mileage"),
        )
    )
