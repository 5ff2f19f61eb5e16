"""The vehicle catalogue and the rankings read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.fixed_values import (
    FREQUENT_MAKE_FROM,
    HOME_GROUPS,
    HOME_MAKES,
    HOME_VEHICLES,
    LEADER_MAKE_FROM,
    SINGLE_FIGURE_BELOW,
)
from faultline.functions.measures import share, vehicle_sums
from faultline.functions.text import key_make, key_model, vehicle_key


def recall_counts(recalls: DataFrame) -> DataFrame:
    """Distinct campaigns per vehicle key; recall rows repeat a campaign and are not counted."""
    pairs = recalls.select("vehicle_key", "campaign_number").distinct()
    return pairs.groupBy("vehicle_key").agg(F.count("*").alias("recall_count"))


def vehicle_entries(measures: DataFrame) -> DataFrame:
    """One row per vehicle with a known model year."""
    return vehicle_sums(measures, ["complaints"]).select(
        "vehicle_key", "make", key_make(F.col("vehicle_key")).alias("make_slug"),
        "model", key_model(F.col("vehicle_key")).alias("model_slug"),
        "model_year", F.col("complaints").alias("complaint_count"),
    )


def vehicle_catalog(measures: DataFrame, recalls: DataFrame) -> DataFrame:
    """Catalogue with the number of recall campaigns, 0 without any; other recalls are left out."""
    return counted_catalog(measures, recall_counts(recalls))


def counted_catalog(measures: DataFrame, counts: DataFrame) -> DataFrame:
    """The catalogue from `recall_counts` that are already there."""
    counted = vehicle_entries(measures).join(counts, "vehicle_key", "left")
    return counted.withColumn("recall_count", F.coalesce("recall_count", F.lit(0).cast("bigint")))


def overview(
    spark: SparkSession, reports: DataFrame, recalls: DataFrame, vehicles: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Data set totals in one row. Every figure is a scalar subquery, so no tables are paired."""
    catalogued = profiles.agg(
        F.struct(
            F.coalesce(F.sum("total_complaints"), F.lit(0).cast("bigint")).alias("complaints"),
            F.count_distinct("make").alias("makes"),
            F.coalesce(F.sum("with_mileage"), F.lit(0).cast("bigint")).alias("with_mileage"),
            F.min("model_year").alias("earliest"),
            F.max("model_year").alias("latest"),
        )
    ).scalar()
    counted = reports.agg(
        F.struct(F.count("*").alias("complaints"), F.count_distinct("make").alias("makes"))
    ).scalar()
    return (
        spark.range(1)
        .select(
            counted.alias("counted"),
            recalls.agg(F.count("*")).scalar().alias("recalls"),
            vehicles.agg(F.count("*")).scalar().alias("vehicles"),
            catalogued.alias("catalogued"),
        )
        .select(
            F.col("counted.complaints").alias("complaints"), "recalls", "vehicles",
            F.col("catalogued.complaints").alias("complaints_in_catalogue"),
            F.col("catalogued.makes").alias("makes"),
            F.col("counted.makes").alias("canonical_makes"),
            F.col("catalogued.with_mileage").alias("complaints_with_mileage"),
            F.col("catalogued.earliest").alias("earliest_model_year"),
            F.col("catalogued.latest").alias("latest_model_year"),
        )
    )


def coverage_gap(totals: DataFrame) -> DataFrame:
    """What the catalogue does not cover, from the overview row."""
    return totals.select(
        (F.col("complaints") - F.col("complaints_in_catalogue")).alias("without_model_year"),
        (F.col("canonical_makes") - F.col("makes")).alias("makes_outside_catalogue"),
        share(F.col("complaints_with_mileage"), F.col("complaints")).alias("mileage_coverage"),
    )


def make_totals(vehicles: DataFrame) -> DataFrame:
    """Complaints and distinct models per make."""
    per_model = vehicles.groupBy("make_slug", "model_slug").agg(
        F.min("make").alias("make"), F.sum("complaint_count").alias("complaint_count")
    )
    return per_model.groupBy("make_slug").agg(
        F.min("make").alias("make"),
        F.sum("complaint_count").alias("complaint_count"),
        F.count("*").alias("model_count"),
    )


def make_ranking(vehicles: DataFrame) -> DataFrame:
    return make_totals(vehicles).orderBy(F.desc("complaint_count"), "make_slug")


def make_models(vehicles: DataFrame) -> DataFrame:
    """Models of every make with their year span and share; the make total and span go along."""
    make = Window.partitionBy("make_slug")
    per_model = vehicles.groupBy("make_slug", "model_slug").agg(
        F.min("make").alias("make"),
        F.min("model").alias("model"),
        F.sum("complaint_count").alias("complaint_count"),
        F.min("model_year").alias("earliest_model_year"),
        F.max("model_year").alias("latest_model_year"),
    )
    spanned = per_model.select(
        "*",
        F.sum("complaint_count").over(make).alias("make_complaint_count"),
        F.min("earliest_model_year").over(make).alias("make_earliest_year"),
        F.max("latest_model_year").over(make).alias("make_latest_year"),
    )
    return spanned.withColumn(
        "share", share(F.col("complaint_count"), F.col("make_complaint_count"))
    ).orderBy("make_slug", F.desc("complaint_count"), "model_slug")


def model_years(vehicles: DataFrame) -> DataFrame:
    """Years of every model, newest first."""
    return vehicles.select(
        "make_slug", "model_slug", "model_year", "vehicle_key", "complaint_count"
    ).orderBy("make_slug", "model_slug", F.desc("model_year"))


def resolve_vehicles(requests: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Identity of every requested (make_slug, model_slug, model_year), null where unknown."""
    key = vehicle_key(F.col("make_slug"), F.col("model_slug"), F.col("model_year"))
    known = vehicles.select("vehicle_key", "make", "model")
    return requests.withColumn("_key", key).join(
        known, F.col("_key") == F.col("vehicle_key"), "left"
    ).drop("_key")


def most_reported(profiles: DataFrame, limit: int = HOME_VEHICLES) -> DataFrame:
    """The vehicles with most complaints."""
    return (
        profiles.orderBy(F.desc("total_complaints"), "vehicle_key")
        .limit(limit)
        .select(
            "vehicle_key", "make", key_make(F.col("vehicle_key")).alias("make_slug"),
            "model", key_model(F.col("vehicle_key")).alias("model_slug"),
            "model_year", "total_complaints", "with_mileage",
        )
    )


def make_tiers(
    vehicles: DataFrame,
    leader_from: int = LEADER_MAKE_FROM,
    single_figure_below: int = SINGLE_FIGURE_BELOW,
) -> DataFrame:
    """Every make as `leader` or `tail` with its share; single-figure makes are marked."""
    makes = make_totals(vehicles)
    total = vehicles.agg(F.sum("complaint_count")).scalar()
    count = F.col("complaint_count")
    return makes.select(
        "make_slug", "make", "complaint_count", "model_count",
        F.when(count >= leader_from, "leader").otherwise("tail").alias("tier"),
        (count < single_figure_below).alias("single_figure"),
        share(count, total).alias("share"),
    )


def make_index_summary(
    vehicles: DataFrame,
    leader_from: int = LEADER_MAKE_FROM,
    single_figure_below: int = SINGLE_FIGURE_BELOW,
) -> DataFrame:
    """Number of makes, single-figure makes, and the leaders' share of all complaints."""
    count = F.col("complaint_count")
    return (
        make_totals(vehicles)
        .agg(
            F.count("*").alias("total_makes"),
            F.coalesce(F.sum("complaint_count"), F.lit(0).cast("bigint")).alias("total_complaints"),
            F.count_if(count >= leader_from).alias("leaders"),
            F.count_if(count < single_figure_below).alias("single_figure_makes"),
            F.coalesce(
                F.sum(F.when(count >= leader_from, count)), F.lit(0).cast("bigint")
            ).alias("leader_complaints"),
        )
        .withColumn("leader_share", share(F.col("leader_complaints"), F.col("total_complaints")))
    )


def top_makes(vehicles: DataFrame, limit: int = HOME_MAKES) -> DataFrame:
    """Leading makes with the bar width relative to the first, to one decimal."""
    top = make_ranking(vehicles).limit(limit)
    leader = make_totals(vehicles).agg(F.max("complaint_count")).scalar()
    return top.select(
        "make_slug", "make", "complaint_count",
        F.round(share(F.col("complaint_count"), leader), 1).alias("bar_width"),
    )


def frequent_makes(vehicles: DataFrame, at_least: int = FREQUENT_MAKE_FROM) -> DataFrame:
    """Makes with many complaints, alphabetically."""
    return (
        make_totals(vehicles)
        .filter(F.col("complaint_count") >= at_least)
        .orderBy("make", "make_slug")
        .select("make_slug", "make", "complaint_count")
    )


def top_groups(taxonomy: DataFrame, reports_total: DataFrame, limit: int = HOME_GROUPS) -> DataFrame:
    """Leading component groups: bar width and share of all complaints.

    `reports_total` is a one-row, one-column frame with the number of complaints on record.
    """
    top = taxonomy.orderBy(F.desc("complaint_count"), "component_group").limit(limit)
    leader = taxonomy.agg(F.max("complaint_count")).scalar()
    return top.select(
        "component_group", "complaint_count",
        F.round(share(F.col("complaint_count"), leader), 1).alias("bar_width"),
        share(F.col("complaint_count"), reports_total.scalar()).alias("dataset_share"),
    )
