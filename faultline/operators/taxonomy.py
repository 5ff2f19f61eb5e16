"""Component groups: counts, histograms, top levels and rankings. Includes unknown model years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.fixed_values import (
    HIGH_MILEAGE_FROM,
    LEADING_GROUPS,
    MILEAGE_BIN_WIDTH,
    SHAPE_SHARE,
    TAXONOMY_RANKING,
    THIN_COMPONENT_SAMPLE_BELOW,
)
from faultline.functions.measures import (
    BIN_COLUMNS,
    bin_label,
    histogram_array,
    share,
    summed,
    width,
)
from faultline.functions.text import key_make, key_model, slug

NO_VEHICLES = (
    "array<struct<vehicle_key:string,make:string,model:string,model_year:int,count:bigint,"
    "total_complaints:bigint>>"
)


def group_totals(measures: DataFrame) -> DataFrame:
    """One row per component group: complaints, mileage sample and bin counts."""
    return measures.groupBy("component_group").agg(
        F.sum("complaints").alias("complaint_count"), *summed(["with_mileage", *BIN_COLUMNS])
    )


def group_top_levels(measures: DataFrame) -> DataFrame:
    """The raw top levels folded into each group."""
    known = measures.filter(F.col("top_level").isNotNull())
    return known.select("component_group", "top_level").distinct()


def group_top_makes(measures: DataFrame, limit: int = TAXONOMY_RANKING) -> DataFrame:
    """The makes with most complaints under each group."""
    counted = measures.groupBy("component_group", "make").agg(F.sum("complaints").alias("count"))
    rank = Window.partitionBy("component_group").orderBy(F.desc("count"), "make")
    return counted.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= limit)


def group_top_vehicles(
    components: DataFrame, profiles: DataFrame, limit: int = TAXONOMY_RANKING
) -> DataFrame:
    """The vehicles each group weighs on most, with the vehicle total.

    Ranks the breakdown rows first and joins names only to the winners.
    """
    rank = Window.partitionBy("component_group").orderBy(F.desc("count"), "vehicle_key")
    winners = components.withColumn("position", F.row_number().over(rank)).filter(
        F.col("position") <= limit
    )
    named = profiles.select("vehicle_key", "make", "model", "model_year", "total_complaints")
    return winners.join(named, "vehicle_key").select(
        "component_group", "position", "vehicle_key", "make", "model", "model_year", "count",
        "total_complaints",
    )


def _ranked_list(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """Rows already limited per group, as one array per group in order of position."""
    packed = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("entry"))))
    return rows.groupBy("component_group").agg(
        F.transform(packed, lambda e: e.entry).alias(name)
    )


def component_taxonomy(
    measures: DataFrame, components: DataFrame, profiles: DataFrame
) -> DataFrame:
    """The stored component table, one nested row per group."""
    levels = group_top_levels(measures).groupBy("component_group").agg(
        F.array_sort(F.collect_list("top_level")).alias("top_levels")
    )
    makes = _ranked_list(group_top_makes(measures), "top_makes", "make", "count")
    vehicles = _ranked_list(
        group_top_vehicles(components, profiles), "top_vehicles",
        "vehicle_key", "make", "model", "model_year", "count", "total_complaints",
    )
    joined = group_totals(measures)
    for part in (levels, makes, vehicles):
        joined = joined.join(part, "component_group", "left")
    return joined.select(
        "component_group", "complaint_count", "with_mileage",
        F.coalesce("top_levels", F.array().cast("array<string>")).alias("top_levels"),
        histogram_array().alias("mileage_histogram"),
        "top_makes",
        F.coalesce("top_vehicles", F.from_json(F.lit("[]"), NO_VEHICLES)).alias("top_vehicles"),
    )


def group_ranking(totals: DataFrame) -> DataFrame:
    """Groups with their slug, largest first."""
    return totals.select(
        "component_group", slug(F.col("component_group")).alias("slug"), "complaint_count"
    ).orderBy(F.desc("complaint_count"), "component_group")


def group_by_slug(taxonomy: DataFrame, slugs: DataFrame) -> DataFrame:
    """The stored component rows of the requested slugs."""
    with_slug = taxonomy.withColumn("slug", slug(F.col("component_group")))
    return with_slug.join(slugs.select("slug").distinct(), "slug", "left_semi")


def group_index(totals: DataFrame, leading: int = LEADING_GROUPS) -> DataFrame:
    """Groups with share of all complaints, width of the leader, and the leading groups' share."""
    ranked = totals.select("component_group", "complaint_count")
    everything = ranked.agg(F.sum("complaint_count")).scalar()
    leader = ranked.agg(F.max("complaint_count")).scalar()
    top = ranked.orderBy(F.desc("complaint_count"), "component_group").limit(leading)
    top_sum = top.agg(F.sum("complaint_count")).scalar()
    count = F.col("complaint_count")
    return ranked.select(
        "component_group", slug(F.col("component_group")).alias("slug"), "complaint_count",
        share(count, everything).alias("share"),
        width(count, leader).alias("width"),
        F.round(share(top_sum, everything)).cast("int").alias("leading_share"),
    )


def group_shape(totals: DataFrame) -> DataFrame:
    """Where in a vehicle's life the group fails: early share, high share, tallest bin, class."""
    first_high = HIGH_MILEAGE_FROM // MILEAGE_BIN_WIDTH
    high = sum((F.col(name) for name in BIN_COLUMNS[first_high:]), F.lit(0).cast("bigint"))
    tallest = F.greatest(*BIN_COLUMNS)
    peak = F.coalesce(*[F.when(F.col(name) == tallest, F.lit(i)) for i, name in enumerate(BIN_COLUMNS)])
    label = F.element_at(F.array(*[F.lit(bin_label(i)) for i in range(len(BIN_COLUMNS))]), peak + 1)
    measured = totals.select(
        "component_group", "complaint_count", "with_mileage",
        share(F.col("bin_0"), F.col("with_mileage")).alias("early_share"),
        share(high, F.col("with_mileage")).alias("high_share"),
        share(F.col("with_mileage"), F.col("complaint_count")).alias("mileage_coverage"),
        peak.alias("peak_bin"),
        label.alias("peak_label"),
    )
    return measured.select(
        "*",
        F.when(F.col("early_share") >= SHAPE_SHARE, "near")
        .when(F.col("high_share") >= SHAPE_SHARE, "far")
        .otherwise("broad")
        .alias("shape"),
        F.col("with_mileage").between(1, THIN_COMPONENT_SAMPLE_BELOW - 1).alias("thin_sample"),
    )


def group_make_shares(top_makes: DataFrame, totals: DataFrame) -> DataFrame:
    """Top makes of each group: share of the group and width of its leading make."""
    group = Window.partitionBy("component_group")
    count = F.col("count")
    return (
        top_makes.join(totals.select("component_group", "complaint_count"), "component_group")
        .withColumn("leader", F.max("count").over(group))
        .select(
            "component_group", "position", "make", slug(F.col("make")).alias("make_slug"), "count",
            share(count, F.col("complaint_count")).alias("group_share"),
            width(count, F.col("leader")).alias("width"),
        )
    )


def group_vehicle_shares(top_vehicles: DataFrame, totals: DataFrame) -> DataFrame:
    """Top vehicles of each group: share of the group, of the vehicle, and width of the leader."""
    group = Window.partitionBy("component_group")
    count = F.col("count")
    return (
        top_vehicles.join(totals.select("component_group", "complaint_count"), "component_group")
        .withColumn("leader", F.max("count").over(group))
        .select(
            "component_group", "position", "vehicle_key",
            key_make(F.col("vehicle_key")).alias("make_slug"),
            key_model(F.col("vehicle_key")).alias("model_slug"),
            "model_year", "count",
            share(count, F.col("complaint_count")).alias("group_share"),
            share(count, F.col("total_complaints")).alias("vehicle_share"),
            width(count, F.col("leader")).alias("width"),
        )
    )


def vehicle_group_share(components: DataFrame, profiles: DataFrame) -> DataFrame:
    """Share of each vehicle's complaints that falls in each group."""
    totals = profiles.select("vehicle_key", "total_complaints")
    return components.join(totals, "vehicle_key").select(
        "vehicle_key", "component_group", "count", "total_complaints",
        share(F.col("count"), F.col("total_complaints")).alias("share"),
    )
