"""Recall campaigns: detail, coverage, advisories and per-vehicle summaries.

A recall table repeats a campaign for every model and year, so everything here counts campaigns. Where
several rows must collapse to one, the row is chosen with `min_by`/`max_by`, which combine on the map
side: a campaign that covers a third of the table is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.fixed_values import LATEST_ADVISORIES
from faultline.functions.text import key_make, key_model

CAMPAIGN_TEXT = (
    "manufacturer", "component_name", "component_group", "defect_description", "consequence",
    "corrective_action", "report_received_date", "owners_notified_date",
)


def urgent() -> Column:
    """Whether a recall row carries an advisory."""
    return F.col("do_not_drive") | F.col("park_outside")


def vehicle_recalls(recalls: DataFrame, keep: Sequence[str], tie_break: Sequence[Column]) -> DataFrame:
    """Recall rows of every vehicle, newest first.

    A sort, not a window: ranges are cut over vehicle, date and tie-break, so the rows of one vehicle may
    spread over many tasks. A caller after one vehicle filters on `vehicle_key`, ahead of the sort.
    """
    return recalls.orderBy("vehicle_key", F.desc("report_received_date"), *tie_break).select(
        "vehicle_key", *keep
    )


def campaign_detail(
    recalls: DataFrame, row_order: Sequence[Column], text: Sequence[str] = CAMPAIGN_TEXT
) -> DataFrame:
    """One row per campaign: text of its first row, any flag, largest affected count, vehicles covered.

    Rows are first reduced per campaign and vehicle, then per campaign.
    """
    first = F.struct(*row_order)
    per_vehicle = recalls.groupBy("campaign_number", "vehicle_key").agg(
        F.min(F.struct(first.alias("at"), F.struct(*text).alias("text"))).alias("first"),
        F.max("do_not_drive").alias("do_not_drive"),
        F.max("park_outside").alias("park_outside"),
        F.max("potentially_affected").alias("potentially_affected"),
    )
    per_campaign = per_vehicle.groupBy("campaign_number").agg(
        F.min("first").alias("first"),
        F.max("do_not_drive").alias("do_not_drive"),
        F.max("park_outside").alias("park_outside"),
        F.max("potentially_affected").alias("potentially_affected"),
        F.count("*").alias("vehicle_count"),
    )
    return per_campaign.select(
        "campaign_number", "first.text.*", "do_not_drive", "park_outside", "potentially_affected",
        "vehicle_count",
    )


def covered_vehicles(recalls: DataFrame) -> DataFrame:
    """campaign_number, vehicle_key, make, model, model_year: every vehicle of every campaign, once."""
    named = recalls.select("campaign_number", "vehicle_key", "make", "model", "model_year").distinct()
    return named.groupBy("campaign_number", "vehicle_key").agg(
        F.min("make").alias("make"),
        F.min("model").alias("model"),
        F.min("model_year").alias("model_year"),
    )


def campaign_vehicles(recalls: DataFrame, limit: int | None = None) -> DataFrame:
    """The vehicles of every campaign by make, model and year (newest first), the first `limit` if given.

    A vehicle's place is the number of vehicles of earlier models, counted over sums, and its place within its
    model, so a campaign that covers very many vehicles is not ranked in one task.
    """
    distinct = covered_vehicles(recalls)
    by_model = ("campaign_number", "make", "model")
    earlier = Window.partitionBy("campaign_number").orderBy("make", "model").rowsBetween(Window.unboundedPreceding, -1)
    models = distinct.groupBy(*by_model).agg(F.count("*").alias("vehicles")).select(
        *[F.col(c).alias(f"_{c}") for c in by_model],
        F.coalesce(F.sum("vehicles").over(earlier), F.lit(0)).alias("before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by_model]
    within = Window.partitionBy(*by_model).orderBy(F.desc("model_year"), "vehicle_key")
    placed = distinct.withColumn("place", F.row_number().over(within)).join(models, same)
    listed = placed.withColumn("position", (F.col("before") + F.col("place")).cast("int"))
    if limit is not None:
        listed = listed.filter(F.col("position") <= limit)
    return listed.select(
        "campaign_number", "position", "make", "model", "model_year", "vehicle_key",
        key_make(F.col("vehicle_key")).alias("make_slug"),
        key_model(F.col("vehicle_key")).alias("model_slug"),
    )


def latest_advisories(recalls: DataFrame, limit: int = LATEST_ADVISORIES) -> DataFrame:
    """Newest campaigns with an advisory. Only the flagged rows count, also for the vehicles.

    Flags and dates are combined per distinct text first, so that the rows are hashed, not sorted.
    """
    per_text = (
        recalls.filter(urgent())
        .groupBy("campaign_number", "vehicle_key", "make", "component_name")
        .agg(
            F.max("do_not_drive").alias("do_not_drive"),
            F.max("park_outside").alias("park_outside"),
            F.max("report_received_date").alias("report_received_date"),
        )
    )
    per_vehicle = per_text.groupBy("campaign_number", "vehicle_key").agg(
        F.min("make").alias("make"),
        F.min("component_name").alias("component_name"),
        F.max("do_not_drive").alias("do_not_drive"),
        F.max("park_outside").alias("park_outside"),
        F.max("report_received_date").alias("report_received_date"),
    )
    per_campaign = per_vehicle.groupBy("campaign_number").agg(
        F.min("make").alias("make"),
        F.min("component_name").alias("component_name"),
        F.max("do_not_drive").alias("do_not_drive"),
        F.max("park_outside").alias("park_outside"),
        F.max("report_received_date").alias("report_received_date"),
        F.count("*").alias("vehicle_count"),
    )
    return per_campaign.orderBy(F.desc("report_received_date"), "campaign_number").limit(limit)


def _newest_first(rank: Sequence[Column]) -> Column:
    """A struct that is largest for the newest row; `rank` holds tie-breaks, larger ones first."""
    return F.struct(F.col("report_received_date").alias("date"), *rank)


def first_campaign_rows(recalls: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """The newest row of every vehicle and campaign, campaigns compared without case."""
    kept = F.struct(
        "campaign_number", "component_group", "do_not_drive", "park_outside", "report_received_date"
    )
    newest = F.max(F.struct(_newest_first(rank).alias("at"), kept.alias("row"))).alias("newest")
    return (
        recalls.groupBy("vehicle_key", F.upper("campaign_number").alias("campaign"))
        .agg(newest)
        .select("vehicle_key", "newest.row.*")
    )


def recall_summary(recalls: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """Campaign counts per vehicle, judged by the newest row of each campaign only.

    A flag that only an older row of the campaign carries is therefore not seen here, unlike in
    `recall_fold`.
    """
    return (
        first_campaign_rows(recalls, rank)
        .groupBy("vehicle_key")
        .agg(
            F.count("*").alias("campaign_count"),
            F.count_if("do_not_drive").alias("do_not_drive_count"),
            F.count_if("park_outside").alias("park_outside_count"),
            F.count_if(urgent()).alias("urgent_count"),
            F.count_distinct(F.upper("component_group")).alias("group_count"),
            F.min(F.year("report_received_date")).alias("earliest_year"),
            F.max(F.year("report_received_date")).alias("latest_year"),
        )
    )


def urgent_campaigns(recalls: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """The flagged campaigns of every vehicle, one row each."""
    return first_campaign_rows(recalls, rank).filter(urgent()).select("vehicle_key", "campaign_number")


def recall_groups(recalls: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """Campaigns per vehicle and component group, groups compared without case."""
    return (
        first_campaign_rows(recalls, rank)
        .groupBy("vehicle_key", F.upper("component_group").alias("_group"))
        .agg(F.min("component_group").alias("component_group"), F.count("*").alias("campaign_count"))
        .drop("_group")
    )


def recall_fold(
    recalls: DataFrame, rank: Sequence[Column], text: Sequence[str] = ("component_group",)
) -> DataFrame:
    """A vehicle's recall rows folded into campaigns, urgent ones first, then the newest.

    Rows are shuffled once to be folded, with the distinct component names among the aggregates, and the folded
    campaigns once to be ranked, without what only chose the newest row. The newest row has the latest date.
    """
    by = ("vehicle_key", "campaign_number")
    newest = F.max(F.struct(_newest_first(rank).alias("at"), F.struct(*text).alias("text")))
    folded = recalls.groupBy(*by).agg(
        newest.alias("newest"),
        F.array_sort(F.collect_set("component_name")).alias("component_names"),
        F.max("potentially_affected").alias("potentially_affected"),
        F.max("do_not_drive").alias("do_not_drive"),
        F.max("park_outside").alias("park_outside"),
    )
    folded = folded.select(
        *by, "newest.text.*", "component_names", F.col("newest.at.date").alias("report_received_date"),
        "potentially_affected", "do_not_drive", "park_outside",
    )
    order = Window.partitionBy("vehicle_key").orderBy(
        F.desc("urgent"), F.desc("report_received_date"), "campaign_number"
    )
    return folded.withColumn("urgent", urgent()).select(
        *by, F.row_number().over(order).alias("position"), *text, "component_names",
        "report_received_date", "potentially_affected", "do_not_drive", "park_outside", "urgent",
        advisory_label(F.col("do_not_drive"), F.col("park_outside")).alias("advisory"),
    )


def advisory_label(do_not_drive: Column, park_outside: Column) -> Column:
    return (
        F.when(do_not_drive & park_outside, "do not drive, and park outside")
        .when(do_not_drive, "do not drive")
        .when(park_outside, "park outside")
        .otherwise("none")
    )


def recall_coverage(listed: DataFrame, model_rows: int | None = None) -> DataFrame:
    """Listed vehicles of a campaign with the place of their model, the first `model_rows` models if given.

    Takes the output of `campaign_vehicles`. Models are numbered over their distinct rows, years within a model.
    """
    by_model = ("campaign_number", "make", "model")
    in_campaign = Window.partitionBy("campaign_number").orderBy("make", "model")
    models = listed.groupBy(*by_model).agg(F.count("*").alias("vehicles")).select(
        *[F.col(c).alias(f"_{c}") for c in by_model], F.row_number().over(in_campaign).alias("model_row")
    )
    if model_rows is not None:
        models = models.filter(F.col("model_row") <= model_rows)
    years = Window.partitionBy(*by_model).orderBy(F.desc("model_year"), "vehicle_key")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by_model]
    return (
        listed.withColumn("year_position", F.row_number().over(years))
        .join(models, same)
        .select("campaign_number", "model_row", "make", "model", "year_position", "model_year", "vehicle_key")
    )


def nested_coverage(coverage: DataFrame) -> DataFrame:
    """Coverage as makes > models > years (newest first, unknown last), one row per campaign.

    Takes `covered_vehicles` or `recall_coverage`: years of a model need no places to be in order.
    """
    years = coverage.groupBy("campaign_number", "make", "model").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("model_year")), asc=False),
            lambda e: e.model_year,
        ).alias("years")
    )
    models = years.groupBy("campaign_number", "make").agg(
        F.array_sort(F.collect_list(F.struct("model", "years"))).alias("models")
    )
    return models.groupBy("campaign_number").agg(
        F.array_sort(F.collect_list(F.struct("make", "models"))).alias("makes")
    )
