"""Side-by-side comparison of vehicles, for any number of requested pairs at once.

A pairs table (`pair_id`, `key_a`, `key_b`) drives every comparison; vehicles are never crossed with
each other. Each pair is turned into two sides, which meet the vehicle tables on `vehicle_key`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.fixed_values import (
    COMPARE_TOP_GROUPS,
    LOPSIDED_FACTOR,
    REMAINDER_LABEL,
    SMALL_SAMPLE_BELOW,
    THIN_MILEAGE_BELOW,
)
from faultline.functions.measures import histogram_rows, severity_rows, share, width
from faultline.functions.text import trim_ws, vehicle_key


def pair_sides(pairs: DataFrame) -> DataFrame:
    """One row per side of a pair."""
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col("key_a").alias("vehicle_key")),
        F.struct(F.lit("b").alias("side"), F.col("key_b").alias("vehicle_key")),
    )
    return pairs.select("pair_id", F.inline(sides))


def _of(side: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("side") == side, value)), F.lit(0).cast("bigint"))


def compare_components(
    pairs: DataFrame, components: DataFrame, profiles: DataFrame, top: int = COMPARE_TOP_GROUPS
) -> DataFrame:
    """Share of each side's complaints per group: the top groups of either side, then the remainder.

    A group outside both top lists is relabelled as the remainder before the second sum, so the
    remainder row appears exactly when something is left over.
    """
    rank = Window.partitionBy("vehicle_key").orderBy(F.desc("count"), "component_group")
    ranked = components.withColumn("rank", F.row_number().over(rank))
    totals = profiles.select("vehicle_key", "total_complaints")
    rows = (
        pair_sides(pairs)
        .join(totals, "vehicle_key", "left")
        .join(ranked, "vehicle_key", "left")
    )
    per_group = rows.groupBy("pair_id", "component_group").agg(
        _of("a", F.col("count")).alias("count_a"),
        _of("b", F.col("count")).alias("count_b"),
        F.max(F.when(F.col("side") == "a", F.col("total_complaints"))).alias("total_a"),
        F.max(F.when(F.col("side") == "b", F.col("total_complaints"))).alias("total_b"),
        F.min("rank").alias("best_rank"),
    )
    # A pair has at most a few dozen groups, so these windows stay small whatever the data size.
    pair = Window.partitionBy("pair_id")
    listed = per_group.withColumns(
        {
            "is_remainder": F.col("best_rank") > top,
            "total_a": F.coalesce(F.max("total_a").over(pair), F.lit(0).cast("bigint")),
            "total_b": F.coalesce(F.max("total_b").over(pair), F.lit(0).cast("bigint")),
        }
    ).filter(F.col("component_group").isNotNull())
    label = F.when(F.col("is_remainder"), F.lit(REMAINDER_LABEL)).otherwise(F.col("component_group"))
    summed = listed.groupBy("pair_id", label.alias("label"), "is_remainder", "total_a", "total_b").agg(
        F.sum("count_a").alias("count_a"), F.sum("count_b").alias("count_b")
    )
    shared = summed.withColumns(
        {
            "share_a": share(F.col("count_a"), F.col("total_a")),
            "share_b": share(F.col("count_b"), F.col("total_b")),
        }
    )
    order = pair.orderBy("is_remainder", F.desc(F.col("share_a") + F.col("share_b")), "label")
    scale = F.max(F.greatest("share_a", "share_b")).over(pair)
    return shared.withColumn("scale", scale).select(
        "pair_id", F.row_number().over(order).alias("position"), "label", "is_remainder",
        "count_a", "share_a", width_of_scale("share_a").alias("width_a"),
        "count_b", "share_b", width_of_scale("share_b").alias("width_b"),
    )


def width_of_scale(name: str) -> Column:
    return width(F.col(name), F.col("scale"))


def compare_mileage(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Both histograms as shares of their samples on a common scale; all bins are present."""
    bins = histogram_rows(profiles, "vehicle_key", "with_mileage")
    rows = pair_sides(pairs).join(bins, "vehicle_key")
    per_bin = rows.groupBy("pair_id", "bin").agg(
        _of("a", F.col("count")).alias("count_a"),
        _of("b", F.col("count")).alias("count_b"),
        _of("a", F.col("with_mileage")).alias("sample_a"),
        _of("b", F.col("with_mileage")).alias("sample_b"),
    )
    shared = per_bin.withColumns(
        {
            "share_a": share(F.col("count_a"), F.col("sample_a")),
            "share_b": share(F.col("count_b"), F.col("sample_b")),
        }
    )
    pair = Window.partitionBy("pair_id")
    return shared.withColumn("scale", F.max(F.greatest("share_a", "share_b")).over(pair)).select(
        "pair_id", "bin", "count_a", "share_a", width_of_scale("share_a").alias("width_a"),
        "count_b", "share_b", width_of_scale("share_b").alias("width_b"),
    )


def compare_severity(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Count and rate per hundred reports of every severity signal on both sides."""
    signals = severity_rows(profiles, "vehicle_key", "total_complaints")
    rows = pair_sides(pairs).join(signals, "vehicle_key")
    return (
        rows.groupBy("pair_id", "signal", "label", "critical")
        .agg(
            _of("a", F.col("count")).alias("count_a"),
            _of("b", F.col("count")).alias("count_b"),
            _of("a", F.col("total_complaints")).alias("total_a"),
            _of("b", F.col("total_complaints")).alias("total_b"),
        )
        .select(
            "pair_id", "signal", "label", "count_a",
            share(F.col("count_a"), F.col("total_a")).alias("rate_a"),
            "count_b",
            share(F.col("count_b"), F.col("total_b")).alias("rate_b"),
            (F.col("critical") & ((F.col("count_a") > 0) | (F.col("count_b") > 0))).alias("highlighted"),
        )
    )


def compare_caveats(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Warnings a reader needs before comparing: volumes far apart, small samples, same vehicle."""
    totals = profiles.select("vehicle_key", "total_complaints", "with_mileage")
    a = totals.toDF("key_a", "total_a", "with_mileage_a")
    b = totals.toDF("key_b", "total_b", "with_mileage_b")
    smaller = F.least("total_a", "total_b")
    larger = F.greatest("total_a", "total_b")
    return (
        pairs.join(a, "key_a")
        .join(b, "key_b")
        .select(
            "pair_id", "key_a", "key_b", "total_a", "total_b",
            ((smaller > 0) & (larger >= smaller * LOPSIDED_FACTOR)).alias("lopsided"),
            F.when(smaller > 0, larger / smaller).alias("volume_ratio"),
            (smaller < SMALL_SAMPLE_BELOW).alias("small_sample"),
            (F.greatest("with_mileage_a", "with_mileage_b") > 0).alias("has_mileage"),
            (F.least("with_mileage_a", "with_mileage_b") < THIN_MILEAGE_BELOW).alias("thin_mileage"),
            (F.col("key_a") == F.col("key_b")).alias("same_vehicle"),
        )
    )


def parse_requests(requests: DataFrame) -> DataFrame:
    """Make, model and year of a requested side, from its parts or else from its key text.

    Adds `request_key`, null unless the request is complete, and `raw_key`, the key text as asked.
    Parts win over the key when all three are given.
    """

    def part(text: Column) -> Column:
        return F.nullif(F.lower(trim_ws(text)), F.lit(""))

    key_text = F.nullif(trim_ws(F.col("key")), F.lit(""))
    segments = F.split(key_text, r"\|", -1)
    year_text = trim_ws(F.get(segments, F.lit(2)))
    key_year = F.when(year_text.rlike("^[+-]?[0-9]+$"), year_text.try_cast("int"))
    asked = requests.select(
        "*",
        part(F.col("make")).alias("_make"),
        part(F.col("model")).alias("_model"),
        F.when(F.col("year") > 0, F.col("year")).alias("_year"),
        key_text.alias("_key"),
        F.when(F.size(segments) == 3, part(F.get(segments, F.lit(0)))).alias("_key_make"),
        F.when(F.size(segments) == 3, part(F.get(segments, F.lit(1)))).alias("_key_model"),
        F.when((F.size(segments) == 3) & (key_year > 0), key_year).alias("_key_year"),
    )
    by_parts = F.col("_make").isNotNull() & F.col("_model").isNotNull() & F.col("_year").isNotNull()
    by_key = (
        F.col("_key_make").isNotNull() & F.col("_key_model").isNotNull() & F.col("_key_year").isNotNull()
    )

    def chosen(name: str) -> Column:
        return (
            F.when(by_parts, F.col(f"_{name}"))
            .when(F.col("_key").isNotNull(), F.when(by_key, F.col(f"_key_{name}")))
            .otherwise(F.col(f"_{name}"))
        )

    parsed = asked.select(
        *requests.columns,
        chosen("make").alias("make_slug"),
        chosen("model").alias("model_slug"),
        chosen("year").alias("model_year"),
        F.when(~by_parts, F.col("_key")).alias("raw_key"),
        (by_parts | (F.col("_key").isNotNull() & by_key)).alias("_complete"),
    )
    key = vehicle_key(F.col("make_slug"), F.col("model_slug"), F.col("model_year"))
    return parsed.withColumn("request_key", F.when(F.col("_complete"), key)).drop("_complete")


def request_status(requests: DataFrame, vehicles: DataFrame, profiles: DataFrame) -> DataFrame:
    """What became of each requested side.

    `empty` nothing was asked, `incomplete` parts are missing, `unknown` no such vehicle or unreadable
    key, `missing` the vehicle has no profile, `resolved` otherwise.
    """
    catalogued = vehicles.select(F.col("vehicle_key").alias("_catalogue_key"))
    profiled = profiles.select(F.col("vehicle_key").alias("_profile_key"))
    looked_up = (
        parse_requests(requests)
        .join(catalogued, F.col("request_key") == F.col("_catalogue_key"), "left")
        .join(profiled, F.col("request_key") == F.col("_profile_key"), "left")
    )
    nothing = F.coalesce("raw_key", "make_slug", "model_slug", F.col("model_year").cast("string")).isNull()
    status = (
        F.when(
            F.col("request_key").isNotNull(),
            F.when(F.col("_catalogue_key").isNull(), "unknown")
            .when(F.col("_profile_key").isNull(), "missing")
            .otherwise("resolved"),
        )
        .when(F.col("raw_key").isNotNull(), "unknown")
        .when(nothing, "empty")
        .otherwise("incomplete")
    )
    return looked_up.withColumn("status", status).drop("_catalogue_key", "_profile_key")
