"""Raw fields to canonical complaint and recall rows, with rejects set aside and counted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.fixed_values import (
    COMPLAINT_POSITIONS,
    FALLBACK_GROUP,
    PERSONAL_DATA_NAMES,
    RECALL_POSITIONS,
    UNKNOWN_GROUP,
)
from faultline.functions import fields as parse
from faultline.functions.text import (
    display_name,
    normalise,
    slug,
    strip_corporate_suffixes,
    trim_ws,
    upper_or_null,
    vehicle_key,
)
from faultline.sources.flat import FlatLines

COMPLAINT_COLUMNS = (
    "id", "odi_number", "manufacturer", "make", "make_raw", "model", "model_raw", "model_year",
    "component", "miles_at_failure", "description", "failure_date", "received_date", "crash", "fire",
    "injured", "deaths", "police_report", "vehicle_towed", "medical_attention", "drive_train",
    "fuel_type", "transmission_type", "cylinders", "vehicle_key",
)
RECALL_COLUMNS = (
    "id", "campaign_number", "manufacturer", "make", "make_raw", "model", "model_raw", "model_year",
    "component_name", "component_group", "recall_type", "potentially_affected",
    "owners_notified_date", "report_received_date", "defect_description", "consequence",
    "corrective_action", "do_not_drive", "park_outside", "vehicle_key",
)


@dataclass(frozen=True)
class MappedRecords:
    """Vehicle records of one kind.

    `judged` decides about every line from its own fields, also those that are no vehicle record; `canonical` adds names,
    groups and keys.
    """

    judged: DataFrame
    canonical: Callable[[DataFrame], DataFrame]
    columns: tuple[str, ...]

    @property
    def parsed(self) -> DataFrame:
        """Vehicle records, accepted or with their `reject_reason`."""
        return self.judged.filter(F.col("is_record") & F.col("is_vehicle")).drop("is_blank", "is_record", "is_vehicle")

    @property
    def records(self) -> DataFrame:
        """Accepted and rejected records with all kept columns and their `reject_reason`."""
        return self.canonical(self.parsed)

    @property
    def good(self) -> DataFrame:
        """Accepted records; the others are dropped before names are looked up."""
        accepted = self.parsed.filter(F.col("reject_reason").isNull())
        return self.canonical(accepted).select(*self.columns)

    @property
    def rejected(self) -> DataFrame:
        return self.parsed.filter(F.col("reject_reason").isNotNull()).select(
            "file", "raw_id", "reject_reason"
        )


def with_make(df: DataFrame, raw: Column, aliases: DataFrame) -> DataFrame:
    """Add the canonical `make` and `make_slug` of a raw make."""
    spelled = df.withColumn("_spelling", strip_corporate_suffixes(normalise(raw))).withColumn(
        "_slug", slug(F.col("_spelling"))
    )
    joined = spelled.join(aliases, F.col("_spelling") == F.col("alias"), "left")
    return joined.select(
        *df.columns,
        F.coalesce("alias_name", display_name(F.col("_spelling"), F.col("_slug"))).alias("make"),
        F.coalesce("alias_slug", "_slug").alias("make_slug"),
    )


def with_model(df: DataFrame, raw: Column) -> DataFrame:
    """Add the canonical `model` and `model_slug` of a raw model; models have no aliases."""
    named = df.withColumn("_name", normalise(raw)).withColumn("model_slug", slug(F.col("_name")))
    return named.withColumn("model", display_name(F.col("_name"), F.col("model_slug"))).drop("_name")


def component_levels(raw: Column) -> Column:
    """The non-empty levels of a component path, trimmed."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ":"), trim_ws)
    return F.filter(parts, lambda level: level != "")


def with_component(df: DataFrame, raw: Column, groups: DataFrame) -> DataFrame:
    """Add `component`, a struct of the raw text, its group and its levels."""
    staged = df.withColumns({"_levels": component_levels(raw), "_raw": trim_ws(F.coalesce(raw, F.lit("")))})
    staged = staged.withColumn("_category", F.upper(F.get("_levels", F.lit(0))))
    joined = staged.join(groups, F.col("_category") == F.col("category"), "left")
    group = F.when(F.col("_category").isNull(), F.lit(UNKNOWN_GROUP)).otherwise(
        F.coalesce("mapped_group", F.lit(FALLBACK_GROUP))
    )
    return joined.select(
        *df.columns,
        F.struct(
            F.col("_raw").alias("raw"), group.alias("group"), F.col("_levels").alias("levels")
        ).alias("component"),
    )


def unmapped_top_levels(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """Top levels missing from the group table with their counts, most frequent first.

    `levels` has one `levels` array per accepted record; union complaints and recalls for a full load.
    Spellings that differ only in case are one top level, shown in its smallest spelling.
    """
    top = levels.select(F.get("levels", F.lit(0)).alias("top_level")).filter("top_level IS NOT NULL")
    counted = top.groupBy("top_level").count()
    folded = counted.groupBy(F.upper("top_level").alias("_category")).agg(
        F.min("top_level").alias("top_level"), F.sum("count").alias("count")
    )
    missing = folded.join(groups, F.col("_category") == F.col("category"), "left_anti")
    return missing.select("top_level", "count").orderBy(F.desc("count"), "top_level")


def _picked(lines: FlatLines, positions: dict[str, int]) -> DataFrame:
    """Of all lines the allow-listed fields as trimmed text columns; no other field leaves the file."""
    return lines.lines.select(
        "file",
        "is_blank",
        lines.is_record.alias("is_record"),
        *[trim_ws(F.get("fields", F.lit(at))).alias(f"raw_{name}") for name, at in positions.items()],
    )


def _raw(name: str) -> Column:
    return F.col(f"raw_{name}")


def _first_failure(*checks: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, null when none does."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])


def map_complaints(lines: FlatLines, aliases: DataFrame, groups: DataFrame) -> MappedRecords:
    """Canonical rows of all vehicle complaints."""
    received = F.coalesce(
        parse.strict_date(_raw("received_date")), parse.strict_date(_raw("date_added"))
    )
    judged = (
        _picked(lines, COMPLAINT_POSITIONS)
        .withColumn("is_vehicle", parse.is_vehicle(_raw("product_type")))
        .withColumns(
            {
                "id": parse.whole_number(_raw("id")),
                "odi_number": parse.whole_number(_raw("odi_number")),
                "received_date": received,
            }
        )
        .withColumn(
            "reject_reason",
            _first_failure(
                (F.col("id").isNull(), "complaint id is not a number"),
                (F.col("odi_number").isNull(), "odi number is not a number"),
                (F.col("received_date").isNull(), "no usable received or added date"),
            ),
        )
    )

    def canonical(df: DataFrame) -> DataFrame:
        df = with_make(df, _raw("make"), aliases)
        df = with_model(df, _raw("model"))
        df = with_component(df, _raw("component"), groups)
        df = df.withColumns(
            {
                "_year": parse.whole_number(_raw("model_year")),
                "_miles": parse.whole_number(_raw("miles")),
                "_cylinders": parse.whole_number(_raw("cylinders")),
            }
        ).withColumn("model_year", parse.model_year(F.col("_year")))
        return df.select(
            "file",
            "raw_id",
            "reject_reason",
            "id",
            "odi_number",
            _raw("manufacturer").alias("manufacturer"),
            "make",
            _raw("make").alias("make_raw"),
            "model",
            _raw("model").alias("model_raw"),
            "model_year",
            "component",
            parse.mileage(F.col("_miles")).alias("miles_at_failure"),
            _raw("description").alias("description"),
            parse.strict_date(_raw("failure_date")).alias("failure_date"),
            "received_date",
            parse.is_y(_raw("crash")).alias("crash"),
            parse.is_y(_raw("fire")).alias("fire"),
            parse.casualties(parse.signed_number(_raw("injured"))).alias("injured"),
            parse.casualties(parse.signed_number(_raw("deaths"))).alias("deaths"),
            parse.is_y(_raw("police_report")).alias("police_report"),
            parse.is_y(_raw("vehicle_towed")).alias("vehicle_towed"),
            parse.is_y(_raw("medical_attention")).alias("medical_attention"),
            upper_or_null(_raw("drive_train")).alias("drive_train"),
            upper_or_null(_raw("fuel_type")).alias("fuel_type"),
            upper_or_null(_raw("transmission_type")).alias("transmission_type"),
            parse.cylinders(F.col("_cylinders")).alias("cylinders"),
            vehicle_key(F.col("make_slug"), F.col("model_slug"), F.col("model_year")).alias(
                "vehicle_key"
            ),
        )

    return MappedRecords(judged, canonical, COMPLAINT_COLUMNS)


def map_recalls(lines: FlatLines, aliases: DataFrame, groups: DataFrame) -> MappedRecords:
    """Canonical rows of all vehicle recalls: one per campaign, model and year."""
    judged = (
        _picked(lines, RECALL_POSITIONS)
        .withColumn("is_vehicle", parse.is_vehicle(_raw("recall_type")))
        .withColumns(
            {
                "id": parse.whole_number(_raw("id")),
                "do_not_drive": parse.is_yes(_raw("do_not_drive")),
                "park_outside": parse.is_yes(_raw("park_outside")),
            }
        )
        .withColumn(
            "reject_reason",
            _first_failure(
                (F.col("id").isNull(), "record id is not a number"),
                (_raw("campaign_number") == "", "campaign number is empty"),
            ),
        )
    )

    def canonical(df: DataFrame) -> DataFrame:
        df = with_make(df, _raw("make"), aliases)
        df = with_model(df, _raw("model"))
        df = with_component(df, _raw("component"), groups)
        df = df.withColumn("_year", parse.whole_number(_raw("model_year"))).withColumn(
            "model_year", parse.model_year(F.col("_year"))
        )
        return df.select(
            "file",
            "raw_id",
            "reject_reason",
            "id",
            _raw("campaign_number").alias("campaign_number"),
            _raw("manufacturer").alias("manufacturer"),
            "make",
            _raw("make").alias("make_raw"),
            "model",
            _raw("model").alias("model_raw"),
            "model_year",
            _raw("component").alias("component_name"),
            F.col("component.group").alias("component_group"),
            F.col("component.levels").alias("levels"),
            _raw("recall_type").alias("recall_type"),
            parse.whole_number(_raw("potentially_affected")).alias("potentially_affected"),
            parse.strict_date(_raw("owners_notified_date")).alias("owners_notified_date"),
            parse.strict_date(_raw("report_received_date")).alias("report_received_date"),
            _raw("defect_description").alias("defect_description"),
            _raw("consequence").alias("consequence"),
            _raw("corrective_action").alias("corrective_action"),
            "do_not_drive",
            "park_outside",
            vehicle_key(F.col("make_slug"), F.col("model_slug"), F.col("model_year")).alias(
                "vehicle_key"
            ),
        )

    return MappedRecords(judged, canonical, RECALL_COLUMNS)


def personal_data_columns(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of columns, at any depth, whose name is on the personal-data list."""
    if isinstance(schema, T.ArrayType):
        return personal_data_columns(schema.elementType, prefix)
    if isinstance(schema, T.MapType):
        return personal_data_columns(schema.valueType, prefix)
    if not isinstance(schema, T.StructType):
        return []
    banned = {name.replace("_", "") for name in PERSONAL_DATA_NAMES}
    found = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if field.name.lower().replace("_", "") in banned:
            found.append(path)
        found += personal_data_columns(field.dataType, f"{path}.")
    return found
