"""Complaint files as they arrive: the same parsing and upsert, one micro-batch per arrival.

A batch is written to its own folder, replacing what a failed attempt left there, so every file counts
exactly once. Batches are only ever added; the current table is the newest row of every id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.fixed_values import COMPLAINT_FIELD_COUNT, COMPONENT_GROUPS, MAKE_ALIASES
from faultline.operators.maintain import latest_per_key
from faultline.operators.records import COMPLAINT_COLUMNS, map_complaints
from faultline.plans.load import complaint_order
from faultline.sources.dimensions import alias_dimension, group_dimension
from faultline.sources.flat import split_lines


def stream_complaints(
    spark: SparkSession,
    source_folder: str,
    target_folder: str,
    checkpoint_folder: str,
    aliases: Mapping[str, str] = MAKE_ALIASES,
    groups: Mapping[str, str] = COMPONENT_GROUPS,
) -> StreamingQuery:
    """Process all files that have not been seen yet, then stop."""
    alias_table, group_table = alias_dimension(spark, aliases), group_dimension(spark, groups)

    def store(batch: DataFrame, batch_id: int) -> None:
        mapped = map_complaints(
            split_lines(batch, COMPLAINT_FIELD_COUNT, F.col("file")), alias_table, group_table
        )
        newest = latest_per_key(mapped.good, ["id"], complaint_order())
        newest.write.mode("overwrite").parquet(f"{target_folder.rstrip('/')}/batch={batch_id}")

    lines = spark.readStream.text(source_folder).select("value", F.input_file_name().alias("file"))
    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint_folder)
        .trigger(availableNow=True)
        .start()
    )


def current_complaints(spark: SparkSession, target_folder: str) -> DataFrame:
    """The newest row of every complaint over all batches."""
    batches = spark.read.option("basePath", target_folder).parquet(target_folder)
    order = [F.col("batch").cast("bigint"), *complaint_order()]
    return latest_per_key(batches, ["id"], order).select(*COMPLAINT_COLUMNS)
