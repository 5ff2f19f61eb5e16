"""Positions in an order, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.sources.shared import checkpointed

Names = list[str]


def with_ordinal(rows: DataFrame, keys: Names, order: list[str | Column], name: str = "ordinal", total: str | None = None) -> DataFrame:
    """`rows` with their position (from 0) among the rows of the same `keys`, in the order `order`; `total` names a
    column for the number of rows of the key.

    The rows are sorted by ranges of keys and order, so a key that holds a third of all rows spreads over many
    tasks; rows of each key in each range are counted, and the counts before a range are its offset. Only these counts
    meet in a window. Rows that agree in keys and order share a range: give an order that tells rows apart.
    Null keys form one key. `rows` should be stored, since the ranges are drawn from a sample of them.
    """
    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    spread = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = checkpointed(spread.select("*", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().alias("at__")))
    runs = placed.groupBy("part__", *keys).agg(F.count("*").alias("n__"), F.min("at__").alias("first__"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("part__").alias("run__"),
        *[F.col(k).alias(f"key{i}__") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("n__").over(before), F.lit(0)) - F.col("first__")).alias("shift__"),
        F.sum("n__").over(group).alias("total__"),
    )
    same = F.col("part__") == F.col("run__")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"key{i}__"))
    columns = [*rows.columns, (F.col("at__") + F.col("shift__")).alias(name)]
    return placed.join(offsets, same).select(*columns, *([F.col("total__").alias(total)] if total else []))
