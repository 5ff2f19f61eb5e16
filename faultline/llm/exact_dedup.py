"""Exact duplicates, with a way of its own for heavy hitters.

Misra-Gries counters, one summary per task, find the digests that may be frequent. For these few the
exact count and the row that stays are computed with map-side aggregation and broadcast, so their rows are
decided where they are and never shuffled. All other digests take an ordinary shuffle, in which no group can
exceed 2 / (counters + 1) of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.common import checkpointed, lower_ascii, one_of_each, text_of

#: Counters of a Misra-Gries summary; also the bound on the rows that are broadcast.
COUNTERS = 1023


def merge_counts(summary: Counter, counts: dict, counters: int) -> Counter:
    """A Misra-Gries summary after more counted values: at most `counters` entries, each a lower bound."""
    summary.update(counts)
    if len(summary) > counters:
        cut = sorted(summary.values(), reverse=True)[counters]
        summary = Counter({value: n - cut for value, n in summary.items() if n > cut})
    return summary


def frequent(values: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Values of `column` that may make up 2 / (counters + 1) of the rows or more: none is missed, some may
    be rarer, and there are at most `counters` + 1. Columns: the value, estimate (a lower bound of its count)."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summary: Counter = Counter()
        for batch in batches:
            summary = merge_counts(summary, batch[column].value_counts().to_dict(), counters)
        yield pd.DataFrame({column: list(summary), "estimate": list(summary.values())})

    kind = dict(values.dtypes)[column]
    parts = values.select(column).mapInPandas(summarise, f"{column} {kind}, estimate long")
    least = values.count() / (counters + 1)
    return parts.groupBy(column).agg(F.sum("estimate").alias("estimate")).filter(F.col("estimate") >= least)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read), dropped ones too.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the
    row with the largest doc_id stays (a null doc_id is smaller than any); of rows that repeat this doc_id, too,
    exactly one. An empty table gives no rows.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    digests = checkpointed(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(lower_ascii(text_of()).cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    best = F.max(F.struct("doc_id", "row"))
    candidates = frequent(digests, "digest", counters).select("digest")
    heavy = checkpointed(
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
    )
    decided = digests.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    others = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", "row", best.over(group).alias("best"), F.count("*").over(group).alias("group_size")
    )
    return decided.select("digest", "doc_id", "row", "best", "group_size").unionByName(others).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that stay, with all of their columns.

    Texts travel only where whole rows repeat: there, one of the rows with the same doc_id and text is taken.
    """
    stay = exact_dedup(docs, counters).filter("kept").select(
        F.col("doc_id").alias("stay_id__"), F.col("text_sha256").alias("stay_sha__")
    )
    same = F.col("doc_id").eqNullSafe(F.col("stay_id__")) & (F.col("sha__") == F.col("stay_sha__"))
    marked = docs.withColumn("sha__", F.sha2(lower_ascii(text_of()).cast("binary"), 256))
    return one_of_each(marked.join(stay, same, "left_semi"), docs, "sha__").drop("sha__")
