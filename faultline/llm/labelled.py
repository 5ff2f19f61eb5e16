"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, crc_remainder, text_of


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, most: dict[int, int]
) -> DataFrame:
    """(doc_id, part, label, text) of at most `most[value]` labelled ids for each value of the label.

    Only ids whose crc32 as text modulo `divisor` (part) is not `held_out` are taken, in the order of a hash; null
    labels and ids are left out. Of rows that share an id one is taken. The ids are few, so they are broadcast and the texts stay where they are.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).withColumn(
        "part", crc_remainder(F.col("doc_id"), divisor)
    )
    known = known.filter(F.col("doc_id").isNotNull() & (F.col("part") != held_out)).distinct()
    chosen = None
    for value, n in most.items():
        of = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = of if chosen is None else chosen.unionByName(of)
    chosen = checkpointed(chosen)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # Rows that repeat an id shrink to one per task before they move.
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return rows.groupBy("doc_id", "part", "label").agg(one["text"].alias("text"))
