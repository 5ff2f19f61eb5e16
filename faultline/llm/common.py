"""Helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.shared import checkpointed, forget, release, shared_folder  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written as a compressed table in the shared folder, and where; for what is large and read often."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder), folder


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def crc_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo `divisor`; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def split_by_repeats(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` whose doc_id occurs once in `docs`, and the others; only the ids are counted and compared."""
    twice = checkpointed(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("twice__")))
    same = F.col("doc_id").eqNullSafe(F.col("twice__"))
    return rows.join(twice, same, "left_anti"), rows.join(twice, same, "left_semi")


def one_of_each(rows: DataFrame, docs: DataFrame, mark: str) -> DataFrame:
    """One of the rows that share doc_id and `mark`. Texts are shuffled only for ids that occur more than once in `docs`."""
    once, repeated = split_by_repeats(rows, docs)
    return once.unionByName(repeated.dropDuplicates(["doc_id", mark]))
