"""From raw documents to packed training windows: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.bag_minhash import drop_near_duplicates
from faultline.llm.common import checkpointed, table
from faultline.llm.exact_dedup import drop_copies
from faultline.llm.mixing import apply_mix
from faultline.llm.packing import pack_documents
from faultline.llm.queries import WORD_TOKENIZER
from faultline.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_ROWS, TEXT_ROWS = "10000", "1000"


def text_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of 1 000 rows, since Spark's 10 000 are for narrow rows: a batch stands in the
    executor's and in the worker's memory at once. A session that names another number keeps it; results are the same."""
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, TEXT_ROWS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, learnt from `labels`."""
    text_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    text_batches(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows."""
    text_batches(spark)
    return pack_documents(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages learn, hash and pack, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, cut at checkpoints in between."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
