"""The operators of this subpackage as queries over the given tables, with their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import oracles
from faultline.llm.bag_minhash import near_duplicates
from faultline.llm.common import shared_folder, table
from faultline.llm.conversations import damage_and_repair
from faultline.llm.exact_dedup import exact_dedup
from faultline.llm.html_text import extract_pages
from faultline.llm.merkle import verify_documents
from faultline.llm.mixing import mix
from faultline.llm.neighbours import every_twentieth
from faultline.llm.packing import pack_documents
from faultline.llm.pii import find_personal_data
from faultline.llm.prefix_tree import similar_sets
from faultline.llm.quality import score_quality
from faultline.llm.token_rollups import TokenRollups, corpus_history
from faultline.llm.toxicity import score_toxicity

#: The vocabulary file of the word tokenizer.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_twentieth(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollups = TokenRollups(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}")
    return corpus_history(table(spark, sf_dir, "documents"), WORD_TOKENIZER, rollups)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).drop("set_key")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_exact_dedup,
        op2_neighbours,
        op3_pii,
        op4_mixing,
        op5_quality,
        op6_packing,
        op7_bag_minhash,
        op8_html_text,
        op9_token_rollups,
        op10_toxicity,
        op11_conversations,
        op12_prefix_tree,
        op13_merkle_manifest,
    )
    return {operator.__name__: operator for operator in operators}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
