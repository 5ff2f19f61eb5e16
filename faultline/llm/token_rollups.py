"""Token totals by source, language and tokenizer version, maintained from signed changes.

A batch of inserts, deletes and revised counts becomes signed rows: +1 for a count that now holds, -1 for one that no
longer does, which is looked up among the rows of earlier batches. Totals are sums of signed rows and so can
be added up from the batches in any order. A batch is written to folders of its own and takes effect with its
commit record; sending it again changes nothing, and a batch that broke off is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import text_of
from faultline.llm.words import word_encoder

INSERT, REVISE, DELETE = "insert", "revise", "delete"
KEY = ["doc_id", "version"]
SIGNED = "doc_id long, version string, source string, lang string, tokens long, sign int"
TOTALS = "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """doc_id, source, lang, version, tokens of each row by the tokenizer file; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in batches:
            counts = pa.array([len(encode(text)) for text in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts], names=["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", text_of().alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens")


def count_words(docs: DataFrame, version: str) -> DataFrame:
    """The same, by a rule: the maximal runs of characters other than ASCII white space."""
    words = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", F.lit(version).alias("version"), words.alias("tokens"))


class TokenRollups:
    """Totals kept in a folder that all executors share; one writer at a time.

    Changes have the columns doc_id, source, lang, version, tokens and action; others are not read. A document
    has one count for each version: inserting or revising one that is there replaces it, deleting one that is not
    there does nothing, and for a delete only doc_id and version matter. Of several rows of a batch for one
    document and version a delete yields to the others, then the largest count wins. A null source or language is a
    group of its own; rows without doc_id, version or action are left out, null tokens count as none. An empty batch
    commits and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _committed(self, name: str, schema: str) -> DataFrame:
        """The rows of committed batches."""
        done = self.committed()
        paths = [f"{self.folder}/{name}/{batch}" for batch in done]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def committed(self) -> list[str]:
        """Batches that have taken effect: names only, a few bytes for each batch."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/commits/*").select("batch")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise
        return sorted({row.batch for row in rows.collect()})

    def signed(self, changes: DataFrame) -> DataFrame:
        """The signed rows of a batch against the counts that hold now."""
        rows = changes.filter(F.col("doc_id").isNotNull() & F.col("version").isNotNull() & F.col("action").isNotNull())
        count = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
        rows = rows.select(F.col("doc_id").cast("long"), "version", "source", "lang", count.alias("tokens"), "action")
        best = F.max(F.struct((F.col("action") != DELETE).alias("stays"), "tokens", "source", "lang"))
        last = rows.groupBy(*KEY).agg(best.alias("row"))
        new = last.filter("row.stays").select(*KEY, "row.source", "row.lang", "row.tokens", F.lit(1).alias("sign"))
        told = self._committed("ledger", SIGNED).join(last.select(*KEY), KEY, "left_semi")
        held = told.groupBy(*KEY, "source", "lang", "tokens").agg(F.sum("sign").alias("n")).filter("n > 0")
        old = held.select(*KEY, "source", "lang", "tokens", F.lit(-1).alias("sign"))
        return new.unionByName(old)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it has been applied before, and then nothing is done."""
        if batch in self.committed():
            return False
        ledger = f"{self.folder}/ledger/{batch}"
        self.signed(changes).write.mode("overwrite").parquet(ledger)
        signed = self.spark.read.schema(SIGNED).parquet(ledger)
        delta = signed.groupBy("source", "lang", "version").agg(
            F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        record = self.spark.range(1).select(F.lit(batch).alias("batch"))
        record.write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of all groups that hold documents."""
        sums = self._committed("deltas", TOTALS).groupBy("source", "lang", "version")
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs > 0")


def corpus_history(docs: DataFrame, tokenizer: str, rollups: TokenRollups) -> DataFrame:
    """Totals of a corpus after a history of batches: all documents are inserted by two counts, a batch is sent
    twice, documents with repeated lines are revised to what remains without them, and of equal texts all but the
    smallest doc_id are deleted."""
    line_count = F.size(F.split(text_of(), "\n", -1))
    lines = F.array_distinct(F.split(text_of(), "\n", -1))
    shorter = docs.filter(F.size(lines) < line_count).withColumn("text", F.array_join(lines, "\n"))
    same = docs.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("sha"))
    first = same.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    copies = same.select("doc_id").join(first, "doc_id", "left_anti").select(
        "doc_id",
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"),
        F.explode(F.array(F.lit("word_bpe_49k"), F.lit("words"))).alias("version"),
        F.lit(0).cast("long").alias("tokens"),
        F.lit(DELETE).alias("action"),
    )
    acting = lambda rows, action: rows.withColumn("action", F.lit(action))
    rollups.commit("1-bpe", acting(count_tokens(docs, tokenizer, "word_bpe_49k"), INSERT))
    rollups.commit("2-words", acting(count_words(docs, "words"), INSERT))
    rollups.commit("2-words", acting(count_words(docs, "words"), INSERT))
    revised = count_tokens(shorter, tokenizer, "word_bpe_49k").unionByName(count_words(shorter, "words"))
    rollups.commit("3-lines", acting(revised, REVISE))
    rollups.commit("4-copies", copies)
    return rollups.totals()
