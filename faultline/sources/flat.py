"""Headerless tab-separated files: raw split on tabs, no quoting, nothing trimmed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from faultline.fixed_values import COMPLAINT_FIELD_COUNT, RECALL_FIELD_COUNT
from faultline.functions.text import is_blank
from faultline.sources.shared import checkpointed

#: Lines whose malformed ones are kept together while lines are numbered: 2 ** 13.
_CHUNK_BITS = 13


class MalformedLine(ValueError):
    """A line whose number of fields breaks the contract of its file."""


@dataclass(frozen=True)
class FlatLines:
    """Lines of flat files, split but not yet interpreted.

    `lines` has `file`, `block`, `value`, `fields`, `field_count` and `is_blank`; the other frames are views of
    it, so nothing is scanned twice unless two of them are used. `block` is where the split that a line was read in
    starts in its file, null for lines that come from no file.
    """

    lines: DataFrame
    expected: int

    @property
    def _is_malformed(self) -> Column:
        return ~F.col("is_blank") & (F.col("field_count") != self.expected)

    @property
    def is_record(self) -> Column:
        return ~F.col("is_blank") & (F.col("field_count") == self.expected)

    @property
    def good(self) -> DataFrame:
        return self.lines.filter(self.is_record)

    @property
    def malformed(self) -> DataFrame:
        return self.lines.filter(self._is_malformed).select(
            "file", F.lit(self.expected).alias("expected"), F.col("field_count").alias("actual"), "value"
        )

    def numbered_malformed(self) -> DataFrame:
        """Malformed lines with their place in their file: `file`, `line` (from 1, blank lines counted), `expected`,
        `actual`, `value`. For lines read from files that are each named once; a null file or block raises when run.

        A split is read by one task in order, so a line's place is the number of lines in earlier splits of its file plus
        its place in its split. One pass counts lines per chunk of a split and keeps the chunk's malformed lines (at most
        2 ** 13) beside the count; sums over splits then run over one row per split. Runs a job for the first pass,
        whose rows are kept, since a second reading could cut files into other splits.
        """
        at = F.col("at")
        bad = F.struct("at", F.col("field_count").alias("actual"), "value")
        chunks = checkpointed(
            self.lines.select(
                F.coalesce("file", F.raise_error(F.lit("lines without a file have no number"))).alias("file"),
                F.coalesce("block", F.raise_error(F.lit("lines without a split have no number"))).alias("block"),
                "value",
                "field_count",
                self._is_malformed.alias("is_malformed"),
                F.monotonically_increasing_id().alias("at"),
            )
            .groupBy("file", "block", F.shiftright("at", _CHUNK_BITS).alias("chunk"))
            .agg(
                F.count("*").alias("lines"),
                F.min("at").alias("first"),
                F.collect_list(F.when(F.col("is_malformed"), bad)).alias("malformed"),
            )
        )
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        splits = (
            chunks.groupBy("file", "block")
            .agg(F.sum("lines").alias("lines"), F.min("first").alias("split_first"))
            .select("file", "block", "split_first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
        )
        return (
            chunks.select("file", "block", F.explode("malformed").alias("bad"))
            .select("file", "block", "bad.*")
            .join(splits, ["file", "block"])
            .select(
                "file",
                (F.col("before") + at - F.col("split_first") + 1).alias("line"),
                F.lit(self.expected).alias("expected"),
                "actual",
                "value",
            )
        )

    def counts(self) -> DataFrame:
        """One row: records, blank lines and malformed lines."""
        blank = F.col("is_blank")
        fits = F.col("field_count") == self.expected
        return self.lines.agg(
            F.count_if(~blank & fits).alias("records"),
            F.count_if(blank).alias("blank_lines"),
            F.count_if(~blank & ~fits).alias("malformed_lines"),
        )

    def require_well_formed(self) -> FlatLines:
        """Raise on the first malformed line (by file and line) instead of setting it aside. Runs a job, and numbers
        lines only if there is one."""
        if self.malformed.isEmpty():
            return self
        row = self.numbered_malformed().orderBy("file", "line").first()
        raise MalformedLine(
            f"{row['file']}, line {row['line']}: expected {row['expected']} fields but found {row['actual']}: "
            f"{row['value'][:120]!r}"
        )

    def observed(self, observation: Observation) -> FlatLines:
        """The same lines, counting them into the observation while any job reads them."""
        watched = self.lines.observe(
            observation,
            F.count_if(~F.col("is_blank")).alias("lines_read"),
            F.count_if(F.col("is_blank")).alias("blank_lines"),
            F.count_if(self._is_malformed).alias("malformed_lines"),
        )
        return FlatLines(watched, self.expected)


def split_lines(
    lines: DataFrame, expected: int, file: Column | None = None, block: Column | None = None
) -> FlatLines:
    """Split a frame with a `value` column; `file` and `block` tell the origin of a line.

    The fields are generated rather than projected: filters on them then stay above the split instead
    of being pushed below it with a copy of it each, so a line is split once.
    """
    split = lines.select(
        (F.lit(None).cast("string") if file is None else file).alias("file"),
        (F.lit(None).cast("long") if block is None else block).alias("block"),
        "value",
        F.explode(F.array(F.split(F.col("value"), "\t", -1))).alias("fields"),
    )
    return FlatLines(
        split.select(
            "*",
            F.size("fields").alias("field_count"),
            is_blank(F.col("value")).alias("is_blank"),
        ),
        expected,
    )


def read_flat(
    spark: SparkSession, paths: str | Sequence[str], expected: int, strict: bool = False
) -> FlatLines:
    """Read one or more files as one table. The text source accepts LF, CRLF and a byte-order mark."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    split = split_lines(
        spark.read.text(paths), expected, F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    )
    return split.require_well_formed() if strict else split


def read_complaint_lines(
    spark: SparkSession, paths: str | Sequence[str], strict: bool = False
) -> FlatLines:
    return read_flat(spark, paths, COMPLAINT_FIELD_COUNT, strict)


def read_recall_lines(
    spark: SparkSession, paths: str | Sequence[str], strict: bool = False
) -> FlatLines:
    return read_flat(spark, paths, RECALL_FIELD_COUNT, strict)
