"""Lookup tables: make spellings and component groups.

Both are curated lists that a person edits, so a file is read whole, as a dictionary. As Spark frames they carry
their real size, which lets Catalyst broadcast them on its own and shuffle them should someone supply a large one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import collapse_ws, display_name, slug

def read_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object of strings in one file, from any file system Spark can read."""
    mapping = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(mapping, dict):
        raise ValueError(f"{path} is not a JSON object")
    return {str(key): str(value) for key, value in mapping.items()}


def _cleaned(mapping: Mapping[str, str], collapse: bool) -> dict[str, str]:
    """Trimmed entries by upper-case key, the last one winning; incomplete entries are dropped."""

    def tidy(text: str) -> str:
        return " ".join(text.split()).upper() if collapse else text.strip()

    pairs = ((tidy(key).upper(), tidy(value)) for key, value in mapping.items())
    return {key: value for key, value in pairs if key and value}


def _frame(spark: SparkSession, rows: Mapping[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(
        pa.table(
            {
                key: pa.array(list(rows.keys()), pa.string()),
                value: pa.array(list(rows.values()), pa.string()),
            }
        )
    )


def group_dimension(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """`category` (upper case) and its `mapped_group`."""
    return _frame(spark, _cleaned(mapping, collapse=False), "category", "mapped_group")


def close_aliases(mapping: Mapping[str, str]) -> dict[str, str]:
    """Point every alias at the end of its chain; a cycle ends at the first name met twice."""
    step = _cleaned(mapping, collapse=True)

    def end_of(alias: str) -> str:
        trail = [alias]
        while trail[-1] in step and step[trail[-1]] not in trail:
            trail.append(step[trail[-1]])
        return step.get(trail[-1], trail[-1])

    return {alias: end_of(alias) for alias in step}


def alias_dimension(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """`alias`, with the `alias_name` and `alias_slug` it stands for."""
    closed = _frame(spark, close_aliases(mapping), "alias", "target")
    target_slug = slug(F.col("target"))
    return closed.select(
        "alias",
        display_name(collapse_ws(F.col("target")), target_slug).alias("alias_name"),
        target_slug.alias("alias_slug"),
    )
