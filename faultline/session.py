"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(
    name: str = "faultline", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session in UTC with adaptive execution; `settings` override everything.

    On a cluster the number of shuffle partitions is left to its configuration: adaptive execution
    merges small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
