"""Batch load: flat files to base tables to derived tables.

A run writes everything below its own folder and never touches another run, so readers switch by
naming the newer folder and a failed run leaves nothing half replaced. Derived tables are always
rebuilt whole; vehicles that vanished from the base tables vanish from them as well.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from faultline.fixed_values import COMPONENT_GROUPS, MAKE_ALIASES
from faultline.functions.measures import report_cells
from faultline.operators import maintain
from faultline.operators.catalog import vehicle_catalog
from faultline.operators.profile import (
    component_rows,
    profile_scalars,
    vehicle_profiles,
)
from faultline.operators.records import (
    COMPLAINT_COLUMNS,
    RECALL_COLUMNS,
    MappedRecords,
    map_complaints,
    map_recalls,
    unmapped_top_levels,
)
from faultline.operators.taxonomy import component_taxonomy
from faultline.sources.dimensions import alias_dimension, group_dimension
from faultline.sources.flat import FlatLines, read_complaint_lines, read_recall_lines

DERIVED_TABLES = ("vehicles", "profiles", "components")


@dataclass(frozen=True)
class Run:
    """The folder of one load."""

    spark: SparkSession
    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Write a table and hand back the written one, which no longer depends on its inputs."""
        rows.write.mode("overwrite").parquet(self.path(table))
        return self.read(table)


def complaint_order() -> list[Column]:
    """Which of two rows with one id replaces the other inside a load: the one received later."""
    return [F.col("received_date"), F.col("odi_number"), F.col("vehicle_key"), F.col("description")]


def recall_order() -> list[Column]:
    return [
        F.col("report_received_date"), F.col("campaign_number"), F.col("vehicle_key"),
        F.col("defect_description"),
    ]


@dataclass(frozen=True)
class Staged:
    """Parsed records of one load as written: accepted and rejected ones, and the lines and outcomes counted on the way."""

    records: DataFrame
    columns: tuple[str, ...]
    lines: Mapping[str, int]
    outcomes: Mapping[str, int]

    @property
    def accepted(self) -> DataFrame:
        return self.records.filter(F.col("reject_reason").isNull())


def _stage(
    run: Run, name: str, lines: FlatLines, mapper, aliases: DataFrame, groups: DataFrame
) -> Staged:
    """Parse once, write accepted and rejected records together, and count lines and outcomes on the way."""
    seen, decided = Observation(f"{name} lines"), Observation(f"{name} outcomes")
    mapped: MappedRecords = mapper(lines.observed(seen), aliases, groups)
    records = mapped.records.observe(
        decided,
        F.count(F.lit(1)).alias("vehicle_records"),
        F.count("reject_reason").alias("mapping_failures"),
    )
    written = run.write(f"staging/{name}", records)
    if seen.get["malformed_lines"]:
        run.write(f"staging/{name}-malformed", lines.numbered_malformed())
    return Staged(written, mapped.columns, seen.get, decided.get)


def load(
    spark: SparkSession,
    folder: str,
    complaint_files: str | Sequence[str],
    recall_files: str | Sequence[str] = (),
    previous: str | None = None,
    aliases: Mapping[str, str] = MAKE_ALIASES,
    groups: Mapping[str, str] = COMPONENT_GROUPS,
    record_limit: int | None = None,
    strict: bool = False,
) -> Run:
    """Load flat files into a new run.

    With `previous`, rows are upserted into that run's base tables; without it the load is a full
    refresh. `record_limit` keeps the accepted complaints with the lowest ids, for trial runs. Without
    recall files the recalls of the previous run are kept. Reports: counters of lines and outcomes, complaints per
    spelling of a make, rare spellings, unmapped components, and a summary with the load's duration.
    """
    started = time.monotonic()
    run = Run(spark, folder)
    before = Run(spark, previous) if previous else None
    alias_table, group_table = alias_dimension(spark, aliases), group_dimension(spark, groups)

    complaint_lines = read_complaint_lines(spark, complaint_files, strict)
    complaints = _stage(
        run, "complaints", complaint_lines, map_complaints, alias_table, group_table
    )
    incoming = complaints.accepted.select(*COMPLAINT_COLUMNS)
    if record_limit is not None:
        incoming = incoming.orderBy("id").limit(record_limit)
    _store_complaints(run, incoming, before)
    accepted_levels = complaints.accepted.select(F.col("component.levels").alias("levels"))

    if recall_files:
        recall_lines = read_recall_lines(spark, recall_files, strict)
        recalls = _stage(run, "recalls", recall_lines, map_recalls, alias_table, group_table)
        _store_recalls(run, recalls.accepted.select(*RECALL_COLUMNS), before)
        accepted_levels = accepted_levels.unionByName(recalls.accepted.select("levels"))
        maintain.write_report(_counters(recalls), run.path("reports/recall-load"))
    elif before is not None:
        run.write("recalls", before.read("recalls"))
    else:
        run.write("recalls", spark.createDataFrame([], RECALL_SCHEMA))

    maintain.write_report(_counters(complaints), run.path("reports/complaint-load"))
    spellings = run.write("reports/make-spellings", maintain.spelling_counts(complaints.accepted))
    maintain.write_report(maintain.rare_spellings(spellings), run.path("reports/rare-makes"))
    maintain.write_report(
        unmapped_top_levels(accepted_levels, group_table), run.path("reports/unmapped-components")
    )
    rebuild(run)
    summary = maintain.load_summary(spellings, time.monotonic() - started)
    maintain.write_report(summary, run.path("reports/summary"))
    return run


RECALL_SCHEMA = (
    "id int, campaign_number string, manufacturer string, make string, make_raw string, model string, "
    "model_raw string, model_year int, component_name string, component_group string, "
    "recall_type string, potentially_affected int, owners_notified_date date, "
    "report_received_date date, defect_description string, consequence string, "
    "corrective_action string, do_not_drive boolean, park_outside boolean, vehicle_key string"
)


def _store_complaints(run: Run, incoming: DataFrame, before: Run | None) -> None:
    newest = (
        maintain.latest_per_key(incoming, ["id"], complaint_order())
        if before is None
        else maintain.upsert(before.read("complaints"), incoming, ["id"], complaint_order())
    )
    # Ordered by vehicle and date so that a lookup skips row groups; the date in the range keeps a
    # vehicle with very many complaints from ending up in one file.
    ordered = newest.select(*COMPLAINT_COLUMNS).repartitionByRange("vehicle_key", "received_date")
    run.write("complaints", ordered.sortWithinPartitions("vehicle_key", F.desc("received_date")))


def _store_recalls(run: Run, incoming: DataFrame, before: Run | None) -> None:
    newest = (
        maintain.latest_per_key(incoming, ["id"], recall_order())
        if before is None
        else maintain.upsert(before.read("recalls"), incoming, ["id"], recall_order())
    )
    ordered = newest.select(*RECALL_COLUMNS).repartitionByRange("vehicle_key", "id")
    run.write("recalls", ordered.sortWithinPartitions("vehicle_key", "id"))


def _counters(staged: Staged) -> DataFrame:
    """Load counters, all from the pass that wrote the staged records."""
    lines, outcomes = staged.lines, staged.outcomes
    read, malformed = lines["lines_read"], lines["malformed_lines"]
    vehicles, failures = outcomes["vehicle_records"], outcomes["mapping_failures"]
    row = (read, lines["blank_lines"], malformed, read - malformed - vehicles, failures, vehicles - failures)
    names = ("lines_read", "blank_lines", "malformed_lines", "non_vehicle", "mapping_failures", "accepted")
    return staged.records.sparkSession.createDataFrame([row], ", ".join(f"{name} long" for name in names))


def rebuild(run: Run) -> None:
    """Recompute all derived tables from the stored base tables of a run.

    Reports are scanned once into cells, which are written and shared by all three tables. The
    component table ranks vehicles from the profiles, so it comes last.
    """
    cells = run.write("staging/cells", report_cells(run.read("complaints")))
    run.write("vehicles", vehicle_catalog(cells, run.read("recalls")))
    run.write("profiles", vehicle_profiles(cells))
    run.write(
        "components", component_taxonomy(cells, component_rows(cells), profile_scalars(cells))
    )
