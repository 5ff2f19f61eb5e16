"""Updates of a loaded data set without a rebuild: a base table in key ranges, derived tables by differences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from faultline.functions.measures import report_cells
from faultline.operators import deltas as by
from faultline.operators.catalog import vehicle_catalog
from faultline.operators.profile import component_rows, profile_scalars, vehicle_profiles
from faultline.operators.taxonomy import component_taxonomy
from faultline.sources.ranged import RangedTable
from faultline.sources.shared import checkpointed


@dataclass(frozen=True)
class Derived:
    """All tables that follow from the reports, and the cells they follow from."""

    cells: DataFrame
    vehicles: DataFrame
    profiles: DataFrame
    components: DataFrame


def derive(reports: DataFrame, recalls: DataFrame) -> Derived:
    """Every table from all reports."""
    cells = checkpointed(report_cells(reports))
    breakdown, scalars = component_rows(cells), profile_scalars(cells)
    tables = vehicle_catalog(cells, recalls), vehicle_profiles(cells), component_taxonomy(cells, breakdown, scalars)
    return Derived(cells, *map(checkpointed, tables))


def update(table: RangedTable, derived: Derived, incoming: DataFrame, order: Sequence[str | Column], recalls: DataFrame) -> Derived:
    """Upsert reports into `table` and bring the derived tables up to date.

    Only ranges that incoming ids fall into are read; reports that change nothing touch nothing. Raises StaleBase, with nothing
    committed, if another writer was faster.
    """
    base = table.version()
    changed, replaced = table.changes(incoming, order, base)
    deltas = checkpointed(by.signed_cells(changed, replaced))
    table.apply(changed, base)
    cells = checkpointed(by.apply_deltas(derived.cells, deltas))
    profiles = checkpointed(by.refresh_profiles(derived.profiles, cells, deltas))
    return Derived(
        cells,
        checkpointed(by.refresh_catalog(derived.vehicles, cells, deltas, recalls)),
        profiles,
        checkpointed(by.refresh_taxonomy(derived.components, cells, deltas, profiles)),
    )
