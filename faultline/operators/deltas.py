"""Derived tables kept up to date by signed differences of cells instead of a rebuild.

Cells are sums, so a replaced report is its old cell taken off and its new one added. A cell whose reports have all gone
vanishes, and with it names, top levels and vehicles that nothing supports any longer: all derived tables follow from
cells. Only vehicles, and groups of vehicles, that a difference touches are computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.measures import DIMENSIONS, MEASURES, report_cells, summed
from faultline.operators.catalog import counted_catalog, recall_counts
from faultline.operators.profile import component_rows, flat_profiles, vehicle_profiles
from faultline.operators.taxonomy import component_taxonomy


def signed_cells(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Cells of `added` reports less those of `removed` ones; cells that stay the same are left out."""
    taken = report_cells(removed).select(*DIMENSIONS, *[(-F.col(m)).alias(m) for m in MEASURES])
    both = report_cells(added).unionByName(taken).groupBy(*DIMENSIONS).agg(*summed(MEASURES))
    return both.filter(" OR ".join(f"{m} <> 0" for m in MEASURES))


def touched(deltas: DataFrame) -> DataFrame:
    return deltas.select("vehicle_key").distinct()


def apply_deltas(cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """Cells after the differences. Cells of untouched vehicles pass as they are."""
    vehicles = touched(deltas)
    moved = cells.join(vehicles, "vehicle_key", "left_semi").unionByName(deltas)
    summed_up = moved.groupBy(*DIMENSIONS).agg(*summed(MEASURES)).filter("complaints > 0")
    return cells.join(vehicles, "vehicle_key", "left_anti").unionByName(summed_up)


def _refreshed(table: DataFrame, fresh: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `keys` replaced by `fresh`; those without a fresh row are gone."""
    return table.join(keys, keys.columns, "left_anti").unionByName(fresh)


def refresh_profiles(profiles: DataFrame, cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored profiles after the differences; `cells` are those after them."""
    vehicles = touched(deltas)
    return _refreshed(profiles, vehicle_profiles(cells.join(vehicles, "vehicle_key", "left_semi")), vehicles)


def refresh_catalog(vehicles: DataFrame, cells: DataFrame, deltas: DataFrame, recalls: DataFrame) -> DataFrame:
    """The catalogue after the differences. Recalls are read for touched vehicles only."""
    theirs = recalls.join(touched(deltas), "vehicle_key", "left_semi")
    return refresh_counted_catalog(vehicles, cells, deltas, recall_counts(theirs))


def refresh_counted_catalog(vehicles: DataFrame, cells: DataFrame, deltas: DataFrame, counts: DataFrame) -> DataFrame:
    """The catalogue after the differences, from `recall_counts` that are already there and hold the touched vehicles."""
    keys = touched(deltas)
    return _refreshed(vehicles, counted_catalog(cells.join(keys, "vehicle_key", "left_semi"), counts), keys)


def touched_groups(cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """Groups with a difference, and groups that rank a touched vehicle, whose total may have moved."""
    ranked = cells.join(touched(deltas), "vehicle_key", "left_semi").select("component_group")
    return deltas.select("component_group").unionByName(ranked).distinct()


def refresh_taxonomy(components: DataFrame, cells: DataFrame, deltas: DataFrame, profiles: DataFrame) -> DataFrame:
    """The component table after the differences; `cells` and `profiles` are those after them."""
    groups = touched_groups(cells, deltas)
    theirs = cells.join(groups, "component_group", "left_semi")
    fresh = component_taxonomy(theirs, component_rows(theirs), flat_profiles(profiles))
    return _refreshed(components, fresh, groups)
