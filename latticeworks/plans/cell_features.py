"""Footprints -> one feature row per grid cell, all cells kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.operators import cells, joins, order

MIN_CONFIDENCE = 0.65


def clean_footprints(
    raw: DataFrame, duplicate_key: list[str], order_by: list[str], min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Confidence filter, then the first row per duplicate key."""
    return joins.keep_first(raw.where(F.col("confidence") >= min_confidence), duplicate_key, order_by)


def building_features(
    footprints: DataFrame, key: str = "grid_id", cuts_from: DataFrame | None = None
) -> DataFrame:
    """Size, inequality, entropy and class mix per cell.

    All columns are aggregates over one counted distribution: the cells are
    ordered once, and one map-side combined pass yields every statistic.
    """
    dist = cells.size_distribution(footprints, [key], cuts_from=cuts_from)
    return cells.statistics(dist, [key], {
        **cells.basic_statistics(),
        **cells.inequality(),
        "building_area_entropy": order.binned_entropy("area_m2", 20),
        **cells.class_shares_of("area_m2"),
    })


def grid_table(grid: DataFrame, features: DataFrame, key: str = "grid_id") -> DataFrame:
    """Left join onto the full grid, zero counts filled, coverage added."""
    joined = joins.onto_full_grid(grid, features, key, {"building_count": 0})
    return cells.built_coverage(joined, "total_footprint_area", "cell_area_m2")
