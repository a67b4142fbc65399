"""Cell covariates: population, roads, points of interest, centres, terrain."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.functions import projection, scalars
from latticeworks.functions.scalars import round_even
from latticeworks.operators import joins, lattice, nearest
from latticeworks.session import checkpointed
from latticeworks.sources import lookups

log = logging.getLogger(__name__)
CELL_KM2 = 0.25


def centre_distance_columns(cells: DataFrame, key: str) -> DataFrame:
    """Distance to each fixed centre, the shortest, and its name; no join."""
    x, y = projection.to_utm(F.col("lon"), F.col("lat"))
    at = cells.select(key, x.alias("_x"), y.alias("_y"))
    d = scalars.centre_distances(F.col("_x"), F.col("_y"), lookups.centres_utm())
    named = at.select(key, *[c.alias(f"_d_{k}") for k, c in d.items()])
    best, name = scalars.nearest_centre({k: F.col(f"_d_{k}") for k in d})
    return named.select(
        key,
        round_even(best, 0).alias("distance_to_nearest_cbd_m"),
        *[round_even(f"_d_{k}", 0).alias(f"distance_to_{k}_cbd_m") for k in d],
        name.alias("nearest_cbd"),
    )


def road_lengths(roads: DataFrame, size: float) -> DataFrame:
    """Road length and density per touched cell, all and major roads.

    The reported length counts a whole segment in every cell it touches;
    ``clipped_length_m`` counts only the part inside.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    pieces = lattice.segment_cells(roads, 0.0, 0.0, size).withColumn("len", length)
    major = scalars.is_major_road("highway")
    total = F.sum("len")
    return pieces.groupBy("col", "row").agg(
        total.alias("road_length_total_m"),
        (total / CELL_KM2).alias("road_density_m_per_km2"),
        F.coalesce(F.sum(F.when(major, F.col("len"))), F.lit(0.0)).alias("road_length_major_m"),
        F.sum(lattice.clipped_length(size)).alias("clipped_length_m"),
    )


def road_points(roads: DataFrame, step: float = 100.0) -> DataFrame:
    """Points about every ``step`` metres along each segment, both ends included."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n = F.greatest(F.lit(2), F.floor(length / step).cast("int"))
    t = roads.select("road_id", "ax", "ay", "bx", "by", n.alias("_n")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i")
    )
    f = F.col("_i") / (F.col("_n") - 1)
    return t.select(
        F.concat_ws("-", "road_id", "_i").alias("point_id"),
        (F.col("ax") + (F.col("bx") - F.col("ax")) * f).alias("x"),
        (F.col("ay") + (F.col("by") - F.col("ay")) * f).alias("y"),
    )


def major_road_distance(cells: DataFrame, roads: DataFrame, key: str) -> DataFrame:
    points = road_points(roads.where(scalars.is_major_road("highway")))
    found = nearest.nearest_one(cells.select(key, "x", "y"), points, key, "point_id")
    return found.select(key, F.col("nearest_distance").alias("distance_to_major_road_m"))


def category_distances(
    cells: DataFrame, pois: DataFrame, key: str, poi_key: str, category: str, categories: Sequence[str]
) -> DataFrame:
    """One distance column per category, null where a category has no points."""
    found = nearest.nearest(cells.select(key, "x", "y"), pois, key, poi_key, group=[category])
    distance = F.get(F.col("neighbours"), F.lit(0))["distance"]
    return found.groupBy(key).agg(*[
        F.max(F.when(F.col(category) == c, distance)).alias(f"distance_to_{c}_m") for c in categories
    ])


def urban_distance(cells: DataFrame, key: str, coverage: str, threshold: float = 0.05) -> DataFrame:
    """Distance to the nearest cell at or above the coverage threshold."""
    # Written once: the search reads both sides several times, and the coverage may be costly to get.
    at = checkpointed(cells.select(key, "x", "y", (F.coalesce(F.col(coverage), F.lit(0.0)) >= threshold).alias("_urban")))
    found = nearest.nearest_one(at.select(key, "x", "y"), at.where("_urban").select(key, "x", "y"), key, key)
    return found.select(key, F.col("nearest_distance").alias("distance_to_urban_edge_m"))


def covariate_table(
    base: DataFrame, key: str, modules: Mapping[str, Callable[[], DataFrame]], wanted: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Left-join the wanted modules; one whose input path is absent is logged and skipped.

    Any other error is a fault of the module and is raised.
    """
    out, skipped = base, []
    for name in wanted:
        try:
            out = joins.attach(out, modules[name](), key)
        except (AnalysisException, FileNotFoundError) as error:  # a missing input must not stop the others
            if isinstance(error, AnalysisException) and "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            log.warning("module %s skipped: %s", name, error)
            skipped.append(name)
    return out, skipped
