"""Neighbour graphs over lattice cells: edges, repair, audit, components."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.operators.joins import lookup_join
from latticeworks.operators.nearest import knn_edges, nearest  # noqa: F401
from latticeworks.session import checkpointed


def queen_edges(cells: DataFrame, key: str, col: str = "col", row: str = "row") -> DataFrame:
    """Directed edges between cells that share an edge or a corner."""
    offsets = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy
    ])
    probes = cells.select(F.col(key).alias("i"), col, row, F.explode(offsets).alias("o")).select(
        "i", (F.col(col) + F.col("o.dx")).alias("_c"), (F.col(row) + F.col("o.dy")).alias("_r")
    )
    home = cells.select(F.col(key).alias("j"), F.col(col).alias("_c"), F.col(row).alias("_r"))
    return probes.join(home, ["_c", "_r"]).select("i", "j")


def row_standardised(edges: DataFrame) -> DataFrame:
    """Weight 1/degree on every edge; a unit's edges are few (lattice or k)."""
    degree = F.count(F.lit(1)).over(Window.partitionBy("i"))
    return edges.select("i", "j", (1.0 / degree).alias("w"))


def attach_islands(cells: DataFrame, key: str, edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Join every unit without neighbours to its nearest unit, both ways.

    ``near`` gives edges (i, j, distance) of ``knn_edges`` over the same units, if they are there already:
    the nearest unit is among them.
    """
    linked = edges.select(F.col("i").alias(key)).distinct()
    islands = cells.join(linked, key, "left_anti")
    if near is None:
        found = nearest(islands.select(key, "x", "y"), cells, key, key, 1, exclude_same_key=True)
        new = found.select(F.col(key).alias("i"), F.explode("neighbours.id").alias("j"))
    else:
        asked = near.join(islands.select(F.col(key).alias("i")), "i", "left_semi")
        new = asked.groupBy("i").agg(F.min(F.struct("distance", "j")).alias("first")).select("i", F.col("first.j").alias("j"))
    both = new.unionByName(new.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select("i", "j").unionByName(both).distinct()


def components(cells: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Smallest member id of each unit's connected component.

    Alternates large-star and small-star steps until the edge set stops
    changing. Minima are combined map-side and looked up through salted joins,
    so the hub of a giant component stays spread out. Lineage is cut with a
    durable checkpoint each round.
    """
    links = checkpointed(
        edges.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"))
        .where("u <> v").distinct()
    )
    state = None
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == state:
            break
        state = now
    units = cells.select(F.col(key).alias("u"))
    labelled = units.join(links.groupBy("u").agg(F.min("v").alias("v")), "u", "left")
    return labelled.select(F.col("u").alias(key), F.coalesce("v", "u").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every unit sends its larger neighbours to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    sent = lookup_join(both, best, ["u"], "inner", probe=False).where("v > u")
    return sent.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every unit ties its smaller neighbours and itself to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    best = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = lookup_join(down, best, ["u"], "inner", probe=False).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = best.select("u", F.col("m").alias("v"))
    return tied.unionByName(own).where("u <> v").distinct()


def component_sizes(labels: DataFrame) -> DataFrame:
    """Number of components per size band, and the largest component."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("s"))
    s = F.col("s")
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"),
        F.count_if(s == 1).alias("n_singletons"),
        F.count_if(s.between(2, 5)).alias("n_2_to_5"),
        F.count_if(s.between(6, 20)).alias("n_6_to_20"),
        F.count_if(s > 20).alias("n_above_20"),
        F.max(s).alias("largest_component"),
    )


def audit(cells: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Units, islands, components and the range of neighbour counts."""
    return audits(cells, key, {"": edges}).drop("spec")


def audits(cells: DataFrame, key: str, specs: Mapping[str, DataFrame]) -> DataFrame:
    """``audit`` of several graphs over the same units, one row per name in ``spec``.

    The graphs go through one search for components, side by side: a unit's id carries its graph's number.
    So the number of jobs and plans the driver holds does not grow with the number of graphs.
    """
    m = len(specs)
    whole = isinstance(cells.schema[key].dataType, T.IntegralType)

    def tagged(column: str, graph: Column) -> Column:
        return F.col(column).cast("long") * m + graph if whole else F.struct(graph.alias("graph"), F.col(column).alias("id"))

    def number(unit: Column) -> Column:
        return F.pmod(unit, F.lit(m)).cast("int") if whole else unit["graph"]

    edges = reduce(DataFrame.unionByName, [
        e.select(tagged("i", F.lit(n)).alias("i"), tagged("j", F.lit(n)).alias("j")) for n, e in enumerate(specs.values())])
    units = cells.select(key, F.explode(F.array(*[F.lit(n) for n in range(m)])).alias("_g")).select(tagged(key, F.col("_g")).alias("unit"))
    degrees = edges.groupBy(F.col("i").alias("unit")).agg(F.count(F.lit(1)).alias("d"))
    per_unit = units.join(degrees, "unit", "left").na.fill(0, ["d"])
    base = per_unit.groupBy(number(F.col("unit")).alias("_g")).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("d") == 0).alias("n_islands"),
        F.min("d").alias("min_neighbors"),
        F.max("d").alias("max_neighbors"),
        F.avg("d").alias("mean_neighbors"),
    )
    parts = components(units, "unit", edges).select("component").distinct().groupBy(number(F.col("component")).alias("_g")).agg(
        F.count(F.lit(1)).alias("n_components"))
    # One row per graph on each side.
    names = cells.sparkSession.createDataFrame(list(enumerate(specs)), "_g int, spec string")
    return names.join(base, "_g", "left").join(parts, "_g", "left").na.fill(0, ["n_units", "n_islands", "n_components"]).drop("_g")
