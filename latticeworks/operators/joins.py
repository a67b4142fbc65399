"""Joins that keep their equi-keys and survive hot ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions.rings import ring_bounds, point_in_ring

BROADCAST_ROWS = 20_000
SALTS = 8


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the table provably holds at most ``rows`` rows (stops reading beyond)."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
    salts: int = SALTS, probe: bool = True,
) -> DataFrame:
    """Equi-join of a large, possibly skewed left side to a narrower right side.

    The right side is broadcast only after its row count was checked. Beyond
    that the left keys are salted and the right side is repeated once per
    salt, so one hot key is shared by ``salts`` tasks (AQE may split further).
    Pass ``probe=False`` for a right side that is costly to compute: it is
    then not counted first and never broadcast, since its size is only guessed
    from the files it stems from, whatever an explode made of them.
    """
    on = list(on)
    if probe and is_small(right):
        return left.join(F.broadcast(right), on, how)
    # The salt is drawn from the whole row, so rows of one key spread out.
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def attach(base: DataFrame, extra: DataFrame | None, key: str) -> DataFrame:
    """Left join that skips absent tables and columns the base already has.

    Accepts a key spelled ``<key>_500m`` on the incoming side.
    """
    if extra is None:
        return base
    incoming = next((k for k in (key, f"{key}_500m") if k in extra.columns), None)
    if incoming is None:
        return base
    extra = extra.withColumnRenamed(incoming, key)
    new = [c for c in extra.columns if c not in base.columns]
    return base.join(extra.select(key, *new), key, "left") if new else base


def onto_full_grid(
    grid: DataFrame, features: DataFrame, key: str, zero_filled: Mapping[str, object] | None = None
) -> DataFrame:
    """All grid cells with their features; named columns get a fill value."""
    out = grid.join(features, key, "left")
    return out.na.fill(dict(zero_filled)) if zero_filled else out


def assemble_outer(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer combination of per-key tables."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def mismatch(flags: DataFrame, a: str, b: str, measures: Mapping[str, Column]) -> DataFrame:
    """Profiles of the rows in A only and in B only, one row per direction."""
    a_col, b_col = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    side = F.when(a_col & ~b_col, f"{a}_only").when(b_col & ~a_col, f"{b}_only")
    return (
        flags.withColumn("direction", side)
        .where(F.col("direction").isNotNull())
        .groupBy("direction")
        .agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()])
    )


def reproduction_difference(
    ours: DataFrame, published: DataFrame, key: str, pairs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Largest and mean absolute difference and correlation per compared pair."""
    joined = ours.join(published, key)
    aggs = [F.count(F.lit(1)).alias("n_matched")]
    for name, (a, b) in pairs.items():
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        gap = F.when(both, F.abs(F.col(a) - F.col(b)))
        aggs += [
            F.max(gap).alias(f"{name}_max_abs_diff"),
            F.avg(gap).alias(f"{name}_mean_abs_diff"),
            F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"{name}_corr"),
        ]
    return joined.agg(*aggs)


def union_tagged(layers: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of same-shaped layers with the layer name in a column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in a stated order.

    Planned as a group limit, so every map task passes on at most one row per
    key and a key with many copies stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def stratified_sample(
    df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int
) -> DataFrame:
    """Up to ``per_stratum`` rows per stratum, repeatable for a seed."""
    draw = F.xxhash64(F.col(key), F.lit(seed))
    w = Window.partitionBy(stratum).orderBy(draw, key)
    picked = df.withColumn("_rn", F.row_number().over(w))
    return picked.where(F.col("_rn") <= per_stratum).drop("_rn")


def locate(
    points: DataFrame,
    regions: DataFrame,
    point_key: Sequence[str],
    tile: float,
    first_by: str | None = None,
) -> DataFrame:
    """Left join of points (x, y) to the region rings that hold them.

    Regions are covered with square tiles and joined on the tile; the exact
    ring test is part of the join condition. With ``first_by`` one region per
    point is kept (lowest value wins). Region columns: ``ring`` plus any
    attributes.
    """
    xmin, ymin, xmax, ymax = ring_bounds(F.col("ring"))

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / F.lit(tile)), F.floor(hi / F.lit(tile)))

    cover = (
        regions.withColumn("_tx", F.explode(span(xmin, xmax)))
        .withColumn("_ty", F.explode(span(ymin, ymax)))
    )
    attributes = [c for c in regions.columns if c != "ring"]
    tiled = points.withColumn("_tx", F.floor(F.col("x") / F.lit(tile))).withColumn(
        "_ty", F.floor(F.col("y") / F.lit(tile))
    )
    if first_by is not None:  # the regions of a tile side by side; each point picks the first that holds it
        value = F.struct(F.col(first_by).alias("_o"), *attributes, "ring")
        cover = cover.groupBy("_tx", "_ty").agg(F.collect_list(value).alias("_regions"))
        found = lookup_join(tiled, cover, ["_tx", "_ty"], "left")
        holding = F.filter("_regions", lambda c: point_in_ring(F.col("x"), F.col("y"), c["ring"]))
        first = F.array_min(F.transform(holding, lambda c: F.struct(c["_o"], *[c[a].alias(a) for a in attributes])))
        return found.select(*points.columns, first.alias("_a")).select(*points.columns, *[F.col(f"_a.{a}") for a in attributes])
    salts = 1 if is_small(cover) else SALTS
    tiled = tiled.withColumn("_salt", F.pmod(F.xxhash64(*point_key), F.lit(salts)).cast("int"))
    cover = cover.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = F.broadcast(cover) if salts == 1 else cover.hint("merge")
    left, right = tiled.alias("p"), right.alias("r")
    keys = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in ("_tx", "_ty", "_salt")]
    inside = point_in_ring(F.col("p.x"), F.col("p.y"), F.col("r.ring"))
    hits = left.join(right, reduce(lambda a, b: a & b, keys) & inside, "left").select(
        *[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in attributes]
    )
    return hits
