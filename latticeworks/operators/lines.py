"""Polylines by running length: segments, shares of cells, points at equal steps.

A line is an array of points. Its segments carry the length run up to them, so that a place along the
line is found in the segment whose interval holds it, wherever the vertices are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions import rings
from latticeworks.operators import lattice


def measured_segments(lines: DataFrame, key: str, line: str = "line", columns: Sequence[str] = ()) -> DataFrame:
    """(key, columns, seq, ax, ay, bx, by, from_m, to_m, length_m): segments by running length.

    Segments without length are dropped; a line of one point, an empty or a null one has no row.
    """
    each = lines.select(key, *columns, F.posexplode(rings.segments(F.col(line))).alias("seq", "s"))
    flat = each.select(key, *columns, "seq", *[F.col(f"s.{p}.{c}").alias(n) for n, p, c in (("ax", "p", "x"), ("ay", "p", "y"), ("bx", "q", "x"), ("by", "q", "y"))])
    flat = flat.withColumn("m", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where("m > 0")
    along = Window.partitionBy(key).orderBy("seq")
    run = flat.withColumn("to_m", F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("from_m", F.coalesce(F.lag("to_m").over(along), F.lit(0.0)))
    return run.withColumn("length_m", F.max("to_m").over(Window.partitionBy(key))).drop("m")


def points_along(segments: DataFrame, key: str, step: float = 100.0) -> DataFrame:
    """(point_id, key, at_m, x, y): places about every ``step`` metres along whole lines, both ends included.

    A line of length L gets max(2, floor(L / step)) places at equal distances.
    """
    n = F.greatest(F.lit(2), F.floor(F.col("length_m") / step).cast("int"))
    gap = F.col("length_m") / (n - 1)
    first = F.ceil(F.col("from_m") / gap).cast("int")
    # The place on a shared vertex is the later segment's; the last place is the last segment's.
    last = F.when(F.col("to_m") >= F.col("length_m"), n - 1).otherwise(F.ceil(F.col("to_m") / gap).cast("int") - 1)
    first = F.when(F.col("from_m") <= 0, 0).otherwise(first)
    none = F.expr("CAST(array() AS array<int>)")
    placed = segments.select("*", gap.alias("_gap"), F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(none)).alias("_k"))
    t = F.least(F.greatest((F.col("_k") * F.col("_gap") - F.col("from_m")) / (F.col("to_m") - F.col("from_m")), F.lit(0.0)), F.lit(1.0))
    return placed.select(
        F.concat_ws("-", key, "_k").alias("point_id"), key, (F.col("_k") * F.col("_gap")).alias("at_m"),
        (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("y"))


def length_by_cell(segments: DataFrame, key: str, size: float, major: Column, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(col, row, n_lines, total_m, major_m, inside_m): a line's whole length once in each cell it touches, and the part inside."""
    pieces = lattice.segment_cells(segments.withColumn("_major", major), x0, y0, size).withColumn("_in", lattice.clipped_length(size, x0, y0))
    once = pieces.groupBy(key, "col", "row").agg(F.max("length_m").alias("m"), F.max("_major").alias("_major"), F.sum("_in").alias("_in"))
    return once.groupBy("col", "row").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("m").alias("total_m"),
        F.coalesce(F.sum(F.when(F.col("_major"), F.col("m"))), F.lit(0.0)).alias("major_m"), F.sum("_in").alias("inside_m"))
