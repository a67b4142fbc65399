"""Polygons of several parts with holes, as tables of directed edges.

An outer ring runs counter-clockwise and a hole clockwise, so a polygon is always to the left of its
edges and sums over edges need not know which ring an edge is of. Nothing here holds a whole polygon:
edges are cut by a square lattice and meet points and cells by equi-joins on the cell.

In one lattice row let an edge piece that climbs by dy stand in column c. The polygon's area in a cell is
the sum of the pieces' own areas to the cell's west side plus cell width times the dy of all pieces in
columns further east. So a running sum over the touched cells of a row gives every cell's exact share,
and between two touched cells all cells are inside (the sum is a whole cell height) or outside (zero).
First moments run the same way and give centroids.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.functions import rings
from latticeworks.operators.joins import BROADCAST_ROWS, is_small, lookup_join
from latticeworks.operators.lattice import segment_cells
from latticeworks.session import ship_package

# Where in a cell its reference point lies; no lattice coordinate falls on it.
REF_X, REF_Y = 0.41421356237, 0.57721566490
EDGE = ["ax", "ay", "bx", "by"]
# WKT, in Java's regular expressions and in Python's.
_NUMBER = r"-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"
_PAIR = rf"({_NUMBER})\s+({_NUMBER})"
_RING = r"\([^()]*\)"
_PART = rf"\(\s*{_RING}(?:\s*,\s*{_RING})*\s*\)"


def wkt_polygons(wkt: Column) -> Column:
    """WKT POLYGON or MULTIPOLYGON as parts of rings of points; the first ring of a part is its outer one."""
    parts = F.regexp_extract_all(wkt, F.lit(_PART), F.lit(0))

    def points(text: Column) -> Column:
        # One scan finds the pairs; their numbers are what stands before the first and behind the last blank.
        pairs = F.regexp_extract_all(F.translate(text, "\t\n\x0b\f\r", "     "), F.lit(_PAIR), F.lit(0))
        return F.transform(pairs, lambda p: rings.point(F.substring_index(p, " ", 1), F.substring_index(p, " ", -1)))

    return F.transform(parts, lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"\(([^()]*)\)"), F.lit(1)), points))


def _over_rings(parts: Column, term) -> Column:
    """Sum of ``term(ring, is a hole)`` over all rings of all parts."""
    def part(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda r, i: term(r, i > 0)), F.lit(0.0), lambda acc, v: acc + v)

    return F.aggregate(F.transform(parts, part), F.lit(0.0), lambda acc, v: acc + v)


def polygon_area(parts: Column) -> Column:
    """Outer rings less their holes."""
    return _over_rings(parts, lambda r, hole: F.when(hole, -rings.ring_area(r)).otherwise(rings.ring_area(r)))


def polygon_perimeter(parts: Column) -> Column:
    """Length of all rings, holes too."""
    return _over_rings(parts, lambda r, hole: rings.ring_perimeter(r))


def polygon_bounds(parts: Column) -> tuple[Column, Column, Column, Column]:
    points = F.flatten(F.flatten(parts))
    return rings.ring_bounds(points)


def polygon_centroid(parts: Column) -> tuple[Column, Column]:
    """Area centroid; null without area."""
    area = polygon_area(parts)
    out = []
    for axis in (0, 1):
        def moment(r: Column, hole: Column, axis=axis) -> Column:
            m = F.coalesce(rings.ring_area(r) * rings.ring_centroid(r)[axis], F.lit(0.0))
            return F.when(hole, -m).otherwise(m)

        out.append(F.when(area > 0, _over_rings(parts, moment) / area))
    return out[0], out[1]


def largest_part(parts: Column) -> Column:
    """The part with the largest area, holes taken off (the first of equals), as parts of one."""
    def area(p: Column) -> Column:
        return polygon_area(F.array(p))

    best = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)),
        lambda held, p: F.when(area(p) > area(held), p).otherwise(held))
    return F.when(F.size(parts) > 0, F.array(best))


def with_polygon_metrics(df: DataFrame, parts: str, exact: bool = False, largest: str | None = None) -> DataFrame:
    """Rows with area, perimeter and shape ratios of the whole geometry, by the names of ``shape_metrics``.

    ``largest`` names a column for the area of the largest part. The measures are taken once a row, the area
    of each part too; the ratios read them.
    """
    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, v: acc + v)

    def sums(measures: Column) -> Column:
        areas = F.transform(measures, lambda p: total(F.transform(p, lambda r, i: F.when(i > 0, -r["area"]).otherwise(r["area"]))))
        length = total(F.transform(measures, lambda p: total(F.transform(p, lambda r: r["length"]))))
        return rings.let(areas, lambda a: F.struct(total(a).alias("area"), F.array_max(a).alias("largest"), length.alias("length")))

    # What is exploded are plain numbers: the ratios and whatever rounds them read these again and again.
    each = F.transform(parts, lambda p: F.transform(p, lambda r: rings.ring_area_and_perimeter(r)))
    base = F.struct(rings.let(each, sums).alias("of"), rings.let(F.flatten(F.flatten(parts)), rings.ring_box).alias("box"))
    once = df.select("*", F.explode(F.array(base)).alias("_m"))
    bounds = tuple(F.col(f"_m.box.{c}") for c in ("x0", "y0", "x1", "y1"))
    added = {largest: F.col("_m.of.largest")} if largest else {}
    return once.withColumns(rings.shape_ratios(F.col("_m.of.area"), F.col("_m.of.length"), bounds, exact) | added).drop("_m")


def measured_wkt(df: DataFrame, wkt: str, exact: bool = False, largest: str | None = None, n_parts: str = "n_parts") -> DataFrame:
    """``with_polygon_metrics`` of the polygons in a text column, which goes, and the number of their parts.

    Numbers are read and summed up in Python workers, for all rows of a batch at once: as columns of nested arrays,
    every vertex costs a chain of interpreted expressions. Rows do not move.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != wkt]
    doubles = ["_area", "_length", "_largest", "_x0", "_y0", "_x1", "_y1"]
    schema = T.StructType([*kept, T.StructField("_parts", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in doubles]])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            columns = _wkt_measures(batch.column(wkt).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], [*names, "_parts", *doubles])

    once = df.select(*names, wkt).mapInArrow(run, schema)
    added = ({largest: F.col("_largest")} if largest else {}) | {n_parts: F.col("_parts")}
    ratios = rings.shape_ratios(F.col("_area"), F.col("_length"), tuple(F.col(c) for c in doubles[3:]), exact)
    return once.withColumns(ratios | added).drop("_parts", *doubles)


def _wkt_measures(texts: list[str | None]) -> list[pa.Array]:
    """Parts, area, length, largest part and bounds of each text, as the column expressions have them."""
    part_of, ring_of, pair_of = (re.compile(p, re.ASCII).findall for p in (_PART, _RING, _PAIR))
    pairs, points, ring_part, hole, part_row = [], [], [], [], []
    for row, text in enumerate(texts):
        for part in part_of(text) if text is not None else ():
            for i, ring in enumerate(ring_of(part)):
                found = pair_of(ring)
                pairs += found
                points.append(len(found))
                ring_part.append(len(part_row))
                hole.append(i > 0)
            part_row.append(row)
    n, ring_part, part_row, points = len(texts), np.array(ring_part, np.int64), np.array(part_row, np.int64), np.array(points, np.int64)
    x, y = np.fromiter(map(float, chain.from_iterable(pairs)), np.float64, 2 * len(pairs)).reshape(-1, 2).T
    ring = np.repeat(np.arange(len(points)), points)
    first = (np.cumsum(points) - points)[ring]
    at = np.flatnonzero(ring[1:] == ring[:-1])  # a segment begins here
    u, v = x - x[first], y - y[first]
    cross = u[at] * v[at + 1] - u[at + 1] * v[at]
    length = np.hypot(x[at + 1] - x[at], y[at + 1] - y[at])

    def summed(groups, values, count):
        return np.bincount(groups, values, count).astype(np.float64)  # whole numbers if there is nothing to count

    area = np.abs(summed(ring[at], cross, len(points)) / 2)
    of_part = summed(ring_part, np.where(np.array(hole, bool), -area, area), len(part_row))
    lengths = summed(part_row, summed(ring_part, summed(ring[at], length, len(points)), len(part_row)), n)
    most = np.full(n, -np.inf)
    np.maximum.at(most, part_row, of_part)
    parts = np.bincount(part_row, minlength=n)
    null = np.array([t is None for t in texts], bool)
    of_row = part_row[ring_part[ring]]
    bare = np.bincount(of_row, minlength=n) == 0
    box = []
    for ends, values in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y)):
        out = np.full(n, np.inf if ends is np.minimum else -np.inf)
        ends.at(out, of_row, values)
        box.append(pa.array(out, mask=bare))
    return [pa.array(parts.astype(np.int32), mask=null), pa.array(summed(part_row, of_part, n), mask=null), pa.array(lengths, mask=null),
            pa.array(most, mask=parts == 0), *box]


def tidy_polygon(parts: Column) -> Column:
    """Closed rings without repeated vertices; rings that keep fewer than four points go, a part with its outer ring."""
    tidy = F.transform(parts, lambda p: F.transform(p, lambda r: rings.tidy_ring(r)))
    whole = F.filter(tidy, lambda p: F.coalesce(F.size(F.get(p, F.lit(0))) >= 4, F.lit(False)))
    return F.transform(whole, lambda p: F.filter(p, lambda r: F.size(r) >= 4))


def polygon_status(parts: Column) -> Column:
    """The first status of any ring that is neither valid nor repaired; else repaired if any is, else valid."""
    found = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda r: rings.ring_status(r))))
    bad = F.filter(found, lambda s: ~s.isin("valid", "repaired"))
    return (
        F.when(parts.isNull() | (F.size(parts) <= 0), "empty")
        .when(F.size(bad) > 0, F.get(bad, F.lit(0)))
        .when(F.array_contains(found, "repaired"), "repaired").otherwise("valid")
    )


def edge_table(df: DataFrame, key: str, parts: str) -> DataFrame:
    """(key, ax, ay, bx, by): the edges of every polygon, directed as stated above; edges without length go."""
    each = df.select(key, F.explode(parts).alias("_part")).select(key, F.posexplode("_part").alias("_i", "_ring"))
    area = rings.signed_area(F.col("_ring"))
    turned = each.select(key, ((area > 0) == (F.col("_i") == 0)).alias("_keep"), F.explode(rings.segments(rings.tidy_ring(F.col("_ring")))).alias("_s"))
    p, q = F.col("_s.p"), F.col("_s.q")
    first, last = F.when(F.col("_keep"), p).otherwise(q), F.when(F.col("_keep"), q).otherwise(p)
    return turned.select(key, first["x"].alias("ax"), first["y"].alias("ay"), last["x"].alias("bx"), last["y"].alias("by")).where("ax <> bx OR ay <> by")


def edge_cells(edges: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """One row per edge and cell it touches or nearly touches (a billionth of a cell)."""
    return segment_cells(edges, x0, y0, size, pad=size * 1e-9)


def touched_cells(edges: DataFrame, key: str, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(key, row, col) of the cells that edges touch: ``area``, ``mx``, ``my`` inside and whether the reference
    point is (``odd``); ``east`` is the polygon's height share right behind the cell."""
    left, low = F.lit(float(x0)) + F.col("col") * size, F.lit(float(y0)) + F.col("row") * size
    ax, ay, bx, by = (F.col(c) for c in EDGE)
    t_in, t_out = F.lit(0.0), F.lit(1.0)
    for a, b, start in ((ax, bx, left), (ay, by, low)):
        t0, t1 = (start - a) / (b - a), (start + size - a) / (b - a)
        apart = (a < start) | (a >= start + size)  # parallel to the side and outside
        t_in = F.greatest(t_in, F.when(b != a, F.least(t0, t1)).when(apart, 1.0).otherwise(0.0))
        t_out = F.least(t_out, F.when(b != a, F.greatest(t0, t1)).when(apart, 0.0).otherwise(1.0))
    t_out = F.greatest(t_in, t_out)
    # The piece inside the cell, from its south-west corner.
    piece = edge_cells(edges, size, x0, y0).select(
        "*", *[(o + t * d - s).alias(n) for n, o, t, d, s in (
            ("px", ax, t_in, bx - ax, left), ("py", ay, t_in, by - ay, low), ("qx", ax, t_out, bx - ax, left), ("qy", ay, t_out, by - ay, low))])
    dy, px, qx, py, qy = F.col("qy") - F.col("py"), F.col("px"), F.col("qx"), F.col("py"), F.col("qy")
    ref_y = low + REF_Y * size
    cross = F.when((ay > ref_y) != (by > ref_y), ax + (bx - ax) * (ref_y - ay) / (by - ay))
    here = F.floor((cross - x0) / size) == F.col("col")
    sums = piece.groupBy(key, "row", "col").agg(
        F.sum(dy).alias("dy"), F.sum(dy * (py + qy) / 2).alias("ydy"),
        F.sum(dy * (px + qx) / 2).alias("own"),
        F.sum(dy * (px * px + px * qx + qx * qx) / 6).alias("own_x"),
        F.sum(dy * (2 * px * py + 2 * qx * qy + px * qy + qx * py) / 6).alias("own_y"),
        F.count_if(here).alias("n_cross"), F.count_if(here & (cross > left + REF_X * size)).alias("n_right"),
    )
    east = Window.partitionBy(key, "row").orderBy(F.col("col").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def behind(c: str) -> Column:
        return F.coalesce(F.sum(c).over(east), F.lit(0))

    run = sums.select("*", *[behind(c).alias(f"e_{c}") for c in ("dy", "ydy", "n_cross")])
    return run.select(
        key, "row", "col",
        (F.col("own") + size * F.col("e_dy")).alias("area"),
        (F.col("own_x") + size * size / 2 * F.col("e_dy")).alias("mx"),
        (F.col("own_y") + size * F.col("e_ydy")).alias("my"),
        ((F.col("n_right") + F.col("e_n_cross")) % 2 == 1).alias("odd"),
        F.col("e_dy").alias("east"),
    )


def cover(edges: DataFrame, key: str, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """All lattice cells that a polygon touches or holds: (key, row, col, touched, area, centroid_x, centroid_y, odd).

    Area and centroid are those of the polygon's part in the cell, exact for any shape; a touched cell
    that holds none of it has area 0 (up to rounding) and no centroid. Overlapping parts count twice.
    """
    return _filled(touched_cells(edges, key, size, x0, y0), key, size, x0, y0)


def _filled(touched: DataFrame, key: str, size: float, x0: float, y0: float) -> DataFrame:
    """Touched cells and those held between them, with area and centroid."""
    beside = Window.partitionBy(key, "row").orderBy("col")
    runs = touched.select(key, "row", "col", F.lead("col").over(beside).alias("_next"), "east")
    inner = runs.where((F.col("_next") > F.col("col") + 1) & (F.col("east") > size / 2)).select(
        key, "row", F.explode(F.sequence(F.col("col") + 1, F.col("_next") - 1)).alias("col"))
    full = F.lit(float(size * size))
    both = touched.select(key, "row", "col", F.lit(True).alias("touched"), "area", "mx", "my", "odd").unionByName(
        inner.select(key, "row", "col", F.lit(False).alias("touched"), full.alias("area"), (full * size / 2).alias("mx"), (full * size / 2).alias("my"), F.lit(True).alias("odd")))
    some = F.col("area") > size * size * 1e-9
    return both.select(
        key, "row", "col", "touched", F.greatest("area", F.lit(0.0)).alias("area"),
        F.when(some, F.lit(float(x0)) + F.col("col") * size + F.col("mx") / F.col("area")).alias("centroid_x"),
        F.when(some, F.lit(float(y0)) + F.col("row") * size + F.col("my") / F.col("area")).alias("centroid_y"), "odd")


def _moments(dy: Column, px: Column, py: Column, qx: Column, qy: Column) -> list[Column]:
    """What a piece from p to q adds to its cell, in coordinates of the cell."""
    return [dy.alias("dy"), (dy * (py + qy) / 2).alias("ydy"), (dy * (px + qx) / 2).alias("own"),
            (dy * (px * px + px * qx + qx * qx) / 6).alias("own_x"), (dy * (2 * px * py + 2 * qx * qy + px * qy + qx * py) / 6).alias("own_y")]


def _blocks(first: Column, behind: Column) -> Column:
    """Rows ``first`` to ``behind`` (exclusive) as aligned blocks of 2^level rows, at most two of a level."""
    levels = F.sequence(F.lit(0), F.floor(F.log2((behind - first).cast("double"))).cast("int"))

    def of(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level)
        lo, hi = F.ceil(first / width), F.floor(behind / width)
        at = F.array(F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), lo), F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1), hi - 1))
        return F.transform(F.filter(at, lambda x: x.isNotNull()), lambda x: F.struct(level.alias("level"), x.cast("long").alias("at")))

    none = F.expr("CAST(array() AS array<struct<level: int, at: bigint>>)")
    return F.when(behind > first, F.flatten(F.transform(levels, of))).otherwise(none)


def _sums_by_columns(edges: DataFrame, key: str, size: float, x0: float, y0: float) -> DataFrame:
    """The sums of ``_moments`` in each touched cell, with edges cut by lattice columns only.

    Of a piece in a column only the first and the last row are taken by themselves. Over the whole rows between
    them its moments are polynomials of the row; these are added up by blocks of 2^level rows and worked out cell
    by cell afterwards. So work grows with the edges times the columns they cross and the logarithm of their rows.
    """
    left = F.lit(float(x0)) + F.col("col") * size
    ax, ay, bx, by = (F.col(c) for c in EDGE)
    cut = edges.select(key, *EDGE, F.explode(F.sequence(
        F.floor((F.least("ax", "bx") - x0) / size), F.floor((F.greatest("ax", "bx") - x0) / size))).alias("col"))
    s0, s1 = (left - ax) / (bx - ax), (left + size - ax) / (bx - ax)
    t_in = F.when(bx != ax, F.greatest(F.lit(0.0), F.least(s0, s1))).otherwise(0.0)
    t_out = F.greatest(t_in, F.when(bx != ax, F.least(F.lit(1.0), F.greatest(s0, s1))).otherwise(1.0))
    px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
    piece = cut.select(key, "col", *[(o + t * d - s).alias(n) for n, o, t, d, s in (
        ("px", ax, t_in, bx - ax, left), ("py", ay, t_in, by - ay, F.lit(float(y0))), ("qx", ax, t_out, bx - ax, left), ("qy", ay, t_out, by - ay, F.lit(float(y0))))])
    piece = piece.withColumns({"lo": F.floor(F.least(py, qy) / size), "hi": F.floor(F.greatest(py, qy) / size)})
    # The ends, cell by cell.
    ends = piece.withColumn("row", F.explode(F.array_distinct(F.array("lo", "hi"))))
    low = F.col("row") * size
    u0, u1 = (low - py) / (qy - py), (low + size - py) / (qy - py)
    v_in = F.when(qy != py, F.greatest(F.lit(0.0), F.least(u0, u1))).otherwise(0.0)
    v_out = F.greatest(v_in, F.when(qy != py, F.least(F.lit(1.0), F.greatest(u0, u1))).otherwise(1.0))
    ends = ends.select(key, "row", "col", *[(o + v * d - b).alias(n) for n, o, v, d, b in (
        ("px", px, v_in, qx - px, F.lit(0.0)), ("py", py, v_in, qy - py, low), ("qx", px, v_out, qx - px, F.lit(0.0)), ("qy", py, v_out, qy - py, low))])
    ends = ends.select(key, "row", "col", *_moments(qy - py, px, py, qx, qy))
    # The rows between: in row k of a block the piece goes from x + k h to x + (k + 1) h.
    whole = piece.where("hi > lo + 1").select(key, "col", "px", "py", "qx", "qy", F.explode(_blocks(F.col("lo") + 1, F.col("hi"))).alias("b"))
    slope = (qx - px) / (qy - py)
    base = F.col("b.at") * F.pow(F.lit(2.0), F.col("b.level")) * size
    whole = whole.select(key, "col", "b.level", "b.at", F.when(qy > py, size).otherwise(-size).alias("d"), (slope * size).alias("h"), (px + (base - py) * slope).alias("x"))
    d, h, x = F.col("d"), F.col("h"), F.col("x")
    terms = {"d0": d, "o0": d * (x + h / 2), "o1": d * h, "x0": d * (x * x + x * h + h * h / 3) / 2, "x1": d * h * (x + h / 2), "x2": d * h * h / 2,
             "y0": d * size * (x / 2 + h / 3), "y1": d * size * h / 2}
    blocks = whole.groupBy(key, "col", "level", "at").agg(*[F.sum(v).alias(n) for n, v in terms.items()])
    width = F.pow(F.lit(2.0), F.col("level")).cast("long")
    each = blocks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), width - 1)))
    k = F.col("k")
    rows = each.select(
        key, (F.col("at") * width + k).alias("row"), "col", F.col("d0").alias("dy"), (F.col("d0") * size / 2).alias("ydy"), (F.col("o0") + F.col("o1") * k).alias("own"),
        (F.col("x0") + (F.col("x1") + F.col("x2") * k) * k).alias("own_x"), (F.col("y0") + F.col("y1") * k).alias("own_y"))
    return ends.unionByName(rows).groupBy(key, "row", "col").agg(*[F.sum(c).alias(c) for c in ("dy", "ydy", "own", "own_x", "own_y")])


def shares(edges: DataFrame, key: str, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``cover`` without ``odd``, for polygons whose edges are long in cells and whose columns are few."""
    sums = _sums_by_columns(edges, key, size, x0, y0)
    east = Window.partitionBy(key, "row").orderBy(F.col("col").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.select("*", *[F.coalesce(F.sum(c).over(east), F.lit(0.0)).alias(f"e_{c}") for c in ("dy", "ydy")])
    touched = run.select(
        key, "row", "col", (F.col("own") + size * F.col("e_dy")).alias("area"), (F.col("own_x") + size * size / 2 * F.col("e_dy")).alias("mx"),
        (F.col("own_y") + size * F.col("e_ydy")).alias("my"), F.lit(None).cast("boolean").alias("odd"), F.col("e_dy").alias("east"))
    return _filled(touched, key, size, x0, y0).drop("odd")


def _holds(x: Column, y: Column, cell: Column, ref_x: Column, ref_y: Column) -> Column:
    """Even-odd test along reference point - corner - point, against the edges of one cell."""

    def crossings(e: Column) -> Column:
        up = ((e["ax"] > ref_x) != (e["bx"] > ref_x)) & (
            (e["ay"] + (e["by"] - e["ay"]) * (ref_x - e["ax"]) / (e["bx"] - e["ax"]) > y)
            != (e["ay"] + (e["by"] - e["ay"]) * (ref_x - e["ax"]) / (e["bx"] - e["ax"]) > ref_y))
        at = e["ax"] + (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"])
        along = ((e["ay"] > y) != (e["by"] > y)) & ((at > x) != (at > ref_x))
        return F.when(up, 1).otherwise(0) + F.when(along, 1).otherwise(0)

    n = F.aggregate(cell["edges"], F.lit(0), lambda acc, e: acc + crossings(e))
    return F.when(cell["edges"].isNull(), cell["odd"]).otherwise((n % 2 == 1) != cell["odd"])


def holders(points: DataFrame, edges: DataFrame, key: str, size: float, x0: float = 0.0, y0: float = 0.0, out: str = "polygons") -> DataFrame:
    """Points (x, y) with ``out``: the keys of all polygons that hold them, sorted; empty if none.

    A point is looked up by its cell: in cells that no edge touches the answer stands, in others the
    point is tested against that cell's edges only. Choose ``size`` so that few edges meet in a cell.
    Points without coordinates are in no polygon. On an edge either answer may come.
    """
    cells = cover(edges, key, size, x0, y0).select(key, "row", "col", "odd", "touched")
    lists = edge_cells(edges, size, x0, y0).groupBy(key, "row", "col").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    known = cells.where("touched").drop("touched").join(lists, [key, "row", "col"]).unionByName(
        cells.where("NOT touched").select(key, "row", "col", "odd"), allowMissingColumns=True)
    grouped = known.groupBy("row", "col").agg(F.collect_list(F.struct(F.col(key).alias("key"), "odd", "edges")).alias("_cells"))
    keyed = points.withColumns({
        "_c": F.floor((F.col("x") - x0) / size).cast("long"), "_r": F.floor((F.col("y") - y0) / size).cast("long")})
    found = lookup_join(keyed, grouped.withColumnsRenamed({"row": "_r", "col": "_c"}), ["_r", "_c"], "left", probe=False)
    ref_x, ref_y = F.lit(float(x0)) + (F.col("_c") + REF_X) * size, F.lit(float(y0)) + (F.col("_r") + REF_Y) * size
    holding = F.filter("_cells", lambda c: _holds(F.col("x"), F.col("y"), c, ref_x, ref_y))
    kind = f"array<{edges.schema[key].dataType.simpleString()}>"
    keys = F.array_sort(F.transform(holding, lambda c: c["key"]))
    return found.select(*points.columns, F.coalesce(keys, F.array().cast(kind)).alias(out))


def held(points: DataFrame, edges: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, out: str = "inside") -> DataFrame:
    """Points (x, y) with ``out``: whether they are in the polygons, by the even-odd rule over all (closed) rings.

    For points that stand in columns, as pixel centres and snapped coordinates do: an edge is cut only by the
    columns it crosses, so cost grows with the crossings and not with the edges' length in cells. A point is
    inside if an odd number of crossings lies below it: running counts along each column, block by block
    (64 ``size`` high), so that no task holds a whole column. Points without coordinates are outside. On an
    edge either answer may come.
    """
    strip = F.floor((F.col("x") - x0) / size)
    columns = points.select("x").where("x IS NOT NULL").distinct().select("x", strip.alias("_strip"))
    ax, ay, bx, by = (F.col(c) for c in EDGE)
    cut = edges.select(*EDGE).where("ax <> bx").withColumn("_strip", F.explode(F.sequence(
        F.floor((F.least("ax", "bx") - x0) / size), F.floor((F.greatest("ax", "bx") - x0) / size))))
    near = cut.join(F.broadcast(columns), "_strip") if is_small(columns, BROADCAST_ROWS) else lookup_join(cut, columns, ["_strip"], "inner", probe=False)
    crossings = near.where((ax > F.col("x")) != (bx > F.col("x"))).select("x", (ay + (by - ay) * (F.col("x") - ax) / (bx - ax)).alias("y"))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    block = F.floor((F.col("y") - y0) / (64 * size)).alias("_block")
    here, cross = points.where(placed).select("*", block), crossings.select("x", "y", block)
    # What the blocks below hold, for each block with a point or a crossing.
    each = here.select("x", "_block", F.lit(0).alias("_n")).unionByName(cross.select("x", "_block", F.lit(1).alias("_n"))).groupBy("x", "_block").agg(F.sum("_n").alias("_n"))
    below = Window.partitionBy("x").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("x", "_block", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_n"), F.lit(0).alias("_kind"))
    rows = here.withColumns({"_n": F.lit(0).cast("long"), "_kind": F.lit(2)})
    rows = rows.unionByName(cross.withColumns({"_n": F.lit(1).cast("long"), "_kind": F.lit(1)}), allowMissingColumns=True)
    rows = rows.unionByName(base, allowMissingColumns=True)
    # The base row has no y and comes first.
    order = Window.partitionBy("x", "_block").orderBy(F.col("y").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn(out, F.sum("_n").over(order) % 2 == 1).where("_kind = 2").select(*points.columns, out)
    return told.unionByName(points.where(~placed).withColumn(out, F.lit(False)))


def zone_cells(pixels: DataFrame, edges: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Pixels (x, y of their centres) with the row and column of the clipped cell that holds the centre; null outside."""
    found = held(pixels, edges, size, x0, y0, "_in")
    return found.select(
        *pixels.columns,
        F.when(F.col("_in"), F.floor((F.col("y") - y0) / size).cast("long")).alias("zone_row"),
        F.when(F.col("_in"), F.floor((F.col("x") - x0) / size).cast("long")).alias("zone_col"))
