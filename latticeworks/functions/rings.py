"""Polygon rings as ``array<struct<x,y>>`` columns: measures, tests, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it on.

    Array expressions are not shared between uses inside a lambda, so every
    measure binds its ring before it walks it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """Closed ring of an axis-aligned rectangle from its south-west corner."""
    x1, y1 = x0 + width, y0 + height
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def wkt_rings(wkt: Column) -> Column:
    """Outer rings of a WKT POLYGON or MULTIPOLYGON."""
    number = r"-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"
    pair = rf"({number})\s+({number})"
    # An outer ring opens with "((" (polygon) or follows ")), ((" (multipolygon).
    parts = F.regexp_extract_all(wkt, F.lit(r"\(\(([^()]*)\)"), F.lit(1))
    return F.transform(
        parts,
        lambda part: F.zip_with(
            F.regexp_extract_all(part, F.lit(pair), F.lit(1)),
            F.regexp_extract_all(part, F.lit(pair), F.lit(2)),
            lambda x, y: point(x, y),
        ),
    )


def largest_ring(rings: Column) -> Column:
    """Part with the largest area (the first of equals)."""
    return F.aggregate(
        F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))),
        F.get(rings, F.lit(0)),
        lambda best, r: F.when(ring_area(r) > ring_area(best), r).otherwise(best),
    )


def segments(ring: Column) -> Column:
    """Consecutive vertex pairs as ``array<struct<p,q>>``."""

    def pairs(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(0))
        return F.zip_with(
            F.slice(r, 1, n), F.slice(r, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q"))
        )

    return let(ring, pairs)


def _total(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + term(s))


def signed_area(ring: Column) -> Column:
    # Coordinates relative to the first vertex keep the sum well conditioned.

    def shoelace(r: Column) -> Column:
        o = F.get(r, F.lit(0))
        return _total(
            segments(r), lambda s: (s.p.x - o.x) * (s.q.y - o.y) - (s.q.x - o.x) * (s.p.y - o.y)
        )

    return let(ring, shoelace) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return _total(segments(ring), lambda s: F.hypot(s.q.x - s.p.x, s.q.y - s.p.y))


def ring_area_and_perimeter(ring: Column) -> Column:
    """``ring_area`` and ``ring_perimeter`` as a struct, from one list of segments."""

    def both(b: Column) -> Column:
        o, s = b["o"], b["s"]
        area = F.abs(_total(s, lambda e: (e.p.x - o.x) * (e.q.y - o.y) - (e.q.x - o.x) * (e.p.y - o.y)) / 2)
        return F.struct(area.alias("area"), _total(s, lambda e: F.hypot(e.q.x - e.p.x, e.q.y - e.p.y)).alias("length"))

    return let(F.struct(F.get(ring, F.lit(0)).alias("o"), segments(ring).alias("s")), both)


def ring_box(ring: Column) -> Column:
    """``ring_bounds`` as a struct, with each axis gone through once."""
    axes = F.struct(F.transform(ring, lambda p: p.x).alias("x"), F.transform(ring, lambda p: p.y).alias("y"))
    return let(axes, lambda a: F.struct(
        F.array_min(a["x"]).alias("x0"), F.array_min(a["y"]).alias("y0"), F.array_max(a["x"]).alias("x1"), F.array_max(a["y"]).alias("y1")))


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a simple ring; null without area."""

    def along(axis: str):
        def centre(r: Column) -> Column:
            o, a = F.get(r, F.lit(0)), signed_area(r)
            moment = _total(
                segments(r),
                lambda s: (s.p[axis] + s.q[axis] - 2 * o[axis])
                * ((s.p.x - o.x) * (s.q.y - o.y) - (s.q.x - o.x) * (s.p.y - o.y)),
            )
            return F.when(a != 0, o[axis] + moment / (6 * a))

        return centre

    return let(ring, along("x")), let(ring, along("y"))


def shape_metrics(ring: Column) -> dict[str, Column]:
    """Area, perimeter and the shape ratios; zero divisors give null."""
    area, perimeter = ring_area(ring), ring_perimeter(ring)
    return shape_ratios(area, perimeter, ring_bounds(ring))


def shape_ratios(area: Column, perimeter: Column, bounds: tuple, exact: bool = False) -> dict[str, Column]:
    """The measures by name, rounded as published unless ``exact``."""
    from latticeworks.functions import scalars

    def round_even(value: Column, digits: int) -> Column:
        return value if exact else scalars.round_even(value, digits)

    xmin, ymin, xmax, ymax = bounds
    long_side = F.greatest(xmax - xmin, ymax - ymin)
    short_side = F.least(xmax - xmin, ymax - ymin)
    some_area, some_edge = F.when(area > 0, area), F.when(perimeter > 0, perimeter)
    pi = F.pi()
    return {
        "area_m2": round_even(area, 2),
        "perimeter_m": round_even(perimeter, 2),
        "compactness": round_even(4 * pi * some_area / (some_edge * some_edge), 4),
        "shape_index": round_even(some_edge / (2 * F.sqrt(pi * some_area)), 4),
        "elongation": round_even(F.when(short_side > 0, long_side / short_side), 4),
        "log_area_m2": round_even(F.log1p(area), 4),
    }


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray test on a closed ring."""
    crossings = F.aggregate(
        segments(ring),
        F.lit(0),
        lambda acc, s: acc
        + F.when(
            ((s.p.y > y) != (s.q.y > y))
            & (x < (s.q.x - s.p.x) * (y - s.p.y) / (s.q.y - s.p.y) + s.p.x),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """True on a vertex or an edge of a closed ring."""
    return F.exists(
        segments(ring),
        lambda s: ((s.q.x - s.p.x) * (y - s.p.y) == (s.q.y - s.p.y) * (x - s.p.x))
        & x.between(F.least(s.p.x, s.q.x), F.greatest(s.p.x, s.q.x))
        & y.between(F.least(s.p.y, s.q.y), F.greatest(s.p.y, s.q.y)),
    )


def strictly_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """``point_in_ring`` without the points of the ring itself."""
    return point_in_ring(x, y, ring) & ~on_ring(x, y, ring)


def tidy_ring(ring: Column) -> Column:
    """Drop repeated neighbouring vertices and close the ring."""

    def slim(r: Column) -> Column:
        kept = F.filter(
            F.sequence(F.lit(0), F.size(r) - 1),
            lambda i: (i == 0) | (F.get(r, i) != F.get(r, F.greatest(i - 1, F.lit(0)))),
        )
        return F.transform(kept, lambda i: F.get(r, i))

    def close(r: Column) -> Column:
        closed = F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)
        return F.when(closed, r).otherwise(F.concat(r, F.slice(r, 1, 1)))

    return F.when(F.size(ring) > 0, let(let(ring, slim), close))


def self_crosses(ring: Column) -> Column:
    """True when two non-neighbouring edges properly cross."""

    def side(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))

    def any_pair(segs: Column) -> Column:
        return F.exists(
            segs,
            lambda s: F.exists(
                segs,
                lambda t: (side(s.p, s.q, t.p) * side(s.p, s.q, t.q) < 0)
                & (side(t.p, t.q, s.p) * side(t.p, t.q, s.q) < 0),
            ),
        )

    return let(segments(ring), any_pair)


def ring_status(ring: Column) -> Column:
    """valid / repaired are kept; every other status goes to quarantine."""
    finite = F.forall(ring, lambda p: (F.abs(p.x) < F.lit(1e300)) & (F.abs(p.y) < F.lit(1e300)))

    def judge(both: Column) -> Column:
        raw, tidy = both["raw"], both["tidy"]
        return (
            F.when(F.size(tidy) < 4, "too_few_points")
            .when(self_crosses(tidy), "self_crossing")
            .when(ring_area(tidy) <= 0, "zero_area")
            .when(tidy == raw, "valid")
            .otherwise("repaired")
        )

    return (
        F.when(ring.isNull() | (F.size(ring) <= 0), "empty")
        .when(~F.coalesce(finite, F.lit(False)), "not_finite")
        .otherwise(let(F.struct(ring.alias("raw"), tidy_ring(ring).alias("tidy")), judge))
    )


def _clip_side(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """Keep the part of a closed ring on one side of an axis-parallel line."""

    def inside(p: Column) -> Column:
        return p[axis] >= limit if keep_above else p[axis] <= limit

    def crossing(s: Column) -> Column:
        t = (limit - s.p[axis]) / (s.q[axis] - s.p[axis])
        return point(s.p.x + t * (s.q.x - s.p.x), s.p.y + t * (s.q.y - s.p.y))

    def emit(s: Column) -> Column:
        return (
            F.when(inside(s.p) & inside(s.q), F.array(s.q))
            .when(inside(s.p), F.array(crossing(s)))
            .when(inside(s.q), F.array(crossing(s), s.q))
            .otherwise(F.array().cast(RING_TYPE))
        )

    def close(out: Column) -> Column:
        return F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(out)

    return let(F.flatten(F.transform(segments(ring), emit)), close)


def clip_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Part of a ring inside an axis-aligned box."""
    left = _clip_side(ring, "x", x0, True)
    right = _clip_side(left, "x", x1, False)
    bottom = _clip_side(right, "y", y0, True)
    return _clip_side(bottom, "y", y1, False)
