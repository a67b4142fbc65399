"""Row-level derivations: rounding, ratios, classes and change indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class limits in square metres, half-open [lo, hi).
SIZE_CLASSES = ["very_small", "small", "medium", "large", "very_large"]
PROVISIONAL_LIMITS = {
    "very_small": (0, 20),
    "small": (20, 60),
    "medium": (60, 200),
    "large": (200, 1000),
    "very_large": (1000, None),
}
FUNCTIONAL_LIMITS = {
    "very_small": (0, 25),
    "small": (25, 65),
    "medium": (65, 200),
    "large": (200, 1000),
    "very_large": (1000, None),
}

# Road tags counted as major, region tiers, age classes in order.
MAJOR_ROADS = [
    "motorway", "trunk", "primary", "secondary",
    "motorway_link", "trunk_link", "primary_link", "secondary_link",
]
METRO_CORES = ["Accra-Tema", "Kumasi"]
CORRIDORS = ["Accra-Kasoa", "Accra-Prampram", "Accra-Dodowa", "Kumasi-Ejisu", "Tamale-Savelugu"]
AGE_CLASSES = ["pre_1975", "1975_1990", "1990_2000", "2000_2010", "2010_2020", "not_built"]
BUILT_THRESHOLD = 0.01
EPSILON = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column | str, digits: int) -> Column:
    """Scale, round half to even, unscale; negative zero becomes zero."""
    scale = F.lit(float(10**digits))
    return F.rint(col(c) * scale) / scale + F.lit(0.0)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value, keeping nulls (``greatest``/``least`` alone skip them)."""
    bounded = c
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(float(lo)))
    if hi is not None:
        bounded = F.least(bounded, F.lit(float(hi)))
    return F.when(c.isNotNull(), bounded)


def ratio(num: Column, den: Column, at_zero: float | None = None) -> Column:
    """num/den for a positive denominator, else ``at_zero`` (null when den is null)."""
    return F.when(den > 0, num / den).when(den <= 0, F.lit(at_zero).cast("double"))


def clean_pixel(c: Column | str, nodata: float | None = None, allow_negative: bool = False) -> Column:
    """Nodata, NaN and (by default) negatives become null; zero stays zero."""
    c = col(c)
    ok = ~F.isnan(c)
    if nodata is not None:
        ok &= c != F.lit(nodata)
    if not allow_negative:
        ok &= c >= 0
    return F.when(ok, c)


def lenient_double(c: Column | str) -> Column:
    return col(c).try_cast("double")


def size_class(area: Column | str, limits: Mapping[str, tuple] = PROVISIONAL_LIMITS) -> Column:
    """First class whose [lo, hi) holds the area, ``unknown`` otherwise."""
    area = col(area)
    out = None
    for label, (lo, hi) in limits.items():
        inside = area >= lo
        if hi is not None:
            inside &= area < hi
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise("unknown")


def limits_from_edges(edges: Sequence[float]) -> dict[str, tuple]:
    """Four quantile edges -> five half-open classes."""
    bounds = [0.0, *edges, None]
    return {label: (bounds[i], bounds[i + 1]) for i, label in enumerate(SIZE_CLASSES)}


def volume(area: Column | str, height: Column | str, known: Column | None = None) -> Column:
    area, height = col(area), col(height)
    estimate = F.when(height > 0, round_even(area * height, 1))
    return estimate if known is None else F.coalesce(known, estimate)


def flag_tiny(area: Column | str) -> Column:
    return F.coalesce(col(area) < 5.0, F.lit(False))


def flag_large(area: Column | str) -> Column:
    return F.coalesce(col(area) >= 50_000.0, F.lit(False))


def is_major_road(tag: Column | str) -> Column:
    return F.coalesce(col(tag).rlike("|".join(MAJOR_ROADS)), F.lit(False))


def region_tier(name: Column | str, metro: str, corridor: str, secondary: str) -> Column:
    name = col(name)
    return (
        F.when(name.isin(METRO_CORES), metro)
        .when(name.isin(CORRIDORS), corridor)
        .when(name.isNotNull(), secondary)
    )


def implied_storeys(height: Column | str) -> Column:
    return round_even(col(height) / 3.0, 1)


def built_fraction(gross: Column | str, net: Column | str) -> Column:
    """Pixel identity gross = net x fraction, solved for the fraction."""
    gross, net = col(gross), col(net)
    return F.when(net > 0, gross / net).when(net <= 0, F.lit(0.0))


def above(c: Column | str, threshold: float) -> Column:
    """Strict threshold flag; missing counts as below."""
    return F.coalesce(col(c), F.lit(-1.0)) > F.lit(threshold)


def first_box(x: Column, y: Column, boxes: Sequence[tuple]) -> Column:
    """Name of the first box (name, x0, y0, x1, y1) that holds the point."""
    out = None
    for name, x0, y0, x1, y1 in boxes:
        inside = x.between(x0, x1) & y.between(y0, y1)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out if out is not None else F.lit(None).cast("string")


def centre_distances(x: Column, y: Column, centres: Sequence[tuple]) -> dict[str, Column]:
    return {name: F.hypot(x - F.lit(cx), y - F.lit(cy)) for name, cx, cy in centres}


def nearest_centre(distances: Mapping[str, Column]) -> tuple[Column, Column]:
    """(shortest distance, its name); the first named centre wins a tie."""
    best = F.least(*distances.values())
    name = reduce(
        lambda acc, kv: acc.when(kv[1] == best, kv[0]),
        list(distances.items())[1:],
        F.when(next(iter(distances.values())) == best, next(iter(distances))),
    )
    return best, name


# --- change indicators over years -------------------------------------------------


def relative_change(first: Column, last: Column) -> Column:
    return (last - first) / (first + F.lit(EPSILON))


def peak_growth_start(years: Sequence[int], counts: Sequence[Column]) -> Column:
    """Start year of the interval with the largest increase, null without growth."""
    steps = [b - a for a, b in zip(counts, counts[1:])]
    best = F.greatest(*steps) if len(steps) > 1 else steps[0]
    pick = F.when(F.lit(False), F.lit(0))
    for year, step in zip(years, steps):
        pick = pick.when(step == best, F.lit(int(year)))
    return F.when(best > 0, pick)


def growth_class(growth_pct: Column | str, vertical: Column | str) -> Column:
    g, v = col(growth_pct), col(vertical)
    return (
        F.when((g > 50) & (v < -0.1), "rapid_horizontal_expansion")
        .when((g > 50) & (v > 0.1), "rapid_vertical_intensification")
        .when(g > 50, "rapid_growth_mixed")
        .when(g > 10, "moderate_growth")
        .when((g <= 10) & (v > 0.1), "vertical_intensification")
        .otherwise("stable_or_no_data")
    )


def age_class(first_epoch: Column | str) -> Column:
    """Window in which the first built epoch falls; null means never built."""
    e = col(first_epoch)
    return (
        F.when(e <= 1975, AGE_CLASSES[0])
        .when(e <= 1990, AGE_CLASSES[1])
        .when(e <= 2000, AGE_CLASSES[2])
        .when(e <= 2010, AGE_CLASSES[3])
        .when(e <= 2020, AGE_CLASSES[4])
        .otherwise(AGE_CLASSES[5])
    )


def expansion_phase(dominant: Column | str, share_not_built: Column | str, recent: Column | str) -> Column:
    """Development phase; the strongest rule is tested first."""
    dom = F.coalesce(col(dominant), F.lit("not_built"))
    empty = F.coalesce(col(share_not_built), F.lit(0.0))
    grown = F.coalesce(col(recent), F.lit(0.0))
    return (
        F.when(empty > 0.9, "undeveloped")
        .when((empty > 0.5) & (grown > 0.01), "emerging_frontier")
        .when(dom == "2010_2020", "active_expansion")
        .when(dom.isin("pre_1975", "1975_1990"), "established_urban")
        .when(dom.isin("1990_2000", "2000_2010"), "consolidating_urban")
        .when(empty < 0.9, "sparsely_built")
        .otherwise("undeveloped")
    )


def steps_reached(value: Column | str, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value (a value on an edge goes up)."""
    value = col(value)
    return reduce(lambda a, b: a + b, [(value >= F.lit(e)).cast("int") for e in edges])
