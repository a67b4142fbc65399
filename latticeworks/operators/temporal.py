"""Change over years and epochs: indicators, ages, phases, region summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions import scalars as S
from latticeworks.functions.scalars import round_even

PIXEL_AREA_M2 = 10_000.0


def pivot_epochs(
    long: DataFrame, keys: Sequence[str], epoch: str, value: str, epochs: Sequence[int], prefix: str
) -> DataFrame:
    """Long (keys, epoch, value) -> one column per requested epoch."""
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col(epoch) == e, F.col(value))).alias(f"{prefix}{e}") for e in epochs
    ])


def available_epochs(long: DataFrame, epoch: str, wanted: Sequence[int]) -> tuple[list[int], list[int]]:
    """(present, missing) among the wanted epochs; fails when none is present."""
    wanted = list(wanted)
    found = {r[0] for r in long.where(F.col(epoch).isin(wanted)).select(epoch).distinct().collect()}
    present = [e for e in wanted if e in found]
    if not present:
        raise ValueError(f"none of the requested epochs has data: {wanted}")
    return present, [e for e in wanted if e not in found]


def change_indicators(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """Absolute change, growth rate, vertical index, peak year, growth class."""
    first, last = years[0], years[-1]
    c0, c1 = F.col(f"building_count_{first}"), F.col(f"building_count_{last}")
    h0, h1 = F.col(f"mean_height_{first}"), F.col(f"mean_height_{last}")
    counts = [F.col(f"building_count_{y}") for y in years]
    out = df.withColumns({
        "building_count_change": round_even(c1 - c0, 2),
        "height_change": round_even(h1 - h0, 2),
        "building_growth_rate": round_even(S.relative_change(c0, c1) * 100, 2),
        "vertical_growth_index": round_even(S.relative_change(h0, h1) - S.relative_change(c0, c1), 4),
        "peak_growth_year": S.peak_growth_start(years, counts),
    })
    return out.withColumn(
        "growth_class", S.growth_class("building_growth_rate", "vertical_growth_index")
    )


def _exact(column: str) -> Column:
    """Sum that no order of adding changes: eight decimals, as a double."""
    return F.sum(F.col(column).cast("decimal(28,8)")).cast("double")


def _mean(column: str) -> Column:
    return _exact(column) / F.count(column)


def temporal_summary(df: DataFrame, region: str, years: Sequence[int]) -> DataFrame:
    """Per region and year: counts and heights; change over the whole period."""
    aggs = [F.count(F.lit(1)).alias("n_cells")]
    for y in years:
        aggs += [
            round_even(_exact(f"building_count_{y}"), 0).alias(f"total_building_count_{y}"),
            round_even(_mean(f"building_count_{y}"), 2).alias(f"mean_building_count_{y}"),
            round_even(_mean(f"mean_height_{y}"), 2).alias(f"mean_height_{y}"),
        ]
    aggs += [
        round_even(_exact("building_count_change"), 0).alias("building_count_change"),
        round_even(_mean("building_growth_rate"), 2).alias("mean_growth_rate"),
        round_even(_mean("vertical_growth_index"), 4).alias("mean_vgi"),
    ]
    return df.where(F.col(region).isNotNull()).groupBy(region).agg(*aggs)


def yearly_magnitudes(df: DataFrame, years: Sequence[int], footprint_count: str) -> DataFrame:
    """Per year: cells, mean/median/p99/max height, mean and max count."""
    from latticeworks.operators import order

    long = unpivot_years(df.where(F.col(footprint_count) > 0), years, [footprint_count])
    heights = order.distribution(long, "mean_height", ["year"])
    stats = heights.groupBy("year").agg(
        F.max("n").alias("n_cells"),
        (F.max("total") / F.max("n")).alias("mean_height_mean_m"),
        order.quantile("mean_height", 0.5).alias("mean_height_median_m"),
        order.quantile("mean_height", 0.99).alias("mean_height_p99_m"),
        F.max("vmax").alias("mean_height_max_m"),
    )
    counts = long.groupBy("year").agg(
        F.avg("building_count").alias("fractional_count_mean"),
        F.max("building_count").alias("fractional_count_max"),
        F.avg(footprint_count).alias("footprints_per_cell_mean"),
    )
    return stats.join(counts, "year")


def unpivot_years(df: DataFrame, years: Sequence[int], keep: Sequence[str]) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(y).alias("year"),
            F.col(f"building_count_{y}").alias("building_count"),
            F.col(f"mean_height_{y}").alias("mean_height"),
        )
        for y in years
    ]))
    return df.select(*keep, rows.alias("_y")).select(*keep, "_y.*")


# --- built-up epochs --------------------------------------------------------------


def coverage(built: Column) -> Column:
    return S.clip(built / F.lit(PIXEL_AREA_M2), 0, 1)


def first_epoch(epochs: Sequence[int], coverages: Mapping[int, Column]) -> Column:
    """Earliest epoch whose coverage reaches the built threshold."""
    hits = [F.when(coverages[e] >= S.BUILT_THRESHOLD, F.lit(e)) for e in epochs]
    return F.least(*hits) if len(hits) > 1 else hits[0]


def built_up_by_cell(stack: DataFrame, zone: Sequence[str], epochs: Sequence[int]) -> DataFrame:
    """Built surface, coverage and age-class mix per cell from the pixel stack.

    One aggregate over the pixels: epoch sums and conditional class counts.
    Missing epochs stay out of the sums; such pixels count as not built.
    """
    aged = stack.na.drop(subset=list(zone)).withColumn(
        "_age", S.age_class(first_epoch(epochs, {e: coverage(F.col(f"built_{e}")) for e in epochs}))
    )
    aggs = []
    for e in epochs:
        built = F.col(f"built_{e}")
        aggs += [
            round_even(F.coalesce(F.sum(built), F.lit(0.0)), 1).alias(f"built_surface_m2_{e}"),
            round_even(F.avg(coverage(built)), 4).alias(f"built_coverage_{e}"),
        ]
    n = F.count(F.lit(1))
    counts = {k: F.count_if(F.col("_age") == k) for k in S.AGE_CLASSES}
    aggs += [round_even(c / n, 4).alias(f"share_{k}") for k, c in counts.items()]
    aggs.append(F.array(*counts.values()).alias("_counts"))
    out = aged.groupBy(*zone).agg(*aggs)
    # The first class in the fixed order wins a tie.
    place = F.array_position("_counts", F.array_max("_counts")).cast("int")
    labels = F.array(*[F.lit(k) for k in S.AGE_CLASSES])
    return out.withColumn("dominant_age_class", F.element_at(labels, place)).drop("_counts")


def built_up_change(df: DataFrame, epochs: Sequence[int], recent_from: int = 2010) -> DataFrame:
    def cov(e: int) -> Column:
        return F.coalesce(F.col(f"built_coverage_{e}"), F.lit(0.0))

    first, last = cov(epochs[0]), cov(epochs[-1])
    recent = round_even(last - cov(recent_from), 4) if recent_from in epochs else F.lit(None).cast("double")
    return df.withColumns({
        "long_term_growth": round_even(last - first, 4),
        "recent_growth_2010": recent,
        "long_term_growth_rate_pct": round_even(F.when(first > 0, (last - first) / first * 100), 2),
    })


def expansion_phases(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "urban_expansion_phase",
        S.expansion_phase("dominant_age_class", "share_not_built", "recent_growth_2010"),
    )


def built_up_summary(df: DataFrame, region: str, epochs: Sequence[int]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_cells")]
    for e in epochs:
        aggs += [
            round_even(_mean(f"built_coverage_{e}"), 4).alias(f"mean_built_coverage_{e}"),
            round_even(_exact(f"built_surface_m2_{e}") / 1e6, 2).alias(f"total_built_surface_km2_{e}"),
        ]
    aggs += [
        round_even(_mean("long_term_growth"), 4).alias("mean_long_term_growth"),
        round_even(_mean("recent_growth_2010"), 4).alias("mean_recent_growth"),
    ]
    return df.where(F.col(region).isNotNull()).groupBy(region).agg(*aggs)
