"""Per-group building statistics: sizes, inequality, class mix, height, mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions.scalars import SIZE_CLASSES, clip, ratio, round_even
from latticeworks.operators import order
from latticeworks.operators.joins import lookup_join


def size_distribution(
    df: DataFrame, by: Sequence[str], area: str = "area_m2", cuts_from: DataFrame | None = None
) -> DataFrame:
    """Positive areas as a counted, positioned distribution per group."""
    return order.distribution(df.where(F.col(area) > 0), area, by, cuts_from=cuts_from)


def basic_statistics(area: str = "area_m2") -> dict[str, Column]:
    """Aggregates over a size distribution."""
    p10, p90 = order.quantile(area, 0.10), order.quantile(area, 0.90)
    mean = F.max("total") / F.max("n")
    return {
        "building_count": F.max("n"),
        "total_footprint_area": F.max("total"),
        "mean_building_area": mean,
        "median_building_area": order.quantile(area, 0.5),
        "building_area_std": order.spread(area),
        "building_area_min": F.max("vmin"),
        "building_area_max": F.max("vmax"),
        "p10_area_m2": p10,
        "p90_area_m2": p90,
        "coefficient_of_variation": ratio(order.spread(area), mean),
        "p90_p10_ratio": ratio(p90, p10),
    }


def inequality(area: str = "area_m2") -> dict[str, Column]:
    return {
        "building_area_gini": order.gini(area),
        "building_area_theil": order.theil(area),
    }


def statistics(dist: DataFrame, by: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    return dist.groupBy(*by).agg(*[c.alias(k) for k, c in columns.items()])


def class_shares(
    df: DataFrame, by: Sequence[str], label: str = "size_class", classes: Sequence[str] = SIZE_CLASSES
) -> DataFrame:
    """Share of each named class among the rows in any named class."""
    known = F.count_if(F.col(label).isin(list(classes)))
    shares = [
        ratio(F.count_if(F.col(label) == c).cast("double"), known.cast("double")).alias(f"share_{c}")
        for c in classes
    ]
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(*shares)


def class_shares_of(area: str = "area_m2", limits: Mapping[str, tuple] | None = None) -> dict[str, Column]:
    """The same shares as aggregates over a size distribution."""
    from latticeworks.functions.scalars import PROVISIONAL_LIMITS, size_class

    label, cnt = size_class(area, limits or PROVISIONAL_LIMITS), F.col("cnt").cast("double")
    known = F.sum(F.when(label != "unknown", cnt))
    return {
        f"share_{c}": ratio(F.coalesce(F.sum(F.when(label == c, cnt)), F.lit(0.0)), known)
        for c in SIZE_CLASSES
    }


def height_volume(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and median of positive heights, total of positive volumes."""
    heights = order.distribution(df.where(F.col("height_m") > 0), "height_m", by)
    tall = heights.groupBy(*by).agg(
        (F.max("total") / F.max("n")).alias("mean_height"),
        order.quantile("height_m", 0.5).alias("median_height"),
    )
    volumes = (
        df.where(F.col("volume_m3") > 0).groupBy(*by).agg(F.sum("volume_m3").alias("total_estimated_volume"))
    )
    return tall.join(volumes, list(by), "full")


def modal_value(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per group, the smallest label on a tie."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(
        F.min(F.struct((-F.col("_c")).alias("c"), F.col(label).alias("v"))).getField("v").alias(label)
    )


def built_coverage(df: DataFrame, footprint: str, cell_area: str) -> DataFrame:
    """Footprint area over cell area in [0, 1]; null without a cell area."""
    covered = F.coalesce(F.col(footprint), F.lit(0.0)) / F.col(cell_area)
    return df.withColumn(
        "built_coverage_ratio", F.when(F.col(cell_area) > 0, clip(covered, 0, 1))
    )


def threshold_counts(
    df: DataFrame, area: str, schemes: Mapping[str, Mapping[str, tuple]]
) -> DataFrame:
    """Buildings per class for several sets of limits, in one pass."""
    from latticeworks.functions.scalars import size_class

    labelled = F.explode(F.array(*[
        F.struct(F.lit(k).alias("scheme"), size_class(area, v).alias("size_class"))
        for k, v in schemes.items()
    ]))
    return (
        df.where(F.col(area) > 0)
        .select(labelled.alias("_s"))
        .groupBy("_s.scheme", "_s.size_class")
        .agg(F.count(F.lit(1)).alias("n_buildings"))
    )


def log10_histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram of log10(value) between the group's extremes."""
    logged = df.where(F.col(value) > 0).withColumn("_v", F.log10(value))
    if by:
        limits = logged.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        placed = lookup_join(logged, limits, by, "inner")
    else:
        row = logged.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
        placed = logged.withColumn("lo", F.lit(row["lo"])).withColumn("hi", F.lit(row["hi"]))
    inside = F.floor((F.col("_v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    binned = placed.withColumn(
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(inside, F.lit(bins - 1))).otherwise(0).cast("int")
    )
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def national_summary(df: DataFrame, limits: Mapping[str, tuple], area: str = "area_m2") -> DataFrame:
    """One row: size, quantiles, inequality, entropy and class counts."""
    from latticeworks.functions.scalars import size_class

    dist = order.distribution(df.where(F.col(area) > 0), area)
    q = {p: order.quantile(area, p / 100) for p in (10, 25, 50, 75, 90, 95, 99)}
    mean = F.max("total") / F.max("n")
    label = size_class(area, limits)
    main = dist.agg(
        F.max("n").alias("n_with_area"),
        round_even(mean, 2).alias("mean_area_m2"),
        round_even(q[50], 2).alias("median_area_m2"),
        *[round_even(q[p], 2).alias(f"p{p}_area_m2") for p in (10, 25, 75, 90, 95, 99)],
        round_even(F.max("vmax"), 2).alias("max_area_m2"),
        round_even(order.gini(area), 4).alias("gini"),
        round_even(order.theil(area), 4).alias("theil_t"),
        round_even(order.spread(area, sample=False) / mean, 4).alias("cv"),
        round_even(ratio(q[90], q[10]), 2).alias("p90_p10_ratio"),
        *[
            F.coalesce(F.sum(F.when(label == k, F.col("cnt"))), F.lit(0)).alias(f"n_{k}")
            for k in SIZE_CLASSES
        ],
    )
    entropy = order.log_entropy(dist, area, [], 30, cap_at_n=False).select(
        round_even("entropy", 4).alias("entropy")
    )
    total = df.agg(F.count(F.lit(1)).alias("n_buildings"))
    one = [t.withColumn("_one", F.lit(1)) for t in (total, main, entropy)]  # one row each
    return reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")


def city_summary(df: DataFrame, region: str, area: str = "area_m2", minimum: int = 10) -> DataFrame:
    """Size statistics and class shares per region with enough buildings."""
    dist = order.distribution(df.where(F.col(area) > 0), area, [region])
    mean = F.max("total") / F.max("n")
    sizes = dist.groupBy(region).agg(
        F.max("n").alias("_positive"),
        round_even(mean, 2).alias("mean_area_m2"),
        round_even(order.quantile(area, 0.5), 2).alias("median_area_m2"),
        round_even(order.quantile(area, 0.75), 2).alias("p75_area_m2"),
        round_even(order.quantile(area, 0.9), 2).alias("p90_area_m2"),
        round_even(order.gini(area), 4).alias("gini"),
        round_even(order.spread(area, sample=False) / mean, 4).alias("cv"),
    ).where(F.col("_positive") >= minimum)
    labelled = F.count("size_class").cast("double")
    mix = df.where(F.col(region).isNotNull()).groupBy(region).agg(
        F.count(F.lit(1)).alias("n_buildings"),
        *[
            round_even(
                F.coalesce(ratio(F.count_if(F.col("size_class") == k).cast("double"), labelled), F.lit(0.0)), 4
            ).alias(f"share_{k}")
            for k in SIZE_CLASSES
        ],
    )
    return sizes.drop("_positive").join(mix, region)


def five_numbers(df: DataFrame, region: str, area: str = "area_m2", minimum: int = 5000) -> DataFrame:
    """Box-plot numbers per region with at least ``minimum`` rows, by falling median."""
    dist = order.distribution(df, area, [region])
    names = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return (
        dist.groupBy(region)
        .agg(F.max("n").alias("n"), *[order.quantile(area, p).alias(k) for k, p in names.items()])
        .where(F.col("n") >= minimum)
        .orderBy(F.col("median").desc(), region)
    )
