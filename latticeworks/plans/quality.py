"""Quality funnel and one-pass data expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions.scalars import flag_large, flag_tiny, round_even
from latticeworks.operators import joins, order


def footprint_funnel(
    raw: DataFrame,
    rules: Sequence[tuple[str, Column]],
    duplicate_key: Sequence[str],
    order_by: Sequence[str],
) -> DataFrame:
    """Rows removed per rule (each counted once, at its first failed rule).

    Duplicates are judged among the rows that pass every rule.
    """
    failed = F.lit(None).cast("string")
    for name, bad in reversed(list(rules)):
        failed = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(failed)
    judged = raw.withColumn("_failed", failed)
    removed = judged.agg(
        F.count(F.lit(1)).alias("n_raw"),
        *[F.count_if(F.col("_failed") == name).alias(f"n_{name}") for name, _ in rules],
        F.count_if(F.col("_failed").isNull()).alias("_passed"),
    )
    final = joins.keep_first(judged.where(F.col("_failed").isNull()), duplicate_key, order_by)
    kept = final.agg(
        F.count(F.lit(1)).alias("n_final"),
        F.count_if(flag_tiny("area_m2")).alias("n_tiny"),
        F.count_if(flag_large("area_m2")).alias("n_large"),
    )
    dist = order.distribution(final, "area_m2")
    area = dist.agg(
        (F.max("total") / F.max("n")).alias("area_mean"),
        order.quantile("area_m2", 0.25).alias("area_p25"),
        order.quantile("area_m2", 0.5).alias("area_p50"),
        order.quantile("area_m2", 0.75).alias("area_p75"),
        F.max("vmax").alias("area_max"),
    )
    one = [t.withColumn("_one", F.lit(1)) for t in (removed, kept, area)]  # one row each
    joined = one[0].join(one[1], "_one").join(one[2], "_one")
    return joined.select(
        "n_raw",
        *[f"n_{name}" for name, _ in rules],
        (F.col("_passed") - F.col("n_final")).alias("n_duplicate"),
        "n_final",
        "n_tiny",
        "n_large",
        round_even(100.0 * F.col("n_final") / F.col("n_raw"), 2).alias("pct_retained"),
        "area_mean", "area_p25", "area_p50", "area_p75", "area_max",
    )


def expectations(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Evaluate named (measured value, passes) aggregate pairs in one scan.

    Returns one row per check: ``check``, ``observed``, ``passed``.
    """
    one = df.agg(*[
        F.struct(
            F.lit(name).alias("check"),
            value.cast("double").alias("observed"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
        ).alias(f"c{i}")
        for i, (name, (value, ok)) in enumerate(checks.items())
    ])
    return one.select(F.explode(F.array(*one.columns)).alias("c")).select("c.*")


def pixel_expectations(df: DataFrame, gross: str, net: str) -> DataFrame:
    """Nulls, negatives, zero co-location, identity, fraction range, magnitudes."""
    g, n = F.col(gross), F.col(net)
    fraction = F.when(n > 0, g / n)

    def none(bad: Column) -> tuple[Column, Column]:
        count = F.count_if(bad)
        return count, count == 0

    over = F.count_if(g > n)
    worst = F.coalesce(F.max(F.when(g > n, g - n)), F.lit(0.0))
    return expectations(df, {
        "gross_null": none(g.isNull() | F.isnan(g)),
        "net_null": none(n.isNull() | F.isnan(n)),
        "gross_negative": none(g < 0),
        "net_negative": none(n < 0),
        "zero_mismatch": none((g == 0) != (n == 0)),
        "gross_above_net_count": (over, over <= 1),
        "gross_above_net_worst": (worst, worst <= 0.06),
        "fraction_max": (F.max(fraction), F.max(fraction) <= 1.001),
        "fraction_min": (F.min(fraction), F.min(fraction) >= 0),
        "gross_max": (F.max(g), F.max(g) < 200),
        "net_max": (F.max(n), F.max(n) < 400),
        "net_mean_built": (F.avg(F.when(n > 0, n)), F.avg(F.when(n > 0, n)).between(0.5, 20)),
    })


def cell_expectations(df: DataFrame, expected_cells: int) -> DataFrame:
    """Row coverage, nodata handling, identity, fraction range, implied height."""
    pixels = F.col("n_source_pixels")
    gross, frac, net = (
        F.col("cell_agbh_mean_m"), F.col("cell_built_fraction_mean"), F.col("cell_anbh_derived_m")
    )
    any_null = gross.isNull() | frac.isNull() | net.isNull()
    wrong_null = F.count_if(((pixels == 0) & net.isNotNull()) | ((pixels > 0) & any_null))
    broken = F.count_if(gross > net + 1e-6)
    rows = F.count(F.lit(1))
    return expectations(df, {
        "cell_rows": (rows, rows == expected_cells),
        "nodata_is_null": (wrong_null, wrong_null == 0),
        "cell_identity": (broken, broken == 0),
        "cell_fraction_min": (F.min(frac), F.min(frac) >= 0),
        "cell_fraction_max": (F.max(frac), F.max(frac) <= 1.001),
        "implied_height_max": (F.max(net), F.max(net) < 60),
    })


def size_expectations(sizes: Mapping[str, tuple[int, int]], spark) -> DataFrame:
    """Cross-table sizes: name -> (observed rows, expected rows)."""
    rows = [(k, float(a), a == b) for k, (a, b) in sizes.items()]
    return spark.createDataFrame(rows, "check string, observed double, passed boolean")
