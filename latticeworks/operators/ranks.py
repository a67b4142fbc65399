"""Rank statistics with shared ranks for ties, and plain correlation."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions.tails import correlation_p, normal_upper
from latticeworks.operators import order
from latticeworks.operators.joins import lookup_join

MIN_ROWS = 100


def rank_pairs(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Distinct (x, y) pairs with their count and average ranks rx, ry.

    Equal pairs are collapsed before the rank look-ups, which spread a value
    shared by many rows over salts.
    """
    by = by or []
    both = df.na.drop(subset=[x, y, *by]).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = both.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("c"))
    rx = order.distribution(both, "_x", by).select(*by, "_x", order.average_rank().alias("rx"))
    ry = order.distribution(both, "_y", by).select(*by, "_y", order.average_rank().alias("ry"))
    return lookup_join(
        lookup_join(pairs, rx, [*by, "_x"], "inner", probe=False), ry, [*by, "_y"], "inner", probe=False
    )


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxy, sxx, syy = F.sum(w * x * y), F.sum(w * x * x), F.sum(w * y * y)
    den = F.sqrt(sxx - sx * sx / n) * F.sqrt(syy - sy * sy / n)
    return F.when(den > 0, (sxy - sx * sy / n) / den)


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation and row count, per group or overall.

    Ranks are taken relative to the middle rank, which keeps the sums small.
    """
    pairs = rank_pairs(df, x, y, by)
    rho = weighted_corr(F.col("rx"), F.col("ry"), F.col("c"))
    return pairs.groupBy(*(by or [])).agg(F.sum("c").alias("n"), rho.alias("spearman_rho"))


def correlation_row(df: DataFrame, label: str, x: str, y: str, log1p: bool = False) -> DataFrame:
    """n, Pearson (raw or log1p) and Spearman with two-sided p-values."""
    spark = df.sparkSession
    both = df.na.drop(subset=[x, y])
    a, b = (F.log1p(x), F.log1p(y)) if log1p else (F.col(x), F.col(y))
    row = both.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r")).first()
    schema = "comparison string, n long, pearson_r double, pearson_p double, spearman_rho double, spearman_p double"
    if row["n"] < MIN_ROWS:
        return spark.createDataFrame([], schema)
    rho = spearman(both, x, y).first()["spearman_rho"]
    n, r = row["n"], row["r"]
    return spark.createDataFrame([(label, n, r, correlation_p(r, n), rho, correlation_p(rho, n))], schema)


def mann_whitney(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """U of the first group and the one-sided (greater) tie-corrected normal p.

    Null U, z and p if a group is empty; null z and p if all values tie.
    """
    dist = order.distribution(df, value, payload={"n1": F.count_if(in_first)})
    t = F.col("cnt").cast("double")
    row = dist.agg(
        F.max("n").alias("n"),
        F.sum("n1").alias("n1"),
        F.sum(F.col("n1") * order.average_rank()).alias("r1"),
        F.sum(t * t * t - t).alias("ties"),
    ).first()
    n, n1 = row["n"], row["n1"]
    n2 = (n or 0) - (n1 or 0)
    schema = "n_first long, n_second long, u double, z double, p_greater double"
    if not n or not n1 or not n2:
        return df.sparkSession.createDataFrame([(n1 or 0, n2 or 0, None, None, None)], schema)
    u = row["r1"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - row["ties"] / (n * (n - 1)))
    z = (u - n1 * n2 / 2 - 0.5) / sqrt(var) if var > 0 else None
    return df.sparkSession.createDataFrame(
        [(n1, n2, float(u), None if z is None else float(z), None if z is None else normal_upper(z))], schema
    )
