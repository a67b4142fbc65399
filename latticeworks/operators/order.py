"""Global and grouped order without a single-task sort.

``distribution`` is the base of every exact quantile, Gini, Lorenz, rank and
U statistic. It first collapses rows to (group, value, count) with map-side
combining, so repeated values cost nothing. It then splits each group by value
range: the cut points come from one approximate-percentile aggregate, so no
(group, range) pair holds more than about 1/ranges of all rows, whatever share
one group has. Running counts inside a range plus the totals of the ranges
below give exact positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.session import range_count

RANGE = "_range"
ID_BUCKETS = 65_536


def value_cuts(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Approximate quantiles of a column: at most ``ranges - 1`` doubles."""
    ranges = ranges or range_count(df.sparkSession)
    probs = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10 * ranges).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def with_range(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Add the value-range number, a fixed function of the value.

    The number is never null, so joins on it add no null filter and branches
    over one ranged frame keep sharing its exchange.
    """
    if not cuts:
        return df.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol=value, outputCol=RANGE, handleInvalid="keep")
        .transform(df)
        .withColumn(RANGE, F.coalesce(F.col(RANGE).cast("int"), F.lit(-1)))
    )


def distribution(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    payload: Mapping[str, Column] | None = None,
    ranges: int | None = None,
    cuts_from: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct (group, value), with exact positions.

    ``cuts_from`` may name a cheaper frame with about the same values (such as
    the input before a de-duplication); it only steers the balance of tasks,
    never the result.

    Columns: the group, ``value``, ``cnt``, any payload aggregates, ``before``
    and ``sum_before`` (rows and value total below it in the group), and the
    group's ``n``, ``total``, ``vmin``, ``vmax``. Null values and null group
    keys are left out.
    """
    by = list(by)
    kept = df.withColumn(value, F.col(value).cast("double")).na.drop(subset=[value, *by])
    cuts = value_cuts(kept if cuts_from is None else cuts_from, value, ranges)
    ranged = with_range(kept, value, cuts)
    distinct = ranged.groupBy(*by, RANGE, value).agg(
        F.count(F.lit(1)).alias("cnt"), *[c.alias(k) for k, c in (payload or {}).items()]
    )
    below = Window.partitionBy(*by, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = distinct.select(
        "*",
        F.coalesce(F.sum("cnt").over(below), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(F.col("cnt") * F.col(value)).over(below), F.lit(0.0)).alias("_sum"),
    )
    totals = distinct.groupBy(*by, RANGE).agg(
        F.sum("cnt").alias("_n"),
        F.sum(F.col("cnt") * F.col(value)).alias("_t"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    # At most ``ranges`` rows per group reach these windows.
    key = by or [F.lit(0)]
    lower = Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    offsets = totals.select(
        *by,
        RANGE,
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_t").over(lower), F.lit(0.0)).alias("_sum0"),
        F.sum("_n").over(whole).alias("n"),
        F.sum("_t").over(whole).alias("total"),
        F.min("_lo").over(whole).alias("vmin"),
        F.max("_hi").over(whole).alias("vmax"),
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per value range
    return inside.join(offsets, [*by, RANGE]).select(
        *by,
        value,
        "cnt",
        *(payload or {}),
        (F.col("_rows0") + F.col("_rows")).alias("before"),
        (F.col("_sum0") + F.col("_sum")).alias("sum_before"),
        "n",
        "total",
        "vmin",
        "vmax",
    )


# --- aggregates over a distribution -----------------------------------------------


def quantile(value: str, p: float) -> Column:
    """Linear-interpolation quantile, as an aggregate over a distribution."""
    pos = F.lit(float(p)) * (F.max("n") - 1)

    def at(rank: Column) -> Column:
        hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    here = F.lit(float(p)) * (F.col("n") - 1)
    low, high = at(F.floor(here)), at(F.ceil(here))
    return low + (high - low) * (pos - F.floor(pos))


def gini(value: str) -> Column:
    """Rank-sum Gini for groups of two or more with a positive total, in [0, 1]."""
    c, b, x = F.col("cnt"), F.col("before"), F.col(value)
    rank_sum = F.sum(x * (c * b + c * (c + 1) / 2))
    n, total = F.max("n"), F.max("total")
    raw = 2 * rank_sum / (n * total) - (n + 1) / n
    return F.when((n >= 2) & (total > 0), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def theil(value: str) -> Column:
    """Theil-T of positive values, floored at zero."""
    share = F.col(value) / (F.col("total") / F.col("n"))
    return F.greatest(F.sum(F.col("cnt") * share * F.log(share)) / F.max("n"), F.lit(0.0))


def spread(value: str, sample: bool = True) -> Column:
    """Standard deviation around the exact group mean."""
    off = F.col(value) - F.col("total") / F.col("n")
    den = F.max("n") - (1 if sample else 0)
    return F.when(den > 0, F.sqrt(F.sum(F.col("cnt") * off * off) / den))


def average_rank() -> Column:
    """Mid-rank of a distinct value (ties share their mean rank)."""
    return F.col("before") + (F.col("cnt") + 1) / 2


def log_entropy(dist: DataFrame, value: str, by: Sequence[str], bins: int, cap_at_n: bool) -> DataFrame:
    """Shannon entropy (bits) of an equal-width histogram of ln(value)."""
    by = list(by)
    k = F.least(F.lit(bins), F.col("n")) if cap_at_n else F.lit(bins)
    lo, hi = F.log("vmin"), F.log("vmax")
    place = F.floor((F.log(value) - lo) * k / (hi - lo))
    binned = dist.withColumn("_bin", F.when(hi > lo, F.least(place, k - 1)).otherwise(F.lit(0)))
    counts = binned.groupBy(*by, "_bin").agg(F.sum("cnt").alias("_c"), F.max("n").alias("n"))
    p = F.col("_c") / F.col("n")
    return counts.groupBy(*by).agg(
        F.when(F.max("n") >= 2, -F.sum(p * F.log2(p)) + F.lit(0.0)).alias("entropy")
    )


def binned_entropy(value: str, bins: int) -> Column:
    """The same entropy as one aggregate, with min(bins, n) bins per group.

    One conditional count per bin, so it shares the pass of other statistics.
    """
    k = F.least(F.lit(bins), F.col("n"))
    lo, hi = F.log("vmin"), F.log("vmax")
    place = F.floor((F.log(value) - lo) * k / (hi - lo))
    index = F.when(hi > lo, F.least(place, k - 1)).otherwise(F.lit(0))
    counts = F.array(*[
        F.coalesce(F.sum(F.when(index == b, F.col("cnt"))), F.lit(0)) for b in range(bins)
    ])
    n = F.max("n")
    total = F.aggregate(
        F.transform(counts, lambda c: F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)),
        F.lit(0.0), lambda a, t: a + t,
    )
    return F.when(n >= 2, -total + F.lit(0.0))


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles per group (one row overall without groups)."""
    dist = distribution(df, value, by)
    aggs = [quantile(value, p).alias(k) for k, p in probs.items()]
    return dist.groupBy(*by).agg(*aggs)


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact global quantiles as driver scalars, for use as thresholds."""
    row = quantiles(df, value, {f"q{i}": p for i, p in enumerate(probs)}).first()
    return [row[f"q{i}"] for i in range(len(probs))]


def lorenz(df: DataFrame, value: str, points: int) -> DataFrame:
    """Lorenz curve thinned to ``points`` equal population steps plus both ends.

    Nulls are left out; a value below zero has no place on the curve and fails the job.
    """
    below = F.raise_error(F.concat(F.lit("value below zero: "), F.col(value).cast("string")))
    checked = F.when(F.col(value) >= 0, F.col(value)).otherwise(below.cast(df.schema[value].dataType))
    dist = distribution(df.where(F.col(value).isNotNull()).withColumn(value, checked), value)
    step = F.explode(F.sequence(
        F.ceil(F.col("before") * points / F.col("n")),
        F.ceil((F.col("before") + F.col("cnt")) * points / F.col("n")),
    ))
    placed = dist.select("*", step.alias("step"))
    rows = F.col("step") * F.col("n") / F.lit(points)
    inside = (rows > F.col("before")) & (rows <= F.col("before") + F.col("cnt"))
    at_zero = (F.col("step") == 0) & (F.col("before") == 0)
    area = F.col("sum_before") + (rows - F.col("before")) * F.col(value)
    return placed.where(inside | at_zero).select(
        (F.col("step") / F.lit(points)).alias("population_share"),
        (area / F.col("total")).alias("value_share"),
    )


def ordinals(df: DataFrame, key: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """0-based rank of each row by a numeric key; ``ties`` names what orders rows of one key, if it is not unique."""
    ranged = with_range(df.withColumn("_k", F.col(key).cast("double")), "_k", value_cuts(df, key))
    return _number(ranged, RANGE, [key, *ties], out).drop("_k", RANGE)


def stable_ids(df: DataFrame, keys: Sequence[str], out: str, pattern: str) -> DataFrame:
    """Text id from a repeatable ordinal over unique row keys.

    Rows are ordered by the hash of their keys, which spreads evenly over tasks
    whatever the key distribution is. The bucket count is fixed, so ids do not
    depend on the session's settings.
    """
    hashed = df.withColumn("_h", F.xxhash64(*keys)).withColumn(RANGE, F.pmod("_h", F.lit(ID_BUCKETS)))
    return (
        _number(hashed, RANGE, ["_h", *keys], "_ord")
        .withColumn(out, F.format_string(pattern, F.col("_ord")))
        .drop("_h", "_ord", RANGE)
    )


def _number(df: DataFrame, bucket: str, order: Sequence[str], out: str) -> DataFrame:
    """Row number inside a bucket plus the sizes of the buckets before it."""
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(bucket, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    return (
        df.withColumn("_in", inside)
        .join(F.broadcast(start), bucket)  # one row per bucket
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_in", "_start")
    )
