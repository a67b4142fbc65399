"""Tables of counts, shares and quantiles: profiles, cross-tabs, bands, modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.operators import order


def in_groups(df: DataFrame, groups: Mapping[str, Column], out: str) -> DataFrame:
    """Repeat each row for every named (possibly overlapping) group it is in."""
    tags = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in groups.items()])
    return df.withColumn(out, F.explode(F.array_compact(tags)))


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(variable, value) rows for numeric columns."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns
    ]))
    return df.select(*keep, rows.alias("_u")).select(*keep, "_u.variable", "_u.value")


def describe(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Per column (and group): rows, missing, mean, sd, min, quantiles, max."""
    by = list(by)
    long = unpivot(df, columns, by)
    keys = [*by, "variable"]
    dist = order.distribution(long, "value", keys)
    stats = dist.groupBy(*keys).agg(
        F.max("n").alias("n"),
        (F.max("total") / F.max("n")).alias("mean"),
        order.spread("value").alias("sd"),
        F.max("vmin").alias("min"),
        *[order.quantile("value", p).alias(k) for k, p in probs.items()],
        F.max("vmax").alias("max"),
    )
    rows = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    out = rows.join(stats, keys, "left")
    n = F.coalesce("n", F.lit(0))
    return out.withColumn("n", n).withColumn("n_missing", F.col("_rows") - n).drop("_rows")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Valid count and percentage per column, from one aggregate."""
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n_valid"),
            (100.0 * F.count(c) / F.count(F.lit(1))).alias("pct_valid"),
        )
        for c in columns
    ])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def column_manifest(
    df: DataFrame, descriptions: Mapping[str, str], sources: Mapping[str, str]
) -> DataFrame:
    """Data dictionary: type, valid and missing counts, description, source.

    ``sources`` maps a column-name prefix to a source label; the longest
    matching prefix wins.
    """

    def source(c: str) -> str:
        hits = [p for p in sources if c.startswith(p)]
        return sources[max(hits, key=len)] if hits else "derived"

    cells = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.col(f"`{f.name}`")).alias("n_valid"),
            (F.count(F.lit(1)) - F.count(F.col(f"`{f.name}`"))).alias("n_missing"),
            F.lit(descriptions.get(f.name, "")).alias("description"),
            F.lit(source(f.name)).alias("source"),
        )
        for f in df.schema.fields
    ])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def modal_bin(
    df: DataFrame, domains: Mapping[str, Column], net: str, gross: str, width: float, bins: int
) -> DataFrame:
    """Fullest histogram bin of the net height per domain, with identity counts."""
    value = F.col(net)
    guess = F.floor(value / width).cast("int")
    # Edges are i * width in floating point; step to the bin whose edges hold.
    placed = (
        F.when(value < guess * F.lit(width), guess - 1)
        .when(value >= (guess + 1) * F.lit(width), guess + 1)
        .otherwise(guess)
    )
    last = F.lit(bins * width)
    index = F.when((value > 0) & (value < last), F.least(placed, F.lit(bins - 1))).when(
        value == last, F.lit(bins - 1)
    )
    rows = in_groups(df.withColumn("_bin", index), domains, "domain")
    counts = rows.groupBy("domain", "_bin").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(value > 0).alias("b"),
        F.count_if((value == 0) & (F.col(gross) == 0)).alias("z"),
        F.count_if((value == 0) != (F.col(gross) == 0)).alias("x"),
        F.count_if(F.col(gross) > value).alias("v"),
    )
    top = F.min(F.when(F.col("_bin").isNotNull(), F.struct((-F.col("c")).alias("c"), F.col("_bin").alias("i"))))
    out = counts.groupBy("domain").agg(
        F.sum("c").alias("n_pixels"), F.sum("b").alias("n_built"), top.alias("_top"),
        F.sum("z").alias("n_zero_both"), F.sum("x").alias("n_zero_mismatch"), F.sum("v").alias("n_gross_above"),
    )
    return out.select(
        "domain", "n_pixels", "n_built",
        (F.col("_top.i") * F.lit(width)).alias("modal_bin_lo"),
        (-F.col("_top.c")).alias("n_modal"),
        (100.0 * -F.col("_top.c") / F.col("n_built")).alias("pct_modal"),
        "n_zero_both", "n_zero_mismatch", "n_gross_above",
        (100.0 * (1 - F.col("n_gross_above") / F.col("n_pixels"))).alias("pct_gross_le_net"),
    )


# --- cross-tabs -------------------------------------------------------------------


def crosstab(df: DataFrame, row: str, col: str, cols: Sequence, prefix: str = "c") -> DataFrame:
    """Percent of all rows per (row class, column class), with margins.

    The raw rows are reduced to class-pair counts; margins come from
    grouping sets over those few counts.
    """
    pairs = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy(F.lit(0))
    shares = pairs.withColumn("_p", 100.0 * F.col("_n") / F.sum("_n").over(total))
    wide = [
        F.coalesce(F.sum(F.when(F.col(col) == k, F.col("_p"))), F.lit(0.0)).alias(f"{prefix}{k}")
        for k in cols
    ]
    named = shares.withColumn(row, F.col(row).cast("string"))
    return (
        named.groupingSets([[F.col(row)], []], F.col(row))
        .agg(F.grouping(row).alias("_all"), *wide, F.sum("_p").alias("row_total"))
        .withColumn(row, F.when(F.col("_all") == 1, "Column total").otherwise(F.col(row)))
        .drop("_all")
    )


def row_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """Share of each column class within its row class."""
    pairs = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and chance diagonal, excess and Cohen's kappa of two classings."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    w, wa, wb = (Window.partitionBy(F.lit(0)), Window.partitionBy(a), Window.partitionBy(b))
    p = pairs.select(
        a, b,
        (F.col("_n") / F.sum("_n").over(w)).alias("p"),
        (F.sum("_n").over(wa) / F.sum("_n").over(w)).alias("pa"),
        (F.sum("_n").over(wb) / F.sum("_n").over(w)).alias("pb"),
    )
    # Chance agreement needs every class of a paired with the same class of b.
    same = F.when(F.col(a) == F.col(b), F.col("p")).otherwise(0.0)
    ma = p.select(F.col(a).alias("k"), "pa").distinct()
    mb = p.select(F.col(b).alias("k"), "pb").distinct()
    pe = ma.join(mb, "k").agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("pe"))
    po = p.agg(F.sum(same).alias("po"))
    one = po.withColumn("_k", F.lit(1)).join(pe.withColumn("_k", F.lit(1)), "_k")  # one row each
    return one.select(
        (100 * F.col("po")).alias("observed_diagonal_pct"),
        (100 * F.col("pe")).alias("expected_diagonal_pct"),
        (100 * (F.col("po") - F.col("pe"))).alias("excess_over_chance"),
        ((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("cohens_kappa"),
    )


def stack_rows(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of small result tables with a label column in front."""
    parts = [df.select(F.lit(k).alias(tag), "*") for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
