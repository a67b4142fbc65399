"""Analyses on the assembled cell table: samples, typologies, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions import scalars as S
from latticeworks.functions.scalars import round_even
from latticeworks.operators import joins, order, profiles

# Built-fraction thresholds of the sample sweep, label -> value.
THRESHOLDS = {"gt0": 1e-9, "0p005": 0.005, "0p01": 0.01, "0p02": 0.02, "0p05": 0.05}
# Quantile edges of the multi-class schemes.
SCHEMES = {"tertile": [1 / 3, 2 / 3], "quartile": [0.25, 0.5, 0.75]}
# Class labels, (vertical high, horizontal high) -> label.
TYPOLOGY = {
    (True, True): "High height / High prior expansion",
    (True, False): "High height / Low prior expansion",
    (False, True): "Low height / High prior expansion",
    (False, False): "Low height / Low prior expansion",
}
COVERAGES = ["built_coverage_1975", "built_coverage_2010", "built_coverage_2015"]
CENTRE_DISTANCE = "distance_to_nearest_cbd_m"
NEEDED = [*COVERAGES, CENTRE_DISTANCE]
NESTED = {
    "A": ["log_distance"],
    "B": ["log_distance", "built_coverage_2010"],
    "C": ["log_distance", "built_coverage_2010", "growth_1975_2010", "growth_2010_2015"],
}
OUTCOMES = {"net": "cell_anbh_derived_m", "gross": "cell_agbh_mean_m"}


# --- samples ----------------------------------------------------------------------


def sample_flags(cells: DataFrame) -> DataFrame:
    """Footprint flag and one valid-height flag per built-fraction threshold."""
    return cells.withColumns({
        "in_national_footprint": F.coalesce(F.col("building_count"), F.lit(0)) > 0,
        **{
            f"in_valid_height_{label}": S.above("cell_built_fraction_mean", t)
            for label, t in THRESHOLDS.items()
        },
    })


def threshold_sensitivity(flags: DataFrame) -> DataFrame:
    """Per threshold: sample size, overlap with the footprint, height summary.

    Rows are repeated for the thresholds they pass and aggregated once.
    """
    totals = flags.agg(
        F.count(F.lit(1)).alias("all"), F.count_if("in_national_footprint").alias("fp")
    ).first()
    groups = {label: F.col(f"in_valid_height_{label}") for label in THRESHOLDS}
    rows = profiles.in_groups(flags, groups, "threshold_label")
    value = reduce(
        lambda acc, kv: acc.when(F.col("threshold_label") == kv[0], kv[1]), THRESHOLDS.items(), F
    )
    n, both = F.count(F.lit(1)), F.count_if("in_national_footprint")
    main = rows.groupBy("threshold_label").agg(
        n.alias("n_cells_valid_height"),
        round_even(100.0 * n / totals["all"], 4).alias("pct_of_all_cells"),
        both.alias("n_overlap"),
        round_even(100.0 * both / totals["fp"], 2).alias("pct_of_footprint_sample"),
        round_even(100.0 * both / n, 2).alias("pct_of_valid_height"),
        F.avg("cell_agbh_mean_m").alias("agbh_mean"),
    ).withColumn("threshold_value", value)
    gross = order.distribution(rows, "cell_agbh_mean_m", ["threshold_label"]).groupBy("threshold_label").agg(
        order.quantile("cell_agbh_mean_m", 0.5).alias("agbh_median")
    )
    net = order.distribution(rows, "cell_anbh_derived_m", ["threshold_label"]).groupBy("threshold_label").agg(
        (F.max("total") / F.max("n")).alias("anbh_mean"),
        order.quantile("cell_anbh_derived_m", 0.5).alias("anbh_median"),
        order.quantile("cell_anbh_derived_m", 0.99).alias("anbh_p99"),
        F.max("vmax").alias("anbh_max"),
    )
    return main.join(gross, "threshold_label", "left").join(net, "threshold_label", "left")


def attrition(cells: DataFrame) -> DataFrame:
    """Footprint cells -> without height -> without covariates -> final."""
    fp = F.col("in_national_footprint")
    tall = F.col("cell_anbh_derived_m").isNotNull()
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in NEEDED])
    return cells.agg(
        F.count_if(fp).alias("n_national_footprint"),
        F.count_if(fp & ~tall).alias("n_dropped_nodata"),
        F.count_if(fp & tall & ~full).alias("n_dropped_missing_covariates"),
        F.count_if(fp & tall & full).alias("n_final"),
    )


def final_sample(cells: DataFrame) -> DataFrame:
    """Footprint cells with a height and all covariates, plus derived columns."""
    kept = cells.where(F.col("in_national_footprint")).na.drop(subset=["cell_anbh_derived_m", *NEEDED])
    c75, c10, c15 = (F.col(c) for c in COVERAGES)
    return kept.withColumns({
        "growth_1975_2010": c10 - c75,
        "growth_2010_2015": c15 - c10,
        "growth_1975_2015": c15 - c75,
        "log_distance": F.log1p(CENTRE_DISTANCE),
        "log_net": F.log1p("cell_anbh_derived_m"),
        "log_gross": F.log1p("cell_agbh_mean_m"),
    })


# --- typologies -------------------------------------------------------------------


def typology_label(v_high: Column, h_high: Column) -> Column:
    return F.when(v_high & h_high, TYPOLOGY[True, True]).when(
        v_high, TYPOLOGY[True, False]
    ).when(h_high, TYPOLOGY[False, True]).otherwise(TYPOLOGY[False, False])


def median_typology(df: DataFrame, vertical: str, horizontal: str) -> tuple[DataFrame, float, float]:
    """2 x 2 classes split at the medians; a value equal to the median is low."""
    v = order.quantile_values(df, vertical, [0.5])[0]
    h = order.quantile_values(df, horizontal, [0.5])[0]
    v_high, h_high = F.col(vertical) > F.lit(v), F.col(horizontal) > F.lit(h)
    out = df.withColumns({
        "typology_class": typology_label(v_high, h_high),
        "v_class": v_high.cast("int"),
        "h_class": h_high.cast("int"),
    })
    return out, v, h


def scheme_classes(
    df: DataFrame, vertical: str, horizontal: str, scheme: str, edges_from: str | None = None
) -> DataFrame:
    """Quantile classes on both axes; a value equal to an edge goes up."""
    probs = SCHEMES[scheme]
    v = order.quantile_values(df, vertical, probs)
    h = order.quantile_values(df, edges_from or horizontal, probs)
    return df.withColumns({
        "v_class": S.steps_reached(vertical, v), "h_class": S.steps_reached(horizontal, h)
    })


def typology_counts(df: DataFrame, n: int) -> DataFrame:
    return df.groupBy("typology_class").agg(
        F.count(F.lit(1)).alias("n"),
        round_even(100.0 * F.count(F.lit(1)) / n, 4).alias("pct_of_sample"),
    )


def tie_counts(df: DataFrame, splits: Mapping[str, float]) -> DataFrame:
    """Cells above, at and below each split value."""
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("variable"), F.lit(float(m)).alias("split"),
            F.count_if(F.col(c) > m).alias("n_above"), F.count_if(F.col(c) == m).alias("n_equal"),
            F.count_if(F.col(c) < m).alias("n_below"),
        )
        for c, m in splits.items()
    ])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def class_profile(df: DataFrame, by: str, medians: Sequence[str], means: Mapping[str, Column]) -> DataFrame:
    """Size, means and exact medians per class."""
    main = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"mean_{k}") for k, c in means.items()])
    for c in medians:
        mid = order.quantiles(df, c, {f"median_{c}": 0.5}, [by])
        main = main.join(mid, by, "left")
    return main


def agreement_table(df: DataFrame, verticals: Mapping[str, str], horizontal: str) -> DataFrame:
    """Diagonal share, chance baseline and kappa per vertical variable and scheme."""
    parts = []
    for label, vertical in verticals.items():
        frames = {"median": median_typology(df, vertical, horizontal)[0]}
        frames |= {s: scheme_classes(df, vertical, horizontal, s) for s in SCHEMES}
        for scheme, frame in frames.items():
            row = profiles.agreement(frame, "v_class", "h_class")
            parts.append(row.select(F.lit(label).alias("vertical_axis"), F.lit(scheme).alias("scheme"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def sensitivity_summary(agreement: DataFrame) -> DataFrame:
    d = F.col("observed_diagonal_pct")
    return agreement.select(
        "vertical_axis", "scheme", round_even(d, 2).alias("diagonal_pct"),
        round_even(100 - d, 2).alias("off_diagonal_pct"),
    )


def zero_composition(df: DataFrame, by: str, value: str) -> DataFrame:
    zero = F.count_if(F.col(value) == 0)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), zero.alias("n_zero"), (100.0 * zero / F.count(F.lit(1))).alias("pct_zero")
    )


# --- regional and descriptive tables ----------------------------------------------


def region_groups(df: DataFrame, region: str) -> DataFrame:
    """Repeat rows for their region (or outside), all named regions, and the nation."""
    name = F.col(region)
    labels = F.array_compact(F.array(
        F.coalesce(name, F.lit("Outside named regions")),
        F.when(name.isNotNull(), "All named regions"),
        F.lit("National sample"),
    ))
    return df.withColumn("region_row", F.explode(labels))


def regional_table(df: DataFrame, region: str) -> DataFrame:
    rows = region_groups(df, region)
    net = order.distribution(rows, "cell_anbh_derived_m", ["region_row"]).groupBy("region_row").agg(
        (F.max("total") / F.max("n")).alias("anbh_mean_m"),
        order.spread("cell_anbh_derived_m").alias("anbh_sd_m"),
        *[
            order.quantile("cell_anbh_derived_m", p).alias(f"anbh_{k}_m")
            for k, p in {"median": 0.5, "p90": 0.9, "p99": 0.99}.items()
        ],
    )
    gross = order.quantiles(rows, "cell_agbh_mean_m", {"agbh_median_m": 0.5}, ["region_row"])
    label = F.col("typology_class")
    diagonal = label.isin(TYPOLOGY[True, True], TYPOLOGY[False, False])
    main = rows.groupBy("region_row").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("cell_agbh_mean_m").alias("agbh_mean_m"),
        F.avg("built_coverage_2010").alias("built_coverage_2010_mean"),
        F.avg("growth_1975_2015").alias("growth_1975_2015_mean"),
        (100 * F.avg(label.startswith("High height").cast("double"))).alias("pct_high_height"),
        (100 * F.avg(diagonal.cast("double"))).alias("pct_diagonal"),
    )
    return main.join(net, "region_row", "left").join(gross, "region_row", "left")


def ordered_report(df: DataFrame, column: str, order_of: Sequence[str]) -> DataFrame:
    """Rows in a stated order, unknown labels last by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in order_of]), F.col(column))
    rank = F.when(place > 0, place).otherwise(len(order_of) + 1)
    return df.withColumn("ordinal", rank).orderBy("ordinal", column)


# --- second product ---------------------------------------------------------------


def band_masks(df: DataFrame, value: str) -> dict[str, Column]:
    """Zero, interquartile, upper and top bands of one variable (may overlap)."""
    p25, p75, p90 = order.quantile_values(df, value, [0.25, 0.75, 0.90])
    v = F.col(value)
    return {
        "zero": v == 0,
        "interquartile": (v >= p25) & (v <= p75),
        "upper_below_p90": (v > p75) & (v <= p90),
        "above_p90": v > p90,
    }


def coverage_profile(rows: DataFrame, by: str, ours: str, other: str) -> DataFrame:
    """Cells, coverage by the other product, our median, its quantiles."""
    main = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        (100.0 * F.count(other) / F.count(F.lit(1))).alias("pct_covered"),
        F.min(ours).alias("ours_min"), F.max(ours).alias("ours_max"),
        F.avg(ours).alias("ours_mean"),
    )
    mid = order.quantiles(rows, ours, {"ours_median": 0.5}, [by])
    dist = order.distribution(rows, other, [by]).groupBy(by).agg(
        F.max("n").alias("other_n"),
        (F.max("total") / F.max("n")).alias("other_mean"),
        *[order.quantile(other, p / 100).alias(f"other_p{p}") for p in (10, 25, 50, 75, 90)],
    )
    return main.join(mid, by, "left").join(dist, by, "left")


def split_agreement(df: DataFrame, ours: str, other: str) -> DataFrame:
    """Median-split agreement where both products are positive.

    Our split is the median of the whole sample, the other one's the median
    over the common positive cells.
    """
    both = df.where(F.col(other).isNotNull() & (F.col(ours) > 0))
    a = order.quantile_values(df, ours, [0.5])[0]
    b = order.quantile_values(both, other, [0.5])[0]
    split = both.select(
        (F.col(ours) > F.lit(a)).cast("int").alias("a"), (F.col(other) > F.lit(b)).cast("int").alias("b")
    )
    return profiles.agreement(split, "a", "b")


# --- validation -------------------------------------------------------------------


def validation_strata(df: DataFrame, region: str, value: str) -> DataFrame:
    """Stratum = region tier + height class split at the sample median."""
    named = df.where(F.col(region).isNotNull() & F.col(value).isNotNull())
    mid = order.quantile_values(named, value, [0.5])[0]
    tier = S.region_tier(region, "Metro_core", "Periurban_corridor", "Secondary_city")
    height = F.when(F.col(value) > F.lit(mid), "HighANBH").otherwise("LowANBH")
    return named.withColumn("stratum", F.concat_ws("_", tier, height))


# Fields of the coding sheet.
CODING_FIELDS = [
    "validator_name", "validation_date", "imagery_source", "observed_dominant_storeys",
    "height_class_match", "dominant_building_use", "settlement_type", "validation_notes",
    "data_quality_flag",
]


def validation_template(
    strata: DataFrame, key: str, value: str, gross: str, per_stratum: int = 20, seed: int = 42
) -> DataFrame:
    """Sampled cells with rounded readings and blank coding fields."""
    sample = joins.stratified_sample(strata, "stratum", key, per_stratum, seed)
    return sample.select(
        key, "stratum",
        round_even("lon", 6).alias("longitude_centroid"), round_even("lat", 6).alias("latitude_centroid"),
        round_even(value, 3).alias("rs_anbh_derived_m"), round_even(gross, 4).alias("rs_agbh_mean_m"),
        S.implied_storeys(value).alias("rs_implied_storeys_3m_rule"),
        *[F.lit(None).cast("string").alias(f) for f in CODING_FIELDS],
    )
