"""Samples, typologies, cross-tabs, profiles and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from latticeworks.catalog.geometry import CENTRES_SQL
from latticeworks.catalog.rasters import BOXES_SQL, BUILT_SQL, HEIGHT_SQL, SECOND_SQL, built_up, heights, second_product, zone_regions
from latticeworks.catalog.registry import query, r, re, rounded
from latticeworks.functions import scalars as S
from latticeworks.operators import joins, order, profiles, ranks
from latticeworks.plans import analysis as A
from latticeworks.plans import bindings as B
from latticeworks.plans import covariates as COV
from latticeworks.plans.bindings import with_sql, SQL
from latticeworks.session import checkpointed


def zone_buildings(spark, sf):
    """Line items per grid cell, as its building count."""
    li = B.table(spark, sf, "lineitem")
    at = B.pixel_index(F.col("l_orderkey"))
    return li.groupBy(at["zcol"].alias("zcol"), at["zrow"].alias("zrow")).agg(
        F.count(F.lit(1)).alias("building_count"), F.avg(F.col("l_extendedprice") / 100).alias("mean_building_area"))


def cell_table(spark, sf):
    """Heights, coverage, centre distance, region and building count per cell."""
    base = heights(spark, sf)
    cover = built_up(spark, sf).select("zcol", "zrow", *A.COVERAGES)
    dist = COV.centre_distance_columns(B.zones(spark, sf), "grid_id").select("grid_id", A.CENTRE_DISTANCE)
    region = zone_regions(spark, sf).select("grid_id", "region")
    out = (
        base.join(cover, ["zcol", "zrow"], "left")
        .join(zone_buildings(spark, sf), ["zcol", "zrow"], "left")
        .join(dist, "grid_id", "left").join(region, "grid_id", "left")
    )
    # Several passes follow; the cell table is small next to its sources, so
    # it is written once rather than derived again from the raw rows.
    return checkpointed(A.sample_flags(out))


def sample(spark, sf):
    return A.final_sample(cell_table(spark, sf))


def typed_sample(spark, sf):
    return A.median_typology(sample(spark, sf), "cell_anbh_derived_m", "growth_1975_2015")[0]


_FLAGS = ", ".join(f"coalesce(cell_built_fraction_mean, -1) > {t!r} AS in_valid_height_{k}" for k, t in A.THRESHOLDS.items())
CELL_SQL = f"""{HEIGHT_SQL}, {SQL['stack']}, {BUILT_SQL}, {CENTRES_SQL},
 bc AS (SELECT l_orderkey % 125 // 5 AS zcol, l_orderkey // 125 // 5 AS zrow, count(*) AS building_count, avg(l_extendedprice/100) AS mean_building_area
   FROM lineitem GROUP BY ALL),
 celltab AS (SELECT h.*, built_coverage_1975, built_coverage_2010, built_coverage_2015, building_count, mean_building_area,
   {re('dmin', 0)} AS distance_to_nearest_cbd_m, {BOXES_SQL.replace('lon ', 'h.lon ').replace('lat ', 'h.lat ')} AS region,
   coalesce(building_count, 0) > 0 AS in_national_footprint, {_FLAGS}
  FROM heights h LEFT JOIN built b USING (zcol, zrow) LEFT JOIN bc USING (zcol, zrow) LEFT JOIN dist d ON d.grid_id = h.grid_id),
 samp AS (SELECT *, built_coverage_2010 - built_coverage_1975 AS growth_1975_2010, built_coverage_2015 - built_coverage_2010 AS growth_2010_2015,
   built_coverage_2015 - built_coverage_1975 AS growth_1975_2015, ln(1 + distance_to_nearest_cbd_m) AS log_distance,
   ln(1 + cell_anbh_derived_m) AS log_net, ln(1 + cell_agbh_mean_m) AS log_gross FROM celltab
  WHERE in_national_footprint AND cell_anbh_derived_m IS NOT NULL AND built_coverage_1975 IS NOT NULL AND built_coverage_2010 IS NOT NULL
   AND built_coverage_2015 IS NOT NULL AND distance_to_nearest_cbd_m IS NOT NULL)"""
TYPE_SQL = f"""{CELL_SQL}, med AS (SELECT quantile_cont(cell_anbh_derived_m, 0.5) AS vm, quantile_cont(growth_1975_2015, 0.5) AS hm FROM samp),
 typed AS (SELECT samp.*, (CASE WHEN cell_anbh_derived_m > vm THEN 'High' ELSE 'Low' END) || ' height / ' || (CASE WHEN growth_1975_2015 > hm THEN 'High' ELSE 'Low' END) || ' prior expansion' AS typology_class,
  (cell_anbh_derived_m > vm)::INTEGER AS v_class, (growth_1975_2015 > hm)::INTEGER AS h_class FROM samp, med)"""


@query(f"""{CELL_SQL} SELECT grid_id, in_national_footprint, {", ".join(f"in_valid_height_{k}" for k in A.THRESHOLDS)} FROM celltab""")
def sample_definitions(spark, sf):
    return cell_table(spark, sf).select("grid_id", "in_national_footprint", *[f"in_valid_height_{k}" for k in A.THRESHOLDS])


@query(f"""{CELL_SQL}, th AS (SELECT unnest({list(A.THRESHOLDS)!r}) AS threshold_label, unnest({list(A.THRESHOLDS.values())!r})::DOUBLE AS threshold_value),
 t AS (SELECT count(*) AS n_all, count(*) FILTER (in_national_footprint) AS n_fp FROM celltab)
SELECT threshold_label, threshold_value, count(*) AS n_cells_valid_height, {re('100.0*count(*)/any_value(n_all)', 4)} AS pct_of_all_cells,
 count(*) FILTER (in_national_footprint) AS n_overlap, {re('100.0*count(*) FILTER (in_national_footprint)/any_value(n_fp)', 2)} AS pct_of_footprint_sample,
 {re('100.0*count(*) FILTER (in_national_footprint)/count(*)', 2)} AS pct_of_valid_height, {r('avg(cell_agbh_mean_m)')} AS agbh_mean,
 {r('quantile_cont(cell_agbh_mean_m, 0.5)')} AS agbh_median, {r('avg(cell_anbh_derived_m)')} AS anbh_mean, {r('quantile_cont(cell_anbh_derived_m, 0.5)')} AS anbh_median,
 {r('quantile_cont(cell_anbh_derived_m, 0.99)')} AS anbh_p99, {r('max(cell_anbh_derived_m)')} AS anbh_max
FROM celltab, th, t WHERE coalesce(cell_built_fraction_mean, -1) > threshold_value GROUP BY ALL""")
def threshold_sensitivity(spark, sf):
    """One row per threshold; the threshold itself stays as it is, as text while the rest is rounded."""
    out = A.threshold_sensitivity(cell_table(spark, sf))
    return rounded(out.withColumn("threshold_value", F.col("threshold_value").cast("string"))).withColumn("threshold_value", F.col("threshold_value").cast("double"))


@query(f"""{CELL_SQL} SELECT count(*) FILTER (in_national_footprint) AS n_national_footprint,
 count(*) FILTER (in_national_footprint AND cell_anbh_derived_m IS NULL) AS n_dropped_nodata,
 count(*) FILTER (in_national_footprint AND cell_anbh_derived_m IS NOT NULL) - (SELECT count(*) FROM samp) AS n_dropped_missing_covariates,
 (SELECT count(*) FROM samp) AS n_final FROM celltab""")
def sample_attrition(spark, sf):
    return A.attrition(cell_table(spark, sf))


@query(f"""{TYPE_SQL} SELECT typology_class, count(*) AS n, {re('100.0*count(*)/(SELECT count(*) FROM samp)', 4)} AS pct_of_sample FROM typed GROUP BY 1""")
def median_split_typology(spark, sf):
    df = typed_sample(spark, sf)
    return A.typology_counts(df, df.count())


@query(f"""{TYPE_SQL} SELECT 'cell_anbh_derived_m' AS variable, {r('any_value(vm)')} AS split, count(*) FILTER (cell_anbh_derived_m > vm) AS n_above,
 count(*) FILTER (cell_anbh_derived_m = vm) AS n_equal, count(*) FILTER (cell_anbh_derived_m < vm) AS n_below FROM samp, med
UNION ALL SELECT 'growth_1975_2015', {r('any_value(hm)')}, count(*) FILTER (growth_1975_2015 > hm), count(*) FILTER (growth_1975_2015 = hm), count(*) FILTER (growth_1975_2015 < hm) FROM samp, med""")
def typology_ties(spark, sf):
    df, v, h = A.median_typology(sample(spark, sf), "cell_anbh_derived_m", "growth_1975_2015")
    return rounded(A.tie_counts(df, {"cell_anbh_derived_m": v, "growth_1975_2015": h}))


@query(f"""{TYPE_SQL} SELECT typology_class, count(*) AS n, {r('avg(cell_anbh_derived_m)')} AS mean_anbh, {r('avg(growth_1975_2015)')} AS mean_growth,
 {r('avg(built_coverage_2010)')} AS mean_built_coverage_2010, {r('avg(growth_1975_2010)')} AS mean_growth_1975_2010, {r('avg(growth_2010_2015)')} AS mean_growth_2010_2015,
 {r('avg(distance_to_nearest_cbd_m)/1000')} AS mean_cbd_km, {r('quantile_cont(cell_anbh_derived_m, 0.5)')} AS median_cell_anbh_derived_m,
 {r('quantile_cont(growth_1975_2015, 0.5)')} AS median_growth_1975_2015 FROM typed GROUP BY 1""")
def typology_profile(spark, sf):
    means = {"anbh": F.avg("cell_anbh_derived_m"), "growth": F.avg("growth_1975_2015"),
             "built_coverage_2010": F.avg("built_coverage_2010"), "growth_1975_2010": F.avg("growth_1975_2010"),
             "growth_2010_2015": F.avg("growth_2010_2015"), "cbd_km": F.avg(A.CENTRE_DISTANCE) / 1000}
    return rounded(A.class_profile(typed_sample(spark, sf), "typology_class", ["cell_anbh_derived_m", "growth_1975_2015"], means))


def _scheme_sql(probs, vertical="cell_anbh_derived_m"):
    q = "[" + ", ".join(repr(p) for p in probs) + "]"
    steps = lambda c, e: " + ".join(f"({c} >= {e}[{i+1}])::INTEGER" for i in range(len(probs)))
    return f"""(SELECT {steps(vertical, 've')} AS v_class, {steps('growth_1975_2015', 'he')} AS h_class FROM samp,
  (SELECT quantile_cont({vertical}, {q}) AS ve, quantile_cont(growth_1975_2015, {q}) AS he FROM samp))"""


def _xtab(scheme):
    k = len(A.SCHEMES[scheme]) + 1
    cols = ", ".join(f"{r(f'100.0*count(*) FILTER (h_class = {i})/any_value(n)')} AS c{i}" for i in range(k))
    return f"""{CELL_SQL}, c AS (SELECT *, count(*) OVER () AS n FROM {_scheme_sql(A.SCHEMES[scheme])})
SELECT coalesce(v_class::VARCHAR, 'Column total') AS v_class, {cols}, {r('100.0*count(*)/any_value(n)')} AS row_total FROM c GROUP BY GROUPING SETS ((v_class), ())"""


@query(_xtab("tertile"))
def tertile_crosstab(spark, sf):
    df = A.scheme_classes(sample(spark, sf), "cell_anbh_derived_m", "growth_1975_2015", "tertile")
    return rounded(profiles.crosstab(df, "v_class", "h_class", [0, 1, 2]))


@query(_xtab("quartile"))
def quartile_crosstab(spark, sf):
    df = A.scheme_classes(sample(spark, sf), "cell_anbh_derived_m", "growth_1975_2015", "quartile")
    return rounded(profiles.crosstab(df, "v_class", "h_class", [0, 1, 2, 3]))


def _agree(label, scheme, src):
    return f"""SELECT '{label}' AS vertical_axis, '{scheme}' AS scheme, po, pe FROM (SELECT sum(p) FILTER (v_class = h_class) AS po FROM (
   SELECT v_class, h_class, count(*)*1.0/sum(count(*)) OVER () AS p FROM {src} z GROUP BY 1, 2)),
  (SELECT sum(a.p*b.p) AS pe FROM (SELECT v_class AS k, count(*)*1.0/sum(count(*)) OVER () AS p FROM {src} z GROUP BY 1) a
   JOIN (SELECT h_class AS k, count(*)*1.0/sum(count(*)) OVER () AS p FROM {src} z GROUP BY 1) b USING (k))"""


def _median_src(vertical):
    return f"""(SELECT ({vertical} > vm)::INTEGER AS v_class, (growth_1975_2015 > hm)::INTEGER AS h_class FROM samp,
  (SELECT quantile_cont({vertical}, 0.5) AS vm, quantile_cont(growth_1975_2015, 0.5) AS hm FROM samp))"""


_AGREE = " UNION ALL ".join(
    _agree(lab, s, _median_src(v) if s == "median" else _scheme_sql(A.SCHEMES[s], v))
    for lab, v in A.OUTCOMES.items() for s in ("median", "tertile", "quartile"))


@query(f"""{CELL_SQL}, a AS ({_AGREE}) SELECT vertical_axis, scheme, {r('100*po')} AS observed_diagonal_pct, {r('100*pe')} AS expected_diagonal_pct,
 {r('100*(po-pe)')} AS excess_over_chance, {r('(po-pe)/(1-pe)')} AS cohens_kappa FROM a""")
def typology_agreement(spark, sf):
    return rounded(A.agreement_table(sample(spark, sf), A.OUTCOMES, "growth_1975_2015"))


@query(f"""{CELL_SQL}, a AS ({_AGREE}) SELECT vertical_axis, scheme, {re('100*po', 2)} AS diagonal_pct, {re('100 - 100*po', 2)} AS off_diagonal_pct FROM a""")
def matched_typology_comparison(spark, sf):
    """Diagonal shares with the vertical variable swapped on the same sample."""
    return A.sensitivity_summary(A.agreement_table(sample(spark, sf), A.OUTCOMES, "growth_1975_2015"))


_REG = f"""{TYPE_SQL}, rows AS (SELECT *, unnest(list_filter([coalesce(region, 'Outside named regions'), CASE WHEN region IS NOT NULL THEN 'All named regions' END, 'National sample'], lambda x: x IS NOT NULL)) AS region_row FROM typed)"""


@query(f"""{_REG} SELECT region_row, count(*) AS n_cells, {r('avg(cell_agbh_mean_m)')} AS agbh_mean_m, {r('avg(built_coverage_2010)')} AS built_coverage_2010_mean,
 {r('avg(growth_1975_2015)')} AS growth_1975_2015_mean, {r("100*avg(starts_with(typology_class, 'High height')::INTEGER)")} AS pct_high_height,
 {r('100*avg((v_class = h_class)::INTEGER)')} AS pct_diagonal, {r('avg(cell_anbh_derived_m)')} AS anbh_mean_m, {r('stddev_samp(cell_anbh_derived_m)')} AS anbh_sd_m,
 {", ".join(f"{r(f'quantile_cont(cell_anbh_derived_m, {p})')} AS anbh_{k}_m" for k, p in {'median': 0.5, 'p90': 0.9, 'p99': 0.99}.items())},
 {r('quantile_cont(cell_agbh_mean_m, 0.5)')} AS agbh_median_m FROM rows GROUP BY 1""")
def regional_table(spark, sf):
    return rounded(A.regional_table(typed_sample(spark, sf), "region"))


_DESC = ["cell_anbh_derived_m", "cell_agbh_mean_m", "cell_built_fraction_mean", "built_coverage_2010", "growth_1975_2010", "growth_2010_2015", "distance_to_nearest_cbd_m"]
_QS = {f"p{p}": p / 100 for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}


def _desc_sql(src, cols, qs):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS n_missing, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS sd, {r(f'min({c})')} AS "min", {r(f'max({c})')} AS "max",
 {", ".join(f"{r(f'quantile_cont({c}, {p})')} AS {k}" for k, p in qs.items())} FROM {src}""" for c in cols)


@query(f"{CELL_SQL} {_desc_sql('samp', _DESC, _QS)}")
def descriptive_statistics(spark, sf):
    return rounded(profiles.describe(sample(spark, sf), _DESC, _QS))


_PROFILE = ["cell_anbh_derived_m", "cell_agbh_mean_m", "built_coverage_1975", "mean_building_area"]


@query(f"{CELL_SQL} {_desc_sql('celltab', _PROFILE, {'p25': 0.25, 'p50': 0.5, 'p75': 0.75})}")
def column_profile(spark, sf):
    return rounded(profiles.describe(cell_table(spark, sf), _PROFILE, {"p25": 0.25, "p50": 0.5, "p75": 0.75}))


@query(f"{CELL_SQL} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n_valid, {r(f'100.0*count({c})/count(*)')} AS pct_valid FROM celltab""" for c in [*_PROFILE, "region"]))
def completeness_report(spark, sf):
    return rounded(profiles.completeness(cell_table(spark, sf), [*_PROFILE, "region"]))


@query(f"{CELL_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS n_valid, count(*) - count({c}) AS n_missing, '{d}' AS description, '{s}' AS source FROM celltab"""
    for c, t, d, s in [("grid_id", "bigint", "Cell identifier", "grid"), ("building_count", "bigint", "", "footprints"), ("region", "string", "First matching region", "derived"),
                       ("cell_anbh_derived_m", "double", "", "height"), ("built_coverage_2010", "double", "", "built_up")]))
def column_manifest(spark, sf):
    df = cell_table(spark, sf).select("grid_id", "building_count", "region", "cell_anbh_derived_m", "built_coverage_2010")
    return profiles.column_manifest(
        df, {"grid_id": "Cell identifier", "region": "First matching region"},
        {"grid": "grid", "building": "footprints", "built": "built_up", "cell": "height"})


_TIER = "CASE WHEN region IN ('Accra-Tema', 'Kumasi') THEN 'Metro core' WHEN region IN ('Accra-Kasoa', 'Accra-Prampram', 'Accra-Dodowa', 'Kumasi-Ejisu', 'Tamale-Savelugu') THEN 'Peri-urban corridor' ELSE 'Secondary city' END"


@query(f"""{TYPE_SQL}, t AS (SELECT {_TIER} AS region_tier, typology_class FROM typed WHERE region IS NOT NULL)
SELECT region_tier, typology_class, count(*) AS n, {r('count(*)*1.0/sum(count(*)) OVER (PARTITION BY region_tier)')} AS share FROM t GROUP BY 1, 2""")
def tier_class_shares(spark, sf):
    df = typed_sample(spark, sf).withColumn("region_tier", S.region_tier("region", "Metro core", "Peri-urban corridor", "Secondary city"))
    return rounded(profiles.row_shares(df.where(F.col("region_tier").isNotNull()), "region_tier", "typology_class"))


def _rank_sql(src, x, y, lab, log):
    a, b = (f"ln(1+{x})", f"ln(1+{y})") if log else (x, y)
    return f"""SELECT '{lab}' AS comparison, count(*) AS n, {r(f'corr({a}, {b})')} AS pearson_r, {r('corr(rx, ry)')} AS spearman_rho FROM (
  SELECT {x}, {y}, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1)/2.0 AS ry
  FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) HAVING count(*) >= 100"""


_PAIRS = [("cell_anbh_derived_m", "mean_building_area"), ("cell_agbh_mean_m", "mean_building_area"), ("cell_anbh_derived_m", "built_coverage_2010")]


@query(f"{CELL_SQL} " + " UNION ALL ".join(_rank_sql("samp", a, b, f"{a}~{b}", False) for a, b in _PAIRS))
def cross_dataset_correlations(spark, sf):
    s = sample(spark, sf)
    parts = [ranks.correlation_row(s, f"{a}~{b}", a, b).drop("pearson_p", "spearman_p") for a, b in _PAIRS]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@query(f"""{TYPE_SQL} SELECT typology_class, count(*) AS n, count(*) FILTER (cell_anbh_derived_m = 0) AS n_zero,
 {r('100.0*count(*) FILTER (cell_anbh_derived_m = 0)/count(*)')} AS pct_zero FROM typed GROUP BY 1""")
def zero_signal_composition(spark, sf):
    return rounded(A.zero_composition(typed_sample(spark, sf), "typology_class", "cell_anbh_derived_m"))


@query(f"""{CELL_SQL}, two AS (SELECT *, coalesce(building_count, 0) >= 103 AS in_dense_cells, coalesce(cell_built_fraction_mean, 0) > 0.37 AS in_built_up_cells FROM celltab)
SELECT CASE WHEN in_dense_cells THEN 'in_dense_cells_only' ELSE 'in_built_up_cells_only' END AS direction, count(*) AS n,
 {r('avg(building_count)')} AS mean_buildings, {r('avg(cell_built_fraction_mean)')} AS mean_fraction FROM two WHERE in_dense_cells <> in_built_up_cells GROUP BY 1""")
def mismatch_profile(spark, sf):
    """Cells dense by the buildings' account only, built up by the pixels' account only."""
    cells = cell_table(spark, sf).withColumns({
        "in_dense_cells": F.coalesce("building_count", F.lit(0)) >= 103,
        "in_built_up_cells": F.coalesce("cell_built_fraction_mean", F.lit(0.0)) > 0.37})
    out = joins.mismatch(cells, "in_dense_cells", "in_built_up_cells", {
        "mean_buildings": F.avg("building_count"), "mean_fraction": F.avg("cell_built_fraction_mean")})
    return rounded(out)


@query(f"""{CELL_SQL} SELECT count(*) FILTER (in_national_footprint) AS n_a, count(*) FILTER (in_valid_height_0p01) AS n_b,
 count(*) FILTER (in_national_footprint AND in_valid_height_0p01) AS n_both, {r('100.0*count(*) FILTER (in_national_footprint AND in_valid_height_0p01)/count(*) FILTER (in_national_footprint)')} AS pct_of_a,
 {r('100.0*count(*) FILTER (in_national_footprint AND in_valid_height_0p01)/count(*) FILTER (in_valid_height_0p01)')} AS pct_of_b FROM celltab""")
def set_overlap(spark, sf):
    a, b = F.col("in_national_footprint"), F.col("in_valid_height_0p01")
    both = F.count_if(a & b)
    return rounded(cell_table(spark, sf).agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), both.alias("n_both"),
        (100.0 * both / F.count_if(a)).alias("pct_of_a"), (100.0 * both / F.count_if(b)).alias("pct_of_b")))


def compared(spark, sf):
    """Typed sample with the second height product."""
    other = second_product(spark, sf).select("grid_id", "net_height_m", "gross_height_m")
    return checkpointed(typed_sample(spark, sf).join(other, "grid_id", "left"))


_CMP = f"""{TYPE_SQL}, {SECOND_SQL}, cmp AS (SELECT typed.*, net_height_m, gross_height_m FROM typed LEFT JOIN second ON second.grid_id = typed.grid_id)"""
_COVER = f"""count(*) AS n_cells, {r('100.0*count(net_height_m)/count(*)')} AS pct_covered, {r('min(cell_anbh_derived_m)')} AS ours_min, {r('max(cell_anbh_derived_m)')} AS ours_max,
 {r('avg(cell_anbh_derived_m)')} AS ours_mean, {r('quantile_cont(cell_anbh_derived_m, 0.5)')} AS ours_median, count(net_height_m) AS other_n, {r('avg(net_height_m)')} AS other_mean,
 {", ".join(f"{r(f'quantile_cont(net_height_m, {p/100})')} AS other_p{p}" for p in (10, 25, 50, 75, 90))}"""


@query(f"""{_CMP}, q AS (SELECT quantile_cont(cell_anbh_derived_m, 0.25) AS a, quantile_cont(cell_anbh_derived_m, 0.75) AS b, quantile_cont(cell_anbh_derived_m, 0.9) AS c FROM cmp),
 bands AS (SELECT *, unnest(list_filter([CASE WHEN cell_anbh_derived_m = 0 THEN 'zero' END, CASE WHEN cell_anbh_derived_m BETWEEN a AND b THEN 'interquartile' END,
  CASE WHEN cell_anbh_derived_m > b AND cell_anbh_derived_m <= c THEN 'upper_below_p90' END, CASE WHEN cell_anbh_derived_m > c THEN 'above_p90' END], lambda x: x IS NOT NULL)) AS band FROM cmp, q),
 rk AS (SELECT band, corr(rx, ry) AS rho FROM (SELECT band, rank() OVER (PARTITION BY band ORDER BY cell_anbh_derived_m) + (count(*) OVER (PARTITION BY band, cell_anbh_derived_m) - 1)/2.0 AS rx,
   rank() OVER (PARTITION BY band ORDER BY net_height_m) + (count(*) OVER (PARTITION BY band, net_height_m) - 1)/2.0 AS ry FROM bands WHERE net_height_m IS NOT NULL) GROUP BY band)
SELECT band, {_COVER}, {r('any_value(rho)')} AS spearman_within FROM bands LEFT JOIN rk USING (band) GROUP BY band""")
def band_profile(spark, sf):
    """Overlapping bands of our height against the second product."""
    df = compared(spark, sf)
    rows = profiles.in_groups(df, A.band_masks(df, "cell_anbh_derived_m"), "band")
    rho = ranks.spearman(rows, "cell_anbh_derived_m", "net_height_m", ["band"]).select("band", F.col("spearman_rho").alias("spearman_within"))
    return rounded(A.coverage_profile(rows, "band", "cell_anbh_derived_m", "net_height_m").join(rho, "band", "left"))


@query(f"{_CMP} SELECT typology_class, {_COVER} FROM cmp GROUP BY 1")
def second_product_by_class(spark, sf):
    return rounded(A.coverage_profile(compared(spark, sf), "typology_class", "cell_anbh_derived_m", "net_height_m"))


@query(f"{_CMP}, zr AS (SELECT *, coalesce(region, 'Outside named regions') AS region_name FROM cmp) SELECT region_name, {_COVER} FROM zr GROUP BY 1")
def second_product_by_region(spark, sf):
    df = compared(spark, sf).withColumn("region_name", F.coalesce("region", F.lit("Outside named regions")))
    return rounded(A.coverage_profile(df, "region_name", "cell_anbh_derived_m", "net_height_m"))


@query(f"""{_CMP}, b AS (SELECT * FROM cmp WHERE net_height_m IS NOT NULL AND cell_anbh_derived_m > 0),
 s AS (SELECT (cell_anbh_derived_m > (SELECT quantile_cont(cell_anbh_derived_m, 0.5) FROM cmp))::INTEGER AS v_class, (net_height_m > (SELECT quantile_cont(net_height_m, 0.5) FROM b))::INTEGER AS h_class FROM b),
 a AS ({_agree('x', 'y', 's')}) SELECT {r('100*po')} AS observed_diagonal_pct, {r('100*pe')} AS expected_diagonal_pct, {r('100*(po-pe)')} AS excess_over_chance, {r('(po-pe)/(1-pe)')} AS cohens_kappa FROM a""")
def two_product_agreement(spark, sf):
    return rounded(A.split_agreement(compared(spark, sf), "cell_anbh_derived_m", "net_height_m"))


@query(f"""{_CMP} {_rank_sql("(SELECT * FROM cmp WHERE net_height_m IS NOT NULL)", 'cell_anbh_derived_m', 'net_height_m', 'net, both defined', True)}
 UNION ALL {_rank_sql("(SELECT * FROM cmp WHERE cell_anbh_derived_m > 0)", 'cell_anbh_derived_m', 'net_height_m', 'net, both positive', True)}
 UNION ALL {_rank_sql("cmp", 'cell_agbh_mean_m', 'gross_height_m', 'gross, all cells', True)}""")
def two_product_correlations(spark, sf):
    df = compared(spark, sf)
    parts = [
        ranks.correlation_row(df, "net, both defined", "cell_anbh_derived_m", "net_height_m", log1p=True),
        ranks.correlation_row(df.where(F.col("cell_anbh_derived_m") > 0), "net, both positive", "cell_anbh_derived_m", "net_height_m", log1p=True),
        ranks.correlation_row(df, "gross, all cells", "cell_agbh_mean_m", "gross_height_m", log1p=True),
    ]
    return rounded(reduce(lambda a, b: a.unionByName(b), [p.drop("pearson_p", "spearman_p") for p in parts]))


@query(f"""{_CMP}, k AS (SELECT v_class, rank() OVER (ORDER BY net_height_m) + (count(*) OVER (PARTITION BY net_height_m) - 1)/2.0 AS rk FROM cmp WHERE net_height_m IS NOT NULL),
 t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM cmp WHERE net_height_m IS NOT NULL GROUP BY net_height_m)),
 mw AS (SELECT count(*) FILTER (v_class = 1)::DOUBLE AS n1, count(*) FILTER (v_class = 0)::DOUBLE AS n2, sum(rk) FILTER (v_class = 1) AS r1, count(*)::DOUBLE AS n FROM k)
SELECT n1::BIGINT AS n_first, n2::BIGINT AS n_second, {r('r1 - n1*(n1+1)/2')} AS u, {r('(r1 - n1*(n1+1)/2 - n1*n2/2 - 0.5)/sqrt(n1*n2/12*((n+1) - ties/(n*(n-1))))')} AS z FROM mw, t""")
def mann_whitney_high_low(spark, sf):
    df = compared(spark, sf).where(F.col("net_height_m").isNotNull())
    return rounded(ranks.mann_whitney(df, "net_height_m", F.col("v_class") == 1).drop("p_greater"))


@query(f"""{TYPE_SQL}, n AS (SELECT *, {_TIER.replace("'Metro core'", "'Metro_core'").replace("'Peri-urban corridor'", "'Periurban_corridor'").replace("'Secondary city'", "'Secondary_city'")} || CASE WHEN cell_anbh_derived_m > (SELECT quantile_cont(cell_anbh_derived_m, 0.5) FROM typed WHERE region IS NOT NULL) THEN '_HighANBH' ELSE '_LowANBH' END AS stratum FROM typed WHERE region IS NOT NULL)
SELECT stratum, least(count(*), 20) AS n_sampled FROM n GROUP BY 1""")
def stratified_sample_sizes(spark, sf):
    strata = A.validation_strata(typed_sample(spark, sf), "region", "cell_anbh_derived_m")
    rows = A.validation_template(strata, "grid_id", "cell_anbh_derived_m", "cell_agbh_mean_m")
    return rows.groupBy("stratum").agg(F.count_distinct("grid_id").alias("n_sampled"))


@query()
def validation_template(spark, sf):
    """Repeatable stratified sample with blank coding fields (hash-drawn)."""
    strata = A.validation_strata(typed_sample(spark, sf), "region", "cell_anbh_derived_m")
    return A.validation_template(strata, "grid_id", "cell_anbh_derived_m", "cell_agbh_mean_m")


@query(f"""{CELL_SQL} SELECT count(*) AS n_matched, {r('max(abs(cell_agbh_mean_m - g2))', 5)} AS agbh_max_abs_diff, {r('avg(abs(cell_agbh_mean_m - g2))', 5)} AS agbh_mean_abs_diff, {r('corr(cell_agbh_mean_m, g2)', 5)} AS agbh_corr
FROM heights JOIN (SELECT zcol, zrow, avg(net*fraction_raw) AS g2 FROM px GROUP BY ALL) USING (zcol, zrow)""")
def reproduction_difference(spark, sf):
    """Cell means recomputed another way, compared with the published column."""
    px = B.pixels(spark, sf).groupBy("zcol", "zrow").agg(F.avg(F.col("net") * F.col("fraction_raw")).alias("g2"))
    ours = heights(spark, sf).join(px, ["zcol", "zrow"]).select("grid_id", "g2")
    pub = heights(spark, sf).select("grid_id", "cell_agbh_mean_m")
    return rounded(joins.reproduction_difference(ours, pub, "grid_id", {"agbh": ("cell_agbh_mean_m", "g2")}), 5)


@query(f"""{with_sql('fp', 'clean', 'yearly', 'cells')}, a AS (SELECT grid_id, count(*) AS n_buildings FROM clean GROUP BY 1),
 b AS (SELECT grid_id, building_count_2001 AS last_count FROM yearly)
SELECT cells.grid_id, col, "row", n_buildings, last_count FROM cells LEFT JOIN a USING (grid_id) LEFT JOIN b USING (grid_id)""")
def schema_safe_assembly(spark, sf):
    """Left joins that skip absent tables and columns already present."""
    grid = B.cells(spark, sf).select("grid_id", "col", "row")
    a = B.clean_footprints(spark, sf).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_buildings"))
    y = B.yearly(spark, sf)
    b = y.select(F.col("grid_id").alias("grid_id_500m"), F.lit(0).alias("col"), F.col("building_count_2001").alias("last_count"))
    return joins.attach(joins.attach(joins.attach(grid, a, "grid_id"), b, "grid_id"), None, "grid_id")


@query(f"""{with_sql('fp')}, a AS (SELECT grid_id, count(*) AS n_tall FROM fp WHERE height_m > 7 AND area_m2 > 1000 GROUP BY 1), b AS (SELECT grid_id, count(*) AS n_tiny FROM fp WHERE area_m2 < 10 GROUP BY 1)
SELECT grid_id, n_tall, n_tiny FROM a FULL JOIN b USING (grid_id)""")
def outer_assembly(spark, sf):
    fp = B.footprints(spark, sf)
    a = fp.where("height_m > 7 AND area_m2 > 1000").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_tall"))
    b = fp.where("area_m2 < 10").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_tiny"))
    return joins.assemble_outer([a, b], "grid_id")


@query(f"""{with_sql('fp', 'cells', 'names')} SELECT region_name AS layer, count(*) AS n, count(DISTINCT grid_id) AS n_cells FROM cells JOIN names USING (district_id) GROUP BY 1""")
def tagged_layer_union(spark, sf):
    """One layer per region, united again with the layer name as a column."""
    cells = joins.lookup_join(B.cells(spark, sf), B.region_names(spark, sf), ["district_id"], "inner")
    regions = [x.r_name for x in B.table(spark, sf, "region").collect()]  # five layer names
    layers = {n: cells.where(F.col("region_name") == n).drop("region_name") for n in regions}
    out = joins.union_tagged(layers, "layer")
    return out.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grid_id").alias("n_cells"))
