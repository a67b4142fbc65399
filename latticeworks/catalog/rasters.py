"""Pixel tables, zonal statistics, resampling, epochs and yearly change."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.catalog.registry import query, r, re, rounded
from latticeworks.functions import scalars as S
from latticeworks.operators import lattice as L
from latticeworks.operators import temporal as T
from latticeworks.plans import bindings as B
from latticeworks.plans import quality
from latticeworks.plans.bindings import EPOCHS, YEARS, with_sql
from latticeworks.sources import lookups

PX = with_sql("px")


def _sum(c: str) -> str:
    return f"sum(CAST({c} AS DECIMAL(28,8)))::DOUBLE"


def _mean(c: str) -> str:
    return f"{_sum(c)}/count({c})"


@query(f"""{PX} SELECT col, "row", {r('gross')} AS gross, {r('net')} AS net,
 {r('CASE WHEN net > 0 THEN gross/net ELSE 0 END')} AS fraction FROM px""")
def pixel_table(spark, sf):
    """Nodata becomes null, zero stays zero; the built fraction is derived."""
    px = B.pixels(spark, sf)
    return rounded(px.select("col", "row", "gross", "net", S.built_fraction("gross", "net").alias("fraction")))


HEIGHT_SQL = with_sql("px", "zones") + """, z AS (SELECT zcol, zrow, count(*) AS n_src, count(gross) AS n_ok,
  sum(gross) AS g, sum(fraction_raw) FILTER (gross IS NOT NULL) AS f FROM px GROUP BY ALL),
 heights AS (SELECT zones.*, coalesce(n_src, 0) AS n_source_pixels, coalesce(n_ok, 0) AS n_valid_pixels,
  coalesce(n_src - n_ok, 0) AS n_nodata_pixels,
  CASE WHEN n_ok > 0 THEN """ + re("g/n_ok", 6) + """ END AS cell_agbh_mean_m,
  CASE WHEN n_ok > 0 THEN """ + re("f/n_ok", 6) + """ END AS cell_built_fraction_mean,
  CASE WHEN n_ok > 0 THEN CASE WHEN f > 0 THEN """ + re("g/f", 6) + """ ELSE 0 END END AS cell_anbh_derived_m
  FROM zones LEFT JOIN z USING (zcol, zrow))"""


def heights(spark, sf):
    """Grid of 5 x 5 pixel cells with mean gross height, fraction, net height."""
    return L.height_zonal(B.zones(spark, sf), B.pixels(spark, sf), ["zcol", "zrow"], "gross", "fraction_raw")


@query(f"""{HEIGHT_SQL} SELECT grid_id, n_source_pixels, n_valid_pixels, n_nodata_pixels,
 {r('cell_agbh_mean_m', 5)} AS cell_agbh_mean_m, {r('cell_built_fraction_mean', 5)} AS cell_built_fraction_mean,
 {r('cell_anbh_derived_m', 5)} AS cell_anbh_derived_m FROM heights""")
def zonal_height(spark, sf):
    return rounded(heights(spark, sf).drop("zcol", "zrow", "lon", "lat"), 5)


SECOND_SQL = """sp AS (SELECT zcol, zrow, CASE WHEN NOT second_nodata AND height_code > 0 AND height_code*0.1::DOUBLE >= 1.0
   AND fraction_code > 0 AND fraction_code <= 100 THEN 1 END AS ok, height_code*0.1::DOUBLE AS h, fraction_code/100.0::DOUBLE AS f FROM px),
 sz AS (SELECT zcol, zrow, count(*) AS n, coalesce(sum(h*f) FILTER (ok = 1), 0) AS hf, coalesce(sum(f) FILTER (ok = 1), 0) AS f FROM sp GROUP BY ALL),
 second AS (SELECT grid_id, zcol, zrow, CASE WHEN f > 0 THEN hf/f END AS net_height_m, CASE WHEN n > 0 THEN hf/n END AS gross_height_m,
   CASE WHEN n > 0 THEN f/n END AS building_fraction FROM zones LEFT JOIN sz USING (zcol, zrow))"""


def second_product(spark, sf, min_height: float = 1.0):
    """Second height product: placeholder codes dropped, fraction-weighted."""
    h, f = F.col("height_code") * 0.1, F.col("fraction_code") / 100
    ok = ~F.col("second_nodata") & (F.col("height_code") > 0) & (h >= min_height) & F.col(
        "fraction_code").between(1, 100)
    px = B.pixels(spark, sf).select("zcol", "zrow", F.when(ok, h).alias("h"), F.when(ok, f).alias("f"))
    return L.weighted_product(B.zones(spark, sf), px, ["zcol", "zrow"], "h", "f")


@query(f"""{with_sql("px", "zones")}, {SECOND_SQL} SELECT grid_id, {r('net_height_m')} AS net_height_m,
 {r('gross_height_m')} AS gross_height_m, {r('building_fraction')} AS building_fraction FROM second""")
def weighted_second_product(spark, sf):
    return rounded(second_product(spark, sf).drop("zcol", "zrow", "lon", "lat"))


@query(f"""{PX} SELECT zcol, zrow, {re('sum(population)', 1)} AS population_count, {re('sum(population)/0.25', 1)} AS population_density
FROM px GROUP BY ALL""")
def population_by_cell(spark, sf):
    sums = L.zonal(B.pixels(spark, sf), ["zcol", "zrow"], {"p": F.sum("population")})
    return sums.select("zcol", "zrow", S.round_even("p", 1).alias("population_count"),
                       S.round_even(F.col("p") / 0.25, 1).alias("population_density"))


@query(f"""{with_sql("px", "zones")} SELECT grid_id, {r('net')} AS net FROM zones LEFT JOIN px
 ON px.col = zones.zcol*5 + 2 AND px."row" = zones.zrow*5 + 2""")
def point_sample(spark, sf):
    """Pixel under each cell centre."""
    at = {"col": F.col("zcol") * 5 + 2, "row": F.col("zrow") * 5 + 2}
    out = L.sample_at(B.zones(spark, sf), B.pixels(spark, sf), at, "net", "net")
    return rounded(out.select("grid_id", "net"))


@query(f"""{PX}, v AS (SELECT *, coalesce(greatest(CASE WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE population/100 END, 0), 0) AS v FROM px)
SELECT col, "row", {re('v', 4)} AS ntl_avg_rad FROM v""")
def night_light_sample(spark, sf):
    """Negatives and nodata become zero."""
    px = B.pixels(spark, sf)
    key = F.col("row") * B.PIXEL_COLS + F.col("col")
    raw = F.when(key % 11 == 0, -1.0).otherwise(F.col("population") / 100)
    return px.select("col", "row", S.round_even(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), 4).alias("ntl_avg_rad"))


@query(f"""{PX}, t AS (SELECT CAST(unnest(range(0, 60)) AS BIGINT) AS tcol), u AS (SELECT DISTINCT CAST(floor("row"*100/230) AS BIGINT) AS trow FROM px)
SELECT tcol, trow, {r('net')} AS net FROM t, u JOIN px ON px.col = floor((tcol + 0.5)*230/100) AND px."row" = floor((trow + 0.5)*230/100)
WHERE (tcol+0.5)*230 < 12500""")
def resample_to_nearest(spark, sf):
    """100 m pixels onto a 230 m lattice by target centre."""
    px = B.pixels(spark, sf).select("col", "row", "net")
    rows = px.select(F.floor(F.col("row") * 100 / 230).cast("long").alias("trow")).distinct()
    targets = rows.withColumn("tcol", F.explode(F.sequence(F.lit(0), F.lit(59)).cast("array<long>")))
    targets = targets.where((F.col("tcol") + 0.5) * 230 < 12_500)
    at = {k: F.floor((F.col(f"t{k}") + 0.5) * 230 / 100).cast("long") for k in ("col", "row")}
    out = L.resample_nearest(targets, px, at, "net")
    return rounded(out.where(F.col("net").isNotNull()).select("tcol", "trow", "net"))


@query(f"""{PX}, w AS (SELECT tc AS tcol, tr AS trow, gross,
  (least(col*100 + 100, (tc+1)*150) - greatest(col*100, tc*150))*(least("row"*100 + 100, (tr+1)*150) - greatest("row"*100, tr*150)) AS w
 FROM (SELECT *, unnest(list_distinct([(col*100)//150, (col*100+99)//150])) AS tc FROM px) p,
  LATERAL (SELECT unnest(list_distinct([("row"*100)//150, ("row"*100+99)//150])) AS tr)
 WHERE gross IS NOT NULL)
SELECT tcol, trow, {r('sum(w*gross)/sum(w)')} AS gross FROM w GROUP BY ALL""")
def resample_to_average(spark, sf):
    """100 m pixels onto a 150 m lattice, overlap-weighted, nodata left out."""
    out = L.resample_average(B.pixels(spark, sf).select("col", "row", "gross"), "gross", 100.0, 150.0)
    return rounded(out.where(F.col("gross").isNotNull()))


@query(f"""{PX}, s AS (SELECT col, "row", coalesce(gross, 0) AS c,
  lag(coalesce(gross, 0)) OVER (PARTITION BY "row" ORDER BY col) AS w, lead(coalesce(gross, 0)) OVER (PARTITION BY "row" ORDER BY col) AS e,
  lag(coalesce(gross, 0)) OVER (PARTITION BY col ORDER BY "row") AS s, lead(coalesce(gross, 0)) OVER (PARTITION BY col ORDER BY "row") AS n FROM px)
SELECT col, "row", {r('''degrees(atan(sqrt(
 pow(CASE WHEN w IS NOT NULL AND e IS NOT NULL THEN (e-w)/200.0 WHEN e IS NOT NULL THEN (e-c)/100.0 WHEN w IS NOT NULL THEN (c-w)/100.0 ELSE 0 END, 2) +
 pow(CASE WHEN s IS NOT NULL AND n IS NOT NULL THEN (n-s)/200.0 WHEN n IS NOT NULL THEN (n-c)/100.0 WHEN s IS NOT NULL THEN (c-s)/100.0 ELSE 0 END, 2))))''')} AS slope_deg FROM s""")
def terrain_slope(spark, sf):
    return rounded(L.slope_degrees(B.pixels(spark, sf), "gross", 100.0, 100.0))


# --- epochs -----------------------------------------------------------------------

_COV = {e: f"least(greatest(built_{e}/10000, 0), 1)" for e in EPOCHS}
_FIRST = "least(" + ", ".join(f"CASE WHEN {_COV[e]} >= 0.01 THEN {e} END" for e in EPOCHS) + ")"
_AGE = f"""CASE WHEN e0 <= 1975 THEN 'pre_1975' WHEN e0 <= 1990 THEN '1975_1990' WHEN e0 <= 2000 THEN '1990_2000'
 WHEN e0 <= 2010 THEN '2000_2010' WHEN e0 <= 2020 THEN '2010_2020' ELSE 'not_built' END"""
BUILT_SQL = f"""aged AS (SELECT *, {_AGE} AS age FROM (SELECT *, {_FIRST} AS e0 FROM stack)),
 built0 AS (SELECT zcol, zrow, {", ".join(f"{re(f'coalesce(sum(built_{e}), 0)', 1)} AS built_surface_m2_{e}, {re(f'avg({_COV[e]})', 4)} AS built_coverage_{e}" for e in EPOCHS)},
  {", ".join(f"{re(f"count(*) FILTER (age = '{k}')*1.0/count(*)", 4)} AS share_{k}, count(*) FILTER (age = '{k}') AS n_{k}" for k in S.AGE_CLASSES)}
  FROM aged GROUP BY ALL),
 built1 AS (SELECT *, CASE greatest({", ".join(f"n_{k}" for k in S.AGE_CLASSES)})
  {" ".join(f"WHEN n_{k} THEN '{k}'" for k in S.AGE_CLASSES)} END AS dominant_age_class,
  {re('coalesce(built_coverage_2020, 0) - coalesce(built_coverage_1975, 0)', 4)} AS long_term_growth,
  {re('coalesce(built_coverage_2020, 0) - coalesce(built_coverage_2010, 0)', 4)} AS recent_growth_2010,
  CASE WHEN coalesce(built_coverage_1975, 0) > 0 THEN {re('(coalesce(built_coverage_2020, 0) - built_coverage_1975)/built_coverage_1975*100', 2)} END AS long_term_growth_rate_pct FROM built0),
 built AS (SELECT * EXCLUDE ({", ".join(f"n_{k}" for k in S.AGE_CLASSES)}), CASE WHEN share_not_built > 0.9 THEN 'undeveloped'
  WHEN share_not_built > 0.5 AND recent_growth_2010 > 0.01 THEN 'emerging_frontier'
  WHEN dominant_age_class = '2010_2020' THEN 'active_expansion' WHEN dominant_age_class IN ('pre_1975', '1975_1990') THEN 'established_urban'
  WHEN dominant_age_class IN ('1990_2000', '2000_2010') THEN 'consolidating_urban' WHEN share_not_built < 0.9 THEN 'sparsely_built'
  ELSE 'undeveloped' END AS urban_expansion_phase FROM built1)"""


def built_up(spark, sf):
    cells = T.built_up_by_cell(B.epoch_stack(spark, sf), ["zcol", "zrow"], EPOCHS)
    return T.expansion_phases(T.built_up_change(cells, EPOCHS))


@query(f"{with_sql('stack')}, {BUILT_SQL} SELECT * FROM built")
def built_up_epochs(spark, sf):
    """Epoch coverage, age mix, change metrics and expansion phase per cell."""
    return built_up(spark, sf)


@query("""SELECT l_orderkey % 125 AS col, l_orderkey // 125 AS "row", """ + ", ".join(
    f"{r(f'sum(l_extendedprice) FILTER (year(l_shipdate) = {y})')} AS built_{y}" for y in YEARS)
    + " FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY l_orderkey")
def multi_epoch_stack(spark, sf):
    """Long pixel table -> one band per available year."""
    px = B.table(spark, sf, "lineitem").groupBy("l_orderkey", F.year("l_shipdate").alias("epoch")).agg(
        F.sum("l_extendedprice").alias("built"))
    present, _ = T.available_epochs(px, "epoch", [*YEARS, 2030])
    wide = T.pivot_epochs(px.where(F.col("epoch").isin(present)), ["l_orderkey"], "epoch", "built", present, "built_")
    at = B.pixel_index(F.col("l_orderkey"))
    return rounded(wide.select(at["col"].alias("col"), at["row"].alias("row"), *[f"built_{y}" for y in present]))


@query("""SELECT CAST(y AS INTEGER) AS epoch, EXISTS (SELECT 1 FROM lineitem WHERE year(l_shipdate) = y) AS available
FROM (SELECT unnest([1990, 1995, 1998, 2001, 2030]) AS y)""")
def epoch_availability(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("epoch"))
    present, missing = T.available_epochs(li, "epoch", [1990, 1995, 1998, 2001, 2030])
    return spark.createDataFrame([(e, True) for e in present] + [(e, False) for e in missing], "epoch int, available boolean")


BOXES_SQL = "CASE " + " ".join(
    f"WHEN lon BETWEEN {x0} AND {x1} AND lat BETWEEN {y0} AND {y1} THEN '{n}'" for n, x0, y0, x1, y1 in lookups.boxes()) + " END"


def zone_regions(spark, sf):
    z = B.zones(spark, sf)
    return z.withColumn("region", S.first_box(F.col("lon"), F.col("lat"), lookups.boxes()))


@query(f"{with_sql('zones')} SELECT grid_id, {BOXES_SQL} AS region FROM zones")
def region_first_match(spark, sf):
    return zone_regions(spark, sf).select("grid_id", "region")


@query(f"""{with_sql('stack', 'zones')}, {BUILT_SQL} SELECT region, count(*) AS n_cells,
 {", ".join(f"{re(_mean(f'built_coverage_{e}'), 4)} AS mean_built_coverage_{e}, {re(_sum(f'built_surface_m2_{e}') + '/1e6', 2)} AS total_built_surface_km2_{e}" for e in EPOCHS)},
 {re(_mean('long_term_growth'), 4)} AS mean_long_term_growth, {re(_mean('recent_growth_2010'), 4)} AS mean_recent_growth
FROM (SELECT *, {BOXES_SQL} AS region FROM zones) LEFT JOIN built USING (zcol, zrow) WHERE region IS NOT NULL GROUP BY region""")
def built_up_city_summary(spark, sf):
    joined = zone_regions(spark, sf).join(built_up(spark, sf), ["zcol", "zrow"], "left")
    return T.built_up_summary(joined, "region", EPOCHS)


_C = {y: f"building_count_{y}" for y in YEARS}
_REL_C = "(building_count_2001 - building_count_1995)/(building_count_1995 + 1e-6::DOUBLE)"
_REL_H = "(mean_height_2001 - mean_height_1995)/(mean_height_1995 + 1e-6::DOUBLE)"
_STEPS = [f"(building_count_{b} - building_count_{a})" for a, b in zip(YEARS, YEARS[1:])]
CHANGE_SQL = f"""ch0 AS (SELECT *, {re('building_count_2001 - building_count_1995', 2)} AS building_count_change,
  {re('mean_height_2001 - mean_height_1995', 2)} AS height_change, {re(f'{_REL_C}*100', 2)} AS building_growth_rate,
  {re(f'{_REL_H} - {_REL_C}', 4)} AS vertical_growth_index,
  CAST(CASE WHEN greatest({", ".join(_STEPS)}) > 0 THEN CASE greatest({", ".join(_STEPS)}) {" ".join(f"WHEN {s} THEN {y}" for y, s in zip(YEARS, _STEPS))} END END AS INTEGER) AS peak_growth_year FROM yearly),
 change AS (SELECT *, CASE WHEN building_growth_rate > 50 AND vertical_growth_index < -0.1 THEN 'rapid_horizontal_expansion'
  WHEN building_growth_rate > 50 AND vertical_growth_index > 0.1 THEN 'rapid_vertical_intensification'
  WHEN building_growth_rate > 50 THEN 'rapid_growth_mixed' WHEN building_growth_rate > 10 THEN 'moderate_growth'
  WHEN vertical_growth_index > 0.1 AND building_growth_rate <= 10 THEN 'vertical_intensification' ELSE 'stable_or_no_data' END AS growth_class FROM ch0)"""


@query(f"""{with_sql('fp', 'yearly')}, {CHANGE_SQL} SELECT grid_id, building_count_change, height_change, building_growth_rate,
 vertical_growth_index, peak_growth_year, growth_class FROM change""")
def temporal_indicators(spark, sf):
    out = T.change_indicators(B.yearly(spark, sf), YEARS)
    return out.select("grid_id", "building_count_change", "height_change", "building_growth_rate",
                      "vertical_growth_index", "peak_growth_year", "growth_class")


@query(f"""{with_sql('fp', 'yearly', 'cells', 'names')}, {CHANGE_SQL} SELECT region_name, count(*) AS n_cells,
 {", ".join(f"{re(_sum(f'building_count_{y}'), 0)} AS total_building_count_{y}, {re(_mean(f'building_count_{y}'), 2)} AS mean_building_count_{y}, {re(_mean(f'mean_height_{y}'), 2)} AS mean_height_{y}" for y in YEARS)},
 {re(_sum('building_count_change'), 0)} AS building_count_change, {re(_mean('building_growth_rate'), 2)} AS mean_growth_rate,
 {re(_mean('vertical_growth_index'), 4)} AS mean_vgi
FROM cells JOIN names USING (district_id) LEFT JOIN change USING (grid_id) GROUP BY region_name""")
def temporal_city_summary(spark, sf):
    from latticeworks.operators.joins import lookup_join
    cells = lookup_join(B.cells(spark, sf), B.region_names(spark, sf), ["district_id"], "inner")
    joined = cells.join(T.change_indicators(B.yearly(spark, sf), YEARS), "grid_id", "left")
    return T.temporal_summary(joined, "region_name", YEARS)


@query(f"""{with_sql('fp', 'yearly')}, u AS ({" UNION ALL ".join(f"SELECT {y} AS year, building_count_{y} AS c, mean_height_{y} AS h, building_count_1995 + building_count_2001 AS n FROM yearly" for y in YEARS)})
SELECT CAST(year AS INTEGER) AS year, count(h) AS n_cells, {r('avg(h)')} AS mean_height_mean_m, {r('quantile_cont(h, 0.5)')} AS mean_height_median_m,
 {r('quantile_cont(h, 0.99)')} AS mean_height_p99_m, {r('max(h)')} AS mean_height_max_m, {r('avg(c)')} AS fractional_count_mean,
 {r('max(c)')} AS fractional_count_max, {r('avg(n)')} AS footprints_per_cell_mean FROM u WHERE n > 0 GROUP BY year""")
def yearly_magnitude_check(spark, sf):
    y = B.yearly(spark, sf).withColumn("footprints", F.col("building_count_1995") + F.col("building_count_2001"))
    return rounded(T.yearly_magnitudes(y, YEARS, "footprints"))


# --- pixel checks -----------------------------------------------------------------


@query(f"""{PX}, g AS (SELECT * REPLACE (net*fraction_raw AS gross) FROM px WHERE o_orderkey % 97 <> 5), f AS (SELECT *, CASE WHEN net > 0 THEN gross/net END AS fr FROM g),
 c AS (SELECT count(*) FILTER (gross > net) AS over, coalesce(max(gross - net) FILTER (gross > net), 0) AS worst, max(fr) AS fmax, min(fr) AS fmin,
  max(gross) AS gmax, max(net) AS nmax, avg(net) FILTER (net > 0) AS nmean, count(*) FILTER ((gross = 0) <> (net = 0)) AS zm,
  count(*) FILTER (gross IS NULL) AS gnull, count(*) FILTER (net IS NULL) AS nnull, count(*) FILTER (gross < 0) AS gneg, count(*) FILTER (net < 0) AS nneg FROM f)
SELECT "check", {r('observed', 5)} AS observed, passed FROM (
 SELECT 'gross_null' AS "check", gnull::DOUBLE AS observed, gnull = 0 AS passed FROM c UNION ALL SELECT 'net_null', nnull, nnull = 0 FROM c
 UNION ALL SELECT 'gross_negative', gneg, gneg = 0 FROM c UNION ALL SELECT 'net_negative', nneg, nneg = 0 FROM c
 UNION ALL SELECT 'zero_mismatch', zm, zm = 0 FROM c UNION ALL SELECT 'gross_above_net_count', over, over <= 1 FROM c
 UNION ALL SELECT 'gross_above_net_worst', worst, worst <= 0.06 FROM c UNION ALL SELECT 'fraction_max', fmax, fmax <= 1.001 FROM c
 UNION ALL SELECT 'fraction_min', fmin, fmin >= 0 FROM c UNION ALL SELECT 'gross_max', gmax, gmax < 200 FROM c
 UNION ALL SELECT 'net_max', nmax, nmax < 400 FROM c UNION ALL SELECT 'net_mean_built', nmean, nmean BETWEEN 0.5 AND 20 FROM c)""")
def pixel_expectation_report(spark, sf):
    """The checks read the raw band; only pixels that hold the declared nodata value are left out."""
    px = B.pixels(spark, sf).where(~F.col("gross_raw").eqNullSafe(F.lit(B.NODATA)))
    return rounded(quality.pixel_expectations(px, "gross_raw", "net"), 5)


@query(f"""{HEIGHT_SQL}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM part) AS want,
  count(*) FILTER ((n_valid_pixels = 0 AND cell_anbh_derived_m IS NOT NULL) OR (n_valid_pixels > 0 AND (cell_agbh_mean_m IS NULL OR cell_anbh_derived_m IS NULL))) AS wrong,
  count(*) FILTER (cell_agbh_mean_m > cell_anbh_derived_m + 1e-6) AS broken, min(cell_built_fraction_mean) AS f0, max(cell_built_fraction_mean) AS f1,
  max(cell_anbh_derived_m) AS h FROM heights)
SELECT "check", {r('observed', 5)} AS observed, passed FROM (
 SELECT 'cell_rows' AS "check", n::DOUBLE AS observed, n = want AS passed FROM c UNION ALL SELECT 'nodata_is_null', wrong, wrong = 0 FROM c
 UNION ALL SELECT 'cell_identity', broken, broken = 0 FROM c UNION ALL SELECT 'cell_fraction_min', f0, f0 >= 0 FROM c
 UNION ALL SELECT 'cell_fraction_max', f1, f1 <= 1.001 FROM c UNION ALL SELECT 'implied_height_max', h, h < 60 FROM c)""")
def cell_expectation_report(spark, sf):
    h = heights(spark, sf).withColumn("n_source_pixels", F.col("n_valid_pixels"))
    return rounded(quality.cell_expectations(h, B.table(spark, sf, "part").count()), 5)


@query(f"""{PX}, d AS (SELECT 'envelope' AS domain, * FROM px WHERE gross IS NOT NULL UNION ALL SELECT 'boundary', * FROM px WHERE gross IS NOT NULL AND col BETWEEN 20 AND 100),
 e AS (SELECT i, i*0.05::DOUBLE AS lo, (i+1)*0.05::DOUBLE AS hi FROM (SELECT unnest(range(0, 199)) AS i)),
 b AS (SELECT domain, i, count(*) AS c FROM d JOIN e ON net > 0 AND net >= lo AND (net < hi OR (i = 198 AND net = hi)) GROUP BY ALL),
 m AS (SELECT domain, i, c FROM b QUALIFY row_number() OVER (PARTITION BY domain ORDER BY c DESC, i) = 1),
 s AS (SELECT domain, count(*) AS n_pixels, count(*) FILTER (net > 0) AS n_built, count(*) FILTER (net = 0 AND gross = 0) AS n_zero_both,
  count(*) FILTER ((net = 0) <> (gross = 0)) AS n_zero_mismatch, count(*) FILTER (gross > net) AS n_gross_above FROM d GROUP BY domain)
SELECT domain, n_pixels, n_built, {r('i*0.05::DOUBLE')} AS modal_bin_lo, c AS n_modal, {r('100.0*c/n_built')} AS pct_modal,
 n_zero_both, n_zero_mismatch, n_gross_above, {r('100.0*(1 - n_gross_above*1.0/n_pixels)')} AS pct_gross_le_net FROM s JOIN m USING (domain)""")
def modal_bin_concentration(spark, sf):
    from latticeworks.operators.profiles import modal_bin
    px = B.pixels(spark, sf).where(F.col("gross").isNotNull())
    return rounded(modal_bin(px, {"envelope": F.lit(True), "boundary": F.col("col").between(20, 100)}, "net", "gross", 0.05, 199))
