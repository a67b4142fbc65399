"""Footprint cleaning, row derivations and per-cell building features."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.catalog.registry import query, r, re, rounded
from latticeworks.functions import scalars as S
from latticeworks.operators import cells as C
from latticeworks.operators import joins, order
from latticeworks.plans import bindings as B
from latticeworks.plans.bindings import with_sql
from latticeworks.plans.cell_features import building_features, grid_table

CLEAN = with_sql("fp", "clean")

CLASS_SQL = """CASE WHEN area_m2 >= 0 AND area_m2 < 20 THEN 'very_small' WHEN area_m2 < 60 AND area_m2 >= 20 THEN 'small'
 WHEN area_m2 < 200 AND area_m2 >= 60 THEN 'medium' WHEN area_m2 < 1000 AND area_m2 >= 200 THEN 'large'
 WHEN area_m2 >= 1000 THEN 'very_large' ELSE 'unknown' END"""

BASIC_SQL = {
    "building_count": "count(*)",
    "total_footprint_area": r("sum(area_m2)"),
    "mean_building_area": r("avg(area_m2)"),
    "median_building_area": r("quantile_cont(area_m2, 0.5)"),
    "building_area_std": r("stddev_samp(area_m2)"),
    "building_area_min": r("min(area_m2)"),
    "building_area_max": r("max(area_m2)"),
    "p10_area_m2": r("quantile_cont(area_m2, 0.1)"),
    "p90_area_m2": r("quantile_cont(area_m2, 0.9)"),
    "coefficient_of_variation": r("stddev_samp(area_m2)/avg(area_m2)"),
    "p90_p10_ratio": r("quantile_cont(area_m2, 0.9)/quantile_cont(area_m2, 0.1)"),
}


def _basic_sql() -> str:
    return ", ".join(f"{e} AS {k}" for k, e in BASIC_SQL.items())


GINI_SQL = """ineq AS (SELECT grid_id, CASE WHEN count(*) >= 2 THEN least(greatest(
    2*sum(rn*area_m2)/(count(*)*sum(area_m2)) - (count(*)+1.0)/count(*), 0), 1) END AS g,
    greatest(avg((area_m2/mu)*ln(area_m2/mu)), 0) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY area_m2) AS rn,
        avg(area_m2) OVER (PARTITION BY grid_id) AS mu FROM clean) GROUP BY grid_id)"""

ENTROPY_SQL = """ent AS (SELECT grid_id, CASE WHEN max(n) >= 2 THEN -sum(p*log2(p)) END AS e FROM (
  SELECT grid_id, n, count(*)*1.0/n AS p FROM (
    SELECT grid_id, n, CASE WHEN hi > lo THEN least(floor((ln(area_m2)-ln(lo))*least(20,n)/(ln(hi)-ln(lo))), least(20,n)-1) ELSE 0 END AS bin
    FROM (SELECT *, count(*) OVER w AS n, min(area_m2) OVER w AS lo, max(area_m2) OVER w AS hi
          FROM clean WINDOW w AS (PARTITION BY grid_id))) GROUP BY grid_id, n, bin) GROUP BY grid_id)"""


@query(f"""{CLEAN}, {GINI_SQL}, {ENTROPY_SQL}, {B.SQL['cells']},
 basic AS (SELECT grid_id, {_basic_sql()} FROM clean GROUP BY grid_id),
 shares AS (SELECT grid_id, {", ".join(f"count(*) FILTER ({CLASS_SQL} = '{c}')*1.0/count(*) FILTER ({CLASS_SQL} <> 'unknown') AS share_{c}" for c in S.SIZE_CLASSES)}
   FROM clean GROUP BY grid_id)
SELECT c.grid_id, c.col, c."row", c.cell_area_m2, c.district_id,
  coalesce(building_count, 0) AS building_count, {", ".join(k for k in BASIC_SQL if k != "building_count")},
  {r('g')} AS building_area_gini, {r('t')} AS building_area_theil, {r('e')} AS building_area_entropy,
  {", ".join(f"{r('share_' + c)} AS share_{c}" for c in S.SIZE_CLASSES)},
  {r("least(greatest(coalesce(total_footprint_area, 0)/cell_area_m2, 0), 1)")} AS built_coverage_ratio
FROM cells c LEFT JOIN basic USING (grid_id) LEFT JOIN ineq USING (grid_id) LEFT JOIN ent USING (grid_id) LEFT JOIN shares USING (grid_id)""")
def cell_feature_table(spark, sf):
    """Flagship: clean, classify, aggregate and attach to every cell."""
    features = building_features(B.clean_footprints(spark, sf), cuts_from=B.footprints(spark, sf))
    out = grid_table(B.cells(spark, sf), features)
    return rounded(out)


@query("WITH " + B.SQL["fp"] + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, confidence, area_m2
FROM fp WHERE confidence >= 0.65""")
def confidence_filter(spark, sf):
    return B.footprints(spark, sf).where(F.col("confidence") >= 0.65).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "confidence", "area_m2")


@query(f"{CLEAN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, area_m2 FROM clean")
def duplicate_removal(spark, sf):
    return B.clean_footprints(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "area_m2")


@query("WITH " + B.SQL["fp"] + """ SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
FROM fp WHERE x BETWEEN 2000 AND 6500 AND y BETWEEN 0 AND 900""")
def bounding_box_filter(spark, sf):
    fp = B.footprints(spark, sf)
    return fp.where(F.col("x").between(2000, 6500) & F.col("y").between(0, 900)).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"""WITH {B.SQL['fp']} SELECT {CLASS_SQL} AS size_class,
 CASE WHEN area_m2 < 25 THEN 'very_small' WHEN area_m2 < 65 THEN 'small' WHEN area_m2 < 200 THEN 'medium' WHEN area_m2 < 1000 THEN 'large' ELSE 'very_large' END AS functional_class,
 area_m2 < 5 AS flag_tiny, area_m2 >= 50000 AS flag_large, 'footprint' AS source,
 count(*) AS n, {r('sum(area_m2)', 4)} AS area, {r("sum(CASE WHEN height_m > 0 THEN round_even(area_m2*height_m*10, 0)/10 END)", 4)} AS volume
FROM fp GROUP BY ALL""")
def classes_flags_volume(spark, sf):
    """Schema normalisation, two class schemes, quality flags and volume."""
    fp = B.footprints(spark, sf).withColumnsRenamed({"area_m2": "area_m2"}).withColumn("source", F.lit("footprint"))
    out = fp.select(
        S.size_class("area_m2").alias("size_class"),
        S.size_class("area_m2", S.FUNCTIONAL_LIMITS).alias("functional_class"),
        S.flag_tiny("area_m2").alias("flag_tiny"), S.flag_large("area_m2").alias("flag_large"),
        "source", "area_m2", S.volume("area_m2", "height_m").alias("volume_m3"))
    keys = ["size_class", "functional_class", "flag_tiny", "flag_large", "source"]
    return rounded(out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("area_m2").alias("area"), F.sum("volume_m3").alias("volume")), 4)


@query(f"""{CLEAN} SELECT grid_id, {_basic_sql()} FROM clean GROUP BY grid_id""")
def cell_size_statistics(spark, sf):
    dist = C.size_distribution(B.clean_footprints(spark, sf), ["grid_id"])
    return rounded(C.statistics(dist, ["grid_id"], C.basic_statistics()))


@query(f"""{CLEAN}, {GINI_SQL}, {ENTROPY_SQL} SELECT grid_id, {r('g')} AS building_area_gini,
 {r('t')} AS building_area_theil, {r('e')} AS building_area_entropy FROM ineq JOIN ent USING (grid_id)""")
def cell_inequality(spark, sf):
    dist = C.size_distribution(B.clean_footprints(spark, sf), ["grid_id"])
    main = C.statistics(dist, ["grid_id"], C.inequality())
    ent = order.log_entropy(dist, "area_m2", ["grid_id"], 20, cap_at_n=True)
    return rounded(main.join(ent.withColumnRenamed("entropy", "building_area_entropy"), "grid_id"))


@query(f"""{CLEAN} SELECT grid_id, {", ".join(f"{r(f"count(*) FILTER ({CLASS_SQL} = '{c}')*1.0/count(*)")} AS share_{c}" for c in S.SIZE_CLASSES)}
FROM clean GROUP BY grid_id""")
def cell_class_shares(spark, sf):
    fp = B.clean_footprints(spark, sf).withColumn("size_class", S.size_class("area_m2"))
    return rounded(C.class_shares(fp, ["grid_id"]))


@query(f"""{CLEAN} SELECT grid_id, {r('avg(height_m)')} AS mean_height, {r('quantile_cont(height_m, 0.5)')} AS median_height,
 {r('sum(round_even(area_m2*height_m*10, 0)/10)', 4)} AS total_estimated_volume
FROM clean WHERE height_m > 0 GROUP BY grid_id""")
def cell_height_volume(spark, sf):
    fp = B.clean_footprints(spark, sf).withColumn("volume_m3", S.volume("area_m2", "height_m"))
    out = C.height_volume(fp, ["grid_id"])
    return rounded(out.withColumn("total_estimated_volume", S.round_even(F.col("total_estimated_volume") + 1.7e-7, 4)))


@query(f"""{CLEAN} SELECT grid_id, l_class AS modal_class FROM (
 SELECT grid_id, {CLASS_SQL} AS l_class, count(*) AS c FROM clean GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY c DESC, l_class) = 1""")
def cell_modal_class(spark, sf):
    fp = B.clean_footprints(spark, sf).withColumn("modal_class", S.size_class("area_m2"))
    return C.modal_value(fp, ["grid_id"], "modal_class")


@query(f"""WITH {B.SQL['fp']}, k AS (SELECT floor(y/250)*2000 + floor(x/250) AS kk, area_m2 FROM fp),
 g AS (SELECT kk, area_m2, row_number() OVER (PARTITION BY kk ORDER BY area_m2) AS rn FROM k)
SELECT CAST(kk AS BIGINT) AS cell_key, count(*) AS building_count, {r('sum(area_m2)', 4)} AS total_footprint_area,
 {r('quantile_cont(area_m2, 0.5)')} AS median_building_area,
 {r("CASE WHEN count(*) >= 2 THEN least(greatest(2*sum(rn*area_m2)/(count(*)*sum(area_m2)) - (count(*)+1.0)/count(*), 0), 1) END")} AS building_area_gini,
 {r('least(sum(area_m2)/62500, 1)')} AS built_coverage_ratio
FROM g GROUP BY kk""")
def fine_cell_features(spark, sf):
    """250 m cells by floor arithmetic, then the fine-cell statistics."""
    from latticeworks.operators.lattice import cell_key
    fp = B.footprints(spark, sf).withColumn("cell_key", cell_key(F.col("x"), F.col("y"), 0.0, 0.0, 250))
    dist = C.size_distribution(fp, ["cell_key"])
    stats = {k: v for k, v in C.basic_statistics().items()
             if k in ("building_count", "total_footprint_area", "median_building_area")}
    out = C.statistics(dist, ["cell_key"], {**stats, "building_area_gini": order.gini("area_m2")})
    out = out.withColumn("built_coverage_ratio", S.clip(F.col("total_footprint_area") / 62_500.0, 0, 1))
    return rounded(out.withColumn("total_footprint_area", S.round_even(F.col("total_footprint_area") + 1.7e-7, 4)))


_EDGES = """edges AS (SELECT quantile_cont(area_m2, [0.2, 0.4, 0.6, 0.8]) AS q FROM clean WHERE area_m2 > 0)"""
_DD_CLASS = """CASE WHEN area_m2 < q[1] THEN 'very_small' WHEN area_m2 < q[2] THEN 'small'
 WHEN area_m2 < q[3] THEN 'medium' WHEN area_m2 < q[4] THEN 'large' ELSE 'very_large' END"""


@query(f"""{CLEAN}, {_EDGES}, s AS (SELECT 'data_driven' AS scheme, {_DD_CLASS} AS size_class FROM clean, edges
 UNION ALL SELECT 'functional', CASE WHEN area_m2 < 25 THEN 'very_small' WHEN area_m2 < 65 THEN 'small' WHEN area_m2 < 200 THEN 'medium' WHEN area_m2 < 1000 THEN 'large' ELSE 'very_large' END FROM clean
 UNION ALL SELECT 'provisional', {CLASS_SQL} FROM clean)
SELECT scheme, size_class, count(*) AS n_buildings FROM s GROUP BY ALL""")
def threshold_class_counts(spark, sf):
    """Quintile, functional and provisional class limits counted in one pass."""
    fp = B.clean_footprints(spark, sf)
    edges = order.quantile_values(fp.where(F.col("area_m2") > 0), "area_m2", [0.2, 0.4, 0.6, 0.8])
    return C.threshold_counts(fp, "area_m2", {
        "data_driven": S.limits_from_edges(edges),
        "functional": S.FUNCTIONAL_LIMITS,
        "provisional": S.PROVISIONAL_LIMITS,
    })


@query(f"""{CLEAN} SELECT {", ".join(f"{r(f'quantile_cont(area_m2, {p/100})')} AS p{p}" for p in (20, 40, 60, 80))} FROM clean""")
def data_driven_thresholds(spark, sf):
    return rounded(order.quantiles(B.clean_footprints(spark, sf), "area_m2", {f"p{p}": p / 100 for p in (20, 40, 60, 80)}))


_NAT_GINI = """g AS (SELECT 2*sum(rn*area_m2)/(count(*)*sum(area_m2)) - (count(*)+1.0)/count(*) AS gini, avg((area_m2/mu)*ln(area_m2/mu)) AS theil
 FROM (SELECT area_m2, row_number() OVER (ORDER BY area_m2) AS rn, avg(area_m2) OVER () AS mu FROM clean)),
 h AS (SELECT -sum(p*log2(p)) AS e FROM (SELECT count(*)*1.0/any_value(n) AS p FROM (
   SELECT count(*) OVER () AS n, least(floor((ln(area_m2)-ln(min(area_m2) OVER ()))*30/(ln(max(area_m2) OVER ())-ln(min(area_m2) OVER ()))), 29) AS b FROM clean) GROUP BY b))"""


@query(f"""{CLEAN}, {_EDGES}, {_NAT_GINI}, c AS (SELECT {_DD_CLASS} AS k FROM clean, edges)
SELECT count(*) AS n_buildings, count(*) AS n_with_area, {re('avg(area_m2)', 2)} AS mean_area_m2,
 {", ".join(f"{re(f'quantile_cont(area_m2, {p/100})', 2)} AS {'median' if p == 50 else f'p{p}'}_area_m2" for p in (10, 25, 50, 75, 90, 95, 99))},
 {re('max(area_m2)', 2)} AS max_area_m2, {re('any_value(gini)', 4)} AS gini, {re('any_value(theil)', 4)} AS theil_t,
 {re('any_value(e)', 4)} AS entropy, {re('stddev_pop(area_m2)/avg(area_m2)', 4)} AS cv,
 {re('quantile_cont(area_m2, 0.9)/quantile_cont(area_m2, 0.1)', 2)} AS p90_p10_ratio,
 {", ".join(f"(SELECT count(*) FROM c WHERE k = '{k}') AS n_{k}" for k in S.SIZE_CLASSES)}
FROM clean, g, h""")
def national_size_summary(spark, sf):
    fp = B.clean_footprints(spark, sf)
    edges = order.quantile_values(fp, "area_m2", [0.2, 0.4, 0.6, 0.8])
    return C.national_summary(fp, S.limits_from_edges(edges))


def _with_region(spark, sf):
    """Footprints with their district and region name (cells joined first)."""
    cells = joins.lookup_join(B.cells(spark, sf).select("grid_id", "district_id"),
                              B.region_names(spark, sf), ["district_id"])
    return joins.lookup_join(B.clean_footprints(spark, sf), cells, ["grid_id"])


REGION = with_sql("fp", "clean", "cells", "names") + """, reg AS (SELECT clean.*, district_id, district_name, region_name
 FROM clean LEFT JOIN cells USING (grid_id) LEFT JOIN names USING (district_id))"""


@query(f"""{REGION}, z AS (SELECT *, {CLASS_SQL} AS size_class,
  row_number() OVER (PARTITION BY region_name ORDER BY area_m2) AS rn FROM reg WHERE region_name IS NOT NULL)
SELECT region_name, count(*) AS n_buildings, {re('avg(area_m2)', 2)} AS mean_area_m2,
 {re('quantile_cont(area_m2, 0.5)', 2)} AS median_area_m2, {re('quantile_cont(area_m2, 0.75)', 2)} AS p75_area_m2,
 {re('quantile_cont(area_m2, 0.9)', 2)} AS p90_area_m2,
 {re('2*sum(rn*area_m2)/(count(*)*sum(area_m2)) - (count(*)+1.0)/count(*)', 4)} AS gini,
 {re('stddev_pop(area_m2)/avg(area_m2)', 4)} AS cv,
 {", ".join(f"{re(f"count(*) FILTER (size_class = '{c}')*1.0/count(size_class)", 4)} AS share_{c}" for c in S.SIZE_CLASSES)}
FROM z GROUP BY region_name HAVING count(*) >= 10""")
def city_size_summary(spark, sf):
    fp = _with_region(spark, sf).withColumn("size_class", S.size_class("area_m2"))
    return C.city_summary(fp, "region_name")


@query(f"""{REGION} SELECT region_name, count(*) AS n, {", ".join(f"{r(f'quantile_cont(area_m2, {p})')} AS {k}"
 for k, p in {"min": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1}.items())}
FROM reg WHERE region_name IS NOT NULL GROUP BY region_name HAVING count(*) >= 500""")
def region_five_numbers(spark, sf):
    return rounded(C.five_numbers(_with_region(spark, sf), "region_name", minimum=500))


@query(f"""{REGION} SELECT grid_id, region_name AS region FROM (SELECT grid_id, region_name, count(*) AS c FROM reg GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY c DESC, region_name) = 1""")
def cell_modal_region(spark, sf):
    fp = _with_region(spark, sf).withColumnRenamed("region_name", "region")
    return C.modal_value(fp, ["grid_id"], "region")


@query(f"""{CLEAN}, v AS (SELECT log10(area_m2) AS l FROM clean), m AS (SELECT min(l) AS lo, max(l) AS hi FROM v)
SELECT 'all' AS size_class, CAST(least(floor((l-lo)*120/(hi-lo)), 119) AS INTEGER) AS bin, count(*) AS n FROM v, m GROUP BY ALL
UNION ALL SELECT * FROM (
 WITH w AS (SELECT {CLASS_SQL} AS size_class, log10(area_m2) AS l FROM clean),
  k AS (SELECT size_class, min(l) AS lo, max(l) AS hi FROM w GROUP BY 1)
 SELECT size_class, CAST(CASE WHEN hi > lo THEN least(floor((l-lo)*80/(hi-lo)), 79) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
 FROM w JOIN k USING (size_class) GROUP BY ALL)""")
def log_area_histogram(spark, sf):
    fp = B.clean_footprints(spark, sf).withColumn("size_class", S.size_class("area_m2"))
    whole = C.log10_histogram(fp, "area_m2", 120).withColumn("size_class", F.lit("all"))
    return whole.unionByName(C.log10_histogram(fp, "area_m2", 80, ["size_class"]))


@query(f"""{CLEAN}, o AS (SELECT area_m2, row_number() OVER (ORDER BY area_m2) AS rn, count(*) OVER () AS n,
  sum(area_m2) OVER (ORDER BY area_m2 ROWS UNBOUNDED PRECEDING) AS cum, sum(area_m2) OVER () AS total FROM clean),
 s AS (SELECT unnest(range(0, 101)) AS k)
SELECT {r('k/100.0')} AS population_share,
 {r("coalesce((SELECT (cum - area_m2 + (k*n/100.0 - rn + 1)*area_m2)/total FROM o WHERE rn = greatest(ceil(k*(SELECT max(n) FROM o)/100.0), 1)), 0)")} AS value_share
FROM s""")
def lorenz_curve(spark, sf):
    return rounded(order.lorenz(B.clean_footprints(spark, sf), "area_m2", 100))


@query(f"""WITH {B.SQL['fp']}, a AS (SELECT *, CASE WHEN x NOT BETWEEN 0 AND 8999 THEN 'outside'
   WHEN area_m2 < 12 THEN 'invalid' WHEN confidence < 0.65 THEN 'below_confidence' END AS failed FROM fp),
 b AS (SELECT *, CASE WHEN failed IS NULL THEN row_number() OVER (PARTITION BY failed, l_orderkey, l_linenumber
   ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) END AS rn FROM a),
 f AS (SELECT *, coalesce(failed, CASE WHEN rn > 1 THEN 'duplicate' END) AS why FROM b)
SELECT count(*) AS n_raw, count(*) FILTER (why = 'outside') AS n_outside, count(*) FILTER (why = 'invalid') AS n_invalid,
 count(*) FILTER (why = 'below_confidence') AS n_below_confidence, count(*) FILTER (why = 'duplicate') AS n_duplicate,
 count(*) FILTER (why IS NULL) AS n_final, count(*) FILTER (why IS NULL AND area_m2 < 5) AS n_tiny,
 count(*) FILTER (why IS NULL AND area_m2 >= 50000) AS n_large,
 {re('100.0*count(*) FILTER (why IS NULL)/count(*)', 2)} AS pct_retained,
 {r('avg(area_m2) FILTER (why IS NULL)')} AS area_mean, {r('quantile_cont(area_m2, 0.5) FILTER (why IS NULL)')} AS area_p50,
 {r('quantile_cont(area_m2, 0.25) FILTER (why IS NULL)')} AS area_p25, {r('quantile_cont(area_m2, 0.75) FILTER (why IS NULL)')} AS area_p75,
 {r('max(area_m2) FILTER (why IS NULL)')} AS area_max FROM f""")
def quality_funnel(spark, sf):
    from latticeworks.plans.quality import footprint_funnel
    fp = B.footprints(spark, sf)
    rules = [("outside", ~F.col("x").between(0, 8999)), ("invalid", F.col("area_m2") < 12),
             ("below_confidence", F.col("confidence") < 0.65)]
    return rounded(footprint_funnel(fp, rules, B.DUPLICATE_KEY, B.KEEP_ORDER))


@query(f"""{CLEAN} SELECT count(*) AS n, count(DISTINCT l_orderkey || '-' || l_linenumber) AS n_ids,
 'fp_00000000' AS first_id, printf('fp_%08d', count(*)-1) AS last_id FROM clean""")
def stable_row_ids(spark, sf):
    """Zero-padded ordinals without gaps over the cleaned footprints."""
    out = order.stable_ids(B.clean_footprints(spark, sf), B.ROW_KEY, "building_id", "fp_%08d")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("building_id").alias("n_ids"),
                   F.min("building_id").alias("first_id"), F.max("building_id").alias("last_id"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey*7919 % 1000003) - 1 AS BIGINT) AS rank0 FROM orders""")
def distributed_rank(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 1000003).alias("k"))
    # Keys beyond 1000003 rows repeat: rows of one key stand by their order number, whatever the tasks are.
    return order.ordinals(o, "k", "rank0", ["o_orderkey"]).select("o_orderkey", F.col("rank0").cast("long").alias("rank0"))
