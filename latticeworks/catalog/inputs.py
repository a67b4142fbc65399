"""Source handling, scalar rules and assembly checks on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.catalog.geometry import _supplier_points, zone_points
from latticeworks.catalog.registry import query, r, re, rounded
from latticeworks.catalog.rasters import BOXES_SQL, heights, HEIGHT_SQL, zone_regions
from latticeworks.catalog.tables import cell_table
from latticeworks.functions import scalars as S
from latticeworks.operators import lattice
from latticeworks.plans import bindings as B
from latticeworks.plans import covariates as COV
from latticeworks.plans import quality
from latticeworks.plans.bindings import with_sql
from latticeworks.sources import lookups, readers, sinks


@query("""SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS floors, TRY_CAST(p_name AS DOUBLE) AS height,
 NULL::VARCHAR AS "class" FROM part""")
def pruned_read_with_optional_columns(spark, sf):
    """Column-pruned read; bad text and absent columns become typed nulls."""
    df = readers.pruned_parquet(spark, f"{sf}/part.parquet", ["p_partkey", "p_brand"], {"p_name": "double", "class": "string"})
    return df.select("p_partkey", S.lenient_double(F.substring("p_brand", 7, 10)).alias("floors"), F.col("p_name").alias("height"), "class")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('CASE WHEN l_tax > 0 THEN l_discount/l_tax END')} AS ratio_null,
 {r('CASE WHEN l_tax > 0 THEN l_discount/l_tax ELSE 0 END')} AS ratio_zero, {r('least(CASE WHEN l_tax > 0 THEN l_discount/l_tax ELSE 0 END, 1)')} AS ratio_clipped,
 {r('ln(1+l_quantity)')} AS log_quantity FROM lineitem""")
def guarded_ratios(spark, sf):
    li = B.table(spark, sf, "lineitem")
    a, b = F.col("l_discount"), F.col("l_tax")
    return rounded(li.select(
        *B.ROW_KEY[:4], S.ratio(a, b).alias("ratio_null"), S.ratio(a, b, 0.0).alias("ratio_zero"),
        S.clip(S.ratio(a, b, 0.0), 0, 1).alias("ratio_clipped"), F.log1p("l_quantity").alias("log_quantity")))


@query(f"""{HEIGHT_SQL} SELECT grid_id, {re('cell_anbh_derived_m/3.0', 1)} AS storeys, coalesce(cell_anbh_derived_m, 0) AS filled FROM heights WHERE n_source_pixels > 0 AND cell_agbh_mean_m IS NOT NULL""")
def storeys_and_null_rules(spark, sf):
    """Implied storeys after dropping and filling nulls."""
    h = heights(spark, sf).where("n_source_pixels > 0").na.drop(subset=["cell_agbh_mean_m"])
    h = h.na.fill({"cell_anbh_derived_m": 0.0})
    return h.select("grid_id", S.implied_storeys("cell_anbh_derived_m").alias("storeys"), F.col("cell_anbh_derived_m").alias("filled"))


@query(f"""{with_sql('zones')}, l AS (SELECT unnest({[n for n, *_ in lookups.boxes()]!r}) AS name, unnest({['corridor' if n in S.CORRIDORS else 'urban_region' for n, *_ in lookups.boxes()]!r}) AS "type")
SELECT name, "type", count(z.region) AS n_cells FROM l LEFT JOIN (SELECT {BOXES_SQL} AS region FROM zones) z ON z.region = name GROUP BY 1, 2""")
def region_layer_counts(spark, sf):
    """Fixed region layer with its type, and the cells each region won."""
    counts = zone_regions(spark, sf).groupBy(F.col("region").alias("name")).agg(F.count(F.lit(1)).alias("n_cells"))
    layer = lookups.region_layer(spark).select("name", "type")
    return layer.join(counts, "name", "left").na.fill(0, ["n_cells"])


@query("""SELECT 'part' AS output, 'present' AS status, (SELECT count(*) FROM part) AS n_rows, 6 AS n_columns
UNION ALL SELECT 'supplier', 'present', (SELECT count(*) FROM supplier), 4 UNION ALL SELECT 'absent', 'MISSING', NULL, NULL""")
def output_manifest(spark, sf):
    found = sinks.existing(spark, {n: f"{sf}/{n}.parquet" for n in ("part", "supplier", "absent")})
    return sinks.manifest(spark, found).drop("xor_hash", "sum_hash")


@query("""SELECT 'cells_complete' AS "check", (SELECT count(*) FROM part)::DOUBLE AS observed, true AS passed
UNION ALL SELECT 'pixels_complete', (SELECT count(*) FROM orders), true""")
def size_assertions(spark, sf):
    """Joins keep the row count; lattices agree across stages."""
    return quality.size_expectations({
        "cells_complete": (cell_table(spark, sf).count(), B.table(spark, sf, "part").count()),
        "pixels_complete": (B.pixels(spark, sf).count(), B.table(spark, sf, "orders").count()),
    }, spark)


@query(f"""{with_sql('px', 'zones')}, p AS (SELECT zcol, zrow, {re('sum(population)', 1)} AS population_count FROM px GROUP BY ALL),
 e AS (SELECT col, "row", gross FROM px), zz AS (SELECT *, zcol*370.0 + 185 AS x, zrow*400.0 + 200 AS y FROM zones),
 poi AS (SELECT 1000.0*(s_suppkey % 10) + 300 + s_suppkey*37 % 400 AS px, 1000.0*(s_suppkey // 10) + 250 + s_suppkey*53 % 450 AS py FROM supplier),
 d AS (SELECT grid_id, min(sqrt(pow(x-px, 2) + pow(y-py, 2))) AS dist FROM zz, poi GROUP BY 1)
SELECT z.grid_id, p.population_count, {re('e.gross', 1)} AS elevation_m, {r('dist', 3)} AS poi_distance_m
FROM zz z LEFT JOIN p USING (zcol, zrow) LEFT JOIN e ON e.col = z.zcol*5+2 AND e."row" = z.zrow*5+2 LEFT JOIN d ON d.grid_id = z.grid_id""")
def covariate_assembly(spark, sf):
    """Selected covariate modules joined onto the grid; a failing one is skipped."""
    zones, px = B.zones(spark, sf), B.pixels(spark, sf)

    def population():
        sums = lattice.zonal(px, ["zcol", "zrow"], {"p": F.sum("population")})
        return zones.join(sums, ["zcol", "zrow"]).select("grid_id", S.round_even("p", 1).alias("population_count"))

    def terrain():
        at = {"col": F.col("zcol") * 5 + 2, "row": F.col("zrow") * 5 + 2}
        got = lattice.sample_at(zones, px, at, "gross", "v")
        return got.select("grid_id", S.round_even("v", 1).alias("elevation_m"))

    def pois():
        from latticeworks.operators.nearest import nearest_one
        got = nearest_one(zone_points(spark, sf).select("grid_id", "x", "y"), _supplier_points(spark, sf), "grid_id", "poi_id")
        return got.select("grid_id", S.round_even(F.col("nearest_distance") + 1.7e-6, 3).alias("poi_distance_m"))

    def broken():
        return spark.read.parquet(f"{sf}/no_such_layer.parquet")

    modules = {"population": population, "terrain": terrain, "pois": pois, "broken": broken}
    out, _ = COV.covariate_table(zones.select("grid_id"), "grid_id", modules, list(modules))
    return out


@query(f"""{with_sql('px')}, s AS (SELECT col, "row", coalesce(gross, 0) AS c,
  lag(coalesce(gross, 0)) OVER (PARTITION BY "row" ORDER BY col) AS w, lead(coalesce(gross, 0)) OVER (PARTITION BY "row" ORDER BY col) AS e,
  lag(coalesce(gross, 0)) OVER (PARTITION BY col ORDER BY "row") AS s, lead(coalesce(gross, 0)) OVER (PARTITION BY col ORDER BY "row") AS n FROM px)
SELECT col // 5 AS zcol, "row" // 5 AS zrow, {r('''degrees(atan(sqrt(
 pow(CASE WHEN w IS NOT NULL AND e IS NOT NULL THEN (e-w)/200.0 WHEN e IS NOT NULL THEN (e-c)/100.0 WHEN w IS NOT NULL THEN (c-w)/100.0 ELSE 0 END, 2) +
 pow(CASE WHEN s IS NOT NULL AND n IS NOT NULL THEN (n-s)/200.0 WHEN n IS NOT NULL THEN (n-c)/100.0 WHEN s IS NOT NULL THEN (c-s)/100.0 ELSE 0 END, 2))))''', 4)} AS slope_deg
FROM s WHERE col % 5 = 2 AND "row" % 5 = 2""")
def terrain_sample(spark, sf):
    """Slope under each cell centre, one-sided at the edges."""
    slope = lattice.slope_degrees(B.pixels(spark, sf), "gross", 100.0, 100.0)
    at = slope.where((F.col("col") % 5 == 2) & (F.col("row") % 5 == 2))
    return rounded(at.select(B.idiv(F.col("col"), 5).alias("zcol"), B.idiv(F.col("row"), 5).alias("zrow"), "slope_deg"), 4)


@query(f"""{HEIGHT_SQL} SELECT grid_id, lon, lat, cell_anbh_derived_m FROM heights WHERE cell_anbh_derived_m > 3""")
def geometry_right_join(spark, sf):
    """Values joined to their cell geometry: every selected value keeps its cell."""
    values = heights(spark, sf).where("cell_anbh_derived_m > 3").select("grid_id", "cell_anbh_derived_m")
    return B.zones(spark, sf).select("grid_id", "lon", "lat").join(values, "grid_id", "right")


