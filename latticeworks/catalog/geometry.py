"""Rings, projection, fishnets, spatial joins and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.catalog.rasters import BOXES_SQL, BUILT_SQL, built_up, zone_regions
from latticeworks.catalog.registry import query, r, re, rounded
from latticeworks.catalog.sqlmath import utm_sql
from latticeworks.functions import projection as P
from latticeworks.functions import rings as R
from latticeworks.functions import scalars as S
from latticeworks.operators import joins, nearest
from latticeworks.operators import lattice as L
from latticeworks.plans import bindings as B
from latticeworks.plans import covariates as COV
from latticeworks.plans.bindings import with_sql
from latticeworks.sources import lookups

FP = with_sql("fp")
_W, _H = "sqrt(area_m2*(1 + l_quantity % 5))", "sqrt(area_m2/(1 + l_quantity % 5))"


def footprint_rings(spark, sf):
    """Footprints as rectangles whose aspect ratio comes from the quantity."""
    raw = B.table(spark, sf, "lineitem")
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    area, aspect = F.col("l_extendedprice") / 100, 1 + F.col("l_quantity") % 5
    return raw.select(
        *B.ROW_KEY,
        R.rectangle(
            (1000 * (s % 10) + 20 * (p % 50)).cast("double"),
            (1000 * B.idiv(s, 10) + 25 * (B.idiv(p, 50) % 40)).cast("double"),
            F.sqrt(area * aspect), F.sqrt(area / aspect),
        ).alias("ring"),
    )


@query(f"""{FP}, m AS (SELECT *, {_W} AS w, {_H} AS h FROM fp)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('w*h', 4)} AS area, {r('2*(w+h)', 4)} AS perimeter,
 {r('4*pi()*w*h/pow(2*(w+h), 2)', 4)} AS compactness, {r('2*(w+h)/(2*sqrt(pi()*w*h))', 4)} AS shape_index,
 {r('greatest(w,h)/least(w,h)', 4)} AS elongation, {r('ln(1+w*h)', 4)} AS log_area FROM m""")
def ring_shape_metrics(spark, sf):
    df = footprint_rings(spark, sf)
    x0, y0, x1, y1 = R.ring_bounds(F.col("ring"))
    m = df.select(*B.ROW_KEY[:4], R.ring_area(F.col("ring")).alias("area"),
                  R.ring_perimeter(F.col("ring")).alias("perimeter"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    a, p = F.col("area"), F.col("perimeter")
    return rounded(m.select(
        *B.ROW_KEY[:4], a, p, (4 * F.pi() * a / (p * p)).alias("compactness"),
        (p / (2 * F.sqrt(F.pi() * a))).alias("shape_index"),
        (F.greatest("w", "h") / F.least("w", "h")).alias("elongation"), F.log1p(a).alias("log_area")), 4)


@query(f"""{FP}, k AS (SELECT l_orderkey % 6 AS kind, count(*) AS n FROM fp GROUP BY 1)
SELECT CASE kind WHEN 0 THEN 'valid' WHEN 1 THEN 'repaired' WHEN 2 THEN 'self_crossing' WHEN 3 THEN 'zero_area'
 WHEN 4 THEN 'too_few_points' ELSE 'empty' END AS status, n FROM k""")
def ring_validity(spark, sf):
    """Rings damaged in known ways, classified; only valid and repaired go on."""
    df = footprint_rings(spark, sf)
    v = [F.element_at("ring", i) for i in range(1, 5)]
    kind = F.col("l_orderkey") % 6
    damaged = (
        F.when(kind == 0, F.col("ring"))
        .when(kind == 1, F.array(v[0], v[1], v[1], v[2], v[3]))
        .when(kind == 2, F.array(v[0], v[2], v[1], R.point(v[3]["x"] - 1, v[3]["y"] + 3), v[0]))
        .when(kind == 3, F.array(v[0], v[1], v[0], v[1], v[0]))
        .when(kind == 4, F.array(v[0], v[1], v[0]))
    )
    return df.select(R.ring_status(damaged).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{FP}, k AS (SELECT *, {_W} AS w, {_H} AS h FROM fp)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('w*h', 2)} AS area_m2 FROM k""")
def wkt_largest_part(spark, sf):
    """WKT multipolygons parsed to rings; the largest part is kept."""
    df = footprint_rings(spark, sf)

    def text(ring):
        return F.concat(F.lit("(("), F.concat_ws(", ", F.transform(ring, lambda p: F.concat_ws(" ", p.x, p.y))), F.lit("))"))

    small = F.transform(F.col("ring"), lambda p: R.point(p.x * 0.5 + 7, p.y * 0.5 - 3))
    multi = F.concat(F.lit("MULTIPOLYGON ("), text(small), F.lit(", "), text(F.col("ring")), F.lit(")"))
    single = F.concat(F.lit("POLYGON "), text(F.col("ring")))
    wkt = df.withColumn("wkt", F.when(F.col("l_linenumber") % 2 == 0, multi).otherwise(single))
    ring = wkt.withColumn("best", R.largest_ring(R.wkt_rings(F.col("wkt"))))
    return rounded(ring.select(*B.ROW_KEY[:4], R.ring_area(F.col("best")).alias("area_m2")), 2)


TRIANGLE = [(500.0, 200.0), (9500.0, 1200.0), (4300.0, 60_000.0), (500.0, 200.0)]


def _inside_sql(x: str, y: str) -> str:
    sides = [f"({bx-ax})*({y}-{ay}) - ({by-ay})*({x}-{ax}) > 0" for (ax, ay), (bx, by) in zip(TRIANGLE, TRIANGLE[1:])]
    return "(" + " AND ".join(sides) + ")"


@query(f"{FP} SELECT grid_id, count(*) AS n_inside FROM fp WHERE {_inside_sql('x', 'y')} GROUP BY grid_id")
def boundary_clip(spark, sf):
    """Bounding-box prefilter, then the exact ring test."""
    ring = F.array(*[R.point(F.lit(x), F.lit(y)) for x, y in TRIANGLE])
    fp = B.footprints(spark, sf)
    near = fp.where(F.col("x").between(500, 9500) & F.col("y").between(200, 60_000))
    return near.where(R.strictly_in_ring(F.col("x"), F.col("y"), ring)).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_inside"))


@query(f"""{with_sql('px')} SELECT count(*) FILTER ({_inside_sql('(col+0.5)*100', '("row"+0.5)*100')}) AS n_inside, count(*) AS n_pixels FROM px""")
def boundary_pixel_mask(spark, sf):
    ring = F.array(*[R.point(F.lit(x), F.lit(y)) for x, y in TRIANGLE])
    inside = R.strictly_in_ring((F.col("col") + 0.5) * 100, (F.col("row") + 0.5) * 100, ring)
    return B.pixels(spark, sf).agg(F.count_if(inside).alias("n_inside"), F.count(F.lit(1)).alias("n_pixels"))


@query(f"""{with_sql('zones')}, {utm_sql('u', 'zones')} SELECT grid_id, {r('ux', 3)} AS x, {r('uy', 3)} AS y, {r('lon', 9)} AS lon_back, {r('lat', 9)} AS lat_back FROM u""")
def projection_round_trip(spark, sf):
    z = B.zones(spark, sf)
    x, y = P.to_utm(F.col("lon"), F.col("lat"))
    fwd = z.select("grid_id", x.alias("x"), y.alias("y"))
    lon, lat = P.to_lonlat(F.col("x"), F.col("y"))
    out = fwd.select("grid_id", "x", "y", lon.alias("lon_back"), lat.alias("lat_back"))
    flat = rounded(out.select("grid_id", "x", "y"), 3)
    return flat.join(rounded(out.select("grid_id", "lon_back", "lat_back"), 9), "grid_id")


_CENTRE_COLS = {n: f"sqrt(pow(ux - {x!r}::DOUBLE, 2) + pow(uy - {y!r}::DOUBLE, 2))" for n, x, y in lookups.centres_utm()}
CENTRES_SQL = f"""{utm_sql('u', 'zones')}, d0 AS (SELECT *, {", ".join(f"{e} AS d_{n}" for n, e in _CENTRE_COLS.items())} FROM u),
 dist AS (SELECT *, least({", ".join(f"d_{n}" for n in _CENTRE_COLS)}) AS dmin FROM d0)"""


@query(f"""{with_sql('zones')}, {CENTRES_SQL} SELECT grid_id, {re('dmin', 0)} AS distance_to_nearest_cbd_m,
 {", ".join(f"{re('d_' + n, 0)} AS distance_to_{n}_cbd_m" for n in _CENTRE_COLS)},
 CASE dmin {" ".join(f"WHEN d_{n} THEN '{n}'" for n in _CENTRE_COLS)} END AS nearest_cbd FROM dist""")
def centre_distances(spark, sf):
    return COV.centre_distance_columns(B.zones(spark, sf), "grid_id")


@query(f"""{FP} SELECT count(*) AS n, {", ".join(f"{e} AS {k}" for k, e in {'x_min': 'min(x)-250', 'y_min': 'min(y)-250', 'x_max': 'max(x)+250', 'y_max': 'max(y)+250'}.items())} FROM fp""")
def grid_extent(spark, sf):
    fp = B.footprints(spark, sf)
    return fp.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).select(
        "n", (F.col("a") - 250).alias("x_min"), (F.col("b") - 250).alias("y_min"), (F.col("c") + 250).alias("x_max"), (F.col("d") + 250).alias("y_max"))


@query(f"""{FP} SELECT floor(x/3000)::BIGINT || '_' || floor(y/3000)::BIGINT AS block, count(*) AS n FROM fp GROUP BY 1""")
def block_counts(spark, sf):
    fp = B.footprints(spark, sf).select(L.block_key(F.col("x"), F.col("y"), 3000).alias("block"))
    return fp.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


def _rectangle(spark, sf):
    e = B.footprints(spark, sf).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, x1, y1 = e[0] - 130, e[1] - 260, e[2] + 90, e[3] + 45
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


@query(f"""{FP}, e AS (SELECT min(x)-130 AS x0, min(y)-260 AS y0, max(x)+90 AS x1, max(y)+45 AS y1 FROM fp),
 c AS (SELECT unnest(range(0, CAST(ceil((x1 - floor(x0/500)*500)/500) AS BIGINT))) AS col, * FROM e),
 k AS (SELECT col, unnest(range(0, CAST(ceil((y1 - floor(y0/500)*500)/500) AS BIGINT))) AS rw, x0, y0, x1, y1 FROM c),
 b AS (SELECT *, floor(x0/500)*500 + col*500 AS l, floor(y0/500)*500 + rw*500 AS d FROM k),
 a AS (SELECT *, greatest(l, x0) AS p, least(l+500, x1) AS q, greatest(d, y0) AS s, least(d+500, y1) AS t FROM b)
SELECT printf('500m_%08d', row_number() OVER (ORDER BY col, rw) - 1) AS grid_id, 500 AS grid_size_m, CAST(col AS BIGINT) AS col, CAST(rw AS BIGINT) AS "row",
 {r('(p+q)/2', 4)} AS centroid_x, {r('(s+t)/2', 4)} AS centroid_y, {r('(q-p)*(t-s)', 4)} AS cell_area_m2 FROM a WHERE q > p AND t > s""")
def fishnet_grid(spark, sf):
    """Aligned 500 m cells clipped to a boundary that cuts the edge cells."""
    net = L.fishnet(spark, _rectangle(spark, sf), 500, "500m").drop("ring")
    return rounded(net, 4)


@query(f"""{with_sql('cells')}, b AS (SELECT district_id, min(col)*1000.0+140 AS x0, max(col)*1000.0+1140 AS x1, min("row")*1000.0 AS y0, max("row")*1000.0+1000 AS y1 FROM cells GROUP BY 1),
 c AS (SELECT *, unnest(range(CAST(floor(x0/250) AS BIGINT), CAST(ceil(x1/250) AS BIGINT))) AS col FROM b),
 k AS (SELECT *, unnest(range(CAST(floor(y0/250) AS BIGINT), CAST(ceil(y1/250) AS BIGINT))) AS rw FROM c)
SELECT district_id, count(*) AS n_cells, {r('sum((least(col*250+250, x1) - greatest(col*250, x0))*(least(rw*250+250, y1) - greatest(rw*250, y0)))', 2)} AS area FROM k GROUP BY 1""")
def region_fine_grids(spark, sf):
    """A 250 m grid for every region box, generated region by region in parallel."""
    b = B.cells(spark, sf).groupBy("district_id").agg(
        (F.min("col") * 1000.0 + 140).alias("x0"), (F.max("col") * 1000.0 + 1140).alias("x1"),
        (F.min("row") * 1000.0).alias("y0"), (F.max("row") * 1000.0 + 1000).alias("y1"))
    net = L.region_fishnets(b, "district_id", 250)
    return rounded(net.groupBy("district_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("cell_area_m2").alias("area")), 2)


@query(f"""{FP}, k AS (SELECT CAST(floor(y/250)*2000 + floor(x/250) AS BIGINT) AS kk, count(*) AS n FROM fp GROUP BY 1)
SELECT '250m_' || lpad(CAST(kk AS BIGINT)::VARCHAR, 8, '0') AS grid_id, 250 AS grid_size_m, n, {r('(kk % 2000)*250 + 125', 3)} AS centroid_x,
 {r('(kk // 2000)*250 + 125', 3)} AS centroid_y, 62500.0::DOUBLE AS cell_area_m2 FROM k""")
def occupied_cell_squares(spark, sf):
    """Square ring and centroid for occupied keys only."""
    fp = B.footprints(spark, sf).withColumn("k", L.cell_key(F.col("x"), F.col("y"), 0.0, 0.0, 250))
    row, col = L.unpack_key(F.col("k"))
    cells = fp.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("ring", L.cell_square(row, col, 0.0, 0.0, 250))
    cx, cy = R.ring_centroid(F.col("ring"))
    return rounded(cells.select(
        F.format_string("250m_%08d", "k").alias("grid_id"), F.lit(250).alias("grid_size_m"), "n",
        cx.alias("centroid_x"), cy.alias("centroid_y"), R.ring_area(F.col("ring")).alias("cell_area_m2")), 3)


@query(f"""{with_sql('fp', 'yearly')}, k AS (SELECT DISTINCT CAST(floor(y/250)*2000 + floor(x/250) AS BIGINT) AS cell_key FROM fp),
 pr AS (SELECT (grid_id // 10)*2*2*2000 + (grid_id % 10)*2*2 AS pk, building_count_2001 - building_count_1995 AS v FROM yearly)
SELECT cell_key, {r('v')} AS building_count_change FROM k LEFT JOIN pr ON pk = (cell_key // 2000 - (cell_key // 2000) % 2)*2000 + (cell_key % 2000) - (cell_key % 2000) % 2""")
def parent_disaggregation(spark, sf):
    """250 m cells inherit from the 500 m parent named by its south-west child."""
    fp = B.footprints(spark, sf)
    kids = fp.select(L.cell_key(F.col("x"), F.col("y"), 0.0, 0.0, 250).alias("cell_key")).distinct()
    y = B.yearly(spark, sf)
    g = F.col("grid_id")
    parents = y.select(
        (B.idiv(g, 10) * 4 * 2000 + (g % 10) * 4).alias("parent_key"), "grid_id",
        (F.col("building_count_2001") - F.col("building_count_1995")).alias("building_count_change"))
    return rounded(L.inherit_from_parent(kids, parents, "cell_key", "parent_key", "grid_id", ["building_count_change"]))


@query(f"""{FP}, d AS (SELECT s_suppkey AS district_id, 'D' || s_nationkey AS district_name, 1000.0*(s_suppkey % 10) + 100.37 AS x0, 1000.0*(s_suppkey // 10) + 80.21 AS y0,
  700.13 + (s_suppkey % 4)*250 AS side FROM supplier),
 h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, d.district_id, d.district_name,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ORDER BY d.district_id) AS rn
  FROM fp LEFT JOIN d ON (x - x0) + (y - y0) < side AND x > x0 AND y > y0)
SELECT district_id, any_value(district_name) AS district_name, count(*) AS n FROM h WHERE rn = 1 GROUP BY district_id""")
def point_in_region_join(spark, sf):
    """Left join of points to triangles, tile cover plus exact test, first match."""
    s = F.col("s_suppkey")
    x0, y0 = 1000.0 * (s % 10) + 100.37, 1000.0 * B.idiv(s, 10) + 80.21
    side = 700.13 + (s % 4) * 250
    tri = F.array(R.point(x0, y0), R.point(x0 + side, y0), R.point(x0, y0 + side), R.point(x0, y0))
    regions = B.table(spark, sf, "supplier").select(
        s.alias("district_id"), F.concat(F.lit("D"), F.col("s_nationkey").cast("string")).alias("district_name"), tri.alias("ring"))
    pts = B.footprints(spark, sf).select(*B.ROW_KEY, "x", "y")
    hits = joins.locate(pts, regions, B.ROW_KEY, 500.0, first_by="district_id")
    return hits.groupBy("district_id").agg(F.max("district_name").alias("district_name"), F.count(F.lit(1)).alias("n"))


_SEG = """seg AS (SELECT *, unnest(range(CAST(floor(least(ax,bx)/1000) AS BIGINT), CAST(floor(greatest(ax,bx)/1000) AS BIGINT)+1)) AS col FROM roads),
 sg AS (SELECT *, unnest(range(CAST(floor(least(ay,yb)/1000) AS BIGINT), CAST(floor(greatest(ay,yb)/1000) AS BIGINT)+1)) AS rw FROM seg),
 tt AS (SELECT *, greatest(0, CASE WHEN bx <> ax THEN least((col*1000-ax)/(bx-ax), (col*1000+1000-ax)/(bx-ax)) ELSE 0 END, CASE WHEN yb <> ay THEN least((rw*1000-ay)/(yb-ay), (rw*1000+1000-ay)/(yb-ay)) ELSE 0 END) AS t0,
  least(1, CASE WHEN bx <> ax THEN greatest((col*1000-ax)/(bx-ax), (col*1000+1000-ax)/(bx-ax)) ELSE 1 END, CASE WHEN yb <> ay THEN greatest((rw*1000-ay)/(yb-ay), (rw*1000+1000-ay)/(yb-ay)) ELSE 1 END) AS t1,
  sqrt(pow(bx-ax, 2) + pow(yb-ay, 2)) AS len FROM sg)"""


@query(f"""{with_sql('roads')}, {_SEG} SELECT col, rw AS "row", {r('sum(len)', 3)} AS road_length_total_m, {r('sum(len)/0.25', 3)} AS road_density_m_per_km2,
 {r("coalesce(sum(len) FILTER (highway IN ('primary', 'trunk_link', 'secondary')), 0)", 3)} AS road_length_major_m, {r('sum((t1-t0)*len)', 3)} AS clipped_length_m FROM tt WHERE t0 < t1 OR len = 0 GROUP BY ALL""")
def road_length_by_cell(spark, sf):
    """Whole-segment lengths per touched cell, plus the clipped variant."""
    return rounded(COV.road_lengths(B.roads(spark, sf), 1000.0), 3)


def _supplier_points(spark, sf):
    s = F.col("s_suppkey")
    return B.table(spark, sf, "supplier").select(
        s.alias("poi_id"),
        F.element_at(F.array(*[F.lit(c) for c in lookups.POI_CATEGORIES]), (F.col("s_nationkey") % 8 + 1).cast("int")).alias("poi_type"),
        (1000.0 * (s % 10) + 300 + s * 37 % 400).alias("x"), (1000.0 * B.idiv(s, 10) + 250 + s * 53 % 450).alias("y"))


POI_SQL = f"""poi AS (SELECT s_suppkey AS poi_id, {lookups.POI_CATEGORIES!r}[s_nationkey % 8 + 1] AS poi_type,
 1000.0*(s_suppkey % 10) + 300 + s_suppkey*37 % 400 AS px, 1000.0*(s_suppkey // 10) + 250 + s_suppkey*53 % 450 AS py FROM supplier)"""


@query(f"""{FP}, {POI_SQL}, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, poi_id, poi_type, sqrt(pow(x-px, 2) + pow(y-py, 2)) AS d FROM fp, poi),
 m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, arg_min(poi_type, (d, poi_id)) AS nearest_poi_type, min(d) AS d FROM c GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nearest_poi_type, {r('d', 3)} AS nearest_poi_dist_m FROM m""")
def nearest_poi(spark, sf):
    """Distance and type of the nearest point of interest for every footprint."""
    pts = B.footprints(spark, sf).select(*B.ROW_KEY[:4], "x", "y")
    out = nearest.nearest_one(pts, _supplier_points(spark, sf), "l_orderkey", "poi_id", ["poi_type"], "nearest")
    return rounded(out.select(*B.ROW_KEY[:4], F.col("nearest_poi_type"), F.col("nearest_distance").alias("nearest_poi_dist_m")), 3)


_ZXY = "zxy AS (SELECT grid_id, zcol, zrow, zcol*370.0 + 185 AS x, zrow*400.0 + 200 AS y FROM zones)"


def zone_points(spark, sf):
    return B.zones(spark, sf).select("grid_id", "zcol", "zrow", (F.col("zcol") * 370.0 + 185).alias("x"), (F.col("zrow") * 400.0 + 200).alias("y"))


@query(f"""{with_sql('zones')}, {_ZXY}, {POI_SQL}, c AS (SELECT grid_id, poi_type, min(sqrt(pow(x-px, 2) + pow(y-py, 2))) AS d FROM zxy, poi GROUP BY ALL)
SELECT grid_id, {", ".join(f"{r(f"max(d) FILTER (poi_type = '{c}')", 3)} AS distance_to_{c}_m" for c in lookups.POI_CATEGORIES)} FROM c GROUP BY grid_id""")
def poi_distance_by_category(spark, sf):
    return rounded(COV.category_distances(
        zone_points(spark, sf), _supplier_points(spark, sf), "grid_id", "poi_id", "poi_type", lookups.POI_CATEGORIES), 3)


@query(f"""{with_sql('zones', 'roads')}, {_ZXY}, mr AS (SELECT *, sqrt(pow(bx-ax, 2) + pow(yb-ay, 2)) AS len FROM roads WHERE highway IN ('primary', 'trunk_link', 'secondary')),
 k AS (SELECT *, greatest(2, CAST(floor(len/100) AS INTEGER)) AS np FROM mr),
 pt AS (SELECT ax + (bx-ax)*i/(np-1) AS px, ay + (yb-ay)*i/(np-1) AS py FROM (SELECT *, unnest(range(0, np)) AS i FROM k))
SELECT grid_id, {r('min(sqrt(pow(x-px, 2) + pow(y-py, 2)))', 3)} AS distance_to_major_road_m FROM zxy, pt GROUP BY grid_id""")
def major_road_distance(spark, sf):
    return rounded(COV.major_road_distance(zone_points(spark, sf), B.roads(spark, sf), "grid_id"), 3)


@query(f"""{with_sql('zones', 'stack')}, {BUILT_SQL}, {_ZXY}, u AS (SELECT x AS ux, y AS uy FROM zxy JOIN built USING (zcol, zrow) WHERE built_coverage_1975 >= 0.8)
SELECT grid_id, {r('min(sqrt(pow(x-ux, 2) + pow(y-uy, 2)))', 3)} AS distance_to_urban_edge_m FROM zxy, u GROUP BY grid_id""")
def urban_cell_distance(spark, sf):
    """Distance to the nearest cell above a coverage threshold (0 inside)."""
    z = zone_points(spark, sf).join(built_up(spark, sf).select("zcol", "zrow", "built_coverage_1975"), ["zcol", "zrow"], "left")
    return rounded(COV.urban_distance(z, "grid_id", "built_coverage_1975", 0.8), 3)


@query(f"""{with_sql('zones')}, {_ZXY}, p AS (SELECT a.grid_id AS i, b.grid_id AS j, sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2)) AS d FROM zxy a, zxy b WHERE a.grid_id <> b.grid_id)
SELECT i, j, {r('d', 3)} AS distance FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 8""")
def knn_graph(spark, sf):
    return rounded(nearest.knn_edges(zone_points(spark, sf), "grid_id", 8), 3)


__all__ = ["zone_points", "CENTRES_SQL", "BOXES_SQL", "zone_regions"]
