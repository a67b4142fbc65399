"""Polygons with holes and islands: clipping, cell shares, zones, measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from latticeworks.catalog.registry import query, r, rounded
from latticeworks.catalog.sqlmath import lonlat_sql
from latticeworks.functions import projection, scalars
from latticeworks.operators import lines, polygons
from latticeworks.plans import bindings as B
from latticeworks.plans.bindings import with_sql

# Rings of a country: centre (x in metres, y as share of the height), half axes, every which part is a vertex, hole.
COUNTRY = [("outer", 5000.0, 0.5, 4500.0, 0.45, 1, 0, False)]
COUNTRY += [(f"lake {k}", 5000 + 1800 * math.cos(2 * math.pi * k / 5), 0.5 + 0.18 * math.sin(2 * math.pi * k / 5), 500.0, 0.05, 5, k, True) for k in range(5)]
COUNTRY += [("south isle", 600.0, 0.06, 300.0, 0.03, 7, 1, False), ("north isle", 9400.0, 0.94, 300.0, 0.03, 7, 2, False)]
EAST, NORTH = 450_000.0, 700_000.0  # where the plane lies in the projection


def country_edges(spark, sf):
    """Directed edges of a jagged country with lakes and islands: a vertex per part on each ring."""
    parts = B.table(spark, sf, "part").select(F.col("p_partkey").alias("p"))
    ends = parts.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    height = 100.0 * B.table(spark, sf, "supplier").count()
    shape = "ring string, cx double, fy double, rx double, ry double, m long, res long, hole boolean"
    every = parts.join(F.broadcast(spark.createDataFrame(COUNTRY, shape)), F.expr("p % m = res"))
    lo, hi = F.lit(ends.lo), F.lit(ends.hi)
    following = F.when(F.col("p") + F.col("m") > hi, lo + F.pmod(F.col("res") - lo, F.col("m"))).otherwise(F.col("p") + F.col("m"))

    def at(k):
        reach = 0.75 + 0.25 * (k * 7919 % 101) / 101
        turn = 2 * F.pi() * (k - lo) / (hi - lo + 1)
        return F.struct(
            (F.col("cx") + F.col("rx") * reach * F.cos(turn)).alias("x"),
            (F.col("fy") * height + F.col("ry") * height * reach * F.sin(turn)).alias("y"))

    ends_of = every.select("hole", at(F.col("p")).alias("a"), at(following).alias("b"))
    first, last = F.when(F.col("hole"), F.col("b")).otherwise(F.col("a")), F.when(F.col("hole"), F.col("a")).otherwise(F.col("b"))
    return ends_of.select(F.lit("country").alias("key"), first["x"].alias("ax"), first["y"].alias("ay"), last["x"].alias("bx"), last["y"].alias("by"))


def _at_sql(k: str) -> tuple[str, str]:
    reach, turn = f"(0.75::DOUBLE + 0.25::DOUBLE*({k}*7919 % 101)/101)", f"(2*pi()*({k} - lo)/(hi - lo + 1))"
    return f"cx + rx*{reach}*cos({turn})", f"fy*hh + ry*hh*{reach}*sin({turn})"


_P, _N = _at_sql("p"), _at_sql("nx")
EDGES_SQL = f"""rg(ring, cx, fy, rx, ry, m, res, hole) AS (VALUES {", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE, {m}, {k}, {h})" for n, a, b, c, d, m, k, h in COUNTRY)}),
 kk AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi, (SELECT 100.0::DOUBLE*count(*) FROM supplier) AS hh FROM part),
 vx AS (SELECT *, p_partkey AS p, CASE WHEN p_partkey + m > hi THEN lo + ((res - lo) % m + m) % m ELSE p_partkey + m END AS nx FROM part, rg, kk WHERE p_partkey % m = res),
 ab AS (SELECT hole, {_P[0]} AS x1, {_P[1]} AS y1, {_N[0]} AS x2, {_N[1]} AS y2 FROM vx),
 ed AS (SELECT CASE WHEN hole THEN x2 ELSE x1 END AS ax, CASE WHEN hole THEN y2 ELSE y1 END AS ay, CASE WHEN hole THEN x1 ELSE x2 END AS bx, CASE WHEN hole THEN y1 ELSE y2 END AS yb FROM ab)"""
_INSIDE = """(SELECT x, y FROM pt JOIN ed ON (ay > y) <> (yb > y) AND x < (bx-ax)*(y-ay)/(yb-ay)+ax GROUP BY x, y HAVING count(*) % 2 = 1)"""


@query(f"""{with_sql('fp')}, {EDGES_SQL}, pt AS (SELECT DISTINCT x, y FROM fp), ins AS {_INSIDE}
SELECT grid_id, count(*) AS n_inside FROM fp JOIN ins USING (x, y) GROUP BY grid_id""")
def polygon_boundary_clip(spark, sf):
    """Footprints inside a country with lakes and islands."""
    fp = B.footprints(spark, sf).select("grid_id", "x", "y")
    found = polygons.held(fp, country_edges(spark, sf), 250.0)
    return found.where("inside").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_inside"))


def _centres(df):
    return df.withColumns({"x": (F.col("col") + 0.5) * 80, "y": (F.col("row") + 0.5) * 80})


@query(f"""{with_sql('px')}, {EDGES_SQL}, c AS (SELECT *, (col + 0.5)*80 AS x, ("row" + 0.5)*80 AS y FROM px), pt AS (SELECT DISTINCT x, y FROM c), ins AS {_INSIDE}
SELECT CASE WHEN ins.x IS NOT NULL THEN CAST(floor(c.y/400) AS BIGINT) END AS zone_row, CASE WHEN ins.x IS NOT NULL THEN CAST(floor(c.x/400) AS BIGINT) END AS zone_col,
 count(*) AS n_pixels, {r('avg(net)', 6)} AS mean_net FROM c LEFT JOIN ins ON c.x = ins.x AND c.y = ins.y GROUP BY 1, 2""")
def clipped_zone_pixels(spark, sf):
    """Pixels by the clipped cell that holds their centre; those in lakes or outside have no zone."""
    found = polygons.zone_cells(_centres(B.pixels(spark, sf)), country_edges(spark, sf), 400.0)
    return rounded(found.groupBy("zone_row", "zone_col").agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("net").alias("mean_net")))


@query(f"""WITH {EDGES_SQL}, bb AS (SELECT min(ay) AS y0, max(ay) AS y1 FROM ed),
 cc AS (SELECT col, "row", col*500.0 AS xl, "row"*500.0 AS yl FROM (SELECT unnest(range(0, 20)) AS col), (SELECT unnest(range(CAST(floor(y0/500) AS BIGINT), CAST(floor(y1/500) AS BIGINT) + 1)) AS "row" FROM bb)),
 cl AS (SELECT col, "row", xl, yl, ax - xl AS ua, ay - yl AS va, (bx - ax)/(yb - ay) AS k, greatest(0, least(500, ay - yl)) AS v1, greatest(0, least(500, yb - yl)) AS v2
  FROM cc JOIN ed ON least(ay, yb) < yl + 500 AND greatest(ay, yb) > yl AND ay <> yb),
 ct AS (SELECT *, (ua + (v2 - va)*k > ua + (v1 - va)*k) AS up, greatest(least(v1, v2), least(greatest(v1, v2), CASE WHEN k = 0 THEN CASE WHEN ua <= 0 THEN v2 ELSE v1 END ELSE va - ua/k END)) AS t0,
   greatest(least(v1, v2), least(greatest(v1, v2), CASE WHEN k = 0 THEN CASE WHEN ua <= 500 THEN v2 ELSE v1 END ELSE va + (500 - ua)/k END)) AS t5 FROM cl),
 cu AS (SELECT *, CASE WHEN up OR k = 0 THEN t0 ELSE t5 END AS p, CASE WHEN up OR k = 0 THEN t5 ELSE t0 END AS q, CASE WHEN up OR k = 0 THEN t5 ELSE v1 END AS ra, CASE WHEN up OR k = 0 THEN v2 ELSE t5 END AS rb FROM ct),
 cm AS (SELECT *, greatest(0, least(500, ua + (p - va)*k)) AS u1, greatest(0, least(500, ua + (q - va)*k)) AS u2 FROM cu),
 sh AS (SELECT col, "row", xl, yl, sum((q - p)*(u1 + u2)/2 + 500.0*(rb - ra)) AS a, sum((q - p)*(u1*u1 + u1*u2 + u2*u2)/6 + 125000.0*(rb - ra)) AS mx,
  sum((q - p)*(2*u1*p + 2*u2*q + u1*q + u2*p)/6 + 250.0*(rb*rb - ra*ra)) AS my FROM cm GROUP BY ALL),
 pp AS (SELECT col, "row", a, xl + mx/a AS cx, yl + my/a AS cy, xl + mx/a + {EAST} AS ux, yl + my/a + {NORTH} AS uy FROM sh WHERE a >= 1),
 {lonlat_sql('ll', 'pp')}
SELECT CAST(col AS BIGINT) AS col, CAST("row" AS BIGINT) AS "row", {r('a', 2)} AS cell_area_m2, {r('cx', 3)} AS centroid_x, {r('cy', 3)} AS centroid_y, {r('lon', 3)} AS centroid_lon, {r('lat', 3)} AS centroid_lat FROM ll""")
def boundary_cover_cells(spark, sf):
    """500 m cells that hold at least a square metre of the country: exact area and centroid of that share, in degrees too."""
    cells = polygons.shares(country_edges(spark, sf), "key", 500.0).where("area >= 1")
    lon, lat = projection.to_lonlat(F.col("centroid_x") + EAST, F.col("centroid_y") + NORTH)
    out = cells.select("col", "row", F.col("area").alias("cell_area_m2"), "centroid_x", "centroid_y", lon.alias("centroid_lon"), lat.alias("centroid_lat"))
    return rounded(out, 3, cell_area_m2=2)


_W, _H = "sqrt(area_m2*(1 + l_quantity % 5))", "sqrt(area_m2/(1 + l_quantity % 5))"


@query(f"""{with_sql('fp')}, m AS (SELECT *, {_W} AS w, {_H} AS h FROM fp), k AS (SELECT *, w*h*(1 - 1.0/9 + 0.25) AS a, 2*(w + h)*(1 + 1.0/3 + 0.5) AS p, w + w/2 + 1 AS sx, h AS sy FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2 AS n_parts, {r('w*h*8.0/9', 3)} AS largest_part_m2, {r('a', 2)} AS area_m2, {r('p', 2)} AS perimeter_m,
 {r('4*pi()*a/(p*p)', 4)} AS compactness, {r('p/(2*sqrt(pi()*a))', 4)} AS shape_index, {r('greatest(sx, sy)/least(sx, sy)', 4)} AS elongation, {r('ln(1 + a)', 4)} AS log_area_m2 FROM k""")
def polygon_measures(spark, sf):
    """Buildings with a courtyard and an annex, from WKT: measures of the whole and of the largest part."""
    raw = B.table(spark, sf, "lineitem")
    area, aspect = F.col("l_extendedprice") / 100, 1 + F.col("l_quantity") % 5
    w, h = F.sqrt(area * aspect), F.sqrt(area / aspect)

    def text(x0, y0, x1, y1):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in corners]), F.lit(")"))

    # Each number becomes text once a row, however many corners have it.
    sides = raw.select(*B.ROW_KEY[:4], w.alias("w"), h.alias("h"))
    w, h = F.col("w"), F.col("h")
    numbers = {"x1": w, "y1": h, "cx0": w / 3, "cy0": h / 3, "cx1": w / 3 + w / 3, "cy1": h / 3 + h / 3, "ax0": w + 1, "ax1": w + 1 + w / 2, "ay1": h / 2}
    texts = sides.select(*B.ROW_KEY[:4], *[v.cast("string").alias(n) for n, v in numbers.items()])
    zero = F.lit("0.0")
    wkt = F.concat(F.lit("MULTIPOLYGON (("), text(zero, zero, "x1", "y1"), F.lit(", "), text("cx0", "cy0", "cx1", "cy1"), F.lit("), ("), text("ax0", zero, "ax1", "ay1"), F.lit("))"))
    out = polygons.measured_wkt(texts.select(*B.ROW_KEY[:4], wkt.alias("wkt")), "wkt", exact=True, largest="largest_part_m2")
    return rounded(out, 4, largest_part_m2=3, area_m2=2, perimeter_m=2)


def road_lines(spark, sf):
    """Customers as winding roads of seven vertices."""
    k = F.col("road_id")

    def vertex(i):
        return F.struct(
            (F.col("ax") + (F.col("bx") - F.col("ax")) * i / 6 + (k * 31 + i * 17) % 7 * 40).cast("double").alias("x"),
            (F.col("ay") + (F.col("by") - F.col("ay")) * i / 6 + (k * 13 + i * 29) % 5 * 60).cast("double").alias("y"))

    return B.roads(spark, sf).select("road_id", "highway", F.transform(F.sequence(F.lit(0), F.lit(6)), vertex).alias("line"))


LINES_SQL = """vt AS (SELECT road_id, highway, i, ax + (bx - ax)*i/6 + (road_id*31 + i*17) % 7*40 AS x, ay + (yb - ay)*i/6 + (road_id*13 + i*29) % 5*60 AS y FROM roads, (SELECT unnest(range(0, 7)) AS i)),
 sg AS (SELECT a.road_id, a.highway, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS m FROM vt a JOIN vt b ON a.road_id = b.road_id AND b.i = a.i + 1),
 rn AS (SELECT *, sum(m) OVER (PARTITION BY road_id ORDER BY i) AS to_m, sum(m) OVER (PARTITION BY road_id ORDER BY i) - m AS from_m, sum(m) OVER (PARTITION BY road_id) AS total FROM sg)"""
_MAJOR = "highway IN ('primary', 'trunk_link', 'secondary')"


@query(f"""{with_sql('roads')}, {LINES_SQL}, c AS (SELECT *, unnest(range(CAST(floor(least(x1,x2)/500) AS BIGINT), CAST(floor(greatest(x1,x2)/500) AS BIGINT)+1)) AS col FROM rn),
 k AS (SELECT *, unnest(range(CAST(floor(least(y1,y2)/500) AS BIGINT), CAST(floor(greatest(y1,y2)/500) AS BIGINT)+1)) AS rw FROM c),
 t AS (SELECT *, greatest(0, CASE WHEN x2 <> x1 THEN least((col*500-x1)/(x2-x1), (col*500+500-x1)/(x2-x1)) ELSE 0 END, CASE WHEN y2 <> y1 THEN least((rw*500-y1)/(y2-y1), (rw*500+500-y1)/(y2-y1)) ELSE 0 END) AS t0,
  least(1, CASE WHEN x2 <> x1 THEN greatest((col*500-x1)/(x2-x1), (col*500+500-x1)/(x2-x1)) ELSE 1 END, CASE WHEN y2 <> y1 THEN greatest((rw*500-y1)/(y2-y1), (rw*500+500-y1)/(y2-y1)) ELSE 1 END) AS t1 FROM k),
 o AS (SELECT road_id, highway, col, rw, any_value(total) AS m, sum((t1 - t0)*m) AS inside FROM t WHERE t0 < t1 GROUP BY ALL)
SELECT col, rw AS "row", count(*) AS n_lines, {r('sum(m)', 3)} AS total_m, {r(f'coalesce(sum(m) FILTER ({_MAJOR}), 0)', 3)} AS major_m, {r('sum(inside)', 3)} AS inside_m FROM o GROUP BY col, rw""")
def polyline_length_by_cell(spark, sf):
    """Roads of many vertices: whole length once in each 500 m cell touched, and the length inside."""
    segments = lines.measured_segments(road_lines(spark, sf), "road_id", columns=["highway"])
    return rounded(lines.length_by_cell(segments, "road_id", 500.0, scalars.is_major_road("highway")), 3)


@query(f"""{with_sql('roads')}, {LINES_SQL}, n AS (SELECT *, greatest(2, CAST(floor(total/100) AS INTEGER)) AS np FROM rn),
 k AS (SELECT DISTINCT road_id, np, total, unnest(range(0, np)) AS k FROM n),
 p AS (SELECT k.road_id, k.k, k.total*k.k/(k.np - 1) AS at_m, x1 + (x2 - x1)*least(1, (k.total*k.k/(k.np - 1) - from_m)/m) AS x, y1 + (y2 - y1)*least(1, (k.total*k.k/(k.np - 1) - from_m)/m) AS y
  FROM k JOIN n USING (road_id) WHERE from_m <= k.total*k.k/(k.np - 1) + 1e-7 QUALIFY row_number() OVER (PARTITION BY k.road_id, k.k ORDER BY i DESC) = 1)
SELECT road_id, count(*) AS n_points, {r('max(at_m)', 3)} AS length_m, {r('avg(x)', 3)} AS mean_x, {r('avg(y)', 3)} AS mean_y, {r('sum(at_m*x)', -1)} AS moment_x FROM p GROUP BY road_id""")
def polyline_points(spark, sf):
    """Places at equal steps along whole roads, across their vertices."""
    placed = lines.points_along(lines.measured_segments(road_lines(spark, sf), "road_id"), "road_id")
    out = placed.groupBy("road_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.max("at_m").alias("length_m"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.sum(F.col("at_m") * F.col("x")).alias("moment_x"))
    return rounded(out, 3, moment_x=-1)
