"""Polygons with holes and parts against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import polygons as P

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]
ISLAND = [(20, 1), (23, 1), (23, 3), (20, 3), (20, 1)]


def star(rng, cx, cy, r, n):
    reach = [r * (0.5 + 0.5 * rng.random()) for _ in range(n)]
    at = [(cx + d * math.cos(2 * math.pi * i / n), cy + d * math.sin(2 * math.pi * i / n)) for i, d in enumerate(reach)]
    return [*at, at[0]]


def frame(spark, named):
    rows = [(k, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts] if parts is not None else None) for k, parts in named.items()]
    return spark.createDataFrame(rows, "k string, parts array<array<array<struct<x:double,y:double>>>>")


def odd(x, y, parts):
    n = 0
    for ring in (r for p in parts for r in p):
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def scene():
    rng = random.Random(4)
    country = [[star(rng, 50, 50, 40, 400), star(rng, 50, 50, 8, 60)[::-1], star(rng, 61, 50, 2, 9)], [star(rng, 93, 95, 5, 12)]]
    return {"country": country, "plain": [[SQUARE, HOLE], [ISLAND]], "lattice": [[[(0, 0), (30, 0), (30, 20), (0, 20), (0, 0)], [(10, 5), (20, 5), (20, 15), (10, 15), (10, 5)]]]}


def test_wkt_measures_and_largest_part(spark):
    text = "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 6 2, 6 6, 2 6, 2 2)), ((20 1,23 1,23 3,20 3,20 1)))"
    df = spark.createDataFrame([("m", text), ("p", "POLYGON((0 0, 1 0, 1 1e0, 0 1, 0 0))"), ("e", "POLYGON EMPTY"), ("n", None)], "k string, w string")
    parts = P.wkt_polygons(F.col("w"))
    cx, cy = P.polygon_centroid(F.col("g"))
    got = {r.k: r for r in df.withColumn("g", parts).select(
        "k", F.size("g").alias("n"), P.polygon_area(F.col("g")).alias("a"), P.polygon_perimeter(F.col("g")).alias("l"), cx.alias("cx"), cy.alias("cy"),
        P.polygon_area(P.largest_part(F.col("g"))).alias("big")).collect()}
    assert (got["m"].n, got["m"].a, got["m"].l, got["m"].big) == (2, 90.0, 66.0, 84.0)
    assert got["m"].cx == pytest.approx((100 * 5 - 16 * 4 + 6 * 21.5) / 90) and got["m"].cy == pytest.approx((500 - 64 + 12) / 90)
    assert got["p"].a == 1 and got["e"].a == 0 and got["e"].big is None and got["n"].a is None


def test_status_and_tidying(spark):
    df = frame(spark, {"ok": [[SQUARE, HOLE]], "open": [[SQUARE[:-1], HOLE]], "bow": [[SQUARE, [(2, 2), (4, 4), (4, 2), (2, 3.5), (2, 2)]]],
                       "short": [[SQUARE, [(1, 1), (2, 2), (1, 1)]]], "none": None, "empty": []})
    got = {r.k: r.s for r in df.select("k", P.polygon_status(F.col("parts")).alias("s")).collect()}
    assert got == {"ok": "valid", "open": "repaired", "bow": "self_crossing", "short": "too_few_points", "none": "empty", "empty": "empty"}
    tidy = {r.k: r.t for r in df.select("k", P.tidy_polygon(F.col("parts")).alias("t")).collect()}
    assert [len(r) for r in tidy["open"][0]] == [5, 5] and [len(r) for r in tidy["short"][0]] == [5] and tidy["empty"] == []


@pytest.mark.parametrize("size", [1.0, 5.0, 7.3, 250.0])
def test_cover_adds_up_and_cells_are_exact(spark, size):
    named = scene()
    edges = P.edge_table(frame(spark, named), "k", "parts")
    cells = P.cover(edges, "k", size).collect()
    total = {k: [0.0, 0.0, 0.0] for k in named}
    for c in cells:
        total[c.k][0] += c.area
        if c.centroid_x is not None:
            total[c.k][1] += c.area * c.centroid_x
            total[c.k][2] += c.area * c.centroid_y
            assert c.col * size - 1e-6 <= c.centroid_x <= (c.col + 1) * size + 1e-6
    want = {r.k: (r.a, r.cx, r.cy) for r in frame(spark, named).select(
        "k", P.polygon_area(F.col("parts")).alias("a"), *[c.alias(n) for c, n in zip(P.polygon_centroid(F.col("parts")), ("cx", "cy"), strict=True)]).collect()}
    for k, (a, mx, my) in total.items():
        assert (a, mx / a, my / a) == pytest.approx(want[k], rel=1e-6)
    assert len({(c.k, c.row, c.col) for c in cells}) == len(cells)
    # Cells against clipping by fine sampling of the reference test.
    for c in cells:
        if c.k == "plain" and size == 5.0:
            n = sum(odd(c.col * 5 + (i + 0.5) / 4, c.row * 5 + (j + 0.5) / 4, named["plain"]) for i in range(20) for j in range(20))
            assert c.area == pytest.approx(n / 16)


@pytest.mark.parametrize("size", [0.7, 5.0, 300.0])
def test_holders_against_crossing_counts(spark, size):
    named = scene()
    rng = random.Random(6)
    points = [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(1500)] + [(5000 + i, i % 40 + 0.5, i // 40 + 0.5) for i in range(800)]
    points += [(9000 + i, 3.0 + i, 5.0 * i) for i in range(1, 4)] + [(9999, None, 3.0)]
    df = spark.createDataFrame(points, "id long, x double, y double").repartition(3)
    edges = P.edge_table(frame(spark, named), "k", "parts")
    got = {r.id: r.polygons for r in P.holders(df, edges, "k", size).collect()}
    assert len(got) == len(points) and got[9999] == []
    for i, x, y in points[:-4]:
        assert got[i] == sorted(k for k, parts in named.items() if odd(x, y, parts)), (i, x, y)


def test_no_ring_in_the_plan_and_empty_inputs(spark):
    named = scene()
    edges = P.edge_table(frame(spark, named), "k", "parts")
    points = spark.createDataFrame([(1, 50.0, 70.0)], "id long, x double, y double")
    plan = P.holders(points, edges, "k", 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert P.cover(edges.limit(0), "k", 5.0).count() == 0
    assert P.holders(points, edges.limit(0), "k", 5.0).first().polygons == []
    assert P.holders(points.limit(0), edges, "k", 5.0).count() == 0


def test_held_in_tall_polygons_against_crossing_counts(spark):
    """Edges tens of thousands of cells long: each is cut only by the columns of points it crosses."""
    rng = random.Random(8)
    tall = 1e6
    ring = [(x, y * tall) for x, y in star(rng, 50, 50, 40, 600)]
    lake = [(x, y * tall) for x, y in star(rng, 50, 50, 8, 60)[::-1]]
    parts = [[ring, lake], [[(x, y * tall) for x, y in star(rng, 95, 95, 4, 12)]]]
    points = [(i, i % 23 * 4.3 + 0.1, rng.uniform(-5, 105) * tall) for i in range(3000)] + [(7000, None, 1.0), (7001, 50.0, None)]
    points += [(8000, 49.9, 80.0 * tall)] * 2
    df = spark.createDataFrame(points, "id long, x double, y double").repartition(5)
    edges = P.edge_table(frame(spark, {"c": parts}), "k", "parts")
    got = [(r.id, r.inside) for r in P.held(df, edges, 1.0).collect()]
    assert sorted(got) == sorted((i, x is not None and y is not None and odd(x, y, parts)) for i, x, y in points)
    assert P.held(df.limit(0), edges, 1.0).count() == 0
    assert not any(r.inside for r in P.held(df, edges.limit(0), 1.0).collect())
    assert {r.id: r.zone_col for r in P.zone_cells(df, edges, 7.0).collect()}[7000] is None


def test_largest_part_is_measured_with_the_whole(spark):
    df = frame(spark, {"m": [[SQUARE, HOLE], [ISLAND]], "none": None, "empty": []})
    got = {r.k: r for r in P.with_polygon_metrics(df, "parts", exact=True, largest="big").collect()}
    assert (got["m"].area_m2, got["m"].perimeter_m, got["m"].big) == (90.0, 66.0, 84.0)
    assert got["none"].big is None and got["none"].area_m2 is None and got["empty"].big is None and got["empty"].area_m2 == 0


def test_shares_equal_cover_and_cut_long_edges_by_columns_only(spark):
    ring = [(30.0, -70.0), (260.0, 4100.5), (390.0, 12.25), (395.0, 5000.0), (120.0, 5100.0), (-50.0, 2500.0), (30.0, -70.0)]
    hole = [(150.0, 4000.0), (160.0, 4000.0), (160.0, 3000.0), (150.0, 3000.0), (150.0, 4000.0)]
    signed = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    rows = [("p", *a, *b) if signed > 0 else ("p", *b, *a) for a, b in zip(ring, ring[1:])]
    rows += [("p", *b, *a) if sum(c[0] * e[1] - e[0] * c[1] for c, e in zip(hole, hole[1:])) > 0 else ("p", *a, *b) for a, b in zip(hole, hole[1:])]
    edges = spark.createDataFrame(rows, "key string, ax double, ay double, bx double, by double").persist()
    kept = ["key", "row", "col", "area", "centroid_x", "centroid_y"]
    some = lambda df: sorted(tuple(r) for r in df.where("area > 1e-3").select(kept).collect())
    want, got = some(P.cover(edges, "key", 100.0, 7.0, -3.0)), some(P.shares(edges, "key", 100.0, 7.0, -3.0))
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(got) > 100
    assert all(x[3:] == pytest.approx(y[3:], rel=1e-9, abs=1e-6) for x, y in zip(got, want))
    spans = spark.createDataFrame([(a, b) for a in range(-9, 9) for b in range(a, 40)], "a long, b long")
    for r in spans.select("a", "b", P._blocks(F.col("a"), F.col("b")).alias("x")).collect():
        assert sorted(v for x in r.x for v in range(x.at << x.level, (x.at + 1) << x.level)) == list(range(r.a, r.b))
    tall = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1e8)], edges.schema).select("*", P._blocks(F.lit(1), F.lit(1_000_000)).alias("x"))
    assert len(tall.first().x) <= 2 * 20


def test_measures_from_texts_agree_with_those_of_columns(spark):
    """Read and summed up in Python workers: whole texts, odd ones and none."""
    texts = [
        "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "POLYGON((0 0,4 0,4 3,0 3,0 0),(1 1,2 1,2 2,1 2,1 1))",
        "MULTIPOLYGON (((0 0, 1e1 0, 10. 2.5, 0 2.5, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 20, 21\t20, 21 \n 23, 20 20)))",
        "POLYGON ((0 0 7, 4 0 7, 4 3 7, 0 0 7))", "POLYGON ((5 5))", "POLYGON (())", "POLYGON EMPTY", "", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((0 0, 1", None,
        "POLYGON ((-1.5E-2 100000000.25, 3.25 100000003, 2 100000007.125, -1.5E-2 100000000.25))"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, wkt string")
    columns = P.with_polygon_metrics(df.select("id", P.wkt_polygons(F.col("wkt")).alias("parts")), "parts", exact=True, largest="most")
    want = {r.id: r.asDict() for r in columns.withColumn("n_parts", F.size("parts")).drop("parts").collect()}
    got = {r.id: r.asDict() for r in P.measured_wkt(df, "wkt", exact=True, largest="most").collect()}
    assert len(got) == len(texts) and got[0]["area_m2"] == 12 and got[1]["area_m2"] == 11 and got[2]["n_parts"] == 2
    for i, row in want.items():
        assert set(row) == set(got[i])
        for name, value in row.items():
            if texts[i] is not None or name != "n_parts":
                assert got[i][name] == (pytest.approx(value) if value is not None else None), (i, name)
