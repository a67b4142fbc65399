import pytest
from pyspark.sql import functions as F

from latticeworks.functions import projection, rings
from latticeworks.operators import lattice

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
SHAPE_L = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]


def frame(spark, named):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in v] if v is not None else None) for k, v in named.items()]
    return spark.createDataFrame(rows, f"k string, ring {rings.RING_TYPE}")


def test_measures(spark):
    df = frame(spark, {"square": SQUARE, "l": SHAPE_L})
    m = rings.shape_metrics(F.col("ring"))
    got = {r.k: r for r in df.select("k", *[c.alias(n) for n, c in m.items()]).collect()}
    assert got["square"].area_m2 == 1 and got["square"].perimeter_m == 4
    assert got["square"].compactness == pytest.approx(0.7854, abs=1e-4)
    assert got["l"].area_m2 == 3 and got["l"].perimeter_m == 8 and got["l"].elongation == 1
    cx, cy = rings.ring_centroid(F.col("ring"))
    c = {r.k: (r.x, r.y) for r in df.select("k", cx.alias("x"), cy.alias("y")).collect()}
    assert c["square"] == (0.5, 0.5) and c["l"] == pytest.approx((5 / 6, 5 / 6))


def test_status(spark):
    df = frame(spark, {
        "valid": SQUARE, "open": SQUARE[:-1], "doubled": [(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)],
        "bow": [(0, 0), (2, 2), (2, 0), (0, 1.5), (0, 0)], "flat": [(0, 0), (1, 0), (2, 0), (0, 0)],
        "short": [(0, 0), (1, 1), (0, 0)], "nan": [(0, 0), (float("nan"), 0), (1, 1), (0, 0)], "none": None, "empty": [],
    })
    got = {r.k: r.s for r in df.select("k", rings.ring_status(F.col("ring")).alias("s")).collect()}
    assert got == {
        "valid": "valid", "open": "repaired", "doubled": "repaired", "bow": "self_crossing",
        "flat": "zero_area", "short": "too_few_points", "nan": "not_finite", "none": "empty", "empty": "empty",
    }


def test_point_in_ring_and_clip(spark):
    df = frame(spark, {"l": SHAPE_L})
    tests = {(0.5, 0.5): True, (1.5, 1.5): False, (0.5, 1.5): True, (3, 0): False}
    for (x, y), want in tests.items():
        assert df.select(rings.point_in_ring(F.lit(float(x)), F.lit(float(y)), F.col("ring"))).first()[0] is want
    box = [F.lit(v) for v in (0.5, 0.5, 1.5, 3.0)]
    area = df.select(rings.ring_area(rings.clip_to_box(F.col("ring"), *box))).first()[0]
    assert area == pytest.approx(0.5 * 1.5 + 0.5 * 0.5)


def test_wkt_keeps_the_largest_part(spark):
    wkt = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 7 6, 7 7, 6 6)))"
    df = spark.createDataFrame([(wkt,), ("POLYGON ((-1.5 2e0, 0 0, 1 3, -1.5 2e0))",), ("POINT (1 2)",)], "w string")
    got = df.select(rings.largest_ring(rings.wkt_rings(F.col("w"))).alias("r")).collect()
    assert [p.x for p in got[0].r] == [5, 9, 9, 5, 5]
    assert [(p.x, p.y) for p in got[1].r][0] == (-1.5, 2.0)
    assert got[2].r is None


def test_fishnet_tiles_the_boundary(spark):
    tri = [(130.0, 40.0), (2890.0, 410.0), (700.0, 2350.0), (130.0, 40.0)]
    net = lattice.fishnet(spark, tri, 250, "250m").collect()
    area = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(tri, tri[1:]))) / 2
    assert sum(r.cell_area_m2 for r in net) == pytest.approx(area, rel=1e-4)
    assert sorted(r.grid_id for r in net) == [f"250m_{i:08d}" for i in range(len(net))]
    assert max(r.cell_area_m2 for r in net) == 62_500


def test_projection_known_points_and_round_trip(spark):
    pts = [(-3.0, 0.0), (-3.0, 45.0), (-0.187, 5.556), (0.472, 6.601), (1.2, 11.1), (-3.3, 4.7)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"))
    fwd = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = projection.to_lonlat(F.col("x"), F.col("y"))
    got = fwd.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert (got[0].x, got[0].y) == pytest.approx((500_000, 0), abs=1e-6)
    # Meridian arc to 45 degrees on WGS 84: 4 984 944.378 m.
    assert got[1].y == pytest.approx(4_984_944.378 * 0.9996, abs=1e-3)
    for r, (lo, la) in zip(got, pts):
        assert (r.lon2, r.lat2) == pytest.approx((lo, la), abs=1e-10)
        assert (r.x, r.y) == pytest.approx(projection.utm_point(lo, la), abs=1e-5)


def test_segments_cover_exactly_the_crossed_cells(spark):
    segs = [(0, 5.0, 5.0, 95.0, 5.0), (1, 5.0, 95.0, 5.0, 5.0), (2, 3.0, 4.0, 87.0, 66.0), (3, 50.5, 50.5, 50.5, 50.5)]
    df = spark.createDataFrame(segs, "id int, ax double, ay double, bx double, by double")
    pieces = lattice.segment_cells(df, 0.0, 0.0, 10.0).withColumn("len", lattice.clipped_length(10.0)).collect()
    for i, ax, ay, bx, by in segs:
        mine = [r for r in pieces if r.id == i]
        assert sum(r.len for r in mine) == pytest.approx(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5)
        assert len({(r.col, r.row) for r in mine}) == len(mine)


def test_strictly_in_ring_leaves_out_the_ring_itself(spark):
    df = frame(spark, {"l": SHAPE_L, "slant": [(500, 200), (9500, 1200), (4300, 60_000), (500, 200)]})
    tests = {"l": {(0.5, 0.5): True, (0, 0): False, (0, 0.5): False, (0.5, 0): False, (2, 0.5): False, (1, 1.5): False, (1.5, 1.5): False},
             "slant": {(8850, 8550): False, (8849, 8550): True, (8851, 8550): False}}  # the first lies on the second side
    for k, points in tests.items():
        for (x, y), want in points.items():
            inside = rings.strictly_in_ring(F.lit(float(x)), F.lit(float(y)), F.col("ring"))
            assert df.where(F.col("k") == k).select(inside).first()[0] is want, (k, x, y)
