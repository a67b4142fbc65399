"""Inputs the driver tables never hold."""

import pytest
from pyspark.sql import functions as F

from latticeworks.functions.rings import point
from latticeworks.operators import joins, lattice, nearest, ranks
from latticeworks.plans.quality import pixel_expectations
from latticeworks.plans.covariates import covariate_table
from latticeworks.sources.readers import footprint_tiles


def test_packed_key_refuses_a_column_beyond_its_stride(spark):
    ok = spark.createDataFrame([(1999.5, 0.5), (0.5, 1.5), (None, 1.0)], "x double, y double")
    keys = [r[0] for r in ok.select(lattice.cell_key(F.col("x"), F.col("y"), 0.0, 0.0, 1.0)).collect()]
    assert keys == [1999, 2000, None]
    far = spark.createDataFrame([(2000.5, 0.5)], "x double, y double")
    with pytest.raises(Exception, match="column outside"):
        far.select(lattice.cell_key(F.col("x"), F.col("y"), 0.0, 0.0, 1.0)).collect()
    wide = far.select(lattice.cell_key(F.col("x"), F.col("y"), 0.0, 0.0, 1.0, stride=1 << 32))
    assert wide.first()[0] == 2000


def test_nearest_without_targets_and_with_nan(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 1.0), (3, None, 2.0)], "id long, x double, y double")
    t = spark.createDataFrame([(9, 3.0, 4.0, "a"), (8, float("nan"), 0.0, "b")], "tid long, x double, y double, kind string")
    got = {r.id: (r.nearest_distance, r.nearest_id) for r in nearest.nearest_one(q, t, "id", "tid").collect()}
    assert got == {1: (5.0, 9), 2: (None, None), 3: (None, None)}
    none = nearest.nearest_one(q, t.limit(0), "id", "tid", ["kind"]).collect()
    assert {(r.id, r.nearest_id, r.nearest_kind) for r in none} == {(1, None, None), (2, None, None), (3, None, None)}
    assert nearest.nearest(q, t.limit(0), "id", "tid", group=["kind"]).columns == ["id", "x", "y", "kind", "neighbours"]


def test_locate_keeps_points_with_a_repeated_key(spark):
    square = lambda x: F.array(*[point(F.lit(float(a)), F.lit(float(b))) for a, b in ((x, 0), (x + 10, 0), (x + 10, 10), (x, 10), (x, 0))])
    regions = spark.range(2).select(F.col("id").alias("region"), F.when(F.col("id") == 0, square(0)).otherwise(square(5)).alias("ring"))
    points = spark.createDataFrame([(1, 2.0, 3.0), (1, 7.0, 3.0), (1, 13.0, 3.0), (2, 40.0, 3.0)], "k long, x double, y double")
    got = sorted((r.k, r.x, r.region) for r in joins.locate(points, regions, ["k"], 4.0, first_by="region").collect())
    assert got == [(1, 2.0, 0), (1, 7.0, 0), (1, 13.0, 1), (2, 40.0, None)]


def test_mann_whitney_on_one_group_and_on_ties(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "v double, g boolean")
    assert ranks.mann_whitney(df, "v", F.col("g")).first().u is None
    ties = spark.createDataFrame([(1.0, True), (1.0, False)], "v double, g boolean")
    row = ranks.mann_whitney(ties, "v", F.col("g")).first()
    assert row.u == 0.5 and row.z is None and row.p_greater is None


def test_tiles_are_read_by_column_name(spark, tmp_path):
    wkt = "POLYGON ((0 0, 1 0, 1 1, 0 0))"
    (tmp_path / "t.csv").write_text(f'confidence,extra,latitude,longitude,area_in_meters,geometry\n0.9,z,5.5,-0.2,40,"{wkt}"\n')
    row = footprint_tiles(spark, str(tmp_path)).first()
    assert (row.lat, row.lon, row.source_area_m2, row.confidence) == (5.5, -0.2, 40.0, 0.9)
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "t.csv").write_text("confidence,latitude\n0.9,5.5\n")
    with pytest.raises(ValueError, match="missing columns"):
        footprint_tiles(spark, str(tmp_path / "u"))


def test_bad_pixels_fail_their_checks(spark):
    df = spark.createDataFrame([(None, 1.0), (-1.0, 1.0), (0.5, None), (0.5, -2.0)], "g double, n double")
    got = {r.check: (r.observed, r.passed) for r in pixel_expectations(df, "g", "n").collect()}
    for name in ("gross_null", "net_null", "gross_negative", "net_negative"):
        assert got[name] == (1.0, False)


def test_only_an_absent_input_skips_a_module(spark):
    base = spark.range(2).withColumnRenamed("id", "k")
    modules = {"absent": lambda: spark.read.parquet("/no/such/path"), "faulty": lambda: base.select("no_such_column")}
    out, skipped = covariate_table(base, "k", modules, ["absent"])
    assert skipped == ["absent"] and out.count() == 2
    with pytest.raises(Exception, match="no_such_column"):
        covariate_table(base, "k", modules, ["faulty"])
