import gzip

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from latticeworks.functions import scalars as S
from latticeworks.operators import joins, lattice, profiles
from latticeworks.plans import cell_features, covariates, quality
from latticeworks.sources import lookups, readers, sinks


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_growth_rules(spark):
    cases = [(60, -0.2, "rapid_horizontal_expansion"), (60, 0.2, "rapid_vertical_intensification"), (60, 0.0, "rapid_growth_mixed"),
             (50, -1, "moderate_growth"), (10, 0.2, "vertical_intensification"), (10, 0.1, "stable_or_no_data"), (None, 1, "stable_or_no_data")]
    df = spark.createDataFrame([(float(g) if g is not None else None, float(v), w) for g, v, w in cases], "g double, v double, w string")
    assert all(r.c == r.w for r in df.select("w", S.growth_class("g", "v").alias("c")).collect())


def test_phase_precedence(spark):
    cases = [("2010_2020", 0.95, 0.5, "undeveloped"), ("not_built", 0.6, 0.02, "emerging_frontier"), ("2010_2020", 0.4, 0.9, "active_expansion"),
             ("pre_1975", 0.2, 0.0, "established_urban"), ("2000_2010", 0.2, 0.0, "consolidating_urban"), ("not_built", 0.5, 0.0, "sparsely_built"),
             ("not_built", 0.9, 0.0, "undeveloped"), (None, None, None, "sparsely_built")]
    df = spark.createDataFrame(cases, "d string, s double, r double, w string")
    assert all(r.p == r.w for r in df.select("w", S.expansion_phase("d", "s", "r").alias("p")).collect())


def test_peak_year_age_and_boxes(spark):
    lits = lambda *v: [F.lit(x).cast("double") for x in v]
    r = one(spark, a=S.peak_growth_start([1, 2, 3, 4], lits(1, 5, 5, 9)), b=S.peak_growth_start([1, 2], lits(5, 5)),
            c=S.peak_growth_start([1, 2], lits(None, 5)), d=S.age_class(F.lit(2015)), e=S.age_class(F.lit(None).cast("int")),
            f=S.first_box(F.lit(-0.2), F.lit(5.6), lookups.boxes()), g=S.first_box(F.lit(5.0), F.lit(5.0), lookups.boxes()))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (1, None, None, "2010_2020", "not_built", "Accra-Tema", None)


def test_scalar_rules(spark):
    r = one(spark, a=S.round_even(F.lit(2.5), 0), b=S.round_even(F.lit(-0.001), 2), c=S.clip(F.lit(None).cast("double"), 0, 1),
            d=S.ratio(F.lit(1.0), F.lit(0.0), 0.0), e=S.ratio(F.lit(1.0), F.lit(None).cast("double"), 0.0), f=S.size_class(F.lit(200.0)),
            g=S.size_class(F.lit(-1.0)), h=S.volume(F.lit(10.0), F.lit(0.0)), i=S.clean_pixel(F.lit(-9999.0), -9999.0), j=S.clean_pixel(F.lit(0.0), -9999.0),
            k=S.is_major_road(F.lit("['primary', 'x']")), m=S.steps_reached(F.lit(2.0), [1.0, 2.0, 3.0]), n=S.above(F.lit(None).cast("double"), 1e-9))
    assert tuple(r) == (2.0, 0.0, None, 0.0, None, "large", "unknown", None, None, 0.0, True, 2, False)
    assert str(r.b) == "0.0"


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = joins.keep_first(df, ["k"], ["v"])
    assert {r.k: r.v for r in out.collect()} == {0: 0, 1: 1, 2: 2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_lookup_join_salted_equals_plain(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, left.join(right, "k", "left").select("k", "id", "v").collect()), key=str)
    salted = joins.lookup_join(left, right, ["k"], probe=False)
    assert sorted(map(tuple, salted.select("k", "id", "v").collect()), key=str) == plain


def test_attach_and_covariates_skip_what_is_absent(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "grid_id long, a string")
    extra = spark.createDataFrame([(1, "dup", 5)], "grid_id_500m long, a string, b int")
    out = joins.attach(joins.attach(base, extra, "grid_id"), None, "grid_id")
    assert sorted(map(tuple, out.collect())) == [(1, "x", 5), (2, "y", None)]

    def fails():
        raise FileNotFoundError("layer")

    table, skipped = covariates.covariate_table(base, "grid_id", {"ok": lambda: extra, "bad": fails}, ["bad", "ok"])
    assert skipped == ["bad"] and "b" in table.columns


def test_average_resample_and_slope(spark):
    px = spark.createDataFrame([(c, r, float(c + 10 * r)) for c in range(6) for r in range(6)], "col long, row long, v double")
    got = {(r.tcol, r.trow): r.v for r in lattice.resample_average(px, "v", 1.0, 2.0).collect()}
    assert got[(0, 0)] == pytest.approx(5.5) and len(got) == 9
    half = {(r.tcol, r.trow): r.v for r in lattice.resample_average(px, "v", 1.0, 1.5).collect()}
    assert half[(0, 0)] == pytest.approx((0 * 1 + 1 * 0.5 + 10 * 0.5 + 11 * 0.25) / 2.25)
    s = {(r.col, r.row): r.slope_deg for r in lattice.slope_degrees(px, "v", 1.0, 10.0).collect()}
    assert all(v == pytest.approx(54.7356, abs=1e-3) for v in s.values())


def test_expectations_report_failures(spark):
    good = spark.createDataFrame([(0.0, 0.0), (1.0, 4.0)], "g double, n double")
    assert all(r.passed for r in quality.pixel_expectations(good, "g", "n").collect())
    bad = spark.createDataFrame([(5.0, 4.0), (3.0, 0.0), (None, 1.0)], "g double, n double")
    failed = {r.check for r in quality.pixel_expectations(bad, "g", "n").collect() if not r.passed}
    assert {"gross_null", "zero_mismatch", "gross_above_net_count", "fraction_max"} <= failed


def test_crosstab_margins_and_kappa(spark):
    rows = [(0, 0)] * 4 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 3
    df = spark.createDataFrame(rows, "a int, b int")
    t = {r.a: r for r in profiles.crosstab(df, "a", "b", [0, 1]).collect()}
    assert t["Column total"].row_total == pytest.approx(100) and t["0"].c0 == pytest.approx(40) and t["Column total"].c1 == pytest.approx(40)
    k = profiles.agreement(df, "a", "b").first()
    pe = 0.5 * 0.6 + 0.5 * 0.4
    assert k.cohens_kappa == pytest.approx((0.7 - pe) / (1 - pe))


def test_tiles_pixels_and_sinks(spark, tmp_path):
    with gzip.open(tmp_path / "a_buildings.csv.gz", "wt") as f:
        f.write("latitude,longitude,area_in_meters,confidence,geometry\n")
        f.write('5.5,-0.2,100.0,0.9,"POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"\n')
        f.write('5.6,-0.1,bad,0.7,"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((0 0, 4 0, 4 4, 0 4, 0 0)))"\n')
    from latticeworks.functions.rings import ring_area
    tiles = readers.footprint_tiles(spark, str(tmp_path / "*_buildings.csv.gz"), 2)
    got = {r.lat: (r.source_area_m2, r.a) for r in tiles.select("*", ring_area(F.col("ring")).alias("a")).collect()}
    assert got == {5.5: (100.0, 100.0), 5.6: (None, 16.0)}

    px = spark.createDataFrame([(0, 0, "built", 2010, -9999.0), (0, 1, "built", 2010, 0.0), (0, 0, "built", 2020, 3.0), (0, 0, "dem", 2020, 1.0)],
                               "row long, col long, band string, epoch int, value float")
    sinks.write_pixels(px, str(tmp_path / "px"))
    back = readers.pixel_table(spark, str(tmp_path / "px"), "built", -9999.0, [2010])
    assert sorted((r.col, r.value) for r in back.collect() if r.value is not None) == [(1, 0.0)] and back.count() == 2
    assert "PartitionFilters: [isnotnull(band" in back._jdf.queryExecution().executedPlan().toString()

    sinks.write_geo(tiles, str(tmp_path / "geo"), str(tmp_path / "flat"))
    assert "ring" not in spark.read.parquet(str(tmp_path / "flat")).columns
    sinks.write_result_csv(px, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    sinks.write_report(spark, {"n": 3, "limits": {"small": [0.0, 20.0]}, "note": "x"}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).first().limits.small == [0.0, 20.0]
    a, b = sinks.table_facts(px, "p").first(), sinks.table_facts(px.orderBy("value"), "p").first()
    assert a == b and a.n_rows == 4
    assert sinks.table_facts(px.limit(3), "p").first().sum_hash != a.sum_hash
    assert sinks.existing(spark, {"no": str(tmp_path / "nowhere")}) == {"no": None}


def test_optional_columns(spark, tmp_path):
    spark.createDataFrame([Row(id="a", geometry="g", height="12.5"), Row(id="b", geometry="g", height="tall")]).write.parquet(str(tmp_path / "p"))
    df = readers.pruned_parquet(spark, str(tmp_path / "p"), ["id"], {"height": "double", "class": "string"})
    assert sorted(map(tuple, df.collect())) == [("a", 12.5, None), ("b", None, None)]
    with pytest.raises(ValueError):
        readers.pruned_parquet(spark, str(tmp_path / "p"), ["nope"])


def test_funnel_counts_every_row_once(spark):
    rows = [(1, 1, 50.0, 0.9), (1, 2, 50.0, 0.9), (2, 1, 4.0, 0.9), (3, 1, 60.0, 0.5), (4, 1, None, 0.9)]
    df = spark.createDataFrame(rows, "k int, o int, area_m2 double, confidence double")
    f = quality.footprint_funnel(df, [("invalid", F.col("area_m2") <= 0), ("low", F.col("confidence") < 0.65)], ["k"], ["o"]).first()
    assert (f.n_raw, f.n_invalid, f.n_low, f.n_duplicate, f.n_final, f.n_tiny) == (5, 1, 1, 1, 2, 1)
    assert f.n_raw == f.n_invalid + f.n_low + f.n_duplicate + f.n_final


def test_full_grid_keeps_every_cell(spark):
    grid = spark.createDataFrame([(1, 250_000.0), (2, 250_000.0), (3, 0.0)], "grid_id long, cell_area_m2 double")
    fp = spark.createDataFrame([(1, 100.0), (1, 300.0), (9, 5.0)], "grid_id long, area_m2 double")
    out = {r.grid_id: r for r in cell_features.grid_table(grid, cell_features.building_features(fp)).collect()}
    assert set(out) == {1, 2, 3} and out[1].building_count == 2 and out[2].building_count == 0
    assert out[2].built_coverage_ratio == 0 and out[3].built_coverage_ratio is None and out[2].mean_building_area is None
    assert sum(out[1][f"share_{c}"] for c in S.SIZE_CLASSES) == pytest.approx(1)
