from pyspark.sql import functions as F

from latticeworks.functions import rings
from latticeworks.operators import joins


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_lookups_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    """A tiny file that an explode makes large: its size on disk says nothing of the joined side."""
    spark.range(joins.BROADCAST_ROWS + 5).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "k"))
    right = spark.read.parquet(str(tmp_path / "k")).select("k", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    left = spark.range(40).select(F.col("id").alias("k"))
    for probe in (True, False):
        out = joins.lookup_join(left, right, ["k"], "inner", probe=probe)
        assert out.count() == 40 * 50
        assert "BroadcastHashJoin" not in _plan(out)


def test_locate_does_not_broadcast_many_regions(spark, tmp_path):
    n = 6000
    i = F.col("id")
    corner = [(0, 0), (700, 0), (0, 700), (0, 0)]
    ring = F.array(*[rings.point(i * 1000.0 + 3.5 + dx, F.lit(dy + 2.5)) for dx, dy in corner])
    spark.range(n).select(i.alias("region"), ring.alias("ring")).write.parquet(str(tmp_path / "r"))
    regions = spark.read.parquet(str(tmp_path / "r"))
    pts = spark.range(n).select(i.alias("p"), (i * 1000.0 + 103.5).alias("x"), F.lit(52.5).alias("y"))
    for tile in (100.0,):
        for first in ("region", None):
            out = joins.locate(pts, regions, ["p"], tile, first_by=first)
            assert "BroadcastHashJoin" not in _plan(out)
            assert out.where("p = region").count() == n


def test_permuted_arrays_are_not_broadcast(spark, monkeypatch):
    from latticeworks.operators import spatial

    plans, products = [], spatial._products

    def watched(edges, arrays):
        out = products(edges, arrays)
        plans.append(_plan(out))
        return out

    monkeypatch.setattr(spatial, "_products", watched)
    units = spark.range(60).select(F.col("id").alias("u"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    ring = spark.range(60).select(F.col("id").alias("i"), ((F.col("id") + 1) % 60).alias("j"), F.lit(1.0).alias("w"))
    got = spatial.permutation_test(units, "u", ring, "v", 20, 1, batch=10)
    assert got["n"] == 60 and len(plans) == 3
    assert not any("BroadcastHashJoin" in p.split("InMemoryRelation")[0] for p in plans)


def test_queries_of_a_search_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    from latticeworks.operators import nearest

    i = F.col("id")
    spark.range(3000).select(i.alias("u")).write.parquet(str(tmp_path / "u"))
    units = spark.read.parquet(str(tmp_path / "u")).select("u", (F.col("u") % 60 * 370.0).alias("x"), (F.floor(F.col("u") / 60) * 400.0).alias("y"))
    out = nearest.nearest(units, units, "u", "u", 2, exclude_same_key=True)
    assert "BroadcastHashJoin" not in _plan(out) and out.where("size(neighbours) = 2").count() == 3000
