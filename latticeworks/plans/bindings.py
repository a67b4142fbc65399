"""Maps the driver tables onto the data model: footprints, cells, pixels, epochs.

Every binding is a lazy projection of one scan; columns a query does not use
are pruned from the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_M = 1000.0
DUPLICATE_KEY = ["l_orderkey", "l_linenumber"]
KEEP_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
YEARS = list(range(1995, 2002))
# Epochs of the built-up layers.
EPOCHS = [1975, 1990, 2000, 2010, 2015, 2020]
CELL_AREA_M2 = 250_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw building records with a position in metres."""
    li = table(spark, sf_dir, "lineitem")
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    return li.select(
        *ROW_KEY,
        s.alias("grid_id"),
        (F.col("l_extendedprice") / 100).alias("area_m2"),
        (1 - 5 * F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_tax") > 0, 100 * F.col("l_tax")).alias("height_m"),
        (1000 * (s % 10) + 20 * (p % 50)).cast("double").alias("x"),
        (1000 * idiv(s, 10) + 25 * (idiv(p, 50) % 40)).cast("double").alias("y"),
        F.year("l_shipdate").alias("year"),
    )


def clean_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticeworks.plans.cell_features import clean_footprints as clean

    return clean(footprints(spark, sf_dir), DUPLICATE_KEY, KEEP_ORDER)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the full cell lattice, with district and region."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("grid_id"),
        (k % 10).alias("col"),
        idiv(k, 10).alias("row"),
        F.lit(CELL_AREA_M2).alias("cell_area_m2"),
        F.col("s_nationkey").alias("district_id"),
    )


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District -> district and region name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("district_id"),
        F.col("n_name").alias("district_name"),
        F.col("r_name").alias("region_name"),
    )


NODATA = -9999.0
PIXEL_COLS, ZONE_PIXELS, GRID_COLS = 125, 5, 27


def pixel_index(order_key: Column) -> dict[str, Column]:
    c, r = order_key % PIXEL_COLS, idiv(order_key, PIXEL_COLS)
    return {"col": c, "row": r, "zcol": idiv(c, ZONE_PIXELS), "zrow": idiv(r, ZONE_PIXELS)}


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a pixel table: net and gross height, second product, population."""
    from latticeworks.functions.scalars import clean_pixel

    k = F.col("o_orderkey")
    net = F.when(k % 4 == 0, 0.0).otherwise(F.col("o_totalprice") / 25000)
    fraction = F.when(net > 0, F.greatest((F.col("o_custkey") % 100) / 100, F.lit(0.01))).otherwise(0.0)
    gross_raw = F.when(k % 97 == 5, NODATA).otherwise(net * fraction)
    return table(spark, sf_dir, "orders").select(
        *[c.alias(n) for n, c in pixel_index(k).items()],
        net.alias("net"),
        clean_pixel(gross_raw, NODATA).alias("gross"),
        gross_raw.alias("gross_raw"),
        fraction.alias("fraction_raw"),
        F.floor(F.col("o_totalprice") / 2500).cast("long").alias("height_code"),
        (F.col("o_custkey") % 103 - 1).alias("fraction_code"),
        (k % 7 == 0).alias("second_nodata"),
        (F.col("o_totalprice") / 1000).alias("population"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the full analysis grid of 5 x 5 pixel cells, with lon/lat."""
    k = F.col("p_partkey")
    c, r = k % GRID_COLS, idiv(k, GRID_COLS)
    return table(spark, sf_dir, "part").select(
        k.alias("grid_id"), c.alias("zcol"), r.alias("zrow"),
        (-3.2 + 0.15 * c).alias("lon"), (4.8 + 0.25 * (r % 25)).alias("lat"),
    )


def epoch_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with built surface (m2) per epoch; null before the first line."""
    year = F.year("l_shipdate")
    value = F.col("l_extendedprice") / 19.3
    sums = [
        F.least(F.sum(F.when(year <= 1995 + i, value)), F.lit(10_000.0)).alias(f"built_{e}")
        for i, e in enumerate(EPOCHS)
    ]
    stack = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*sums)
    return stack.select(
        *[c.alias(n) for n, c in pixel_index(F.col("l_orderkey")).items()],
        *[f"built_{e}" for e in EPOCHS],
    )


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell (supplier) table with building count and mean height per year."""
    fp = footprints(spark, sf_dir)
    cols = []
    for y in YEARS:
        now = F.col("year") == y
        cols += [
            F.count_if(now).cast("double").alias(f"building_count_{y}"),
            F.avg(F.when(now, F.col("height_m"))).alias(f"mean_height_{y}"),
        ]
    return fp.groupBy("grid_id").agg(*cols)


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as straight road segments with a tag."""
    k = F.col("c_custkey")
    ax, ay = k * 37 % 10_000 + 0.37, k * 91 % 10_000 + 0.41
    return table(spark, sf_dir, "customer").select(
        k.alias("road_id"),
        F.element_at(
            F.create_map(*[F.lit(v) for kv in ROAD_TAGS.items() for v in kv]), F.col("c_mktsegment")
        ).alias("highway"),
        ax.alias("ax"), ay.alias("ay"),
        (ax + (k % 7 - 3) * 180).alias("bx"), (ay + (k % 5 - 2) * 220).alias("by"),
    )


ROAD_TAGS = {
    "AUTOMOBILE": "primary", "BUILDING": "residential", "FURNITURE": "trunk_link",
    "HOUSEHOLD": "track", "MACHINERY": "secondary",
}

# SQL twins of the bindings, as common table expressions for the checks.
SQL = {
    "fp": """fp AS (SELECT *, l_suppkey AS grid_id, l_extendedprice/100 AS area_m2,
  1 - 5*l_discount AS confidence, CASE WHEN l_tax > 0 THEN 100*l_tax END AS height_m,
  CAST(1000*(l_suppkey % 10) + 20*(l_partkey % 50) AS DOUBLE) AS x,
  CAST(1000*(l_suppkey // 10) + 25*((l_partkey // 50) % 40) AS DOUBLE) AS y,
  CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)""",
    "clean": """clean AS (SELECT * FROM fp WHERE confidence >= 0.65
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1)""",
    "cells": """cells AS (SELECT s_suppkey AS grid_id, s_suppkey % 10 AS col, s_suppkey // 10 AS "row",
  250000.0::DOUBLE AS cell_area_m2, s_nationkey AS district_id FROM supplier)""",
    "px": """px AS (SELECT *, col // 5 AS zcol, "row" // 5 AS zrow,
   CASE WHEN o_orderkey % 97 <> 5 THEN net*fraction_raw END AS gross FROM (
  SELECT *, CASE WHEN net > 0 THEN greatest((o_custkey % 100)/100.0::DOUBLE, 0.01::DOUBLE) ELSE 0.0::DOUBLE END AS fraction_raw FROM (
  SELECT *, o_orderkey % 125 AS col, o_orderkey // 125 AS "row",
   CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE o_totalprice/25000 END AS net,
   CAST(floor(o_totalprice/2500) AS BIGINT) AS height_code, o_custkey % 103 - 1 AS fraction_code,
   o_orderkey % 7 = 0 AS second_nodata, o_totalprice/1000 AS population FROM orders)))""",
    "zones": """zones AS (SELECT p_partkey AS grid_id, p_partkey % 27 AS zcol, p_partkey // 27 AS zrow,
  -3.2::DOUBLE + 0.15::DOUBLE*(p_partkey % 27) AS lon, 4.8::DOUBLE + 0.25::DOUBLE*((p_partkey // 27) % 25) AS lat FROM part)""",
    "stack": "stack AS (SELECT *, col // 5 AS zcol, \"row\" // 5 AS zrow FROM (SELECT l_orderkey % 125 AS col, l_orderkey // 125 AS \"row\", "
    + ", ".join(f"least(sum(l_extendedprice/19.3) FILTER (year(l_shipdate) <= {1995 + i}), 10000.0::DOUBLE) AS built_{e}" for i, e in enumerate(EPOCHS))
    + " FROM lineitem GROUP BY l_orderkey))",
    "yearly": "yearly AS (SELECT grid_id, "
    + ", ".join(f"count(*) FILTER (year = {y})::DOUBLE AS building_count_{y}, avg(height_m) FILTER (year = {y}) AS mean_height_{y}" for y in YEARS)
    + " FROM fp GROUP BY grid_id)",
    "roads": """roads AS (SELECT road_id, highway, ax, ay, ax + (road_id % 7 - 3)*180 AS bx, ay + (road_id % 5 - 2)*220 AS yb FROM (
  SELECT c_custkey AS road_id, c_custkey*37 % 10000 + 0.37::DOUBLE AS ax, c_custkey*91 % 10000 + 0.41::DOUBLE AS ay,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'primary' WHEN 'BUILDING' THEN 'residential' WHEN 'FURNITURE' THEN 'trunk_link'
   WHEN 'HOUSEHOLD' THEN 'track' WHEN 'MACHINERY' THEN 'secondary' END AS highway FROM customer))""",
    "names": """names AS (SELECT n_nationkey AS district_id, n_name AS district_name, r_name AS region_name
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
