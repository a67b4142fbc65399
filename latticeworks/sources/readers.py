"""Readers: footprint tiles, column-pruned tables, reference layers, pixels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.functions import rings
from latticeworks.functions.scalars import clean_pixel, lenient_double
from latticeworks.sources import schemas


def footprint_tiles(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """Compressed CSV tiles; columns are found by name, WKT becomes a ring.

    Columns may come in any order and others may stand between them; a wanted
    one that is absent, or a tile whose header differs, is an error.

    A gzip tile is read by one task whatever its size, so the rows are spread
    right after the scan, before any geometry work.
    """
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schemas.FOOTPRINT_TILE).fields}
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in kinds if c not in header]:
        raise ValueError(f"missing columns: {missing}")
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    raw = read.select(*kinds)
    spread = spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return normalise(raw.repartition(spread))


def normalise(raw: DataFrame, source: str = "tiles") -> DataFrame:
    """Canonical column names, source label, largest ring of the WKT."""
    ring = rings.largest_ring(rings.wkt_rings(F.col("geometry")))
    return (
        raw.withColumnsRenamed(schemas.CANONICAL)
        .withColumn("source", F.lit(source))
        .withColumn("ring", ring)
        .withColumnRenamed("geometry", "wkt")
    )


def pruned_parquet(
    spark: SparkSession, path: str, columns: Sequence[str], optional: Mapping[str, str] | None = None
) -> DataFrame:
    """Only the wanted columns; absent optional ones become typed nulls.

    Text in an optional numeric column is read leniently (bad text is null).
    """
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    extra = []
    for name, kind in (optional or {}).items():
        if name not in df.columns:
            extra.append(F.lit(None).cast(kind).alias(name))
        else:
            extra.append((lenient_double(name) if kind == "double" else F.col(name).cast(kind)).alias(name))
    return df.select(*columns, *extra)


def footprint_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Second footprint source; binary geometry only travels through."""
    df = pruned_parquet(spark, path, ["id", "geometry"], schemas.OPTIONAL_FOOTPRINT)
    kind = dict(df.dtypes)["geometry"]
    if kind == "string":
        return normalise(df, "parquet")
    return df.withColumn("source", F.lit("parquet"))


def reference_layer(spark: SparkSession, folder: str, layer: str) -> DataFrame:
    """One region layer: (id, name, ring)."""
    return spark.read.schema(schemas.REGION).parquet(f"{folder}/{layer}")


def pixel_table(
    spark: SparkSession, path: str, band: str, nodata: float | None, epochs: Sequence[int] | None = None
) -> DataFrame:
    """Pixels of one band; nodata and negatives become null.

    Band and epoch are partition columns, so both filters prune folders.
    """
    df = spark.read.schema(schemas.PIXEL).parquet(path).where(F.col("band") == band)
    if epochs is not None:
        df = df.where(F.col("epoch").isin(list(epochs)))
    return df.withColumn("value", clean_pixel("value", nodata))
