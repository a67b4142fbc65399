"""Sinks: Parquet with and without geometry, CSV tables, JSON reports, manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_geo(df: DataFrame, path: str, flat_path: str | None = None, geometry: str = "ring") -> None:
    """Geo table, then a flat copy read back without the geometry column."""
    df.write.mode("overwrite").parquet(path)
    if flat_path:
        df.sparkSession.read.parquet(path).drop(geometry).write.mode("overwrite").parquet(flat_path)


def write_pixels(df: DataFrame, path: str) -> None:
    """Pixel table partitioned by band and epoch."""
    df.repartition("band", "epoch", F.pmod(F.xxhash64("row", "col"), F.lit(64))).write.mode(
        "overwrite"
    ).partitionBy("band", "epoch").parquet(path)


def write_result_csv(df: DataFrame, path: str) -> None:
    """Small result table as one CSV part."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(spark: SparkSession, values: Mapping[str, object], path: str) -> None:
    """One nested JSON record."""

    def column(v):
        if isinstance(v, Mapping):
            return F.struct(*[column(x).alias(k) for k, x in v.items()])
        if isinstance(v, (list, tuple)):
            return F.array(*[F.lit(x) for x in v])
        return F.lit(v)

    row = spark.range(1).select(*[column(v).alias(k) for k, v in values.items()])
    row.coalesce(1).write.mode("overwrite").json(path)


def table_facts(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns and an order-insensitive content checksum, on executors."""
    digest = F.xxhash64(*df.columns)
    return df.agg(
        F.lit(name).alias("output"),
        F.lit("present").alias("status"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.coalesce(F.bit_xor(digest), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"),
    )


def manifest(spark: SparkSession, outputs: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row per expected output; absent ones are listed as missing."""
    schema = "output string, status string, n_rows long, n_columns int, xor_hash long, sum_hash string"
    gone = [(k, "MISSING", None, None, None, None) for k, v in outputs.items() if v is None]
    out = spark.createDataFrame(gone, schema)
    for k, v in outputs.items():
        if v is not None:
            out = out.unionByName(table_facts(v, k))
    return out


def existing(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame | None]:
    """Open the Parquet outputs that exist."""
    found: dict[str, DataFrame | None] = {}
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            found[name] = None
    return found


__all__: Sequence[str] = [
    "existing", "manifest", "table_facts", "write_geo", "write_pixels", "write_report", "write_result_csv",
]
