"""Session set-up and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "latticeworks") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder the session names.

    Falls back to a temporary folder only on a local master, where driver and
    executors share one machine. Spark's checkpoint keeps the plan's size estimate
    and constraints. A join's estimate is the product of its sides, so the digits of
    an iteration's estimate would double with each join, and its constraints would
    pile up on the driver: the rows start a new frame that has neither.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    cut = df.checkpoint(eager=True)._jdf
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(cut.toJavaRDD(), cut.schema()), spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for functions that run in their Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_package_shipped", None) is None:
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(here)
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, files in os.walk(here):
                for file in sorted(files):
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        out.write(full, os.path.join(name, os.path.relpath(full, here)))
        sc.addPyFile(path)
        sc._package_shipped = path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query inside go as soon as it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def range_count(spark: SparkSession) -> int:
    """How many value ranges to cut: one per shuffle partition."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
