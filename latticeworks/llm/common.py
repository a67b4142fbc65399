"""What the operators share: reading tables, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.session import ship_package

# Bytes of text that the vectorised code looks at in one go.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared checkpoint folder the session names.

    A temporary folder is taken only on a local master that names none.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: each is computed once
    and outlives a lost executor; the plan above it starts from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` whose rows no later plan reads, not even after a lost executor:
    call it only once all that was derived from them is itself stored or on the driver."""
    for one in tables:
        path = one.sparkSession._jvm.org.apache.hadoop.fs.Path(one.stored_at)
        path.getFileSystem(one.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` is called so in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose crc32 of the id's text is divisible by five; never learnt from.

    A null id is not held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, binary texts) of consecutive runs of about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, texts.slice(start)


def give_back() -> None:
    """Freed memory that the C library still holds goes back to the system, where the library can do that."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors first."""
    ship_package(df.sparkSession)

    def task(batches):
        yield from run(b for b in batches if b.num_rows)
        # The worker lives on; what its pool and its heap keep would count beside the next stage's memory.
        pa.default_memory_pool().release_unused()
        give_back()

    return df.mapInArrow(task, schema)


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int, share: float = 0.001) -> DataFrame:
    """Inner join of rows with a table of one row per group that knows each group's ``size``.

    Groups with more than ``share`` of all rows number at most 1 / share; they are broadcast, so that
    no task gets a hot group. All others are joined by shuffling.
    """
    hot = groups.where(F.col(size) > max(1.0, total * share))
    rare = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(groups, on)
    return rows.join(F.broadcast(hot), on).unionByName(rare)
