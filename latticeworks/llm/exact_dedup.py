"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per digest. A batch is reduced
to one row per digest (map-side combined, so a text that a third of all rows share is no hot key),
anti-joined to the index by sort-merge without moving the index, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.llm.common import join_groups, scratch, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> Column:
    """Null as empty, A-Z lowered, all else unchanged."""
    filled = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(filled) == F.length(filled)  # then lower() touches A-Z only
    return F.when(plain, F.lower(filled)).otherwise(F.translate(filled, UPPER, LOWER))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, place) of every row; ``place`` tells rows with equal keys apart."""
    return docs.select(
        F.col(key).alias("key"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    )


class DigestIndex:
    """Digests seen so far, with the key of the row that stays and its place in its batch."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (as of ``digests``) that are new.

        The row with the largest key stays, of equal keys the one with the largest place; a null key
        loses to any other. An empty batch creates the index and adds nothing.
        """
        best = batch.groupBy("digest").agg(F.max(F.struct("key", "place")).alias("keep"))
        new = best.select("digest", F.col("keep.key").alias("keep_key"), F.col("keep.place").alias("keep_place"))
        if self.exists():
            new = new.join(self.rows().hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest")
        writer = new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", self.path).saveAsTable(self.name)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, digest (binary SHA-256).

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest key stays, exactly one even if keys repeat; a row with a null key stays only
    if all its group's keys are null (keep_id is then null). With an ``index`` that already holds
    a text, none of the new rows stays. The upper half of the keys goes in before the lower half, so
    that the order of batches agrees with the rule. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    own, index = index is None, index or DigestIndex(spark)
    # Earlier batches' places must not be taken for this one's.
    known = index.rows().select("digest", F.lit(True).alias("known")) if index.exists() else None
    rows = stored(digests(docs, key, text), "digests")
    if known is not None:
        known = stored(rows.select("digest").distinct().join(known, "digest"), "known")
    ends = rows.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    middle = F.lit(None) if ends[0] is None else F.lit(ends[0]) + (F.lit(ends[1]) - F.lit(ends[0])) / 2
    upper = F.coalesce(F.col("key") >= middle, F.lit(False))
    index.append(rows.where(upper))
    index.append(rows.where(~upper))

    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = counts.join(index.rows(), "digest")
    if known is not None:
        groups = groups.join(known, "digest", "left")
    else:
        groups = groups.withColumn("known", F.lit(None).cast("boolean"))
    groups = stored(groups, "groups")
    if own:  # nobody else can name it; its files stay with the run's other tables
        spark.sql(f"DROP TABLE {index.name}")
    found = join_groups(rows, groups, "digest", "group_size", ends[2])
    kept = F.col("known").isNull() & F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("place") == F.col("keep_place"))
    return found.select(
        F.col("key").alias(key), F.col("keep_key").alias("keep_id"), "group_size", kept.alias("kept"), "digest"
    )
