"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: label is the smallest node reachable.

    ``links`` has columns a and b of one type; direction, repeats and loops do not matter, rows with
    a null end are ignored. Each step takes minima (combined before the shuffle) and joins them back,
    in O(log^2) rounds; no group of links is ever gathered. Every round is written to the shared folder.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links",
    )
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or now.n == 0:
            break
        state = now
        # Large star: every node hands its larger neighbours to its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node hands its smaller neighbours and itself to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(handed.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
