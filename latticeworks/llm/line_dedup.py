"""Boilerplate lines by their spread over distinct sites.

A HyperLogLog sketch of the sites is built per line digest and merged by aggregation (map-side
first). Lines clearly below the threshold stay, lines clearly above are boilerplate; those within
four standard errors of it get an exact distinct count. All occurrences of boilerplate but the first
go. Only digests and places are shuffled for the decision; texts move once, for the removal.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, join_groups, stored

LG_K = 12


def occurrences(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(key, t1, t2, at, line, site) of every line that is not blank; t1, t2 identify the text."""
    # The text's hashes are taken before it is exploded: above the generator they would be per line.
    whole = docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        F.col(site).cast("string").alias("site"), F.split(F.col(text), "\n").alias("lines"),
    )
    lines = whole.select("key", "t1", "t2", "site", F.posexplode("lines").alias("at", "line"))
    return lines.withColumn("line", F.trim(F.regexp_replace("line", r"[\t\r]", " "))).where("line <> ''").withColumn("line", F.unhex(F.md5("line")))


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, n, first) of lines on ``min_sites`` distinct sites at least; first: smallest (key, t1, t2, at)."""
    error = 4 * 1.04 / math.sqrt(1 << LG_K)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    sketched = stored(lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("key", "t1", "t2", "at")).alias("first"),
    ).where(F.col("sites") >= low), "spread")
    near = sketched.where(F.col("sites") <= high)
    pairs = lines.select("line", "site").distinct()  # a hot line is as many rows as it has sites
    exact = pairs.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = sketched.where(F.col("sites") > high)
    return sure.unionByName(near.join(exact.select("line"), "line", "left_semi")).select("line", "n", "first")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: key and text) of every row, the text without boilerplate lines, and
    ``__lines`` and ``__removed`` (lines in all, lines taken out).

    Lines are what newlines separate; they are equal if equal after trimming and reading tabs and
    carriage returns as spaces. Blank lines are never boilerplate. A line on ``min_sites`` distinct
    sites or more stays only where it comes first (smallest key, null first; then text, then place
    in it), so that no content is lost altogether; rows equal in key and text get equal answers. A null
    site is no site; a null text stays null with 0 lines. An empty table gives an empty result.
    """
    columns = columns or [key, text]
    lines = stored(occurrences(docs, key, text, site), "lines")
    total = lines.count()
    spread = stored(spread_lines(lines, min_sites), "boilerplate")
    place = F.struct("key", "t1", "t2", "at")
    out = join_groups(lines, spread, "line", "n", total).where(~place.eqNullSafe(F.col("first")))
    out = out.groupBy(F.col("key").alias("__k"), F.col("t1").alias("__u1"), F.col("t2").alias("__u2")).agg(F.collect_set("at").alias("__out"))
    asked = docs.select(*[F.col(c) for c in columns], F.col(key).alias("__key"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2"))
    joined = asked.join(out, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")), "left")
    joined = joined.select(*[F.col(c) for c in columns], "__out")

    def run(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            for x, out in zip(batch.column(text).to_pylist(), batch.column("__out").to_pylist(), strict=True):
                parts = x.split("\n") if x is not None else []
                total.append(len(parts))
                gone.append(len(out or ()))
                if out:
                    drop = set(out)
                    x = "\n".join(p for i, p in enumerate(parts) if i not in drop)
                texts.append(x)
            rows = {c: batch.column(c) for c in columns}
            if text in rows:
                rows[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(rows | {"__lines": pa.array(total, pa.int64()), "__removed": pa.array(gone, pa.int64())})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", `__lines` long, `__removed` long"
    return in_tasks(joined, run, schema)
