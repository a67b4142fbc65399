"""Near duplicates by SimHash and tables of distances to reference fingerprints.

The references are zero, 32 masks of two bits and 8 random fingerprints. The distances to zero and
to a mask give the number of bits set under the mask, (2 + d(x, 0) - d(x, mask)) / 2. A pair within
r <= 2 bits differs under at most 2 of the 32 masks, so of 5 groups of masks at least 3 agree: each
fingerprint is filed under its distances of each of the 10 triples of groups, and only those filed
alike are compared; first by the largest difference of their distances to the random references
(over r: no link), then bit by bit.

Equal fingerprints are one node with a count. A file that holds more than ``crowd`` fingerprints is
not compared pairwise: two fingerprints within 2 bits are both within 1 bit of some point, so its
members are filed again under the 65 points within one bit of them and tied there to the smallest,
at most 65 at a point. Components need no more than these ties.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, join_groups, slices, stored, unused
from latticeworks.llm.components import components

SEED = 42
MASKS = 32
GROUPS = 5
TRIPLES = list(combinations(range(GROUPS), 3))
RANDOM = 8
_STEP = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(i: int) -> int:
    return _signed(3 << (2 * i))


def _random(i: int) -> int:
    return _signed(xxhash.xxh64_intdigest(f"reference {i}", seed=i))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes.

    A-Z are lowered, words are runs of bytes other than space and 0x09-0x0D, shingles are ``shingle``
    words joined by a space, repeats included; fewer words make one shingle, none the value 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _signed(xxhash.xxh64_intdigest(joined, SEED))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), _STEP):
        some = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _STEP], last[at : at + _STEP], strict=True)])
        total += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * total > len(first)).tobytes(), "big"))


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """``columns`` of every row and its fingerprint (long); null text counts as empty."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", fp long"
    ask = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__x"))

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, "__x"):
                out = {c: batch.column(c).slice(first, len(texts)) for c in columns}
                yield pa.RecordBatch.from_pydict(out | {"fp": pa.array([fingerprint(x.as_py(), shingle) for x in texts], pa.int64())})

    return in_tasks(ask, run, schema)


def _distance(a: Column | str, b: Column | int) -> Column:
    left = F.col(a) if isinstance(a, str) else a
    return F.bit_count(left.bitwiseXOR(b if isinstance(b, Column) else F.lit(b).cast("long")))


def _files(fps: DataFrame) -> DataFrame:
    """(fp, file): ten rows a fingerprint."""
    under = [((F.lit(2) + _distance("fp", 0) - _distance("fp", _mask(i))) / 2).cast("long") for i in range(MASKS)]
    groups = [under[g::GROUPS] for g in range(GROUPS)]
    packed = []
    for group in groups:
        value = F.lit(0).cast("long")
        for c in group:
            value = value * 3 + c
        packed.append(value)
    # 7 masks make at most 3^7 = 2187 values, three groups and the triple's number fit 37 bits.
    table = fps.select("fp", *[v.alias(f"g{i}") for i, v in enumerate(packed)])
    keys = [
        F.lit(n).cast("long") * 2187**3 + F.col(f"g{a}") * 2187**2 + F.col(f"g{b}") * 2187 + F.col(f"g{c}")
        for n, (a, b, c) in enumerate(TRIPLES)
    ]
    return table.select("fp", F.explode(F.array(*keys)).alias("file"))


def _close(reach: int) -> Column:
    x, y = F.col("x.fp"), F.col("y.fp")
    apart = F.greatest(*[F.abs(_distance(x, _random(i)) - _distance(y, _random(i))) for i in range(RANDOM)])
    return (x < y) & (apart <= reach) & (_distance(x, y) <= reach)


def links(fps: DataFrame, reach: int = 2, crowd: int = 64) -> DataFrame:
    """(a, b) ties between distinct fingerprints (column fp, no repeats) whose components are those of
    all pairs within ``reach`` (0 to 2) bits."""
    if not 0 <= reach <= 2:
        raise ValueError("reach must be 0, 1 or 2: five groups of masks cover two differences")
    files = stored(_files(fps), "files")
    sizes = files.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = files.join(sizes.where(F.col("n") <= crowd).select("file"), "file", "left_semi")
    pairs = small.alias("x").join(small.alias("y"), "file").where(_close(reach)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    crowded = files.join(sizes.where(F.col("n") > crowd).select("file"), "file", "left_semi").select("fp").distinct()
    if reach == 0:
        return pairs
    flips = [F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)]]
    if reach == 2:
        points = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("point"))
    else:  # within one bit: both share the fingerprint with that bit cleared
        points = crowded.select("fp", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i) & (1 << 64) - 1)).cast("long")).alias("p")) for i in range(64)
        ])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = points.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(ties)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 2, shingle: int = 3, crowd: int = 64, place: str | None = None) -> DataFrame:
    """(key, fp, component_id, kept, place) of every row.

    component_id is the smallest key of the rows whose fingerprints are linked to this one, itself
    included (null keys are passed over; null if there is no other). Equal fingerprints are linked,
    that of empty and null texts (0) too. ``kept`` marks one row of each component: smallest key, null
    last, of equal keys the smallest place. ``place`` names a column that tells rows apart, else one is
    made. Other columns are ignored; an empty table gives an empty result.
    """
    if place is None:
        rows = fingerprints(docs, [key], text, shingle).withColumnRenamed(key, "key").withColumn("place", F.monotonically_increasing_id())
    else:
        rows = fingerprints(docs, [key, place], text, shingle).withColumnRenamed(key, "key").withColumnRenamed(place, "place")
    rows = stored(rows, "fingerprints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "place")).alias("first")
    nodes = stored(rows.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "nodes")
    total = rows.count()
    found = components(links(nodes.select("fp"), reach, crowd))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = labelled.groupBy("label").agg(F.min("first").alias("lowest"))
    groups = stored(labelled.join(lowest, "label").select("fp", "n", F.col("lowest.key").alias("component_id"), F.col("lowest.place").alias("keeper")), "components")
    return join_groups(rows, groups, "fp", "n", total).select(
        F.col("key").alias(key), "fp", "component_id", (F.col("place") == F.col("keeper")).alias("kept"), "place"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each group of near duplicates (see ``near_duplicates``), all columns unchanged."""
    place = unused(docs, "__place")
    placed = stored(docs.withColumn(place, F.monotonically_increasing_id()), "placed")
    found = near_duplicates(placed, key, text, reach, shingle, place=place)
    gone = found.where(~F.col("kept")).select(F.col("place").alias(place))
    return placed.join(gone, place, "left_anti").drop(place)
