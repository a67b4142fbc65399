"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, their stems (first 4 and 5 bytes, for inflected
forms), word pairs and pairs with one or two words between (ASCII letters lowered; words are runs of
ASCII letters, digits and bytes of other scripts); each counts once a text. Training has a rate per coordinate and L1 sparsity; the few weights that are not
zero travel with the task. Learnt from a bounded sample, ``max_rows``; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import SLICE_BYTES, held_out, in_tasks, slices
from latticeworks.llm.hashing import U, Words, mix

BITS = 18
BIAS = 0
_STEMS = (4, 5)
_SKIPS = ((1, 0x9FB21C651E98DF25), (2, 0xE7037ED1A0B428DB), (3, 0x8EBC6AF09C88C6E3))


def features(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram and skip-gram, repeats included; bucket 0 is the bias."""
    words = Words(texts, lower=True, alnum=True)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.text_at))
    kinds = [words.hash, *(mix(words.head(n) + U(n)) for n in _STEMS)]
    owners = [text_of] * len(kinds)
    for gap, salt in _SKIPS:
        same = text_of[gap:] == text_of[:-gap]
        kinds.append(mix(words.hash[:-gap][same] * U(salt) + words.hash[gap:][same]))
        owners.append(text_of[gap:][same])
    bucket = (np.concatenate(kinds) >> U(64 - BITS)).astype(np.int32)
    return np.concatenate(owners), np.where(bucket == BIAS, 1, bucket)


@dataclass
class Model:
    """Non-zero weights by bucket."""

    buckets: np.ndarray
    weights: np.ndarray

    def scores(self, texts: pa.LargeBinaryArray) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.buckets] = self.weights
        owner, bucket = features(texts)
        used = dense[bucket] != 0
        pairs = np.unique(owner[used].astype(np.int64) << BITS | bucket[used])
        total = dense[BIAS] + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def pack(buckets: np.ndarray) -> tuple[int, bytes]:
    """How many sorted buckets, and their differences compressed."""
    gaps = np.diff(buckets, prepend=np.int32(0)).astype(np.int32)
    # The bytes of one place side by side: the upper ones are nearly all zero.
    return len(gaps), pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpack(n: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


@dataclass
class Rows:
    """(distinct buckets, label) rows that are unpacked one at a time, each time they are gone through."""

    packed: list[tuple[int, bytes]]
    labels: list[int]

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        return ((unpack(n, data), y) for (n, data), y in zip(self.packed, self.labels, strict=True))


def ftrl(rows: Iterable[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 3) -> Model:
    """FTRL-proximal over (distinct buckets, label 0/1) rows; no rows give the zero model."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(at):
        a = z[at]
        return np.where(np.abs(a) <= l1, 0.0, -(a - np.sign(a) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for buckets, label in rows:
            at = np.append(buckets, BIAS)
            w = weight(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -500, 500))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(1 << BITS))
    return Model(np.flatnonzero(w).astype(np.int32), w[w != 0])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 5000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the labelled rows of each label whose key hashes lowest, at most ``max_toxic`` and
    ``max_clean``; the bias is then moved to the labels' true share. Held-out keys are left out.

    Null keys and labels are not learnt from; of repeated labels of a key the highest counts, of
    repeated documents the one whose features are lowest in byte order. Without labels the model gives every text the score 0.5.
    """
    known = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
        .where(~held_out("k")).groupBy("k").agg((F.max("y") > 0).cast("int").alias("y"))
    )
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    lowest = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
    chosen = lowest(1, max_toxic).unionByName(lowest(0, max_clean))
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).join(F.broadcast(chosen), "k")

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, "x", SLICE_BYTES // 4):
                owner, bucket = features(texts)
                pairs = np.unique(owner.astype(np.int64) << BITS | bucket)
                cuts = np.searchsorted(pairs >> BITS, np.arange(1, len(texts)))
                parts = np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), cuts)
                yield pa.RecordBatch.from_pydict({
                    "k": batch.column("k").slice(first, len(texts)).cast(pa.string()),
                    "y": batch.column("y").slice(first, len(texts)),
                    "b": pa.array([p.tobytes() for p in parts], pa.binary()),
                })

    def shrink(batches):
        for batch in batches:
            small = [pack(np.frombuffer(b, np.int32)) for b in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "k": batch.column("k"), "y": batch.column("y"), "n": pa.array([n for n, _ in small], pa.int32()), "b": pa.array([b for _, b in small], pa.binary())})

    lowest_of = in_tasks(picked, run, "k string, y int, b binary").groupBy("k", "y").agg(F.min("b").alias("b"))
    rows = in_tasks(lowest_of.select(F.xxhash64("k").alias("h"), "k", "y", "b"), shrink, "h long, k string, y int, n int, b binary").collect()
    rows = [(y, n, bytes(b)) for _, _, y, n, b in sorted((tuple(r) for r in rows), key=lambda r: r[:2])]
    model = ftrl(Rows([(n, b) for _, n, b in rows], [y for y, _, _ in rows]))
    used = {y: sum(r[0] == y for r in rows) for y in (0, 1)}
    if all(used.values()):
        shift = np.log(counts[1] / counts[0]) - np.log(used[1] / used[0])
        weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
        weights[BIAS] = weights.get(BIAS, 0.0) + float(shift)
        model = Model(np.array(sorted(weights), np.int32), np.array([weights[b] for b in sorted(weights)]))
    return model


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of every row and the probability of label 1 (double).

    Null text counts as empty and gets the score of the bias alone; repeated rows are scored alike; other
    columns are ignored; an empty table gives an empty result. ``name`` must not be one of ``columns``.
    """
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` double"
    ask = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__x"))

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, "__x", SLICE_BYTES // 4):
                out = {c: batch.column(c).slice(first, len(texts)) for c in columns}
                yield pa.RecordBatch.from_pydict(out | {name: pa.array(model.scores(texts))})

    return in_tasks(ask, run, schema)
