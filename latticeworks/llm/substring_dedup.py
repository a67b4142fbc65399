"""Repeated passages: windows that repeat at one length alone are tried at twice that length.

The ladder for windows of W words has two rungs, the last of which is W itself:

1. Length h = ceil(W / 2). Of the h-word windows inside each W-word window only the one with the
   smallest hash is looked at (equal W-windows pick the same one), about 2 / (W - h + 2) of all.
2. Length W = h + h, sharing one word if W is odd. Only windows whose h-window repeats are
   candidates; those that repeat are covered. Longer repeats are unions of these, so none is lost.

Texts are written once as zstd-compressed slices of about 2 MB with a number each. Hashes travel
packed by (bucket, slice); a slice sends each hash once, marked if it has it twice, so a passage
that a third of all documents share meets as one entry a slice. Equality is on 96 hash bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, slices, stored
from latticeworks.llm.hashing import U, Words, window_sums

ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("at", "<u4")])
BUCKET_BYTES = 32 << 20
_TWICE = np.uint32(1 << 31)


def _pack(text: str, key: str, kind: str, docs: DataFrame) -> DataFrame:
    """One row a slice: number, keys, text sizes, texts compressed."""

    def run(batches):
        count = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in slices(batch, text):
                sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
                data = b"".join(x for x in texts.to_pylist())
                keys = batch.column(key).slice(first, len(texts))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([count], pa.int64()),
                    "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                    "raw": pa.array([len(data)], pa.int64()),
                    "data": pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()),
                })
                count += 1

    return in_tasks(docs.select(key, text), run, f"slice long, keys array<{kind}>, sizes array<long>, raw long, data binary")


def _texts(row: dict) -> pa.LargeBinaryArray:
    data = pa.decompress(row["data"], row["raw"], codec="zstd") if row["raw"] else pa.py_buffer(b"")
    offsets = np.zeros(len(row["sizes"]) + 1, np.int64)
    np.cumsum(row["sizes"], out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row["sizes"]), [None, pa.py_buffer(offsets), data])


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one text, hashes of all half windows, the one each start picks)."""
    half = (width + 1) // 2
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(words.text_at) - 1), np.diff(words.text_at))
    starts = np.flatnonzero(text_of[:n] == text_of[width - 1 :])
    halves = window_sums(words.hash, half)
    low, pick = halves[:n].copy(), np.arange(n)
    for step in range(1, width - half + 1):
        other = halves[step : step + n]
        less = other < low
        low[less] = other[less]
        pick[less] = np.flatnonzero(less) + step
    return starts, halves, pick[starts]


def _entries(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one entry for each hash, numbered; the number of each input)."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    out = np.empty(len(first), ENTRY)
    out["h1"], out["h2"], out["at"] = a[first], b[first], np.arange(len(first), dtype=np.uint32)
    out["at"][np.diff(np.append(first, len(a))) > 1] |= _TWICE
    return out, number


def _level(row: dict, width: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(entries of a level, place of each candidate, its entry, words)."""
    words = Words(_texts(row))
    starts, halves, pick = _windows(words, width)
    places = np.unique(pick)
    h = halves[places]
    entries, number = _entries(h, (h * U(0xC2B2AE3D27D4EB4F) >> U(32)).astype(np.uint32))
    if level == 1:
        return entries, places, number, words
    again = _marked(entries, row["level1"])[number]
    starts = starts[np.isin(pick, places[again])]
    h1 = window_sums(words.hash, width)[starts]
    h2 = window_sums(words.hash, width, 0xA0761D6478BD642F)[starts]
    entries, number = _entries(h1, (h2 >> U(32)).astype(np.uint32))
    return entries, starts, number, words


def _marked(entries: np.ndarray, found: list[bytes] | None) -> np.ndarray:
    marked = (entries["at"] & _TWICE) > 0
    for part in found or ():
        marked[np.frombuffer(part, np.uint32)] = True
    return marked


def _survivors(sliced: DataFrame, width: int, level: int, buckets: int) -> DataFrame:
    """(slice, list of packed numbers of the entries that other slices have too)."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                entries = _level(row, width, level)[0]
                bucket = (entries["h1"] % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                parts = np.split(entries[order], cuts[1:]) if len(cuts) else []
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[order][cuts], pa.int32()),
                    "slice": pa.array([row["slice"]] * len(parts), pa.int64()),
                    "part": pa.array([p.tobytes() for p in parts], pa.binary()),
                })

    def meet(batches):
        held: list[tuple[int, bytes]] = []
        at = None
        for batch in batches:
            for bucket, number, part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "part")), strict=True):
                if bucket != at and held:
                    yield from found(held)
                    held = []
                at = bucket
                held.append((number, part))
        if held:
            yield from found(held)

    def found(held):
        entries = np.concatenate([np.frombuffer(p, ENTRY) for _, p in held])
        source = np.repeat(np.arange(len(held)), [len(p) // ENTRY.itemsize for _, p in held])
        order = np.lexsort((entries["h2"], entries["h1"]))
        e = entries[order]
        same = (e["h1"][1:] == e["h1"][:-1]) & (e["h2"][1:] == e["h2"][:-1])
        twice = np.zeros(len(e), bool)
        twice[1:] |= same
        twice[:-1] |= same
        keep = order[twice]
        keep = keep[np.argsort(source[keep], kind="stable")]
        cuts = np.flatnonzero(np.diff(source[keep], prepend=-1))
        if len(cuts):
            numbers = entries["at"][keep] & ~_TWICE
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([held[i][0] for i in source[keep][cuts]], pa.int64()),
                "part": pa.array([p.tobytes() for p in np.split(numbers, cuts[1:])], pa.binary()),
            })

    sent = in_tasks(sliced, send, "bucket int, slice long, part binary")
    met = in_tasks(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), meet, "slice long, part binary")
    return met.groupBy("slice").agg(F.collect_list("part").alias(f"level{level}"))


def remove_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the words that a repeated window covers.

    Words are runs of bytes other than space and 0x09-0x0D. Returns ``key``, n_words, n_removed and
    ``kept_text`` (kept words joined by one space), one row per input row. Null text counts as empty;
    texts below ``window`` words are untouched; repeated rows are repeats of each other; a null or
    repeated key is passed through; other columns are ignored. An empty table gives an empty table.
    """
    if window < 2:
        raise ValueError("window must be 2 words at least")
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    sliced = stored(_pack(text, key, kind, docs), "slices")
    raw = sliced.agg(F.sum("raw")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-raw // BUCKET_BYTES))
    one = stored(_survivors(sliced, window, 1, buckets), "level1")
    sliced = sliced.join(one, "slice", "left")
    two = stored(_survivors(sliced, window, 2, buckets), "level2")

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                entries, starts, number, words = _level(row, window, 2)
                cover = np.zeros(len(words.hash) + 1, np.int64)
                at = starts[_marked(entries, row["level2"])[number]]
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + window, 1)
                keep = np.cumsum(cover[:-1]) == 0
                kept, total = [], []
                for k, x in enumerate(_texts(row)):
                    each = x.as_py().split()
                    mine = keep[words.text_at[k] : words.text_at[k + 1]]
                    total.append(len(each))
                    kept.append(each if mine.all() else [w for w, y in zip(each, mine.tolist(), strict=True) if y])
                n = np.array(total, np.int64)
                yield pa.RecordBatch.from_pydict({
                    key: batch.column("keys").slice(i, 1).flatten(),
                    "n_words": pa.array(n),
                    "n_removed": pa.array(n - np.array([len(x) for x in kept], np.int64)),
                    "kept_text": pa.array([b" ".join(x).decode("utf-8", "replace") for x in kept], pa.string()),
                })

    return in_tasks(sliced.join(two, "slice", "left"), finish, f"`{key}` {kind}, n_words long, n_removed long, kept_text string")
