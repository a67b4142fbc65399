"""Runs of periodically repeated words, found on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words
long, that neither neighbour extends. At its right end stands a branching square: two equal halves of
q words whose next words differ. Both halves lie in one LCP interval of depth q, in different children,
so for each interval the suffixes of all children but the largest are tested: is the suffix q words
later, or q words earlier, in the interval too (by its place in the suffix array) but in another child?
The squares found are rotated to the left as far as they go and merged into runs. Intervals come from a
stack over the LCP table; no tree is built.

Texts of a batch share one suffix array; words are told apart by text, so no match crosses texts.
Only stretches that can hold a run are entered: in a run of period q each word after the first q has an
equal one at most q words before it, so for some power of two Q with Q / 2 < q <= Q the run is part of
a stretch of such words (Q in place of q) and the Q words before. No run is lost by that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, slices

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _gaps(keys: np.ndarray) -> np.ndarray:
    """Distance of every place to the last one before it with an equal key; len(keys) + 1 if none."""
    n = len(keys)
    both = np.sort(keys * n + np.arange(n))
    key, place = both // n, both % n
    out = np.full(n, n + 1)
    same = key[1:] == key[:-1]
    out[place[1:][same]] = (place[1:] - place[:-1])[same]
    return out


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _regions(codes: np.ndarray, text_of: np.ndarray, text_at: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words outside of which there is no run."""
    n = len(codes)
    gaps = _gaps(text_of * (int(codes.max()) + 1) + codes)
    depth = np.zeros(n + 1, np.int64)
    reach, longest = 1, int(np.diff(text_at).max())
    while exponent * (reach // 2 + 1) <= longest:
        period = reach // 2 + 1  # the smallest of this power of two
        first, end = _stretches(gaps <= reach)
        enough = end - first >= max(exponent * period, least) - period if reach > 1 else end - first >= max(exponent, least) - 1
        first, end = first[enough], end[enough]
        np.add.at(depth, np.maximum(first - reach, text_at[text_of[first]]), 1)
        np.subtract.at(depth, end, 1)
        reach *= 2
    marked = np.cumsum(depth[:-1]) > 0
    first, end = _stretches(marked)
    cut = text_at[1:-1][(text_at[1:-1] > 0) & (text_at[1:-1] < n)]
    cut = cut[marked[cut] & marked[cut - 1]]  # a stretch ends where its text ends
    return np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([end, cut]))


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, LCP with the suffix before), by doubling of what is not yet told apart.

    The end of the table sorts last. Memory is four bytes a key for each doubling.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    place = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = keys[sa[1:]] != keys[sa[:-1]]
    rank = np.full(n + 1, n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    levels = [rank]
    active, step = place, 1
    while True:
        last = np.append(new[1:], True) if len(new) else new
        keep = ~(new & last)
        active = active[keep]
        if not len(active):
            break
        i = sa[active]
        order_key = rank[i].astype(np.int64) * (n + 1) + rank[np.minimum(i + step, n)]
        order = np.argsort(order_key, kind="stable")
        sa[active] = i[order]
        ordered = order_key[order]
        new = np.ones(len(active), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = rank.copy()
        rank[sa[active]] = np.maximum.accumulate(np.where(new, active, 0))
        levels.append(rank)
        step *= 2
    a, b = sa[:-1], sa[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + common, n)] == levels[k][np.minimum(b + common, n)]
        common[same] += 1 << k
    inverse = np.empty(n, np.int64)
    inverse[sa] = place
    return sa, inverse, np.concatenate([[0], common])


def branching_squares(keys: np.ndarray, copies: int) -> set[tuple[int, int]]:
    """(place, half) of the squares whose continuation differs; only halves that occur ``copies`` times."""
    n = len(keys)
    sa_, isa_, lcp_ = suffix_array(keys)
    sa, isa, lcp = sa_.tolist(), isa_.tolist(), lcp_.tolist()
    lcp.append(-1)
    found: set[tuple[int, int]] = set()
    stack: list[tuple[int, list[int]]] = []
    for k in range(1, n + 1):
        now, left = lcp[k], k - 1
        while stack and stack[-1][0] > now:
            depth, starts = stack.pop()
            low = left = starts[0]
            if k - low < copies or not depth:
                continue
            ends = starts[1:]
            ends.append(k)
            largest = max(range(len(ends)), key=lambda c: ends[c] - starts[c])
            for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
                if c == largest:
                    continue
                for i in sa[a:b]:
                    if i + depth < n:
                        other = isa[i + depth]
                        if low <= other < k and not a <= other < b:
                            found.add((i, depth))
                    if i >= depth:
                        other = isa[i - depth]
                        if low <= other < k and not a <= other < b:
                            found.add((i - depth, depth))
        if stack and stack[-1][0] == now:
            stack[-1][1].append(k)
        else:
            stack.append((now, [left, k]))
    return found


def _rotations(codes: np.ndarray, at: int, half: int, low: int) -> int:
    """How far the square at ``at`` can be rotated to the left: the start of its run."""
    block = 64
    while at > low:
        m = min(block, at - low)
        differ = np.flatnonzero(codes[at - m : at] != codes[at + half - m : at + half])
        if len(differ):
            return at - m + int(differ[-1]) + 1
        at -= m
        block *= 2
    return low


def find_runs(codes: np.ndarray, text_at: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int, int]]:
    """(text, start in it, length, period) of all runs, by text, start and period."""
    if not len(codes):
        return []
    text_of = np.repeat(np.arange(len(text_at) - 1), np.diff(text_at))
    first, end = _regions(codes, text_of, text_at, exponent, least)
    if not len(first):
        return []
    size = end - first
    base = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(first - base, size)
    squares = branching_squares(np.repeat(np.arange(len(first)), size) * (int(codes.max()) + 1) + codes[at], exponent)
    out, last, known = [], -1, []
    for stop, half in sorted((int(at[i]) + 2 * half, half) for i, half in squares):
        if stop != last:
            last, known = stop, []
        # A multiple of a period found here: the same run.
        if any(half % q == 0 and 2 * half <= stop - s for s, q in known):
            continue
        text = int(text_of[stop - 1])
        low = int(text_at[text])
        s = _rotations(codes, stop - 2 * half, half, low)
        known.append((s, half))
        if stop - s >= max(least, exponent * half):
            out.append((text, s - low, stop - s, half))
    return sorted(out)


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.

    Words are runs of bytes other than space and 0x09-0x0D. ``runs`` is an array of (start, length,
    period) by start, then period; ``collapsed`` are the words joined by one space, without those that
    any run holds after its first period. Null and empty texts have no words: no runs, empty string.
    Repeated rows give repeated results, null or repeated keys are passed through, other columns are
    ignored, an empty table gives an empty table. A text is looked at whole, in memory that grows with it.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, "x"):
                split = [x.split() for x in texts.to_pylist()]
                text_at = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
                every = pa.array([w for x in split for w in x], pa.large_binary()).dictionary_encode()
                codes = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs: list[list[dict]] = [[] for _ in split]
                gone: dict[int, np.ndarray] = {}
                for k, start, length, period in find_runs(codes, text_at, exponent, least):
                    runs[k].append({"start": start, "length": length, "period": period})
                    if k not in gone:
                        gone[k] = np.zeros(len(split[k]), bool)
                    gone[k][start + period : start + length] = True
                kept = [x if k not in gone else [w for w, y in zip(x, gone[k].tolist(), strict=True) if not y] for k, x in enumerate(split)]
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column("key").slice(first, len(split)),
                    "n_words": pa.array(np.diff(text_at)),
                    "runs": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    "collapsed": pa.array([b" ".join(x).decode("utf-8", "replace") for x in kept], pa.string()),
                })

    found = in_tasks(docs.select(F.col(key).alias("key"), F.col(text).alias("x")), run, f"key {kind}, n_words long, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("key", key)


def with_echoes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): every tenth text by crc32 of its key repeats a passage of its own to its end.

    Of n words, those from a = g % n on become the words a + (i - a) % p, with g = floor(h / 10),
    p = 1 + floor((n - a) / (3 + g % 8)) and h the crc32 of the key as text, where h % 10 is 0. Texts
    without a word, null texts and rows with a null key stay.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("x"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    g = F.floor(F.col("h") / 10)
    words = F.filter(F.split("x", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = rows.where("h % 10 = 0 AND x IS NOT NULL").select("key", "x", "h", F.explode(F.array(words)).alias("w"))
    n = F.size("w")
    a = F.when(n > 0, g % n).otherwise(0).cast("int")
    hit = hit.select("key", "x", "w", a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))
    moved = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("w"), F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    changed = hit.select("key", F.when(F.size("w") > 0, F.array_join(moved, " ")).otherwise(F.col("x")).alias("x"))
    same = rows.where("h IS NULL OR h % 10 <> 0 OR x IS NULL").select("key", "x")
    return same.unionByName(changed).toDF(key, text)
