"""Packing documents into training sequences as a cutting-stock problem.

1. Tasks tokenise whole texts and cut each document into full sequences, one body of a whole number
   of units (32 tokens) and a tail below one unit. Bodies keep the CRC at every unit, so that any part
   cut at a unit has its CRC without its ids.
2. The histogram of body lengths (at most 127 counts) goes to the driver: a linear program over
   patterns is solved by column generation, a knapsack dynamic program pricing the next pattern.
   Patterns are rounded down; what is left is packed largest first. The emptiest sequences are then
   dissolved and their bodies cut to fill the gaps of the others, so that hardly any padding stays;
   a last rest is cut into sequences of powers of two, which are not padded.
3. Every body has a rank in its length class; pattern, sequence and offset follow from the rank by
   arithmetic, in tasks. Tails fill sequences of their own, also by rank. No group is gathered.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, slices, stored
from latticeworks.llm.hashing import flat, spans

UNIT = 32
MAX_SEEN = 600_000
# Words of letters are given to the library in lines of so many, a lone sign between them.
LINE_WORDS, SIGN = 64, ","
# Column generation stops after so many pivots, or so many that made nothing better.
MAX_PIVOTS, MAX_STALL = 3_000, 100


# ---- tokenising -------------------------------------------------------------------------------


class ChunkTokens(dict):
    """Little-endian 32-bit ids of runs without ASCII white space, as the library encodes them.

    For tokenizers whose splitter drops white space and takes runs of letters and of other signs as
    words: a text's ids are those of its runs in turn, and a run of letters with signs after it is
    the two parts in turn. What was seen last stays known, MAX_SEEN runs at least. Each distinct run of
    a slice is looked up once; a text's ids are then gathered by the numbers of its runs.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        sign = self.library.encode(SIGN, add_special_tokens=False).ids
        self.sign = sign[0] if len(sign) == 1 else None

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: no part of these is the sign, so that its id ends each of them."""
        if self.sign is None:
            return self._encode(words)
        lines = [words[at : at + LINE_WORDS] for at in range(0, len(words), LINE_WORDS)]
        asked = [f" {SIGN} ".join([*line, ""]) for line in lines]
        out = []
        for line, found in zip(lines, self.library.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            end = np.flatnonzero(ids == self.sign)
            if len(end) != len(line):
                out += self._encode(line)
                continue
            data, a = ids.tobytes(), 0
            for b in (end * 4).tolist():
                out.append(data[a:b])
                a = b + 4
        return out

    def learn(self, chunks: list[bytes]) -> None:
        if len(self) + len(chunks) > MAX_SEEN:
            self.older = dict(self)
            self.clear()
        if len(self.parts) > MAX_SEEN:
            self.parts = {}
        new = []
        for chunk in chunks:
            if chunk not in self:
                known = self.older.get(chunk)
                if known is None:
                    new.append(chunk)
                else:
                    self[chunk] = known
        parts = self.parts
        parts[""] = b""
        split, letters, others = [], set(), set()
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            core = text.rstrip(string.punctuation)
            plain = core.isascii()
            # As normalised: some letters are lowered or composed to a letter and a mark.
            whole = core.lower() if plain else unicodedata.normalize("NFC", core).lower()
            if whole.isalpha():
                pair = (whole if plain else core, text[len(core) :])
                if pair[0] not in parts:
                    letters.add(pair[0])
                if pair[1] not in parts:
                    others.add(pair[1])
            else:
                pair = (text, "")
                if text not in parts:
                    others.add(text)
            split.append(pair)
        for words, encode in ((list(letters), self._encode_letters), (list(others), self._encode)):
            if words:
                parts.update(zip(words, encode(words), strict=True))
        for chunk, (a, b) in zip(new, split, strict=True):
            self[chunk] = parts[a] + parts[b]

    def ids(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, with a last one)."""
        buf, off = flat(texts)
        inside, start, end = spans(buf, off)
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=at[1:])
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(buf[inside])])
        coded = runs.dictionary_encode()
        chunks, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn(chunks)
        known = [self[x] for x in chunks]
        size = np.array([len(x) // 4 for x in known], np.int64)
        begin = np.cumsum(size) - size
        own = size[number]
        ends = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=ends[1:])
        place = np.arange(ends[-1]) + np.repeat(begin[number] - ends[:-1], own)
        return np.frombuffer(b"".join(known), "<u4")[place], ends[np.searchsorted(start, off)]


_TOKENS: dict[str, ChunkTokens] = {}


def _tokens(path: str) -> ChunkTokens:
    if path not in _TOKENS:
        _TOKENS[path] = ChunkTokens(path)
    return _TOKENS[path]


PIECE = "place int, rank long, kind int, start long, length long, ids_crc32 long, doc_tokens long, marks binary"


def _pieces(docs: DataFrame, path: str, end_id: int, size: int, key: str, text: str) -> DataFrame:
    """Pieces before they are placed. kind: 0 full, 1.. body units, size/UNIT + n: tail of n tokens."""
    end = int(end_id).to_bytes(4, "little")
    dtype = docs.schema[key].dataType.simpleString()
    full, step = size * 4, UNIT * 4

    def run(batches):
        place = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for batch in batches:
            for first, texts in slices(batch, text):
                tokens = _tokens(path)
                every, cuts = tokens.ids(texts)
                rows = []
                for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
                    ids = every[a:b].tobytes() + end
                    n = len(ids) // 4
                    for at in range(0, len(ids) - full + 1, full):
                        rows.append((first + i, 0, at // 4, size, zlib.crc32(ids[at : at + full]), n, None))
                    at = len(ids) // full * full
                    units = (len(ids) - at) // step
                    if units:
                        marks, crc = [], 0
                        for k in range(units):
                            crc = zlib.crc32(ids[at + k * step : at + (k + 1) * step], crc)
                            marks.append(crc)
                        rows.append((first + i, units, at // 4, units * UNIT, crc, n, np.array(marks, "<u4").tobytes()))
                        at += units * step
                    if at < len(ids):
                        tail = (len(ids) - at) // 4
                        rows.append((first + i, size // UNIT + tail, at // 4, tail, zlib.crc32(ids[at:]), n, None))
                order = []
                for r in rows:
                    order.append(ranks.get(r[1], 0))
                    ranks[r[1]] = order[-1] + 1
                at, kind, start, length, crc, total, marks = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key).take(pa.array(at, pa.int64())),
                    "place": pa.array([place] * len(rows), pa.int32()), "rank": pa.array(order, pa.int64()),
                    "kind": pa.array(kind, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "marks": pa.array(marks, pa.binary()),
                })

    return in_tasks(docs.select(key, text), run, f"`{key}` {dtype}, {PIECE}")


# ---- cutting stock ----------------------------------------------------------------------------


def _knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and the counts of each size (unbounded knapsack by dynamic programming)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            with_one = value[c - sizes[fits]] + prices[fits]
            best = int(with_one.argmax())
            if with_one[best] > value[c] + 1e-12:
                value[c], choice[c] = with_one[best], fits[best]
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(value[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, fractional uses) of the linear program: fewest bins that meet demand.

    Revised simplex over the patterns found so far; a pattern enters while its items' dual prices
    exceed one bin. Stops at the optimum, or with the feasible basis it has when pivots bring nothing.
    """
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    uses = (inverse * demand).sum(1)
    best, stalled = uses.sum(), 0
    for _ in range(MAX_PIVOTS):
        value, pattern = _knapsack(inverse.sum(0), sizes, capacity)
        if not value > 1 + 1e-7 or stalled > MAX_STALL:
            break
        direction = (inverse * pattern).sum(1)
        ratio = np.full(len(uses), np.inf)
        np.divide(uses, direction, out=ratio, where=direction > 1e-7)
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-9)
        out = int(ties[direction[ties].argmax()])
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= direction[:, None] * row
        inverse[out] = row
        step = ratio[out]
        uses = np.maximum(uses - step * direction, 0)
        uses[out] = step
        stalled = 0 if uses.sum() < best - 1e-6 else stalled + 1
        best = min(best, uses.sum())
    return basis, uses


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(count of each size, number of bins)] that use every item exactly once."""
    left = {u: n for u, n in demand.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if left:
        sizes = np.array(sorted(left))
        columns, uses = column_generation(sizes, np.array([left[u] for u in sizes.tolist()], float), capacity)
        for k in np.argsort(-uses, kind="stable"):
            pattern = {int(u): int(a) for u, a in zip(sizes, columns[:, k], strict=True) if a > 0}
            times = min([int(uses[k] + 1e-6), *(left[u] // a for u, a in pattern.items())]) if pattern else 0
            if times > 0:
                out.append((pattern, times))
                for u, a in pattern.items():
                    left[u] -= a * times
    while any(left.values()):  # largest first; each round uses up at least one size
        room, pattern = capacity, {}
        for u in sorted((u for u, n in left.items() if n), reverse=True):
            if take := min(left[u], room // u):
                pattern[u] = take
                room -= take * u
        times = min(left[u] // a for u, a in pattern.items())
        out.append((pattern, times))
        for u, a in pattern.items():
            left[u] -= a * times
    return out


class Layout:
    """Where the body of a length class and rank goes; built on the driver, a few hundred rows."""

    def __init__(self, demand: dict[int, int], capacity: int):
        todo = sorted(patterns(demand, capacity), key=lambda p: -sum(u * a for u, a in p[0].items()))
        whole, loose = [], {}
        fill = lambda p: sum(u * a for u, a in p.items())
        gaps = sum((capacity - fill(p)) * m for p, m in todo)
        given = 0
        while todo and given < gaps:  # dissolve the emptiest until they fill the gaps of the rest
            pattern, times = todo.pop()
            f = fill(pattern)
            # one bin dissolved takes its own gap away and gives its items
            need = min(times, -(-(gaps - given) // capacity)) if f < capacity else 0
            if not need:
                todo.append((pattern, times))
                break
            gaps -= need * (capacity - f)
            given += need * f
            for u, a in pattern.items():
                loose[u] = loose.get(u, 0) + a * need
            if times > need:
                todo.append((pattern, times - need))
        whole = todo
        self.first = 0
        self.by_size: dict[int, list[tuple[int, int, int, int]]] = {u: [] for u in demand}
        taken = dict.fromkeys(demand, 0)
        slots: list[tuple[int, int, int, int]] = []  # first sequence, offset, room, number
        for pattern, times in whole:
            at = 0
            for u in sorted(pattern, reverse=True):
                # ranks from, items per sequence, first sequence, offset
                self.by_size[u].append((taken[u], pattern[u], self.first, at))
                taken[u] += pattern[u] * times
                at += u * pattern[u]
            if at < capacity:
                slots.append((self.first, at, capacity - at, times))
            self.first += times
        self.loose_from = dict(taken)
        self.loose_at, total = {}, 0
        for u in sorted(loose, reverse=True):
            self.loose_at[u] = total
            total += u * loose[u]
        room = sum(r * n for _, _, r, n in slots)
        rest = max(0, total - room)
        if rest >= capacity:
            slots.append((self.first, 0, capacity, rest // capacity))
            self.first += rest // capacity
        bit = 1 << max(0, capacity.bit_length() - 1)
        while bit:  # sequences of powers of two need no padding
            if rest % capacity & bit:
                slots.append((self.first, 0, bit, 1))
                self.first += 1
            bit >>= 1
        self.slots = slots
        self.slot_at = np.concatenate([[0], np.cumsum([r * n for _, _, r, n in slots])]).astype(np.int64)

    def place(self, units: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Parts of a body: (first unit, units, sequence, offset in units)."""
        if rank < self.loose_from[units]:
            entries = self.by_size[units]
            lo, hi = 0, len(entries) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if entries[mid][0] <= rank else (lo, mid - 1)
            start, each, sequence, at = entries[lo]
            nth, slot = divmod(rank - start, each)
            return [(0, units, sequence + nth, at + slot * units)]
        at = self.loose_at[units] + (rank - self.loose_from[units]) * units
        out, done = [], 0
        while done < units:
            k = int(np.searchsorted(self.slot_at, at, side="right")) - 1
            sequence, offset, room, _ = self.slots[k]
            nth, inside = divmod(at - int(self.slot_at[k]), room)
            part = min(units - done, room - inside)
            out.append((done, part, sequence + nth, offset + inside))
            done += part
            at += part
        return out


class Tails:
    """Tails one after another by length and rank; a sequence takes those that begin in its span."""

    def __init__(self, counts: dict[int, int], size: int):
        self.lengths = np.array(sorted(counts), np.int64)
        self.begin = np.concatenate([[0], np.cumsum([n * counts[n] for n in sorted(counts)])]).astype(np.int64)
        self.span = size - (UNIT - 2)
        self.index = {int(n): i for i, n in enumerate(self.lengths)}

    def place(self, length: int, rank: int) -> tuple[int, int]:
        at = int(self.begin[self.index[length]]) + rank * length
        sequence = at // self.span
        edge = sequence * self.span
        k = min(int(np.searchsorted(self.begin, edge, side="right")) - 1, len(self.lengths) - 1)
        n, start = int(self.lengths[k]), int(self.begin[k])
        first = start + -(-(edge - start) // n) * n  # the first tail that begins in the span
        return sequence, at - first


# ---- CRC of a part from the CRCs at its ends ---------------------------------------------------


def _after_zeros(vectors: np.ndarray, count: int) -> np.ndarray:
    """CRC registers after ``count`` zero bytes."""
    v = vectors.astype(np.uint64)
    for _ in range(8 * count):
        v = np.where(v & np.uint64(1), (v >> np.uint64(1)) ^ np.uint64(0xEDB88320), v >> np.uint64(1))
    return v


class PartCrc:
    """crc(part) = crc(up to its end) xor (crc(up to its start) carried over the part's length)."""

    def __init__(self, units: int):
        one = _after_zeros(np.uint64(1) << np.arange(32, dtype=np.uint64), UNIT * 4)
        self.carry = [np.uint64(1) << np.arange(32, dtype=np.uint64)]
        for _ in range(units):
            self.carry.append(self._times(one, self.carry[-1]))

    @staticmethod
    def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
        return np.bitwise_xor.reduce(np.where(bits > 0, matrix[None, :], np.uint64(0)), axis=1)

    def part(self, marks: np.ndarray, first: int, units: int) -> int:
        end = int(marks[first + units - 1])
        if first == 0:
            return end
        return end ^ int(self._times(self.carry[units], np.array([marks[first - 1]], np.uint64))[0])


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the library's ids of its whole text (no special tokens added), then ``end_id``; null
    text counts as empty, so every row has a token at least and appears, repeated rows and null keys
    too. Each id is in exactly one piece; in a sequence offsets run from 0 without gaps up to ``size``
    at most. ``size`` is a multiple of 32 and a power of two. Other columns are ignored; an empty table gives
    an empty result.
    """
    if size % UNIT or size & (size - 1) or size < 2 * UNIT:
        raise ValueError("size must be a power of two of 64 at least")
    capacity = size // UNIT
    pieces = stored(_pieces(docs, path, end_id, size, key, text), "pieces")
    counts = stored(pieces.groupBy("place", "kind").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("place", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    full = total.get(0, 0)
    layout = Layout({k: n for k, n in total.items() if 0 < k < capacity}, capacity)
    tails = Tails({k - capacity: n for k, n in total.items() if k > capacity}, size)
    body_from, tail_from = full, full + layout.first
    dtype = docs.schema[key].dataType.simpleString()

    def run(batches):
        crc = PartCrc(capacity)
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("kind", "rank", "base", "start", "length", "ids_crc32", "marks"))
            for i, (kind, rank, base, start, length, whole, marks) in enumerate(zip(*columns, strict=True)):
                rank += base
                if kind == 0:
                    rows.append((i, start, length, whole, rank, 0))
                elif kind > capacity:
                    sequence, offset = tails.place(length, rank)
                    rows.append((i, start, length, whole, tail_from + sequence, offset))
                else:
                    parts = layout.place(kind, rank)
                    if len(parts) > 1:
                        known = np.frombuffer(marks, "<u4")
                    for first, units, sequence, offset in parts:
                        own = whole if len(parts) == 1 else crc.part(known, first, units)
                        rows.append((i, start + first * UNIT, units * UNIT, own, body_from + sequence, offset * UNIT))
            at, start, length, whole, sequence, offset = zip(*rows, strict=True)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key).take(at), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(whole, pa.int64()), "doc_tokens": batch.column("doc_tokens").take(at),
                "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
            })

    ranked = pieces.join(bases, ["place", "kind"])
    return in_tasks(ranked, run, f"`{key}` {dtype}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
