"""Token counts from a tokenizer compiled to deterministic transducers.

Two machines, both reading left to right and writing numbers only:

* the splitter reads character classes and writes 1 where a pre-token begins (8 states);
* the merger reads a pre-token's bytes and writes, on every transition, by how much the number of
  tokens of the prefix read so far changes (below 0 if tokens merge), so that the sum is the count.

The splitter runs over chunks of a slice of texts in step: first from all 8 states at once, which
gives each chunk its state map; maps compose through a parallel prefix scan into the state before
each chunk; then once more from there. A pre-token boundary resets the merger, so its states need
no map. The merger's states are compiled when first reached: byte-pair encoding of a prefix has one
last token t, the one whose pair with the last token before it is an encoding of its own, so a state
is what may still matter: for each suffix that some longer token begins with, the last token before
it and the count there. Pre-tokens seen before are looked up. Both stores are bounded and start
afresh when full.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from latticeworks.llm.common import in_tasks, slices
from latticeworks.llm.hashing import U, hash_spans

# Splitter states and symbols. C1 and C2 are apostrophes that begin a contraction of 1 or 2 letters,
# S0 and W0 a space and another white space before something visible, W1 any other white space.
FREE, IN_L, IN_N, IN_O, PREFIX, IN_S, LAST1, LAST2 = range(8)
L, N, O, C1, C2, S0, W0, W1 = range(8)
STATES = SYMBOLS = 8
# Contractions that are pre-tokens of their own.
SHORT, LONG = "stmd", ("re", "ve", "ll")
CHUNKS = 2048
MAX_STATES, MAX_SEEN, MAX_PAIRS = 150_000, 400_000, 1_000_000


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a pre-token) by (state, symbol); symbols from 8 on begin a text."""
    fresh = {L: IN_L, N: IN_N, O: IN_O, C1: LAST1, C2: LAST2, S0: PREFIX, W0: FREE, W1: IN_S}
    goes_on = {
        (IN_L, L): IN_L, (IN_N, N): IN_N, (IN_S, W1): IN_S,
        (PREFIX, L): IN_L, (PREFIX, N): IN_N,
        **{(s, x): IN_O for s in (IN_O, PREFIX) for x in (O, C1, C2)},
        **{(LAST1, x): FREE for x in range(SYMBOLS)}, **{(LAST2, x): LAST1 for x in range(SYMBOLS)},
    }
    to = np.zeros((STATES, 2 * SYMBOLS), np.uint8)
    begins = np.ones((STATES, 2 * SYMBOLS), bool)
    for state in range(STATES):
        for symbol in range(SYMBOLS):
            to[state, symbol] = goes_on.get((state, symbol), fresh[symbol])
            begins[state, symbol] = (state, symbol) not in goes_on
            to[state, SYMBOLS + symbol] = fresh[symbol]
    return to, begins


def run_splitter(symbols: np.ndarray, to: np.ndarray, begins: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """Where pre-tokens begin, by chunk state maps and their prefix scan."""
    chunks = max(1, min(chunks, len(symbols) // 16))
    width = -(-len(symbols) // chunks) if len(symbols) else 1
    padded = np.full(chunks * width, W1, np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(chunks, width).T)
    flat_to, flat_begins = to.reshape(-1), begins.reshape(-1)
    row = np.uint8(2 * SYMBOLS)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = flat_to[maps * row + column[:, None]]
    gap = 1
    while gap < chunks:  # inclusive scan: after it, maps[k] leads through chunks 0..k
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        gap *= 2
    state = np.concatenate([np.zeros(1, np.uint8), maps[:-1, FREE]])
    out = np.empty((width, chunks), bool)
    for i, column in enumerate(columns):
        at = state * row + column
        out[i] = flat_begins[at]
        state = flat_to[at]
    return out.T.reshape(-1)[: len(symbols)]


def _classes() -> np.ndarray:
    """Symbol of every code point, without context: L, N, O, C1 (apostrophe), S0, W0."""
    out = np.full(0x110000, O, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = L
        elif kind == "N":
            out[i] = N
    # The White_Space property.
    for first, last in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[first : last + 1] = W0
    out[0x20], out[ord("'")] = S0, C1
    return out


def symbols_of(points: np.ndarray, begin: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Splitter input: classes with what the next two characters of the same text decide."""
    out = classes[points]
    n = len(points)
    next1, next2 = np.zeros(n, points.dtype), np.zeros(n, points.dtype)
    next1[:-1], next2[:-2] = points[1:], points[2:]
    ends = begin[begin > 0] - 1
    last = np.append(ends, n - 1)
    next1[last] = 0
    next2[last] = 0
    next2[last[last > 0] - 1] = 0
    quote = out == C1
    short = np.isin(next1, [ord(c) for c in SHORT])
    long = np.zeros(n, bool)
    for a, b in LONG:
        long |= (next1 == ord(a)) & (next2 == ord(b))
    out[quote] = np.where(short[quote], C1, np.where(long[quote], C2, O))
    white = (out == S0) | (out == W0)
    visible = np.ones(n, bool)
    visible[:-1] = ~white[1:]
    visible[last] = False
    out[white & ~visible] = W1
    out[begin] += SYMBOLS
    return out


class Merger:
    """Byte-pair encoding of one pre-token as a transducer, compiled as far as it was needed."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        # The printable stand-ins of the 256 bytes in the vocabulary's strings.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        stands = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(stands[c] for c in s)
        ids = {}
        for s, i in vocabulary.items():
            if all(c in stands for c in s):
                ids[raw(s)] = i
        self.bytes_of = {i: b for b, i in ids.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.ranks = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b = raw(a), raw(b)
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for b, i in ids.items():
            node = 0
            for byte in b:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        # State 0: nothing read; one live suffix (empty), no token before it.
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.goes: dict[int, int] = {}
        self.writes: dict[int, int] = {}

    def encode(self, data: bytes) -> list[int]:
        """The merges applied by rank; used to decide pairs when compiling."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min((self.ranks.get(p, (1 << 60, 0)) + p for p in zip(ids, ids[1:], strict=False)), key=lambda x: x[0])
            if best[0] == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == best[2] and ids[i + 1] == best[3]:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fits(self, before: int, token: int) -> bool:
        key = (before, token)
        found = self.pairs.get(key)
        if found is None:
            if before < 0:
                found = self.encode(self.bytes_of[token]) == [token]
            else:
                found = self.encode(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def compile(self, state: int, byte: int) -> int:
        """Add the transition; returns the next state."""
        live, last, count = [], -1, 0
        for node, before, at in self.states[state]:  # longest suffix first
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            live.append((to, before, at))
            if last < 0 and self.token[to] >= 0 and self.fits(before, self.token[to]):
                last, count = self.token[to], at + 1
        after = (*((n, b, a - count) for n, b, a in live), (0, last, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        self.goes[state << 8 | byte] = number
        self.writes[state << 8 | byte] = count
        return number

    def count(self, data: bytes) -> int:
        state = total = 0
        goes, writes = self.goes, self.writes
        for byte in data:
            key = state << 8 | byte
            to = goes.get(key)
            if to is None:
                to = self.compile(state, byte)
            total += writes[key]
            state = to
        if len(self.states) > MAX_STATES:
            self.forget()
        return total


class TokenCounter:
    """Counts as the library gives them for a byte-level BPE file: no normaliser, the byte-level
    splitter without prefix space, special strings inside texts as one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        model = spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must match as they stand")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merger = Merger(model["vocab"], model["merges"])
        self.classes = _classes()
        self.to, self.begins = splitter()
        self.seen: dict[int, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.special:
                if special in text:
                    pieces = [y for x in pieces for y in x.split(special)]
            out[i] += len(pieces) - 1
            parts += [p for p in pieces if p]
            owner += [i] * (len(parts) - len(owner))
        if not parts:
            return out
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
        begins = run_splitter(symbols_of(points, begin, self.classes), self.to, self.begins)
        # From characters to bytes.
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(size)
        data = "".join(parts).encode()
        first = np.flatnonzero(begins)
        start = ends[first] - size[first]
        end = np.append(start[1:], len(data))
        hashes = hash_spans(np.frombuffer(data, np.uint8), start, end) + (end - start).astype(U)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        seen, count = self.seen, self.merger.count
        each = list(map(seen.get, distinct.tolist()))
        for i, known in enumerate(each):
            if known is None:
                w = where[i]
                each[i] = seen[int(distinct[i])] = count(data[start[w] : end[w]])
        if len(seen) > MAX_SEEN:
            seen.clear()
        part_of = np.searchsorted(begin, first, side="right") - 1
        per_part = np.bincount(part_of, np.array(each, np.float64)[back], minlength=len(parts))
        np.add.at(out, np.array(owner), per_part.astype(np.int64))
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled tokenizer per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row: UTF-8 bytes and tokens of the whole text.

    Null counts as empty (0, 0); keys may be null or repeat; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, text):
                decoded = [x.decode("utf-8", "replace") for x in texts.to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key).slice(first, len(texts)),
                    "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                    "n_tokens": pa.array(counter(path).counts(decoded), pa.int64()),
                })

    return in_tasks(docs.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long")
