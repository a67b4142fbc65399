"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

Items are cut into segments of at most 64 words; each is a document of the index, its BM25 term
scores divided by their sum, so that a full copy scores 1. A training text is asked in passages of
128 words every 64: a copied segment lies wholly in one of them. All segments that reach the
threshold are retrieved, by the rules of WAND with block maxima, each applied to a batch of passages:

* a segment's postings are needed only for its essential terms, the rarest ones without which the
  rest cannot reach the threshold;
* per block of segments, the maxima of the terms met, plus the most that any of its segments can still get
  from other terms, bound what the block can reach: blocks below the threshold are skipped;
* in the blocks left the same bound is taken per segment, and only then are full scores computed.

Retrieved items count if the text holds them: five-word shingles of the item, and words of its
question and of its answer, are looked up near the passage.

Items are worked in shards of bounded size, one broadcast index each, against all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, slices, stored
from latticeworks.llm.hashing import Words, window_sums

K1, B = 1.2, 0.75
SEGMENT, PASSAGE, STRIDE = 64, 128, 64
BLOCK = 16
# Essential terms are taken until the rest can add this share of the threshold (below 1).
TIGHT = 0.6
SHINGLE = 5
SHARD_WORDS = 500_000
_ENDS = re.compile(rb"(?<=[.?!])\s+|\n")


def question_words(text: bytes) -> int:
    """Words before the last sentence or line, which is the answer; all of them if there is one only."""
    parts = [p for p in _ENDS.split(text) if p.strip()]
    sizes = [len(Words(pa.array([p], pa.large_binary()), lower=True, alnum=True).hash) for p in parts]
    sizes = [n for n in sizes if n]
    return sum(sizes[:-1]) if len(sizes) > 1 else sum(sizes)


def items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, question): packed word hashes of every item of five words or more."""
    kind = benchmark.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, text):
                words = Words(texts, lower=True, alnum=True)
                parts = [words.hash[a:b] for a, b in zip(words.text_at, words.text_at[1:], strict=False)]
                keep = [i for i, p in enumerate(parts) if len(p) >= SHINGLE]
                yield pa.RecordBatch.from_pydict({
                    "item": batch.column(key).slice(first, len(texts)).take(pa.array(keep, pa.int64())),
                    "words": pa.array([parts[i].tobytes() for i in keep], pa.binary()),
                    "question": pa.array([question_words(texts[i].as_py()) for i in keep], pa.int32()),
                })

    return in_tasks(benchmark.select(key, text), run, f"item {kind}, words binary, question int")


def _segments(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, -(-len(words) // SEGMENT))


def _terms(listed: DataFrame) -> DataFrame:
    """(term, df, words): in how many segments each term is, over all items."""

    def run(batches):
        for batch in batches:
            for w in batch.column("words").to_pylist():
                for segment in _segments(np.frombuffer(w, np.uint64)):
                    yield pa.RecordBatch.from_pydict({"term": pa.array(np.unique(segment).view(np.int64))})

    return in_tasks(listed.select("words"), run, "term long").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n + 1)), columns[order], values[order]


def _expand(pointer: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which input, place in the postings) of all postings of ``terms``."""
    count = pointer[terms + 1] - pointer[terms]
    source = np.repeat(np.arange(len(terms)), count)
    place = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(pointer[terms], count)
    return source, place


@dataclass
class Index:
    """One shard: items, segments, essential postings by segment and by block."""

    names: list
    words: list[np.ndarray]
    question: list[int]
    item_of: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    vocabulary: np.ndarray
    rest: np.ndarray
    block_rest: np.ndarray
    by_segment: tuple
    by_block: tuple
    threshold: float

    @classmethod
    def build(cls, rows: list, df: dict[int, int], segments: int, mean: float, threshold: float) -> Index:
        names, words, question, item_of, terms, weights = [], [], [], [], [], []
        for r in rows:
            w = np.frombuffer(bytes(r.words), np.uint64)
            names.append(r.item)
            words.append(w)
            question.append(r.question)
            for segment in _segments(w):
                t, tf = np.unique(segment, return_counts=True)
                d = np.array([df[x] for x in t.view(np.int64).tolist()])
                score = np.log1p((segments - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(segment) / mean))
                item_of.append(len(names) - 1)
                terms.append(t)
                weights.append(score / score.sum())
        essential, rest = [], np.zeros(len(terms))
        for k, (t, w) in enumerate(zip(terms, weights, strict=True)):
            rare = np.argsort(np.array([df[x] for x in t.view(np.int64).tolist()]), kind="stable")
            left = 1 - np.cumsum(w[rare])
            n = int(np.argmax(left < threshold * TIGHT)) + 1
            essential.append(rare[:n])
            rest[k] = max(0.0, left[n - 1])
        segment = np.repeat(np.arange(len(terms)), [len(e) for e in essential]) if terms else np.zeros(0, int)
        term = np.concatenate([t[e] for t, e in zip(terms, essential, strict=True)]) if terms else np.zeros(0, np.uint64)
        weight = np.concatenate([w[e] for w, e in zip(weights, essential, strict=True)]) if terms else np.zeros(0)
        vocabulary, number = np.unique(term, return_inverse=True)
        block = segment // BLOCK
        blocks = int(block.max()) + 1 if len(block) else 0
        both, back = np.unique(number * max(blocks, 1) + block, return_inverse=True)
        top = np.zeros(len(both))
        np.maximum.at(top, back, weight)
        block_rest = np.zeros(blocks)
        np.maximum.at(block_rest, np.arange(len(rest)) // BLOCK, rest)
        return cls(
            names, words, question, np.array(item_of, int), terms, weights, vocabulary, rest, block_rest,
            _csr(number, segment, weight, len(vocabulary)), _csr(both // max(blocks, 1), both % max(blocks, 1), top, len(vocabulary)), threshold,
        )

    def retrieve(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(text, segment, first word, last word, score) of all passages and segments at the threshold."""
        if not len(self.vocabulary) or not len(words.hash):
            return []
        number = np.searchsorted(self.vocabulary, words.hash)
        number[number == len(self.vocabulary)] = 0
        hits = np.flatnonzero(self.vocabulary[number] == words.hash)
        if not len(hits):
            return []
        size = np.diff(words.text_at)
        passages = np.concatenate([[0], np.cumsum(-(-size // STRIDE))])
        text = np.searchsorted(words.text_at, hits, side="right") - 1
        cell = (hits - words.text_at[text]) // STRIDE
        here = passages[text] + cell
        asked = np.concatenate([here, here[cell > 0] - 1])  # a word is in the passage of its cell and the one before
        term = np.concatenate([number[hits], number[hits][cell > 0]])
        pairs = np.unique(asked * len(self.vocabulary) + term)
        asked, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)

        pointer, block, top = self.by_block
        source, place = _expand(pointer, term)
        blocks = len(self.block_rest)
        keys, back = np.unique(asked[source] * blocks + block[place], return_inverse=True)
        bound = np.bincount(back, top[place]) + self.block_rest[keys % blocks]
        open_blocks = keys[bound >= self.threshold - 1e-9]
        if not len(open_blocks):
            return []
        pointer, segment, weight = self.by_segment
        inside = np.isin(asked, open_blocks // blocks)
        asked, term = asked[inside], term[inside]
        source, place = _expand(pointer, term)
        key = asked[source] * blocks + segment[place] // BLOCK
        at = np.minimum(np.searchsorted(open_blocks, key), len(open_blocks) - 1)
        live = open_blocks[at] == key
        source, place = source[live], place[live]
        keys, back = np.unique(asked[source] * len(self.rest) + segment[place], return_inverse=True)
        bound = np.bincount(back, weight[place]) + self.rest[keys % len(self.rest)]
        out = []
        for k in keys[bound >= self.threshold - 1e-9].tolist():
            passage, seg = divmod(k, len(self.rest))
            text = int(np.searchsorted(passages, passage, side="right")) - 1
            first = int(words.text_at[text]) + (passage - int(passages[text])) * STRIDE
            last = min(first + PASSAGE, int(words.text_at[text + 1]))
            score = float(self.weights[seg][np.isin(self.terms[seg], words.hash[first:last])].sum())
            if score >= self.threshold:
                out.append((text, seg, first, last, score))
        return out

    def found(self, words: Words, overlap: float) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, shingles, question, answer) of verified items, each once per text."""
        best: dict[tuple[int, int], tuple] = {}
        for text, seg, first, last, score in self.retrieve(words):
            item = int(self.item_of[seg])
            own = self.words[item]
            begin = max(int(words.text_at[text]), first - len(own))
            near = words.hash[begin : min(int(words.text_at[text + 1]), last + len(own))]
            shingles = np.unique(window_sums(own, SHINGLE))
            share = float(np.isin(shingles, window_sums(near, SHINGLE)).mean())
            q, a = np.unique(own[: self.question[item]]), np.unique(own[self.question[item] :])
            asked = float(np.isin(q, near).mean())
            answered = float(np.isin(a, near).mean()) if len(a) else asked
            if min(share, asked, answered) >= overlap:
                row = (score, share, asked, answered)
                best[text, item] = max(best.get((text, item), row), row)
        return [(t, i, *row) for (t, i), row in sorted(best.items())]


def shards(benchmark: DataFrame, threshold: float, key: str, text: str):
    """The index, one shard after another; a shard holds about SHARD_WORDS words, or one longer item."""
    listed = stored(items(benchmark, key, text), "items")
    # Segments are as many as array_split makes of each item; lengths are in bytes of 8 a word.
    count = F.ceil(F.length("words") / 8 / SEGMENT)
    n, segments = listed.agg(F.sum(F.length("words") / 8), F.sum(count)).first()
    if not n:
        return
    terms = stored(_terms(listed), "terms")
    number = max(1, -(-int(n) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("words"), F.lit(number))
    for k in range(number):
        own = listed.where(shard == k)
        rows = own.orderBy("item", "words").collect()
        used = _terms(own).select("term")
        df = {r.term: r.df for r in terms.join(used, "term", "left_semi").collect()}
        yield Index.build(rows, df, int(segments), float(n) / int(segments), threshold)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, score, shingle_overlap, question_overlap, answer_overlap) of every text and item it holds.

    An item is held if a segment of it scores ``threshold`` and all three overlaps reach ``overlap``.
    Words are lowered runs of ASCII letters, digits and bytes of other scripts. Items of fewer than
    five words have no shingle and are never held; null texts hold nothing; repeated rows and null
    keys give rows of their own; equal items are all reported. Other columns are ignored; empty tables
    give an empty result.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` {item_kind}, score double, shingle_overlap double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in shards(benchmark, threshold, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                for first, texts in slices(batch, text):
                    rows = index.found(Words(texts, lower=True, alnum=True), overlap)
                    if rows:
                        at, found, *scores = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict({
                            key: batch.column(key).take(pa.array([first + i for i in at], pa.int64())),
                            item: pa.array([index.names[i] for i in found]),
                            **{n: pa.array(v, pa.float64()) for n, v in zip(("score", "shingle_overlap", "question_overlap", "answer_overlap"), scores, strict=True)},
                        })

        out = out.unionByName(in_tasks(docs.select(key, text), run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, all columns unchanged."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for index in shards(benchmark, threshold, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, texts in slices(batch, text):
                    for row in held.value.found(Words(texts, lower=True, alnum=True), overlap):
                        keep[first + row[0]] = False
                yield batch.filter(pa.array(keep))

        docs = in_tasks(docs, run, schema)
    return docs
