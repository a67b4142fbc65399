"""Class-based n-grams: words clustered by exchange, texts scored by class transitions and emissions.

P(w | v) = P(class w | class v) P(w | class w). Classes come from the exchange algorithm: the most
frequent words begin with a class each, the end of a text has one, all others share one; then each word
goes where the likelihood of the class bigrams rises most. A sweep judges all words at once by the
bigram table at its begin (every second sweep one half of the words by hash, so that alike words don't
trade places).

Texts are read once, into shards: word hashes met in about SHARD_BYTES of text and the texts as numbers
of these, in a table bucketed by shard. In a sweep each shard sends every word's contexts (how often
which class stands before and after it in training texts), packed by hash bucket, once a word; a bucket
adds them, moves its words and answers each shard with class and count of the words it asked for. The
table of words is never broadcast; the driver sees class tables only. Words are told apart by 64 bits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import discard, in_tasks, scratch, slices, stored
from latticeworks.llm.hashing import U, Words

SHARD_BYTES = 3 << 20
BUCKET_BYTES = 32 << 20
END = U(0xE4D0F7E475E4D0F7)  # stands for the end of a text
REST = 0
_ROWS = 1 << 18


def _planes(x: np.ndarray) -> bytes:
    """The bytes of one place side by side: of small numbers the upper ones are nearly all zero."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(data: bytes, size: int, kind: str, start: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, size * width, start).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(_planes(x), codec="zstd", asbytes=True)


def _unzip(data: bytes, size: int, kind: str) -> np.ndarray:
    return _unplaned(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), size, kind) if size else np.zeros(0, kind)


def _shards(docs: DataFrame, key: str, text: str, trained: Column, kind: str) -> DataFrame:
    """(shard, keys, trained, sizes, words, vocab, n, codes): ``sizes`` counts tokens with the end, whose code is 0."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        keys, flags, hashes, sizes, raw = [], [], [], [], 0

        def shard():
            every = np.concatenate(hashes)
            vocab, inverse, n = np.unique(every, return_inverse=True, return_counts=True)
            often = np.argsort(-n, kind="stable")  # frequent words have small numbers, which take little space
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often), dtype=np.int32)
            size = np.concatenate(sizes)
            codes = np.zeros(len(every) + len(size), np.int32)
            place = np.ones(len(codes), bool)
            place[np.cumsum(size + 1) - 1] = False
            codes[place] = rank[inverse] + 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([number], pa.int64()),
                "keys": pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays(keys)),
                "trained": pa.array([np.concatenate(flags).tobytes()], pa.binary()),
                "sizes": pa.array([(size + 1).tolist()], pa.list_(pa.int64())),
                "vocab": pa.array([np.concatenate([[END], vocab[often]]).astype("<u8").tobytes()], pa.binary()),
                "n": pa.array([len(codes)], pa.int64()),
                "codes": pa.array([_zip(codes)], pa.binary()),
            })

        for batch in batches:
            for first, texts in slices(batch, "x"):
                words = Words(texts, lower=True)
                keys.append(batch.column("key").slice(first, len(texts)))
                flags.append(batch.column("trained").slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(bool))
                hashes.append(words.hash)
                sizes.append(np.diff(words.text_at))
                raw += int(words.offsets[-1])
                if raw >= SHARD_BYTES:
                    yield shard()
                    keys, flags, hashes, sizes, raw, number = [], [], [], [], 0, number + 1
        if keys:
            yield shard()

    ask = docs.select(F.col(key).alias("key"), F.col(text).alias("x"), trained.alias("trained"))
    return in_tasks(ask, run, f"shard long, keys array<{kind}>, trained binary, sizes array<long>, vocab binary, n long, codes binary")


@dataclass
class _Shard:
    """A shard's tokens, with class and count of its words as last answered."""

    sizes: np.ndarray
    trained: np.ndarray
    vocab: np.ndarray
    codes: np.ndarray
    before: np.ndarray
    classes: np.ndarray
    counts: np.ndarray | None

    @classmethod
    def read(cls, row: dict, buckets: int, anchors: list[int], classes: int) -> _Shard:
        vocab = np.frombuffer(row["vocab"], "<u8")
        sizes = np.array(row["sizes"], np.int64)
        codes = _unzip(row["codes"], row["n"], "<i4")
        before = np.zeros_like(codes)
        before[1:] = codes[:-1]  # the first word follows an end, as the text before ends with one
        trained = np.repeat(np.frombuffer(row["trained"], bool), sizes)
        if "answers" not in row:
            known = np.array(anchors, np.int64).view("<u8")
            place = np.argsort(known)
            at = np.searchsorted(known[place], vocab).clip(max=max(len(known) - 1, 0))
            own = np.where(known[place][at] == vocab, place[at] + 1, REST).astype(np.uint8) if len(known) else np.zeros(len(vocab), np.uint8)
            own[0] = classes - 1
            return cls(sizes, trained, vocab, codes, before, own, None)
        order, _ = _dealt(vocab, buckets)
        parts = [a["part"] for a in sorted(row["answers"] or [], key=lambda a: a["bucket"])]
        got = np.frombuffer(b"".join(parts), ANSWER)
        own, counts = np.empty(len(vocab), np.uint8), np.empty(len(vocab), np.int64)
        own[order], counts[order] = got["own"], got["n"]
        return cls(sizes, trained, vocab, codes, before, own, counts)

    def table(self, classes: int) -> np.ndarray:
        """Class bigrams of the training tokens."""
        a, b = self.before[self.trained], self.codes[self.trained]
        return np.bincount(self.classes[a].astype(np.int64) * classes + self.classes[b], minlength=classes * classes)

    def contexts(self, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, context, count): context c stands for class c before, classes + c for class c after."""
        a, b = self.before[self.trained].astype(np.int64), self.codes[self.trained].astype(np.int64)
        each = np.concatenate([b * (2 * classes) + self.classes[a], a * (2 * classes) + classes + self.classes[b]])
        each, n = np.unique(each, return_counts=True)
        return each // (2 * classes), each % (2 * classes), n


ANSWER = np.dtype([("own", "u1"), ("n", "<i8")])


def _dealt(vocab: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(words by bucket, bucket of each of these)."""
    bucket = (vocab % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, batch.slice(i, 1).to_pylist()[0]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def moves(own: np.ndarray, first: np.ndarray, context: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Best class of every word by the change of the class-bigram likelihood.

    Word i has contexts ``first[i]`` to ``first[i + 1]`` (codes as of ``contexts``, counts ``n``). With
    f(x) = x log x the likelihood is sum f(N_ij) - sum f(N_i.) - sum f(N_.j); for its own class a
    word is taken out first. Of equal classes the own one stays, else the lowest number.
    """
    k = len(table)
    table = table.astype(np.float64)
    # Rows: contexts; columns: the class a word would join.
    cells = np.concatenate([table, table.T])
    rows, columns = table.sum(1), table.sum(0)
    out = own.copy()
    words = np.flatnonzero(np.diff(first) > 0)
    step = max(1, _ROWS // k)
    starts = first[words]
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
        some = words[at:end]
        lo, hi = int(first[some[0]]), int(first[some[-1] + 1])
        size = first[some + 1] - first[some]
        mine = np.repeat(own[some], size)
        base = cells[context[lo:hi]]
        count = n[lo:hi].astype(np.float64)
        base[np.arange(hi - lo), mine] -= count
        base = np.maximum(base, 0)
        heads = np.concatenate([[0], np.cumsum(size)[:-1]])
        gain = np.add.reduceat(_xlogx(base + count[:, None]) - _xlogx(base), heads, axis=0)
        before = np.add.reduceat(np.where(context[lo:hi] < k, count, 0), heads)
        after = np.add.reduceat(np.where(context[lo:hi] >= k, count, 0), heads)
        for total, c in ((columns, before), (rows, after)):
            left = np.repeat(total[None, :], len(some), axis=0)
            left[np.arange(len(some)), own[some]] -= c
            left = np.maximum(left, 0)
            gain -= _xlogx(left + c[:, None]) - _xlogx(left)
        gain[:, k - 1] = -np.inf  # the end's class takes no word
        best = gain.argmax(1)
        now = own[some]
        stay = gain[np.arange(len(some)), now] + 1e-9 >= gain[np.arange(len(some)), best]
        out[some] = np.where(stay, now, best)
        at = end
    return out


def _swept(shards: DataFrame, buckets: int, anchors: list[int], table: np.ndarray, half: int | None) -> DataFrame:
    """(shard, answers) after one sweep."""
    k = len(table)

    def send(batches):
        for _, _, row in _rows(batches):
            shard = _Shard.read(row, buckets, anchors, k)
            order, bucket = _dealt(shard.vocab, buckets)
            word, context, n = shard.contexts(k)
            position = np.empty(len(order), np.int64)
            position[order] = np.arange(len(order))
            sent = np.argsort(position[word], kind="stable")
            size = np.bincount(position[word], minlength=len(order))
            ends = np.cumsum(size)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                lo, hi = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                some = sent[lo:hi]
                data = b"".join((shard.vocab[order[a:b]].tobytes(), shard.classes[order[a:b]].tobytes(), size[a:b].astype("<u2").tobytes(),
                                 context[some].astype("u1").tobytes(), _planes(n[some].astype("<u4"))))
                out.append({"bucket": int(bucket[a]), "shard": row["shard"], "words": int(b - a), "raw": len(data), "part": pa.compress(data, codec="zstd", asbytes=True)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("words", pa.int64()), ("raw", pa.int64()), ("part", pa.binary())]))

    def meet(batches):
        held, at = None, None
        for _, _, row in _rows(batches):
            if row["bucket"] != at:
                if held is not None:
                    yield from held.answers(at, table, half)
                held, at = _Bucket(2 * k), row["bucket"]
            held.add(row)
        if held is not None:
            yield from held.answers(at, table, half)

    sent = in_tasks(shards, send, "bucket long, shard long, words long, raw long, part binary")
    met = in_tasks(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), meet, "shard long, bucket long, part binary")
    return met.groupBy("shard").agg(F.collect_list(F.struct("bucket", "part")).alias("answers"))


class _Bucket:
    """Words of one hash bucket: contexts added up part by part, and who asked for which."""

    def __init__(self, width: int):
        self.width = width
        self.words, self.own = np.zeros(0, "<u8"), np.zeros(0, np.uint8)
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.asked: list[tuple[int, np.ndarray]] = []
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, row: dict) -> None:
        data, m = pa.decompress(row["part"], row["raw"], codec="zstd", asbytes=True), row["words"]
        words, own, size = np.frombuffer(data, "<u8", m), np.frombuffer(data, "u1", m, 8 * m), np.frombuffer(data, "<u2", m, 9 * m)
        total = int(size.sum(dtype=np.int64))
        context, n = np.frombuffer(data, "u1", total, 11 * m), _unplaned(data, total, "<u4", 11 * m + total)
        self.asked.append((row["shard"], words))
        self.new.append((words, own, size, context, n))
        self.waiting += total + m
        if self.waiting > 1 << 20:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        words, first = np.unique(np.concatenate([self.words, *[x[0] for x in self.new]]), return_index=True)
        self.own = np.concatenate([self.own, *[x[1] for x in self.new]])[first]
        here = np.searchsorted(words, self.words)
        keys = [here[self.keys // self.width] * self.width + self.keys % self.width] if len(self.keys) else []
        keys += [np.searchsorted(words, np.repeat(x[0], x[2])) * self.width + x[3] for x in self.new]
        n = np.concatenate([self.n, *[x[4].astype(np.int64) for x in self.new]])
        self.keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        self.n = np.bincount(inverse, n, len(self.keys)).astype(np.int64)
        self.words, self.new, self.waiting = words, [], 0

    def answers(self, bucket: int, table: np.ndarray, half: int | None):
        self.merge()
        context = self.keys % self.width
        first = np.searchsorted(self.keys, np.arange(len(self.words) + 1) * self.width)
        total = np.concatenate([[0], np.cumsum(np.where(context < self.width // 2, self.n, 0))])
        found = np.empty(len(self.words), ANSWER)
        found["n"] = total[first[1:]] - total[first[:-1]]
        own = moves(self.own, first, context, self.n, table)
        stays = self.words == END
        if half is not None:
            stays |= (self.words >> U(40)) % U(2) != half
        found["own"] = np.where(stays, self.own, own)
        for shard, words in self.asked:
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "bucket": pa.array([bucket], pa.int64()),
                "part": pa.array([found[np.searchsorted(self.words, words)].tobytes()], pa.binary()),
            })


def _table(shards: DataFrame, buckets: int, anchors: list[int], classes: int) -> np.ndarray:
    """Class bigrams of all training tokens."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for _, _, row in _rows(batches):
            total += _Shard.read(row, buckets, anchors, classes).table(classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(classes * classes, np.int64)
    for row in in_tasks(shards, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row.cell] = row.n
    return out.reshape(classes, classes)


def _words(shards: DataFrame) -> DataFrame:
    """(word, n) of all training tokens, END included."""

    def run(batches):
        for _, _, row in _rows(batches):
            codes = _unzip(row["codes"], row["n"], "<i4")
            n = np.bincount(codes[np.repeat(np.frombuffer(row["trained"], bool), row["sizes"])], minlength=len(row["vocab"]) // 8)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.frombuffer(row["vocab"], "<i8")[at]), "n": pa.array(n[at], pa.int64())})

    return in_tasks(shards.select("trained", "sizes", "vocab", "n", "codes"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", classes: int = 32, sweeps: int = 3) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, train_words, base_score, score) of every row.

    A-Z are lowered; tokens are runs of bytes other than space and 0x09-0x0D, and an end. Learnt from the
    rows where ``trained`` holds (null: not). ``base_score`` is the text's log10 probability by add-one word
    counts, ``score`` that by class bigrams: transitions with ``classes`` pseudo-counts spread by class
    frequency; words by their share of the class. Words not in the training texts are one event of the
    class that rare words begin in, with as many pseudo-counts as words were seen once (one at least).
    Null texts are empty: the end only. Repeated rows are learnt as often as they occur and score alike;
    null or repeated keys are passed through, other columns are ignored, an empty table gives an empty one.
    Of equally frequent words the lesser hash comes first.
    """
    if not 4 <= classes <= 128:
        raise ValueError("classes must be 4 to 128: a context fits one byte")
    if sweeps < 1:
        raise ValueError("the first sweep counts the words")
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"class_lm_{uuid.uuid4().hex}"
    made = _shards(docs, key, text, F.coalesce(trained, F.lit(False)), kind).repartition(parts, "shard")
    made.write.format("parquet").bucketBy(parts, "shard").option("path", scratch(spark, "shards")).saveAsTable(name)
    shards = spark.table(name)
    words = stored(_words(shards), "words")
    seen = words.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"), F.sum((F.col("n") == 1).cast("long")).alias("once")).first()
    tokens, types, once = seen.tokens or 0, seen.words, max(seen.once or 0, 1)
    end = int(np.array([END]).view(np.int64)[0])
    anchors = [r.word for r in words.where(F.col("word") != end).orderBy(F.col("n").desc(), "word").limit(classes - 2).collect()]
    discard(words)
    size = shards.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts, -(-6 * size // BUCKET_BYTES))
    now, last = shards, None
    for sweep in range(sweeps):
        table = _table(now, buckets, anchors, classes)
        half = None if sweep == 0 else sweep % 2
        answers = stored(_swept(now, buckets, anchors, table, half), "answers")
        now = shards.join(answers.hint("merge"), "shard", "left")
        if last is not None:
            discard(last)  # only the latest answers are read from here on
        last = answers
    table = _table(now, buckets, anchors, classes).astype(np.float64)

    rows, columns = table.sum(1), table.sum(0)
    spread = (columns + 1) / (columns.sum() + classes)
    moved = np.log10((table + classes * spread[None, :]) / (rows[:, None] + classes)).reshape(-1)
    weight = columns.copy()
    weight[REST] += once

    def run(batches):
        for batch, i, row in _rows(batches):
            shard = _Shard.read(row, buckets, anchors, classes)
            n = shard.counts if shard.counts is not None else np.zeros(len(shard.vocab), np.int64)
            own = shard.classes.astype(np.int64)
            emitted = np.log10(np.where(n > 0, n, once) / np.maximum(weight[np.where(n > 0, own, REST)], 1))
            emitted[0] = 0  # the end's class holds nothing else
            base = np.log10((n + 1) / (tokens + types + 1))
            heads = np.cumsum(shard.sizes) - shard.sizes
            each = moved[own[shard.before] * classes + own[shard.codes]] + emitted[shard.codes]
            size = len(shard.sizes)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("keys").slice(i, 1).flatten(),
                "n_tokens": pa.array(shard.sizes), "n_known": pa.array(np.add.reduceat((n[shard.codes] > 0).astype(np.int64), heads)),
                "train_tokens": pa.array(np.full(size, tokens)), "train_words": pa.array(np.full(size, types)),
                "base_score": pa.array(np.add.reduceat(base[shard.codes], heads)), "score": pa.array(np.add.reduceat(each, heads)),
            })

    scored = in_tasks(now, run, f"key {kind}, n_tokens long, n_known long, train_tokens long, train_words long, base_score double, score double")
    out = stored(scored, "scores")
    discard(last)
    spark.sql(f"DROP TABLE {name}")  # nobody else can name it; its files stay with the run's other tables
    return out.withColumnRenamed("key", key)
