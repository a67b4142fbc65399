"""Language by a string kernel: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge.

A text is the set of its n-grams of 1 to 4 bytes (ASCII letters lowered; other ASCII bytes count as
space, runs of it as one), hashed to 2^16 places. k(x, z) = |x and z| / sqrt(|x| |z|). With landmarks
Z, features are k(x, Z) K(Z, Z)^-1/2; ridge regression on them per language (target 1, else -1)
folds into one matrix, so that scoring is presence x landmarks x coefficients, batch by batch.
Fitted on a bounded sample, equally many rows per language; every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import held_out, in_tasks, slices
from latticeworks.llm.hashing import flat

PLACES = 1 << 16
UNKNOWN = "und"
_CHUNK = 1 << 20
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _i in range(26):
    _FOLD[65 + _i] = _FOLD[97 + _i] = 97 + _i


def presence(texts: pa.LargeBinaryArray) -> np.ndarray:
    """Boolean (texts x PLACES): which hashed n-grams occur."""
    buf, off = flat(texts)
    out = np.zeros((len(texts), PLACES), bool)
    line = out.reshape(-1)
    owner_base = np.arange(len(texts), dtype=np.int64) * PLACES
    for begin in range(0, len(buf), _CHUNK):
        end = min(len(buf), begin + _CHUNK + 3)
        x = _FOLD[buf[begin:end]]
        owner = np.searchsorted(off, np.arange(begin, end), side="right") - 1
        # one space for a run of it, within a text
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (owner[1:] != owner[:-1])
        x, owner = x[keep], owner[keep]
        code = np.zeros(len(x), np.uint32)
        for n in range(1, 5):
            if len(x) < n:
                break
            code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
            same = owner[: len(code)] == owner[n - 1 :]
            place = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16)
            line[owner_base[owner[: len(code)][same]] + place[same]] = True
            # ``code`` keeps the last four bytes only, which is the 4-gram itself
    return out


def _sizes(packed: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.bitwise_count(packed).sum(1, dtype=np.int64), 1)).astype(np.float32)


@dataclass
class Model:
    """Languages, places that occur in landmarks, landmarks (scaled), coefficients."""

    languages: list[str]
    places: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray

    def predict(self, texts: pa.LargeBinaryArray) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for at in range(0, len(texts), 128):
            part = texts.slice(at, 128)
            value = _kernel(presence(part), self.places, self.landmarks) @ self.coefficients if len(self.languages) else np.zeros((len(part), 0))
            best = value.argmax(1) if len(self.languages) else np.zeros(len(part), int)
            for i, text in enumerate(part):
                if not len(self.languages) or not _has_letter(text.as_py()):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    names.append(self.languages[best[i]])
                    scores.append(float(np.clip((value[i, best[i]] + 1) / 2, 0, 1)))
        return names, np.array(scores)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _landmarks(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places that occur, landmarks as columns scaled by their size)."""
    z = np.unpackbits(packed, axis=1)
    places = np.flatnonzero(z.any(0))
    return places, np.ascontiguousarray((z[:, places] / _sizes(packed)[:, None]).astype(np.float32).T)


def _kernel(seen: np.ndarray, places: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(np.count_nonzero(seen, axis=1), 1)).astype(np.float32)[:, None]
    return seen[:, places].astype(np.float32) @ landmarks / size


def _cholesky(a: np.ndarray) -> np.ndarray:
    low = np.zeros_like(a)
    for j in range(len(a)):
        column = a[j:, j] - (low[j:, :j] * low[j, :j]).sum(1)
        low[j:, j] = column / np.sqrt(max(column[0], 1e-12))
    return low


def _inverse(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangle."""
    out = np.zeros_like(low)
    for i in range(len(low)):
        row = -(low[i, :i, None] * out[:i]).sum(0)
        row[i] += 1.0
        out[i] = row / low[i, i]
    return out


def solve(kernel: np.ndarray, lang: list[str], languages: list[str], between: np.ndarray, ridge: float = 1e-2, jitter: float = 1e-4) -> np.ndarray:
    """Coefficients over landmarks: ridge regression on Nystroem features kernel @ B, where
    B B' is the inverse of the landmarks' kernel (its inverse Cholesky factor; any root gives the
    same predictions). A small problem, so plain loops; no linear algebra library is called."""
    root = _inverse(_cholesky(between + jitter * np.eye(len(between)))).T
    x = np.einsum("ij,jk->ik", kernel.astype(float), root)
    target = np.where(np.array(lang)[:, None] == np.array(languages), 1.0, -1.0)
    half = _inverse(_cholesky(np.einsum("ij,ik->jk", x, x) + ridge * len(x) * np.eye(x.shape[1])))
    beta = np.einsum("ji,jk->ik", half, np.einsum("ij,jk->ik", half, np.einsum("ij,ik->jk", x, target)))
    return np.einsum("ij,jk->ik", root, beta).astype(np.float32)


def train(docs: DataFrame, max_rows: int = 4000, landmarks: int = 64, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on about ``max_rows / languages`` rows of each language and ``landmarks / languages`` (one
    at least) landmarks, those whose key hashes lowest; both bounds hold for any number of rows.

    Held-out keys, null languages, null texts and texts without a letter are not learnt from. Without
    any row every prediction is ``und``.
    """
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(lang).alias("l")).where("l IS NOT NULL AND x IS NOT NULL").where(~held_out("k"))
    counts = {r.l: r.n for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    if not counts:
        return nothing

    def drawn(each: int) -> DataFrame:
        """Rows below the hash that lets about ``each`` rows of a language through."""
        share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, each / n)))])
        return usable.withColumn("h", F.xxhash64("k", F.lit(7))).where((F.col("h") / 2.0**64 + 0.5) < share[F.col("l")])

    def bits(batches):
        for batch in batches:
            for first, texts in slices(batch, "x"):
                for at in range(0, len(texts), 128):
                    some = texts.slice(at, 128)
                    rows = pa.array([i for i, t in enumerate(some) if _has_letter(t.as_py())], pa.int64())
                    seen = np.packbits(presence(some.take(rows)), axis=1)
                    yield pa.RecordBatch.from_pydict({
                        "l": batch.column("l").slice(first + at, len(some)).take(rows), "h": batch.column("h").slice(first + at, len(some)).take(rows),
                        "seen": pa.array([x.tobytes() for x in seen], pa.binary()),
                    })

    each = max(1, landmarks // len(counts))
    marks: dict[str, list] = {}
    for r in in_tasks(drawn(4 * each), bits, "l string, h long, seen binary").orderBy("h", "l", "seen").limit(8 * each * len(counts)).collect():
        own = marks.setdefault(r.l, [])
        if len(own) < each:
            own.append(np.frombuffer(bytes(r.seen), np.uint8))
    if not marks:
        return nothing
    packed = np.array([x for name in sorted(marks) for x in marks[name]])
    places, columns = _landmarks(packed)

    def kernels(batches):
        for batch in batches:
            for first, texts in slices(batch, "x"):
                for at in range(0, len(texts), 128):
                    some = texts.slice(at, 128)
                    rows = [i for i, t in enumerate(some) if _has_letter(t.as_py())]
                    values = _kernel(presence(some), places, columns)[rows]
                    yield pa.RecordBatch.from_pydict({
                        "l": batch.column("l").slice(first + at, len(some)).take(pa.array(rows, pa.int64())),
                        "h": batch.column("h").slice(first + at, len(some)).take(pa.array(rows, pa.int64())),
                        "row": pa.array(values.tolist(), pa.list_(pa.float32())),
                    })

    sample = in_tasks(drawn(max(1, max_rows // len(counts))), kernels, "l string, h long, row array<float>").orderBy("h", "l", "row").limit(2 * max_rows).collect()
    sample = [r for r in sample if r.l in marks]
    bits_of = np.unpackbits(packed, axis=1)[:, places].astype(np.float32)
    between = np.einsum("ij,jk->ik", bits_of, columns) / _sizes(packed)[:, None]
    languages = sorted(marks)
    coefficients = solve(np.array([r.row for r in sample]).reshape(len(sample), len(packed)), [r.l for r in sample], languages, between.astype(float))
    return Model(languages, places, columns, coefficients)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row: a learnt language, or ``und`` with score 0 if the text
    is null or has no letter. Repeated rows get equal answers; other columns are ignored."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, text):
                names, scores = model.predict(texts)
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key).slice(first, len(texts)), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()),
                })

    return in_tasks(docs.select(key, text), run, f"`{key}` {kind}, lang_pred string, score double")
