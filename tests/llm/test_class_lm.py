"""Class bigrams against a plain form of the same clustering, word by word."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import class_lm
from latticeworks.llm.hashing import Words
from latticeworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard string, word long, n long, trained string"
END = None


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(text)), END]


def hash_of(word):
    return int(class_lm.END) if word is END else int(Words(pa.array([word], pa.large_binary())).hash[0])


def likelihood(table, k):
    f = lambda x: x * math.log(x) if x else 0.0
    rows, columns = collections.Counter(), collections.Counter()
    for (a, b), n in table.items():
        rows[a] += n
        columns[b] += n
    return sum(map(f, table.values())) - sum(map(f, rows.values())) - sum(map(f, columns.values()))


def moved(table, context, old, new):
    """Class bigrams after a word goes from one class to another, its contexts' classes as they were."""
    out = collections.Counter(table)
    for (side, c), n in context.items():
        for g, by in ((old, -n), (new, n)):
            out[(c, g) if side == "L" else (g, c)] += by
    return out


def plain(texts, trained, k, sweeps):
    """(n_tokens, n_known, base, score) of every text."""
    split = [tokens(x) for x in texts]
    counts = collections.Counter(w for t, y in zip(split, trained, strict=True) if y for w in t)
    pairs = collections.Counter(p for t, y in zip(split, trained, strict=True) if y for p in zip([END, *t], t, strict=False))
    signed = lambda w: hash_of(w) - (1 << 64) if hash_of(w) >> 63 else hash_of(w)
    ranked = sorted((w for w in counts if w is not END), key=lambda w: (-counts[w], signed(w)))
    own = collections.defaultdict(int, {w: i + 1 for i, w in enumerate(ranked[: k - 2])}) | {END: k - 1}

    def bigrams():
        out = collections.Counter()
        for (a, b), n in pairs.items():
            out[own.get(a, 0), own.get(b, 0)] += n
        return out

    for sweep in range(sweeps):
        table = bigrams()
        contexts = collections.defaultdict(collections.Counter)
        for (a, b), n in pairs.items():
            contexts[b]["L", own.get(a, 0)] += n
            contexts[a]["R", own.get(b, 0)] += n
        new = {}
        for w, context in contexts.items():
            mine = own.get(w, 0)
            if w is END or sweep and (hash_of(w) >> 40) % 2 != sweep % 2:
                continue
            free = moved(table, context, mine, "out")
            free = collections.Counter({x: max(n, 0) for x, n in free.items() if "out" not in x})
            gains = [likelihood_with(free, table, context, mine, g, k) for g in range(k - 1)]
            best = max(range(k - 1), key=lambda g: (gains[g], -g))
            new[w] = mine if gains[mine] + 1e-9 >= gains[best] else best
        own |= new
    table = bigrams()
    rows, columns = collections.Counter(), collections.Counter()
    for (a, b), n in table.items():
        rows[a] += n
        columns[b] += n
    total, once = sum(counts.values()), max(1, sum(n == 1 for n in counts.values()))
    out = []
    for t in split:
        score = base = 0.0
        for a, b in zip([END, *t], t, strict=False):
            g, h = own.get(a, 0), own.get(b, 0)
            spread = (columns[h] + 1) / (sum(columns.values()) + k)
            score += math.log10((table[g, h] + k * spread) / (rows[g] + k))
            if b is not END:
                score += math.log10((counts[b] or once) / (columns[h] + (once if h == 0 else 0)))
            base += math.log10((counts[b] + 1) / (total + len(counts) + 1))
        out.append((len(t), sum(counts[w] > 0 for w in t), total, base, score))
    return out


def likelihood_with(free, table, context, mine, g, k):
    """Likelihood change of joining class g, the word taken out of its own cells and totals."""
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    gain = 0.0
    sides = collections.Counter()
    for (side, c), n in context.items():
        cell = (c, g) if side == "L" else (g, c)
        x = max(table[cell] - (n if g == mine else 0), 0)
        gain += f(x + n) - f(x)
        sides[side] += n
    for side, place in (("L", 1), ("R", 0)):
        x = max(sum(n for cell, n in table.items() if cell[place] == g) - (sides[side] if g == mine else 0), 0)
        gain -= f(x + sides[side]) - f(x)
    return gain


def corpus(rng, n):
    """Texts of a small grammar whose words fall into classes."""
    names, verbs, ends = [f"name{i}" for i in range(30)], [f"verb{i}" for i in range(20)], ["Today", "here.", "now"]
    return [" ".join(rng.choice(x) for x in [names, verbs, names, ends] * rng.randrange(1, 6)) for _ in range(n)]


def test_scores_against_the_plain_form(spark):
    rng = random.Random(12)
    texts = [*corpus(rng, 80), None, "", "Unseen words\x0bhere", "É é name1", "name1 " * 3000]
    rows = [(i, x, "s", 1, 2, "t") for i, x in enumerate(texts)] + [(3, texts[3], "s", 1, 2, "t"), (None, texts[4], "s", 1, 2, "t")]
    trained = [r[0] is not None and r[0] % 5 != 0 and r[0] != 82 for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, sweeps in ((6, 1), (6, 3), (12, 2)):
        got = class_lm.score_texts(df, (F.col("doc_id") % 5 != 0) & (F.col("doc_id") != 82), classes=k, sweeps=sweeps).collect()
        want = plain([r[1] for r in rows], trained, k, sweeps)
        mine = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
        assert mine == sorted(((r[0] is None, r[0] or 0), *x[:3], round(x[3], 6), round(x[4], 6)) for r, x in zip(rows, want, strict=True))


def test_probabilities_add_up():
    """Transitions sum to one; a class's known words and the unseen event fill it."""
    rng = np.random.default_rng(1)
    own, k = np.array([1, 1, 0, 2], np.uint8), 4
    first = np.array([0, 2, 4, 4, 6])
    context, n = np.array([0, 5, 1, 6, 2, 7]), rng.integers(1, 9, 6)
    table = rng.integers(5, 50, (k, k))
    assert class_lm.moves(own, first, context, n, table)[2] == 0  # no context: stays
    assert (class_lm.moves(own, first, context, n, table) != k - 1).all()


def test_nothing_learnt_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, "t"), (2, None, "s", 1, 2, "t")], SCHEMA)
    got = {r.doc_id: r for r in class_lm.score_texts(df, F.lit(False), classes=4, sweeps=1).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got.values())
    assert class_lm.score_texts(df.limit(0), F.lit(True), classes=4, sweeps=1).count() == 0
    with pytest.raises(ValueError, match="sweep"):
        class_lm.score_texts(df, F.lit(True), sweeps=0)


def test_query_base_score_and_gain_on_held_out_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    counts = collections.Counter(w for k, x in docs if not held[k] for w in tokens(x))
    total = sum(counts.values())
    df = QUERIES["op12_lm_scoring"](spark, SF)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == set(held)
    for k, x in docs:
        t, r = tokens(x), got[k]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(counts[w] > 0 for w in t), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and math.isfinite(r.score)
    tested = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_tables_that_no_later_sweep_reads_are_deleted_and_codes_pack_small(spark, monkeypatch):
    rng = np.random.default_rng(4)
    codes = np.minimum(rng.geometric(0.02, 50_000), 20_000).astype(np.int32)
    assert np.array_equal(class_lm._unzip(class_lm._zip(codes), len(codes), "<i4"), codes) and len(class_lm._unzip(class_lm._zip(codes[:0]), 0, "<i4")) == 0
    assert len(class_lm._zip(codes)) < 1.3 * len(codes)  # about a byte a token
    made, stored = [], class_lm.stored
    monkeypatch.setattr(class_lm, "stored", lambda df, name: made.append((name, stored(df, name))) or made[-1][1])
    docs = spark.createDataFrame([(i, f"a b c w{i % 7} d{i}") for i in range(60)], "doc_id long, text string")
    assert class_lm.score_texts(docs, F.lit(True)).count() == 60
    assert [(name, os.path.exists(df.stored_at)) for name, df in made] == [("words", False), *[("answers", False)] * 3, ("scores", True)]
