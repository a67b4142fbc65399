"""Runs of words against a brute-force search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from latticeworks.llm import periodic
from latticeworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(words, exponent=4, least=6):
    """(start, length, period): maximal stretches of every period, of equal ones the smallest."""
    best = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, exponent * q):
                best.setdefault((start, i - start), q)
    return sorted((s, m, q) for (s, m), q in best.items())


def brute_collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases():
    rng = random.Random(11)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, thue_morse(500), fibonacci(400), ["a", "b"] * 4, ["a", "b"] * 4 + ["a"]]
    for _ in range(300):
        n = rng.randrange(1, 40)
        out.append([rng.choice("ab") for _ in range(n)])
    for _ in range(200):
        words = []
        while len(words) < 120:
            part = [rng.choice("abcde") for _ in range(rng.randrange(1, 9))]
            words += part * rng.randrange(1, 7) + part[: rng.randrange(len(part) + 1)]
        out.append(words)
    nested = (["x", "y"] * 4 + ["z"]) * 5
    return [*out, nested, nested * 4 + ["q"] + nested]


def test_runs_of_many_texts_at_once():
    texts = cases()
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    codes = np.array([names[w] for t in texts for w in t], np.int64)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = [[] for _ in texts]
    for k, *run in periodic.find_runs(codes, at):
        got[k].append(tuple(run))
    assert got == [brute_runs(t) for t in texts]


@pytest.mark.parametrize(("exponent", "least"), [(2, 1), (2, 5), (3, 10), (5, 6)])
def test_other_limits(exponent, least):
    for words in cases()[5:120:3]:
        codes = np.array([ord(w) for w in words], np.int64)
        got = [tuple(r[1:]) for r in periodic.find_runs(codes, np.array([0, len(words)]), exponent, least)]
        assert got == brute_runs(words, exponent, least)


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(50):
        keys = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        n = len(keys)
        order = sorted(range(n), key=lambda i: [*keys[i:], 9])
        sa, isa, lcp = periodic.suffix_array(np.array(keys))
        assert sa.tolist() == order and all(isa[sa[k]] == k for k in range(n))
        for k in range(1, n):
            a, b = keys[sa[k - 1] :], keys[sa[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "é é\x0bé é\x0cé é é"), (5, "a\x85a a a a a"), (5, "a\x85a a a a a"), (6, "w " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, key int").repartition(3)
    got = {r.doc_id: r for r in periodic.collapse_runs(df).collect()}
    assert got[1].collapsed == got[2].collapsed == got[3].collapsed == "" and got[1].n_words == 0 and not got[3].runs
    assert got[None].collapsed == "a" and [tuple(r) for r in got[None].runs] == [(0, 6, 1)]
    assert got[4].collapsed == "é" and got[5].collapsed == "a\x85a a a a a"
    assert got[6].collapsed == "w" and [tuple(r) for r in got[6].runs] == [(0, 50_000, 1)]
    assert periodic.collapse_runs(df).count() == len(rows) and periodic.collapse_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        words = [w.decode() for w in words]
        runs = brute_runs(words)
        top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((r.doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()))
    df = QUERIES["op11_periodic_runs"](spark, SF)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert all(f.dataType.simpleString() == "bigint" for f in df.schema.fields[:6])
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 5
