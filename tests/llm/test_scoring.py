"""Toxicity, language, token counts, packing, decontamination, licences and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from latticeworks.llm import decontamination, language, licenses, packing, token_counts, toxicity
from latticeworks.llm.hashing import Words, window_sums

BPE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "don't", "  'll\n\n's  ", "<|endoftext|>x <|endoftext|>", "日本語  é̱́ 🙂🙂", "123 4५६", "İ! ñ.", "x\x1c\x1dy", "word " * 5000]


def texts(*values):
    return pa.array([v.encode() for v in values], pa.large_binary())


def test_words_and_hashes_by_definition():
    values = ["  Aé b\tc ", "", "x", "b c", " " * 5, "Aé"]
    words = Words(texts(*values))
    split = [v.encode().split() for v in values]
    assert np.diff(words.text_at).tolist() == [len(s) for s in split]
    table = collections.defaultdict(set)
    for w, h in zip([w for s in split for w in s], words.hash.tolist(), strict=True):
        table[w].add(h)
    assert all(len(h) == 1 for h in table.values()) and len(set.union(*table.values())) == len(table)
    long = Words(texts("a b c a b c a b")).hash
    sums = window_sums(long, 3)
    assert sums[0] == sums[3] and len(set(sums[:3].tolist())) == 3 and len(window_sums(long, 9)) == 0


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BPE)
    rng = random.Random(1)
    pieces = list("abtsmdrvle'' \n\t .,!09éñ日🙂") + ["'s", "'ll", "the", " of", "<|endoftext|>"]
    values = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    docs = spark.createDataFrame([(i if i else None, v, 1) for i, v in enumerate(values)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BPE).collect()}
    for i, v in enumerate(values):
        assert got[i if i else None] == (len((v or "").encode()), len(library.encode(v or "", add_special_tokens=False).ids)), v
    assert token_counts.count_tokens(docs.limit(0), BPE).count() == 0


def test_splitter_scan_is_the_same_for_any_number_of_chunks():
    to, begins = token_counts.splitter()
    symbols = np.random.default_rng(0).integers(0, 16, 5000).astype(np.uint8)
    state, want = 0, []
    for s in symbols:
        want.append(begins[state, s])
        state = to[state, s]
    for chunks in (1, 2, 7, 300):
        assert token_counts.run_splitter(symbols, to, begins, chunks).tolist() == want


def check_packing(values, rows, size):
    library = Tokenizer.from_file(WORD)
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(values)
    for i, v in values.items():
        ids, at = [*library.encode(v or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and len(part) == r.length > 0 and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding


@pytest.mark.parametrize("lengths", ["mixed", "half", "none"])
def test_packing_covers_every_id_once(spark, lengths):
    rng = random.Random(3)
    values = {
        "mixed": {i: v for i, v in enumerate([*ODD, *["a b " * int(rng.lognormvariate(3, 1.2)) for _ in range(150)]])},
        "half": {i: "a " * (270 + i % 9) for i in range(90)},  # no two fit one sequence
        "none": {1: None},
    }[lengths]
    docs = spark.createDataFrame(list(values.items()), "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, WORD, size=512).collect()
    padding = check_packing(values, rows, 512)
    assert padding <= 2 * 512
    assert packing.pack(docs.limit(0), WORD, size=512).count() == 0


def test_packing_of_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b c"), (1, "b c")], "doc_id long, text string")
    rows = packing.pack(docs, WORD, size=64).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (0, 2), (1, 3), (1, 3)]


def test_patterns_use_every_item_once_and_come_near_the_bound():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(np.clip(rng.lognormal(3, 1, 4000).astype(int), 1, 127), return_counts=True)
    demand = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    used, bins = collections.Counter(), 0
    for pattern, times in packing.patterns(demand, 128):
        assert sum(u * a for u, a in pattern.items()) <= 128
        bins += times
        for u, a in pattern.items():
            used[u] += a * times
    assert used == demand and bins <= -(-int((sizes * counts).sum()) // 128) * 1.02 + 2


def test_toxicity_learns_plain_words_and_handles_edges(spark):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))] + (["vile", "Nasty!"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "z"))
        labels.append((i, int(bad)))
    rows += [(None, "vile nasty", "z"), (2000, None, "z"), (2001, "", "z"), (2001, "", "z")]
    labels += [(None, 1), (3, None), (2, 0), (2, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    tags = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, tags)
    got = toxicity.score(docs, model, ["doc_id", "score"], name="p").collect()
    assert len(got) == len(rows) and {r.score for r in got} == {"z"}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.p >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    assert len(model.weights) < 2000
    nothing = toxicity.train(docs.limit(0), tags.limit(0))
    assert {r.p for r in toxicity.score(docs.limit(3), nothing, ["doc_id"], name="p").collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model, ["doc_id"], name="p").count() == 0


def test_toxicity_scores_by_brute_force():
    model = toxicity.Model(np.arange(0, 1 << toxicity.BITS, 3, dtype=np.int32), np.linspace(-1, 1, len(range(0, 1 << toxicity.BITS, 3))))
    values = ["A b c d a b", "", "x"]
    owner, bucket = toxicity.features(texts(*values))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for i, s in enumerate(model.scores(texts(*values))):
        total = weight[0] + sum(weight.get(b, 0) for b in {int(b) for o, b in zip(owner, bucket, strict=True) if o == i})
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-12


def test_language_on_held_out_rows_and_edges(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "en", "er"], "cc": ["ñe", "que", "ció", "as"]}
    rows = []
    for i in range(600):
        lang = "aa bb cc".split()[i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 50))), lang if i % 50 else None))
    rows += [(None, "ka lo mi ta kalo", "aa"), (1000, None, "aa"), (1001, "12 !?", "aa"), (1002, "", None), (1003, "ka lo mi " * 20000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "l").selectExpr("*", "l AS lang", "1 AS lang_pred").repartition(3)
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == "aa bb cc".split()[i % 3] for i in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0.0
    assert got[None].lang_pred == "aa" == got[1003].lang_pred and all(0 <= r.score <= 1 for r in got.values())
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs.limit(5), empty).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_presence_is_the_set_of_ngrams():
    seen = language.presence(texts("Ab  1cd", "", "ab"))
    text = "ab cd".encode()
    places = set()
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            code = int.from_bytes(text[i : i + n], "big")
            places.add((code + n) * 2654435761 % (1 << 32) >> 16)
    assert set(np.flatnonzero(seen[0]).tolist()) == places and not seen[1].any()


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "and"] * 40 + [f"v{i}" for i in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, f"{prose(rng.randint(8, 50))}. {prose(rng.randint(5, 20))}.") for i in range(60)] + [(60, prose(300)), (61, "too short"), (62, None), (None, "Null id. " + prose(20))]
    docs = [(i, prose(rng.randint(0, 400)), "x") for i in range(80)]
    for i, (_, b) in enumerate(b for b in bench if b[1] and len(b[1].split()) > 5):
        docs.append((100 + i, f"{prose(150)} {b.upper() if i % 2 else b} {prose(90)}", "x"))
    docs += [(300, None, "x"), (301, "", "x"), (None, bench[5][1], "x"), (302, f"{bench[7][1]} {bench[8][1]} {bench[7][1]}", "x"), (303, bench[60][1].rsplit(" ", 200)[0], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(d, b).collect()}
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for i, t, _ in docs:
        own = grams(words(t))
        for j, x in bench:
            g = grams(words(x))
            if g and len(g & own) / len(g) >= 0.8:
                want.add((i, j))
    assert got == want and len(want) > 60
    old, decontamination.SHARD_WORDS = decontamination.SHARD_WORDS, 200
    try:  # many shards, the same pairs
        assert {(r.doc_id, r.item_id) for r in decontamination.matches(d, b).collect()} == want
    finally:
        decontamination.SHARD_WORDS = old
    kept = decontamination.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _, _ in docs if i not in {x for x, _ in want})
    assert decontamination.matches(d.limit(0), b).count() == 0 and decontamination.matches(d, b.limit(0)).count() == 0


def test_licenses_edges(spark):
    rows = [(1, "x\n LICENSED under the Apache-License, version 2.0!\ny", "q"), (2, "Licensed under CC BY NC 4.0", "q"), (3, None, "q"), (4, "", "q"), (None, "Released\nunder the MIT License.", "q"),
            (5, "under", "q"), (6, "word " * 3000, "q"), (2, "Licensed under CC BY NC 4.0", "q"), (7, "Released under the license of MIT", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_no string")
    got = sorted([tuple(r) for r in licenses.scan(docs).collect()], key=repr)
    # Short texts around a notice reach the threshold as a whole too: 2 * 7 / (7 + 9) and 2 * 3 / (3 + 4).
    assert [r[:3] for r in got] == [(1, -1, "Apache-2.0"), (1, 1, "Apache-2.0"), (2, 0, "CC-BY-NC-4.0"), (2, 0, "CC-BY-NC-4.0"), (None, -1, "MIT"), (None, 1, "MIT")]
    assert [round(r[3], 3) for r in got] == [0.875, 1.0, 1.0, 1.0, 1.0, 0.857]
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, templates=[]).count() == 0


def test_licenses_wrapped_inside_a_line_and_full_texts(spark):
    import textwrap
    lead = "Some words come before it. Released under the MIT License. And some more text follows here."
    full = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + textwrap.fill(licenses.FULL_TEXTS[0][1], 78)
    grant = "Own words here.\n\n" + textwrap.fill(licenses.TEMPLATES[2][1], 40) + "\n\n" + " ".join(f"v{i}" for i in range(200))
    two = "aa bb cc dd ee ff gg hh. Licensed under\nthe Apache License,\nVersion 2.0. " + "ii jj kk ll " * 9 + "Released under the MIT\nLicense. " + "mm nn oo " * 9
    isc = "x y z " * 80 + licenses.FULL_TEXTS[1][1] + " x y z" * 80
    docs = spark.createDataFrame([(1, lead), (2, full), (3, grant), (4, two), (5, isc), (6, "Under the license of the works. " * 20)], "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(docs).collect())
    assert [r[:3] for r in got] == [(1, 0, "MIT"), (2, 4, "MIT"), (3, 2, "MIT"), (4, 0, "Apache-2.0"), (4, 2, "MIT"), (5, 0, "ISC")]
    assert all(r[3] > 0.99 for r in got if r[0] != 2)


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900001, "", "en", "s", 0)], docs.schema))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before = docs
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    docs.write.parquet(str(tmp_path / "out"))
    last = {r.doc_id: r.text for r in before.collect()}
    check_packing(last, spark.read.parquet(str(tmp_path / "out")).collect(), 4096)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), sf).count() == 0, name


def test_license_runs_of_many_copies_and_edits(spark):
    """Every copy of a wrapped notice gives one row, on the line it begins in; edits lower Dice as counted by hand."""
    from latticeworks.llm import licenses

    body = licenses.TEMPLATES[8][1]
    lines = [x for i in range(12) for x in (f"Part {i} by some one", *body.replace(" are ", " are\n").split("\n"))]
    got = sorted(tuple(r)[1:] for r in licenses.scan(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect())
    assert got == [(at, "BSD-2-Clause", 1.0) for at in range(1, 48, 4)]
    words = licenses.words_of(body)
    words[7] = "altered"
    edited = " ".join(words[:10]) + "\n" + " ".join(words[10:])
    a, b = {*zip(words, words[1:])}, {*zip(licenses.words_of(body), licenses.words_of(body)[1:])}
    row = licenses.scan(spark.createDataFrame([(2, "before it\n" + edited + "\nafter it")], "doc_id long, text string"), [("X", body)]).collect()
    assert [(r.line_no, r.license) for r in row] in ([(1, "X")], [(-1, "X")])
    assert row[0].dice == pytest.approx(2 * len(a & b) / (len(a) + len(b))) or row[0].line_no == -1


def test_chunk_tokens_are_those_of_the_library_on_odd_runs():
    rng = random.Random(3)
    signs = [*"abXYst.,!?;:&$_<>|'() \n\t", "é", "́", "̸", "İ", "Σ", "ᄀ", "ᅡ", ";", "　", "中", "7", "²", "Ⅷ", "🙂", "<|endoftext|>", "'ll"]
    values = ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(5000)] + ["", " , "]
    tokens = packing.ChunkTokens(WORD)
    for part in (values[:2500], values[2500:], [""], []):
        ids, at = tokens.ids(texts(*part))
        found = tokens.library.encode_batch_fast(part, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [x.ids for x in found]


def test_rows_for_toxicity_come_back_as_packed_and_travel_small():
    rng = np.random.default_rng(5)
    some = [np.unique(rng.integers(1, 1 << toxicity.BITS, n)).astype(np.int32) for n in (0, 1, 7, 3000, 20000)]
    small = [toxicity.pack(x) for x in some]
    assert all(np.array_equal(toxicity.unpack(*p), x) and toxicity.unpack(*p).dtype == np.int32 for p, x in zip(small, some, strict=True))
    assert sum(len(b) for _, b in small) < 0.5 * sum(x.nbytes for x in some)
    labels = [0, 1, 1, 0, 1]
    packed, plain = (toxicity.ftrl(x, l1=0.1) for x in (toxicity.Rows(small, labels), list(zip(some, labels, strict=True))))
    assert np.array_equal(packed.buckets, plain.buckets) and np.array_equal(packed.weights, plain.weights)


def test_toxicity_of_repeated_documents_does_not_depend_on_their_order(spark):
    docs = [(i, f"kind words number {i}") for i in range(30)] + [(i, f"vile filth number {i}") for i in range(30, 60)]
    docs += [(i, f"another text {i}") for i in range(0, 60, 3)]
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((docs, 1), (docs[::-1], 4))]
    assert np.array_equal(models[0].buckets, models[1].buckets) and np.allclose(models[0].weights, models[1].weights)


def test_licence_matches_hold_a_telling_word(spark):
    from pyspark.sql.functions import lower

    known = [(n, licenses.bigrams_of(b)) for n, b in licenses.TEMPLATES + licenses.FULL_TEXTS]
    telling = set(licenses.telling_words(known, 0.8))
    assert not telling & {"the", "of", "and", "to"}
    for _, grams in known:
        left = [g for g in grams if not telling & set(g.split(" "))]
        assert len(left) < len(grams) * 0.8 / 1.2 - 1e-9  # without these words no run or line can match
    rows = [(1, "_Licensed under the Apache License, Version 2.0._"), (2, "éLicensed under CC BY 4.0."), (3, "words of prose\n" * 50), (4, "relicensed copying softwares")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in licenses.scan(docs).collect()) == [(1, 0, "Apache-2.0"), (2, 0, "CC-BY-4.0")]
    assert [r.doc_id for r in docs.where(licenses._tells(lower(docs.text), sorted(telling))).orderBy("doc_id").collect()] == [1, 2]
