"""Exact, substring, line and SimHash deduplication against brute force, edge cases included."""

import collections
import hashlib
import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from latticeworks.llm import exact_dedup, line_dedup, simhash, similar, substring_dedup
from latticeworks.llm.common import stored
from latticeworks.llm.components import components

SCHEMA = "doc_id long, text string, source string, digest string, line string, key long, fp long, slice long"


def frame(spark, rows, parts=3):
    """Rows of (doc_id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", 7, 8, 9) for r in rows], SCHEMA).repartition(parts)


def words(rng, n, of=30):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def test_exact_keeps_the_largest_key_and_one_of_ties(spark):
    rows = [(1, "Ab", "s"), (2, "aB", "s"), (3, None, "s"), (4, "", "s"), (None, "ab", "s"), (5, "É", "s"), (6, "é", "s"), (7, "q", "s"), (7, "Q", "s")]
    got = exact_dedup.deduplicate(frame(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    assert by[1][0].keep_id == 2 and by[2][0].kept and by[None][0].keep_id == 2 and not by[None][0].kept
    assert by[2][0].group_size == 3 and by[3][0].keep_id == 4 and by[5][0].kept and by[6][0].kept
    assert sum(r.kept for r in by[7]) == 1 and by[7][0].group_size == 2
    assert bytes(by[1][0].digest) == hashlib.sha256(b"ab").digest()
    assert exact_dedup.deduplicate(frame(spark, rows).limit(0)).count() == 0


def test_index_persists_over_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.deduplicate(frame(spark, [(1, "a", "s"), (2, "b", "s")]), index=index).collect()
    assert all(r.kept for r in first)
    second = {r.doc_id: r.kept for r in exact_dedup.deduplicate(frame(spark, [(3, "A", "s"), (4, "c", "s")]), index=index).collect()}
    assert second == {3: False, 4: True}
    assert index.rows().count() == 3


def brute_windows(rows, width):
    split = [(x or "").encode().split() for _, x, _ in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (key, _, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_substring_against_brute_force(spark):
    rng = random.Random(5)
    passage = words(rng, 20, 500)
    rows = [(i, words(rng, rng.randint(0, 60), 500), "s") for i in range(60)]
    rows += [(100 + i, f"{words(rng, 5, 500)} {passage}  {words(rng, 5, 500)}", "s") for i in range(30)]
    rows += [(200, f"{passage}\n{passage}", "s"), (201, "a " * 50, "s"), (202, None, "s"), (203, "", "s"), (None, passage, "s"), (204, "é\x1c  " + passage[:40], "s")]
    rows += [rows[3], rows[3], (300, words(rng, 60_000, 100_000), "s")]
    for width in (2, 7, 8):
        got = sorted(map(tuple, substring_dedup.remove_repeats(frame(spark, rows), width).collect()), key=repr)
        assert got == sorted(brute_windows(rows, width), key=repr)
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0), 7).count() == 0


def test_lines_on_many_sites_go_but_for_the_first(spark):
    rows = [(i, f"own {i}\n common \n\n\tcommon", f"s{i % 4}") for i in range(20)]
    rows += [(50, "rare\nx", "s1"), (51, "rare", "s2"), (52, None, "s3"), (53, "", None), (None, "common", "s9"), (54, "nosite", None), (54, "nosite", None)]
    rows += [(60 + i, "three", f"t{i}") for i in range(3)] + [(70 + i, "two", f"t{i % 2}") for i in range(9)]
    got = {(r.doc_id, r.text): (r["__lines"], r["__removed"]) for r in line_dedup.remove_boilerplate(frame(spark, rows), min_sites=3).collect()}
    assert got[None, "common"] == (1, 0)  # the first: a null key comes before others
    assert got[0, "own 0\n"] == (4, 2) and got[19, "own 19\n"] == (4, 2)
    assert got[50, "rare\nx"] == (2, 0) and got[52, None] == (0, 0) and got[53, ""] == (1, 0)
    assert got[60, "three"] == (1, 0) and got[61, ""] == (1, 1) and got[78, "two"] == (1, 0) and got[54, "nosite"] == (1, 0)
    assert line_dedup.remove_boilerplate(frame(spark, rows).limit(0)).count() == 0


def test_fingerprint_by_definition():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = words(rng, n, 40).upper() + " \t É"
        w = text.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == want
    assert simhash.fingerprint(b" \n") == 0


def brute_components(fps, reach):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= reach:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_links_find_every_component_with_and_without_crowds(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(25):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    fps |= {sum(1 << b for b in rng.sample(range(5), 2)) for _ in range(30)}
    fps = [simhash._signed(x) for x in fps]
    table = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    for reach, crowd in ((2, 64), (2, 1), (1, 1), (0, 64)):
        found = {r.node: r.label for r in components(simhash.links(table, reach, crowd)).collect()}
        want = brute_components(fps, reach)
        assert {f: found.get(f, f) for f in fps} == want


def test_near_duplicates_edges(spark):
    rng = random.Random(4)
    base = words(rng, 300, 400)
    rows = [(i, base + f" tail{i}", "s") for i in range(5, 15)] + [(1, None, "s"), (2, "", "s"), (None, " \n", "s"), (3, words(rng, 100, 400), "s"), (3, words(rng, 100, 400), "s")]
    rows += [(40, base, "s"), (40, base, "s")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.doc_id].append(r)
    assert groups[1][0].component_id == 1 and groups[2][0].component_id == 1 and groups[None][0].component_id == 1
    assert len(got) == len(rows)
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert len(kept) == len({(r.component_id, r.fp) if r.component_id == 3 else r.component_id for r in got})
    assert sum(r.doc_id == 40 for r in kept) <= 1
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def brute_near(rows, least=0.8, shingle=5):
    """Kept keys: one of each group that verified pairs connect."""
    sets = []
    for _, x, _ in rows:
        w = (x or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) or frozenset([tuple(w)]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row[0])
    return sorted(min(g, key=lambda k: (k is None, k)) for g in groups.values())


def planted_near(rng):
    rows, passage = [], words(rng, 60, 5000)
    for i in range(25):
        base = words(rng, rng.randint(60, 300), 5000).split()
        rows.append((len(rows), " ".join(base), "s"))
        for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06):  # similarities on both sides of 0.8
            copy = [f"n{rng.randrange(5000)}" if rng.random() < share else w for w in base]
            rows.append((len(rows), " ".join(copy).upper(), "s"))
    rows += [(len(rows) + i, f"{passage} {words(rng, 20 + i, 5000)}", "s") for i in range(40)]  # a common passage
    base = words(rng, 150, 5000).split()
    for _ in range(80):  # a crowd of near copies of one text
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            copy[at] = f"c{rng.randrange(5000)}"
        rows.append((len(rows), " ".join(copy), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "one two", "s"), (903, "One  TWO", "s"), (904, "a b c d e", "s"), (905, "a b c d e f", "s"), (906, "two one", "s")]
    return rows + [(950, rows[0][1], "s"), (950, rows[0][1], "s")]


def test_similar_against_brute_force(spark):
    rows = planted_near(random.Random(11))
    for least, shingle in ((0.8, 5), (0.5, 2)):
        got = similar.keep_one(frame(spark, rows), least=least, shingle=shingle)
        assert sorted(r.doc_id for r in got.collect()) == brute_near(rows, least, shingle)
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert similar.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_pipeline_stage_keeps_one_of_each_group_of_similar_texts(spark):
    rows = planted_near(random.Random(12))
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == brute_near(rows)


def test_sets_are_made_only_of_long_texts_that_are_alike(spark, monkeypatch):
    """Bit maps that a long text's members fill would let every pair through."""
    rng, counts = random.Random(14), collections.defaultdict(list)

    def noted(df, name):
        out = stored(df, name)
        counts[name].append(out.count())
        return out

    monkeypatch.setattr(similar, "stored", noted)
    shared = words(rng, 9000, 10**9)
    texts = [f"{shared} {words(rng, 1900, 10**9)}" for _ in range(3)]
    texts.append(texts[0] + " end")
    placed = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    maps = similar._prefixes(placed.withColumn("id", F.col("place")), "place", "id", "text", 5, 0.8).selectExpr("place AS node", "size", "bits")
    pairs = stored(spark.createDataFrame([(i, j) for j in range(4) for i in range(j)], "a long, b long"), "pairs")
    found = similar._verified(pairs, maps, placed, "place", "text", 5, 0.8)
    assert [tuple(r) for r in found.collect()] == [(0, 3)]
    assert counts["likely"] == [1]


def test_similar_sets_of_unlike_sizes_against_brute_force(spark):
    """Their bit maps have up to eight times the length of one another."""
    rng = random.Random(15)
    base = words(rng, 600, 10**6).split()
    rows = [(i, " ".join(base[: 600 - 37 * i]), "s") for i in range(16)] + [(20 + i, " ".join(base[100 * i :]), "s") for i in range(6)]
    rows += [(30 + i, words(rng, 40 + 30 * i, 10**6), "s") for i in range(8)] + [(40 + i, rows[i][1].upper() + " " + words(rng, 25 * i + 1, 10**6), "s") for i in range(10)]
    for least in (0.2, 0.7):
        got = similar.keep_one(frame(spark, rows), least=least, shingle=3)
        assert sorted(r.doc_id for r in got.collect()) == brute_near(rows, least, 3)


def test_files_compare_only_sets_whose_first_shared_member_may_lie_there(spark):
    places = spark.createDataFrame([(100, 0), (100, 11), (100, 12), (100, 19), (80, 0), (80, 1), (79, 0)], "size int, pos int")
    both = places.alias("x").crossJoin(places.alias("y")).where(similar._alike(0.8))
    got = sorted({tuple(sorted([(r[0], r[1]), (r[2], r[3])], reverse=True)) for r in both.collect()})
    def fit(a, i, b, j):
        most = min(a - i, b - j)
        return min(a, b) >= 0.8 * max(a, b) and most >= 0.8 * (a + b - most) - 1e-9
    rows = [tuple(r) for r in places.collect()]
    assert got == sorted({tuple(sorted([x, y], reverse=True)) for x in rows for y in rows if fit(*x, *y)})
    assert ((100, 12), (100, 12)) not in got and ((100, 19), (80, 0)) in got


def test_large_files_compare_a_pair_once(spark):
    """Sets of ten members, filed under five; all share four of them, each of the fifth is shared by three."""
    rows = [(i, i if i % 7 else 0, 10, pos, pos) for i in range(30) for pos in range(4)] + [(i, i if i % 7 else 0, 10, 4, 100 + i // 3) for i in range(30)]
    mixed = spark.createDataFrame(rows, "node long, label long, size int, pos int, s long")
    got = [tuple(r) for r in similar._open_pairs(mixed, 0.1).collect()]
    want = {(i, j) for j in range(30) for i in range(j) if i % 7 or j % 7}
    assert set(got) == want
    assert len(got) == len(want) + sum(i // 3 == j // 3 for i, j in want)  # those of small files


def test_counters_of_shingles_grow_with_the_texts(spark):
    texts = spark.createDataFrame([("x" * 10**6,)] * 10, "text string")
    assert similar._width(texts.limit(1), "text") == similar.FEWEST
    assert 2 ** similar._width(texts, "text") > 10**7 / similar.COUNTER_BYTES
    assert similar._width(texts.limit(0), "text") == similar.FEWEST


def test_first_candidates_of_the_pipeline_stage_are_those_of_fingerprints(spark):
    """Their ties connect what fingerprints within two bits connect, and links that only they propose count."""
    rng = random.Random(13)
    base = words(rng, 20000, 5000).split()
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 20000, 1000)] + [words(rng, 80, 5000) for _ in range(30)]
    placed = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    rows = similar._prefixes(placed.withColumn("id", -placed.place), "place", "id", "text", 5, 0.8).selectExpr("place AS node", "fp")
    pairs = similar._by_fingerprint(stored(rows, "fingerprints"))
    label = {r.node: r.label for r in components(pairs).collect()}
    fps = [simhash.fingerprint(x.encode(), 5) for x in texts]
    want, first = brute_components(set(fps), 2), {}
    for i, x in enumerate(fps):
        first.setdefault(want[x], i)
    assert len(first) < len(set(fps))
    assert [label.get(i, i) for i in range(len(fps))] == [first[want[x]] for x in fps]


def test_columns_named_like_those_used_inside_come_back_unchanged(spark):
    rows = [(1, "a b c d e f g", "s"), (2, "A b c d e f g", "t"), (3, None, "u"), (4, "h i j k l m n", "v")]
    docs = frame(spark, rows).selectExpr("*", "doc_id * 10 AS __place", "-doc_id AS __PLACE_")
    for keep in (similar.keep_one, simhash.keep_one):
        got = keep(docs)
        assert got.columns == docs.columns
        assert sorted((r.doc_id, r[-2], r[-1]) for r in got.collect()) == [(i, 10 * i, -i) for i in (1, 3, 4)]
