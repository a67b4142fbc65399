"""Licence notices: lines and short texts compared with templates by Dice over word bigrams.

Columns only: a unit (a line, or the whole text if it has more lines than one) is lowered, all but
ASCII letters and digits become spaces, and its distinct word bigrams are compared with those of a
template. For a Dice coefficient of t, sizes a and b must meet b t / (2 - t) <= a <= b (2 - t) / t,
which leaves most units without a candidate before any bigram is built.

A match holds at least t / (2 - t) of its template's bigrams, so it can't miss all of any larger share of
them: from each template a few words are taken whose bigrams are such a share, and texts and lines with none
of these words are left out unsplit. No match is lost by it.

Notices that no line holds alone (wrapped, inside a longer line, full texts) are found as runs of words
over line ends: a best run begins and ends with a bigram of its template, so only those are tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions.rings import let

# Notices by licence, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
# Full texts, looked for as runs of words only.
FULL_TEXTS = [
    ("MIT", TEMPLATES[2][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def words_of(text: str) -> list[str]:
    """A template's words, by the rule the units follow."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


# Taken as telling words only if a template's other words don't suffice.
COMMON = frozenset("a an and any are be by following for in is it not of on or that the this to with work".split())


def telling_words(known: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Words of which every match of any template holds one: with none of them too few of its bigrams are left."""
    out: set[str] = set()
    for _, grams in known:
        left = {tuple(g.split(" ")) for g in grams if not out & set(g.split(" "))}
        while len(left) >= max(len(grams) * least / (2 - least) - 1e-9, 1e-9):
            words = {w for g in left for w in g}
            word = min(words, key=lambda w: (w in COMMON or w.isdigit(), -sum(w in g for g in left), w))
            out.add(word)
            left = {g for g in left if word not in g}
    return sorted(out)


def _tells(text: Column, words: list[str]) -> Column:
    """Whether a lowered text holds one of the words; what is not an ASCII letter or digit ends a word."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    either = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))
    return text.rlike(rf"(?<![a-z0-9])(?:{either})(?![a-z0-9])") if words else F.lit(False)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often it is used above (also in lambdas)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda x, y: F.concat(x, F.lit(" "), y))
                  ).otherwise(F.expr("CAST(array() AS array<string>)"))


def _table(known: list[tuple[str, list[str]]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("b"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known])


def _windows(begin: Column, need: Column, span: Column, b: Column, least: float) -> Column:
    """(d, j) of the windows from pair ``begin`` that reach ``least``: d is -dice, j the last pair.

    ``need`` pairs are the fewest a window has. One pass with running counts: a pair is new in the window if its
    last occurrence (``q`` pairs back) lies before it. A window is left out if a shorter one from the same begin
    is better, for wherever the longer one is free the shorter one is free, too, and wins.
    """
    head = F.slice("p", begin + 1, need - 1)
    zero = F.struct(
        F.size(F.array_distinct(head)).alias("d"), F.size(F.array_intersect(head, F.col("t.grams"))).alias("m"),
        F.lit(0.0).alias("top"), F.expr("CAST(array() AS array<struct<d: double, j: int>>)").alias("out"))

    def step(s, k):
        q, hit = F.get(F.col("q"), k), F.get(F.col("hit"), k)
        fresh = F.when((q == 0) | (q > k - begin), 1).otherwise(0)
        plain = let(fresh, lambda f: F.struct((s["d"] + f).alias("d"), (s["m"] + f).alias("m"), s["top"].alias("top"), s["out"].alias("out")))

        def judged(x):
            return let(x["m"] * 2.0 / (x["d"] + b), lambda dice: F.when((dice >= least) & (dice >= x["top"]), F.struct(
                x["d"].alias("d"), x["m"].alias("m"), dice.alias("top"),
                F.concat(x["out"], F.array(F.struct((-dice).alias("d"), k.alias("j")))).alias("out"))).otherwise(x))

        missed = F.struct((s["d"] + fresh).alias("d"), s["m"].alias("m"), s["top"].alias("top"), s["out"].alias("out"))
        return F.when(hit, let(plain, judged)).otherwise(missed)

    return F.aggregate(F.sequence(begin + need - 1, F.least(begin + span, F.size("p")) - 1), zero, step)["out"]


def _runs(lines: DataFrame, notices: list[tuple[str, list[str]]], texts: list[tuple[str, list[str]]], least: float) -> DataFrame:
    """(key, line_no, license, dice) of runs of words; ``lines`` has key and the lines, cleaned.

    A run has at most (2 - least) / least times its template's bigrams. Of runs that overlap the best stays
    (of equals the first, then the longest). None is given that touches a line with a row of its own, nor for
    the licence of the whole text's row. A run starts only where enough of its template's bigrams follow
    within its greatest length, and what leaves a row are (row, line, begin, end) of runs, no words.
    """
    known = notices + texts
    down, up = least / (2 - least), (2 - least) / least
    longest = int(max(len(g) for _, g in known) * up + 1e-9)
    grams = F.array(*map(F.lit, sorted({x for _, g in known for x in g})))
    fewest = min(len(g) for _, g in known) * down
    split = _once(lines, "lw", F.transform("lines", lambda x: F.filter(F.split(x, " "), lambda y: y != "")))
    joined = _once(split.select("key", "lw"), "p", _pairs(F.flatten("lw")))
    near = joined.where(F.size(F.array_intersect("p", grams)) >= fewest - 1e-9)
    fits = _once(near, "fits", F.filter(_table(known), lambda t: F.size(F.array_intersect("p", t["grams"])) >= t["b"] * down - 1e-9)).where(F.size("fits") > 0)
    def best(words):
        a = F.array_distinct(_pairs(words))
        return F.transform(_table(notices), lambda t: F.struct((F.size(F.array_intersect(a, t["grams"])) * 2.0 / (F.size(a) + t["b"])).alias("dice"), t["name"].alias("name"))) \
            if notices else F.expr("CAST(array() AS array<struct<dice double, name string>>)")

    # A line of fewer or far more pairs than any notice can't be its own row; most are left out by that
    # or hold no telling word.
    telling = F.array(*map(F.lit, telling_words(notices, least))) if notices else F.expr("CAST(array() AS array<string>)")
    sizes = [len(g) for _, g in notices] or [0]

    def reached(words):
        return (F.size(words) > min(sizes) * down) & F.arrays_overlap(words, telling) & F.exists(best(words), lambda x: x["dice"] >= least)

    # line[k]: the line of word k; a run of pairs i to j touches the lines of words i to j + 1.
    fits = _once(_once(fits, "line", F.flatten(F.transform("lw", lambda x, k: F.array_repeat(k, F.size(x))))), "own", F.transform("lw", reached))

    def apart(i, j):
        """Whether words i to j touch no line with a row of its own."""
        first, last = F.get(F.col("line"), i), F.get(F.col("line"), j)
        return ~F.exists(F.slice("own", first + 1, last - first + 1), lambda y: y)

    # The number comes before the explosion: all templates of a row share it.
    each = fits.withColumn("row", F.monotonically_increasing_id()).select("row", "key", "lw", "line", "own", "p", F.explode("fits").alias("t"))
    each = _once(each, "hit", F.transform("p", lambda x: F.array_contains(F.col("t.grams"), x)))
    each = _once(each, "h", F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get(F.col("hit"), i)))
    need, span = F.ceil(F.col("t.b") * down - 1e-9).cast("int"), F.floor(F.col("t.b") * up + 1e-9).cast("int")
    # The hits are in order, so the need-th from here tells whether enough of them are near. No run from here is
    # free if the shortest one is not.
    begins = F.filter("h", lambda i, x: F.coalesce(F.get(F.col("h"), x + need - 1) - i + 1 <= span, F.lit(False)) & apart(i, i + need))
    each = _once(each, "begins", begins).where(F.size("begins") > 0).drop("h")
    each = _once(each, "q", F.transform("p", lambda x, k: F.array_position(F.reverse(F.slice("p", F.greatest(k - longest, F.lit(0)) + 1, F.least(k, F.lit(longest)))), x)))
    ran = F.flatten(F.transform("begins", lambda i: F.transform(_windows(i, need, span, F.col("t.b"), least), lambda y: F.struct(y["d"].alias("d"), i.alias("i"), (-y["j"]).alias("j")))))
    found = _once(each, "runs", ran).where(F.size("runs") > 0).select("row", "key", "lw", "line", "own", "runs", F.col("t.name").alias("name"))

    found = _once(found, "whole", F.transform(F.filter(best(F.flatten("lw")), lambda x: x["dice"] >= least), lambda x: x["name"]))

    listed = found.where(~F.array_contains("whole", F.col("name"))).select(
        "row", "key", "name", F.explode(F.transform(F.filter("runs", lambda x: apart(x["i"], 1 - x["j"])), lambda x: F.struct(x["d"].alias("d"), x["i"].alias("i"), x["j"].alias("j"), F.get(F.col("line"), x["i"]).alias("line")))).alias("x"))
    # Runs that no chain of overlaps ties to each other don't compete: each such stretch is judged by itself.
    before = Window.partitionBy("row").orderBy("i")
    flat = listed.select("row", "key", "x.d", "x.i", "x.j", "name", "x.line")
    reach = F.max(1 - F.col("j")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    tied = flat.withColumn("apart", F.coalesce(F.col("i") > reach, F.lit(True)).cast("long"))
    tied = tied.withColumn("stretch", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = tied.groupBy("row", "stretch").agg(F.first("key").alias("key"), F.array_sort(F.collect_set(F.struct("d", "i", "j", "name", "line"))).alias("runs"))
    kind = "array<struct<d double, i int, j int, name string, line int>>"
    chosen = F.aggregate(F.col("runs").cast(kind), F.expr(f"CAST(array() AS {kind})"), lambda got, x: F.when(
        F.exists(got, lambda y: (x["i"] <= 1 - y["j"]) & (y["i"] <= 1 - x["j"])), got).otherwise(F.concat(got, F.array(x)).cast(kind)))
    return runs.select("key", F.explode(chosen).alias("x")).select("key", F.col("x.line").alias("line_no"), F.col("x.name").alias("license"), (-F.col("x.d")).alias("dice"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, license, dice) of every unit whose best template reaches ``least``.

    line_no counts from 0 over all lines, blank ones too; -1 is the whole text, looked at if it has
    more lines than one. Runs of words that no line holds alone (see ``_runs``) have the line they begin in. Of equally good templates the first name in the alphabet wins. Units of fewer than two words have no
    bigram and never match; null and empty texts give no row; repeated rows give repeated results,
    null keys stay null. An empty table or no template gives an empty result.
    """
    known = [(name, grams) for name, body in (TEMPLATES if templates is None else templates) if (grams := bigrams_of(body))]
    down, up = least / (2 - least), (2 - least) / least
    smallest = min((len(g) for _, g in known), default=1) * down
    longest = max((len(g) for _, g in known), default=0) * up
    full = [(n, bigrams_of(body)) for n, body in FULL_TEXTS] if templates is None else []
    telling = telling_words(known + full, least)
    lower = _once(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "lower", F.lower("text")).where(_tells(F.col("lower"), telling))
    plain = lower.select("key", F.regexp_replace("lower", "[^a-z0-9\n]+", " ").alias("plain"))
    lines = _once(plain, "lines", F.split("plain", "\n"))
    whole = F.when(F.size("lines") > 1, F.array(F.regexp_replace("plain", "\n", " ")))
    units = F.concat("lines", F.coalesce(whole, F.expr("CAST(array() AS array<string>)")))
    listed = lines.select("key", F.size("lines").alias("n"), F.posexplode(units).alias("at", "unit")).where(_tells(F.col("unit"), telling))
    split = _once(listed, "w", F.filter(F.split("unit", " "), lambda y: y != ""))
    split = split.select("key", F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(-1).alias("line_no"), "w")
    # Distinct bigrams are no more than pairs, so only the lower bound holds before they are built.
    sized = split.where(F.size("w") >= max(2, smallest + 1))
    tail = F.slice("w", 2, F.size("w") - 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), tail, lambda x, y: F.concat(x, F.lit(" "), y))
    grams = _once(sized, "a", F.array_distinct(pairs)).withColumn("s", F.size("a")).where((F.col("s") >= smallest) & (F.col("s") <= longest))
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("b"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known
    ]) if known else F.expr("CAST(array() AS array<struct<name string, b int, grams array<string>>>)")
    fitting = F.filter(table, lambda t: (F.col("s") >= t["b"] * down - 1e-9) & (F.col("s") <= t["b"] * up + 1e-9))
    scored = F.transform(fitting, lambda t: F.struct(
        (F.size(F.array_intersect(F.col("a"), t["grams"])) * 2.0 / (F.col("s") + t["b"])).alias("dice"), t["name"].alias("name")))
    best = _once(_once(grams, "t", scored), "top", F.array_max(F.transform("t", lambda x: x["dice"]))).where(F.col("top") >= least)
    name = F.array_min(F.transform(F.filter("t", lambda x: x["dice"] == F.col("top")), lambda x: x["name"]))
    found = best.select("key", "line_no", name.alias("license"), F.col("top").alias("dice"))
    if known or full:
        found = found.unionByName(_runs(lines.select("key", "lines"), known, full, least))
    return found.withColumnRenamed("key", key)
