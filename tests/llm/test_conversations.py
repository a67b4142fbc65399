"""Conversation repair against a plain search over all edit strings, blocks and queries included."""

import hashlib
import random
import zlib

import pytest

from latticeworks.llm import conversations as conv
from latticeworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, digest string"
WHITE = " \t\n\x0b\x0c\r"


def brute(kinds, faults):
    """Cheapest edits by relaxing (cost, letters) over (rows read, last initial) until nothing changes."""
    n = len(kinds)
    best = {(0, ""): (0, "")}
    todo = [(0, "")]
    while todo:
        i, last = todo.pop()
        cost, letters = best[i, last]
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        steps = [("I", i, after, 5)]
        if i < n:
            steps.append(("D", i + 1, last, 2))
            if faults[i] not in "bd":
                extra = 5 * (faults[i] == "t")
                steps.append(("R", i + 1, after, 1 + extra))
                if last + kinds[i] in ("s", "u", "su", "ua", "au"):
                    steps.append(("K", i + 1, kinds[i], extra))
        for letter, j, role, more in steps:
            found = (cost + more, letters + letter)
            if (j, role) not in best or found < best[j, role]:
                best[j, role] = found
                todo.append((j, role))
    return min(best[n, x] for x in ("", "a") if (n, x) in best)


def whole_report(rows):
    """What a conversation's rows (turn, role, text) give."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    seen, faults = set(), ""
    for _, r, x in rows:
        solid = x.rstrip(WHITE)
        faults += "b" if not solid else "d" if (r, x) in seen else "." if solid[-1] in ".!?" else "t"
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = brute([x if x in "sua" and x else "?" for x in initials], faults) if rows else (0, "")
    out, last, i = [], "", 0
    for letter in audit:
        if letter == "K":
            last = initials[i]
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif letter != "D":
            last = "a" if last == "u" else "u"
            out.append(f"{'user' if last == 'u' else 'assistant'}:{rows[i][2] if letter == 'R' else ''}")
        i += letter != "I"
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_auction_against_search():
    rng = random.Random(13)
    for _ in range(3000):
        n = rng.randrange(0, 14)
        kinds = "".join(rng.choice("suuaa?") for _ in range(n))
        faults = "".join(rng.choice("....tbd") for _ in range(n))
        assert conv.solve_whole(kinds, faults) == brute(kinds, faults)


def test_composed_blocks_equal_the_whole():
    rng = random.Random(14)
    for _ in range(500):
        n = rng.randrange(1, 40)
        kinds = "".join(rng.choice("suuaa?") for _ in range(n))
        faults = "".join(rng.choice("....tbd") for _ in range(n))
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(4))})
        solved = [conv.solve_block(kinds[a:b], faults[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        tables = []
        for block in solved:
            order = {x: sorted(y for k, (_, y) in block.items() if k[0] == x[0]).index(s) for x, (_, s) in block.items()}
            tables.append({x: (c, order[x]) for x, (c, _) in block.items()})
        found = {b: x for (a, b), x in conv.compose(tables).items() if a == 0}
        end = min(found, key=lambda b: (found[b][0] + 5 * len(conv.TAILS[b]), found[b][1]))
        states = [0, *map(int, found[end][2])]
        letters = "".join(block[a, b][1] for block, a, b in zip(solved, states, states[1:], strict=False)) + conv.TAILS[end]
        assert (found[end][0] + 5 * len(conv.TAILS[end]), letters) == brute(kinds, faults)


def random_rows(rng, n):
    turns = [rng.choice([None, *range(n)]) if rng.random() < 0.1 else i for i in range(n)]
    return [(t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "user2"]),
             rng.choice(["Yes.", "No!", "what", " \n", "", f"x{rng.randrange(9)}.", f"long {rng.random()}.", "é? "])) for t in turns]


@pytest.mark.parametrize("block", [3, 128])
def test_report_of_any_conversation(spark, block):
    rng = random.Random(5)
    talks = {k: random_rows(rng, rng.randrange(1, 12)) for k in range(60)}
    talks |= {100: random_rows(rng, 400), None: random_rows(rng, 30), 101: [(None, "user", "a.")] * 4, 102: [(1, "user", "same.")] * 50}
    rows = [(k, *r, "k", 1, "d") for k, x in talks.items() for r in x]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    repaired = conv.repair(df, block_rows=block)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conv.report(repaired).collect()}
    assert got == {k: whole_report(x) for k, x in talks.items()}
    flat = [r for r in conv.repaired_rows(repaired).collect() if r.conv_id == 100]
    flat.sort(key=lambda r: (r.part, r.seq, r.place))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in flat).encode()).hexdigest() == got[100][-1]
    initials = "".join(r.role[0] for r in flat).removeprefix("s")
    assert initials == "ua" * (len(initials) // 2)


def test_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, 0, None, None, "k", 1, "d"), (1, 1, "user", "x" * 3_000_000 + ".", "k", 1, "d"), (1, 2, "assistant", "y" * 5_000_000 + "!", "k", 1, "d"), (2, None, "user", None, "k", 1, "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: (r.blank, r.cost, r.audit) for r in conv.report(conv.repair(df)).collect()}
    assert got == {1: (1, 2, "DKK"), 2: (1, 2, "D")}
    assert conv.report(conv.repair(df.limit(0))).count() == 0


def damage(rows):
    """Rows by conversation after the damage, by its rule."""
    out = {}
    for k, t, r, x in rows:
        out.setdefault(k, [])
        r, x = (" " if v is None else v for v in (r, x))
        code = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        x = "" if code == 1 else x.translate(str.maketrans("", "", ".!?")) if code == 2 else x
        out[k] += [(t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    return out


def test_query_against_search(spark, tmp_path):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    gone = next(k for k in range(10_000, 20_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "lost."), (None, None, "user", None), (None, 3, None, "t?")] + [(777, i, "user" if i % 2 else "assistant", f"Line {i % 90}.") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert found.columns == ["conv_id", *COLUMNS]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == {k: whole_report(x) for k, x in damage(rows).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
