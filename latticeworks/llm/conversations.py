"""Repair of conversation structure by cheapest edits, found with auction shortest paths.

A conversation is read row by row in a lattice of (rows read, last role): each arc keeps, reroles or
deletes the next row, or inserts an empty one, at an integer cost. The auction algorithm keeps a node
price that never exceeds an arc's cost plus the price at its end; the path from the origin is extended
by the arc that attains the least sum, or, if the price of its last node lies below that sum, the price
rises to it and the path is contracted by that node. When the path arrives, prices are an optimal dual
solution: every cheapest path consists of tight arcs (price = cost + price at the end) and every tight
path is a cheapest one. The tight arcs are followed in alphabetical order of their letters, dead ends
marked, which gives the least of all cheapest edit strings.

Rows are sorted by range over the whole table, so that a conversation of any size is dealt over many
tasks, and packed into blocks of a bounded number of rows. A conversation inside one block is solved at
once. Of others each block is solved from every state it can begin with to every state it can end
with; these small tables of costs and orders are composed, first over the blocks of one partition,
then over partitions (no more than there are partitions), and the choice goes back down to the blocks.
A block ends with a row that was read, so of two strings of a block none begins the other, and the
order of whole strings is that of their first differing block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm.common import in_tasks, join_groups, stored

BLOCK_ROWS = 128
BLOCK_BYTES = 4 << 20
SPACE = " \t\n\x0b\f\r"
# States: nothing yet, system, user, assistant was last; the role an inserted or reroled row gets there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
TAILS = ("", "II", "I", "")  # what makes a conversation that ends in this state whole
BLOCK = {
    "key": None, "part": pa.int32(), "no": pa.int64(), "seq": pa.int64(), "closed": pa.bool_(), "kinds": pa.string(), "faults": pa.string(),
    "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
}
TYPES = {
    "part": pa.int32(), "seq": pa.int64(), "closed": pa.bool_(), "n": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
    "illegal": pa.int64(), "first": pa.string(), "last": pa.string(), "low": pa.int64(), "high": pa.int64(), "turns": pa.int64(), "cost": pa.int64(),
    "audit": pa.string(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.list_(pa.string()): "array<string>"}
NEVER = 1 << 60
Arc = tuple[str, int, int]


def lattice(kinds: str, faults: str, whole: bool) -> list[list[Arc]]:
    """Arcs (letter, end, cost) of every node, letters in order; node 4 i + state after i rows.

    ``kinds`` are role initials, ``faults`` one of "b" blank, "d" duplicate, "t" truncated, "." a row.
    ``whole`` lets rows be inserted after the last row, and adds an end node.
    """
    n = len(kinds)
    arcs: list[list[Arc]] = []
    for i in range(n):
        gone = faults[i] in "bd"
        extra = TRUNCATED if faults[i] == "t" else 0
        keeps = {} if gone else KEEPS.get(kinds[i], {})
        for q in range(4):
            out = [("D", 4 * i + 4 + q, DELETE), ("I", 4 * i + NEXT[q], INSERT)]
            if q in keeps:
                out.append(("K", 4 * i + 4 + keeps[q], extra))
            if not gone:
                out.append(("R", 4 * i + 4 + NEXT[q], REROLE + extra))
            arcs.append(out)
    for q in range(4):
        last = [("", 4 * n + 4, 0)] if whole and q in (START, ASSISTANT) else []
        arcs.append([*last, ("I", 4 * n + NEXT[q], INSERT)] if whole else [])
    return [*arcs, []] if whole else arcs


def auction(arcs: list[list[Arc]], origin: int, target: int, prices: list[int]) -> tuple[int, str]:
    """(cost, least letters) of the cheapest paths; ``prices`` are kept for other origins of one target."""
    path = [origin]
    while path[-1] != target:
        node = path[-1]
        least, best = NEVER, -1
        for _, end, cost in arcs[node]:
            if cost + prices[end] < least:
                least, best = cost + prices[end], end
        if prices[node] < least:
            prices[node] = least
            if least == NEVER and len(path) == 1:
                raise ValueError("no path")
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)
    dead: set[int] = set()
    trail: list[tuple[int, str, Iterator[Arc]]] = [(origin, "", iter(arcs[origin]))]
    while trail[-1][0] != target:
        node, _, rest = trail[-1]
        for letter, end, cost in rest:
            if end not in dead and prices[node] == cost + prices[end]:
                trail.append((end, letter, iter(arcs[end])))
                break
        else:
            dead.add(node)
            trail.pop()
    return prices[origin] - prices[target], "".join(letter for _, letter, _ in trail)


def solve_whole(kinds: str, faults: str) -> tuple[int, str]:
    arcs = lattice(kinds, faults, whole=True)
    return auction(arcs, START, 4 * len(kinds) + 4, [0] * len(arcs))


def solve_block(kinds: str, faults: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, letters) from each state before the block to each state after its last row."""
    arcs, n = lattice(kinds, faults, whole=False), len(kinds)
    system = any(k == "s" and f not in "bd" for k, f in zip(kinds, faults, strict=True))
    out = {}
    for after in range(4):
        prices = [0] * len(arcs)
        for q in range(3):
            prices[4 * n + q if q < after else 4 * n + q + 1] = NEVER  # the other ends lead nowhere
        for before in range(4):
            if after == START and before != START or after == SYSTEM and not (before == SYSTEM or before == START and system):
                continue
            if after in (USER, ASSISTANT) or before == after or after == SYSTEM:
                out[before, after] = auction(arcs, before, 4 * n + after, prices)
    return out


def compose(tables: list[dict[tuple[int, int], tuple[int, int]]]) -> dict[tuple[int, int], tuple[int, int, str]]:
    """(cost, order among the ends, states after each block) of consecutive blocks with (cost, order)."""
    out = {}
    for before in range(4):
        now, back = {before: (0, 0)}, []
        for table in tables:
            reach: dict[int, tuple[int, int, int, int]] = {}
            for (a, b), (cost, order) in table.items():
                if a in now:
                    found = (now[a][0] + cost, now[a][1], order, a)
                    reach[b] = min(reach.get(b, found), found)
            ordered = sorted(reach, key=lambda b: reach[b][1:3])
            now = {b: (reach[b][0], ordered.index(b)) for b in reach}
            back.append({b: reach[b][3] for b in reach})
        for end, (cost, order) in now.items():
            states, q = [], end
            for step in reversed(back):
                states.append(str(q))
                q = step[q]
            out[before, end] = (cost, order, "".join(reversed(states)))
    return out


def _marked(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversations, each row that repeats an earlier one right after a mark."""
    named = F.when(F.col("key").isNull(), "n").otherwise(F.concat(F.lit("k"), F.length(F.col("key").cast("string")), F.lit(":"), F.col("key").cast("string")))
    rows = rows.select(
        "*", F.substring("text", 1, 64).alias("head"), F.monotonically_increasing_id().alias("id"),
        F.unhex(F.sha2(F.concat(named, F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)).alias("digest"),
    )
    rows = stored(rows, "conversation-rows")
    slim = rows.drop("text")
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn", "id").alias("first")).alias("first")
    groups = slim.groupBy("digest").agg(first, F.count(F.lit(1)).alias("m")).where("m > 1").select("digest", "m", F.col("first.id").alias("first_id"))
    marks = join_groups(slim, stored(groups, "repeats"), "digest", "m", rows.count()).where("id <> first_id")
    both = rows.withColumn("row", F.lit(True)).unionByName(marks.select(*slim.columns, F.lit(None).cast("string").alias("text"), F.lit(False).alias("row")))
    order = ["key", "turn", "role", "head", "digest", "id"]
    return both.repartitionByRange(*order).sortWithinPartitions(*order, "row").select("key", "turn", "role", "text", "row")


def _batches(rows: Iterator[dict], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BLOCK_BYTES of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) if isinstance(v, str) else sum(map(len, v)) if c in ("roles", "texts") else 0 for c, v in row.items())
        if size > BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, pa.schema(types))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, pa.schema(types))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _blocks(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """Blocks of consecutive rows; ``closed`` ones are known to hold a whole conversation.

    ``no`` numbers a partition's conversations, ``seq`` its blocks.
    """

    def read(batches):
        part = TaskContext.get().partitionId()
        seq, no, pieces, size, later = 0, -1, 0, 0, False
        key, held = None, []

        def block(closed):
            kinds = "".join(r[:1] if r and r[0] in KEEPS else "?" for _, r, _, _ in held)
            return {"key": key, "part": part, "no": no, "seq": seq, "closed": closed, "kinds": kinds,
                    "faults": "".join(_fault(x, again) for _, _, x, again in held),
                    "turns": [x[0] for x in held], "roles": [x[1] for x in held], "texts": [x[2] for x in held]}

        for batch in batches:
            for k, turn, role, text, row in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "row")), strict=True):
                new = no < 0 or k != key
                if held and (new or len(held) >= most or size >= BLOCK_BYTES):
                    yield block(new and pieces == 0 and no > 0)
                    seq, pieces, size, held = seq + 1, pieces + 1, 0, []
                if new:
                    key, no, pieces = k, no + 1, 0
                if row:
                    held.append((turn, role, text, later))
                    size += len(text)
                later = not row
        if held:
            yield block(False)

    def run(batches):
        for first in batches:
            types = BLOCK | {"key": first.schema.field("key").type}
            yield from _batches(read(chain([first], batches)), types)

    return in_tasks(rows, run, f"key {kind}, part int, no long, seq long, closed boolean, kinds string, faults string, turns array<long>, roles array<string>, texts array<string>")


def _fault(text: str, repeated: bool) -> str:
    solid = text.rstrip(SPACE)
    return "b" if not solid else "d" if repeated else "." if solid[-1] in ".!?" else "t"


def _choices(blocks: DataFrame, kind: str) -> DataFrame:
    """(part, seq, before, after, tail) of every block that may be part of a longer conversation."""
    shape = "edges array<struct<before: int, after: int, cost: bigint, rank: int, path: string>>"

    def ends(batches):
        for batch in batches:
            edges = []
            for kinds, faults in zip(batch.column("kinds").to_pylist(), batch.column("faults").to_pylist(), strict=True):
                solved = solve_block(kinds, faults)
                ranks = {}
                for q in range(4):
                    mine = sorted((x for x in solved if x[0] == q), key=lambda x: solved[x][1])
                    ranks |= {x: k for k, x in enumerate(mine)}
                edges.append([{"before": a, "after": b, "cost": cost, "rank": ranks[a, b], "path": str(b)} for (a, b), (cost, _) in solved.items()])
            fields = [("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("path", pa.string())]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "part", "no", "seq")} | {"edges": pa.array(edges, pa.list_(pa.struct(fields)))})

    def tables(group: pd.DataFrame):
        return [{(e["before"], e["after"]): (e["cost"], e["rank"]) for e in edges} for edges in group["edges"]]

    def listed(found):
        return [{"before": a, "after": b, "cost": c, "rank": r, "path": p} for (a, b), (c, r, p) in found.items()]

    def in_partition(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        first = group.iloc[0]
        return pd.DataFrame({"key": [first["key"]], "part": [first["part"]], "no": [first["no"]], "seq": [first["seq"]], "edges": [listed(compose(tables(group)))]})

    def over_partitions(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        found = {b: x for (a, b), x in compose(tables(group)).items() if a == START}
        end = min(found, key=lambda b: (found[b][0] + INSERT * len(TAILS[b]), found[b][1]))
        states = [START, *map(int, found[end][2])]
        return pd.DataFrame({
            "part": group["part"], "no": group["no"], "seq": group["seq"], "before": states[:-1], "after": states[1:],
            "path": [next(e["path"] for e in edges if (e["before"], e["after"]) == (a, b)) for edges, a, b in zip(group["edges"], states[:-1], states[1:], strict=True)],
            "tail": [""] * (len(group) - 1) + [TAILS[end]],
        })

    solved = in_tasks(blocks.where("NOT closed").select("key", "part", "no", "seq", "kinds", "faults"), ends, f"key {kind}, part int, no long, seq long, {shape}")
    level = solved.groupBy("part", "no").applyInPandas(in_partition, f"key {kind}, part int, no long, seq long, {shape}")
    chosen = level.groupBy("key").applyInPandas(over_partitions, "part int, no long, seq long, before int, after int, path string, tail string")
    each = chosen.select("part", "seq", "before", "path", "tail", F.posexplode(F.split("path", "")).alias("k", "state"))
    each = each.where("state <> ''")
    before = F.when(F.col("k") == 0, F.col("before")).otherwise(F.substring(F.col("path"), F.col("k"), F.lit(1)).cast("int"))
    tail = F.when(F.col("k") == F.length("path") - 1, F.col("tail")).otherwise("")
    return each.select("part", (F.col("seq") + F.col("k")).alias("seq"), before.alias("before"), F.col("state").cast("int").alias("after"), tail.alias("tail"))


def _edited(row: dict) -> tuple[int, str, list[str], list[str]]:
    """(cost, letters, roles, texts) of a block after its cheapest edits."""
    if row["closed"]:
        state = START
        cost, letters = solve_whole(row["kinds"], row["faults"])
    else:
        state = row["before"]
        arcs = lattice(row["kinds"], row["faults"], whole=False)
        prices = [0] * len(arcs)
        for q in range(4):
            if q != row["after"]:
                prices[4 * len(row["kinds"]) + q] = NEVER
        cost, letters = auction(arcs, state, 4 * len(row["kinds"]) + row["after"], prices)
        cost, letters = cost + INSERT * len(row["tail"]), letters + row["tail"]
    roles, texts, i = [], [], 0
    for letter in letters:
        if letter == "K":
            state = KEEPS[row["kinds"][i]][state]
            roles.append(row["roles"][i])
            texts.append(row["texts"][i])
        elif letter != "D":
            state = NEXT[state]
            roles.append(NAMES[state])
            texts.append(row["texts"][i] if letter == "R" else "")
        i += letter != "I"
    return cost, letters, roles, texts


@dataclass
class Repaired:
    """Blocks after repair: those that hold a whole conversation, and parts of conversations."""

    whole: DataFrame
    parts: DataFrame


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> Repaired:
    """Repaired conversations, in blocks that ``repaired_rows`` and ``report`` read.

    A conversation is all rows of one key (null is one too), by turn (nulls first), role, first 64
    characters of the text and its digest; null roles and texts are one space. A row is blank (no
    character but space and 0x09-0x0D), else duplicate (role and text seen earlier), else truncated (last
    such character not one of .!?). Keeping costs 0, a new role (user or assistant) 1, deleting 2 and is
    required for blank and duplicate rows, inserting an empty user or assistant row 5; truncated rows that
    stay cost 5 more. What is left has role initials ``(s?(ua)+)?``; of the cheapest edit strings the least
    stands. Initials are the first characters of roles, of whatever role. Repeated rows are duplicates,
    other columns are ignored, an empty table gives an empty table.
    """
    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    blocks = stored(_blocks(_marked(plain), kind, block_rows), "conversation-blocks")
    choices = stored(_choices(blocks, kind), "conversation-choices")

    def mend(row):
        cost, letters, roles, texts = _edited(row)
        initials = [r[:1] for r in row["roles"]]
        known = [t for t in row["turns"] if t is not None]
        one = {c: row[c] for c in ("key", "part", "seq", "closed")} | {"n": len(initials)}
        one |= {name: row["faults"].count(f) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
        one |= {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0], "last": initials[-1]}
        return one | {"low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "cost": cost, "audit": letters, "roles": roles, "texts": texts}

    def run(batches):
        for first in batches:
            types = {"key": first.schema.field("key").type} | TYPES
            yield from _batches(map(mend, _each(chain([first], batches))), types)

    columns = ["key", "part", "seq", "closed", "kinds", "faults", "turns", "roles", "texts"]
    shut = blocks.where("closed").select(*columns, F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"), F.lit(None).cast("string").alias("tail"))
    open_ = blocks.where("NOT closed").join(choices, ["part", "seq"]).select(*columns, "before", "after", "tail")
    shape = f"key {kind}, " + ", ".join(f"{c} {_SQL[t]}" for c, t in TYPES.items())
    return Repaired(*(in_tasks(x, run, shape).withColumnRenamed("key", key) for x in (shut, open_)))


def repaired_rows(repaired: Repaired, key: str = "conv_id") -> DataFrame:
    """(key, part, seq, place, role, text): rows after repair; part, seq and place order a conversation."""
    rows = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")
    blocks = repaired.whole.unionByName(repaired.parts)
    return blocks.select(key, "part", "seq", rows).select(key, "part", "seq", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def report(repaired: Repaired, key: str = "conv_id") -> DataFrame:
    """One row a conversation that has rows: counts, cost, edits, digest of the repaired ``role:text`` lines.

    SHA-256 runs over a conversation's blocks in order: those of one conversation stream through one
    task, which keeps the digest's state, the counts and the edit string only.
    """
    kind = repaired.whole.schema[key].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def done(now):
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return {c: now[c] for c in ("key", *names[1:])} | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

    def fold(rows):
        now = None
        for row in rows:
            if now is not None and (row["closed"] or now["closed"] or row["key"] != now["key"]):
                yield done(now)
                now = None
            if now is None:
                now = row | {"audit": [row["audit"]], "sha": hashlib.sha256(), "lines": 0}
            else:
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += row[c]
                now["illegal"] += now["last"] + row["first"] not in ("su", "ua", "au")
                now["audit"].append(row["audit"])
                now["last"] = row["last"]
                if row["low"] is not None:  # sorted: only the last turn so far may come again
                    now["turns"] += row["turns"] - (now["high"] == row["low"])
                    now["low"], now["high"] = row["low"] if now["low"] is None else now["low"], row["high"]
            for a, b in zip(row["roles"], row["texts"], strict=True):
                now["sha"].update(("\n" if now["lines"] else "").encode() + f"{a}:{b}".encode())
                now["lines"] += 1
        if now is not None:
            yield done(now)

    def run(batches):
        for first in batches:
            types = {"key": first.schema.field("key").type} | dict.fromkeys(names, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
            yield from _batches(fold(_each(chain([first], batches))), types)

    columns = ["part", "seq", "closed", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "cost", "audit", "roles", "texts"]
    whole, parts = (x.select(F.col(key).alias("key"), *columns) for x in (repaired.whole, repaired.parts))
    shape = f"key {kind}, " + ", ".join(f"{c} long" for c in names) + ", audit string, repaired_sha256 string"
    shut = in_tasks(whole, run, shape)
    open_ = in_tasks(parts.repartition("key").sortWithinPartitions("key", "part", "seq"), run, shape)
    return shut.unionByName(open_).withColumnRenamed("key", key)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults planted by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its .!? marks, 3 repeats it, 4 makes its role user.
    Null values are one space, in the hashed text too; a null turn stays null for the order.
    """
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    code = F.crc32(name.cast("binary")) % 20
    found = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return found.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
