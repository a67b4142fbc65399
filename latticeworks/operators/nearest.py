"""Exact nearest neighbours by refining pairs of tiles, without all-pairs joins.

Queries and targets are put on one square tile lattice. From a single root tile down, each kept (query
tile, target tile) pair is split into smaller ones, and a child pair is dropped once the target tile lies
farther from every corner of the query tile than the k nearest targets can: what is closer at all corners
is closer everywhere in the tile. Depth is each branch's own: a target tile of few targets stays as it is,
a query tile far off all its targets stays whole while these are split further (its parts would keep the
same list), and a query tile leaves the descent with its list of target tiles once these hold few targets
in all, so close pairs of targets are looked into where they lie and nowhere else. Only tiles travel through the levels. In the end each query row scans its tile's list in
place, so query rows are never multiplied or shuffled by candidate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions.rings import let
from latticeworks.session import checkpointed

LEAF_TARGETS = 4  # a tile of no more targets is not split
SCAN_TARGETS = 64  # a query tile whose list holds no more targets is not split; at least ``SCAN_SHARE`` for each wanted
SCAN_SHARE = 20
SHORT_LIST = 24  # longer lists are gone through once more, target by target
FAR = 4.0  # a query tile as many of its widths off all its targets is not split
FIRST, STEP = 4, 3  # levels of the first round, and of each further one while pairs are few
MANY_PAIRS = 50_000  # from here one level at a time: children of eight by eight tiles are mostly dropped again
SLACK, EDGE = 1e-12, 0.02  # of a distance, and in finest tiles
FINEST = 44  # levels; positions closer than the plane / 2^44 share a tile


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    query_key: str,
    target_key: str,
    k: int = 1,
    attributes: Sequence[str] = (),
    group: Sequence[str] = (),
    exclude_same_key: bool = False,
) -> DataFrame:
    """The k nearest targets of every query row as ``neighbours``.

    Both sides carry ``x``, ``y``. ``neighbours`` is an array of structs
    (distance, id, attributes), nearest first, ties by the lowest id. With
    ``group`` the search runs once per group of targets and the result has one
    row per (query, group). With ``exclude_same_key`` a row is not its own
    neighbour. Queries without coordinates or targets get a null list.
    """
    group = list(group)
    need = k + (1 if exclude_same_key else 0)

    def number(c: str):  # not a number is no coordinate
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

    t = targets.select(
        *group,
        number("x").alias("_x"),
        number("y").alias("_y"),
        F.col(target_key).alias("_id"),
        *[F.col(a).alias(f"_a_{a}") for a in attributes],
    ).na.drop(subset=["_x", "_y"])
    # Of targets on one spot only the lowest ``need`` ids can ever be returned.
    same_spot = Window.partitionBy(*group, "_x", "_y").orderBy("_id")
    t = checkpointed(t.withColumn("_rn", F.row_number().over(same_spot)).where(F.col("_rn") <= need).drop("_rn"))
    q = queries.select("*", number("x").alias("_x"), number("y").alias("_y"))
    q = q.withColumns({"_x": F.when(F.col("_y").isNotNull(), F.col("_x")), "_y": F.when(F.col("_x").isNotNull(), F.col("_y"))})
    bounds = [
        d.agg(F.min("_x").alias("a"), F.min("_y").alias("b"), F.max("_x").alias("c"), F.max("_y").alias("d")).first()
        for d in (q, t)
    ]
    if any(b["a"] is None for b in bounds):
        # Nobody to ask or nobody to find: the same columns, null lists.
        kinds = ["distance:double", f"id:{targets.schema[target_key].dataType.simpleString()}"]
        kinds += [f"{a}:{targets.schema[a].dataType.simpleString()}" for a in attributes]
        void = F.lit(None).cast(f"array<struct<{','.join(kinds)}>>").alias("neighbours")
        groups = [F.lit(None).cast(targets.schema[g].dataType).alias(g) for g in group]
        return queries.select("*", *groups, void)
    x0, y0 = min(b["a"] for b in bounds), min(b["b"] for b in bounds)
    side = max(max(b["c"] for b in bounds) - x0, max(b["d"] for b in bounds) - y0) * (1 + 1e-9) + 1e-6
    scale = 2.0**FINEST / side
    scan = max(SCAN_TARGETS, SCAN_SHARE * need)

    def tile(c: str, level: int):
        return F.floor(F.col(c) / 2.0 ** (FINEST - level)).cast("long")

    def tiled(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "_c": F.floor((F.col("_x") - x0) * scale).cast("long"),
            "_r": F.floor((F.col("_y") - y0) * scale).cast("long"),
        })

    q, t = tiled(q), tiled(t)
    # Every level starts from these two tables, so the query and target rows are read once for the descent.
    q_fine = checkpointed(q.where(F.col("_c").isNotNull()).select("_c", "_r").distinct())
    t_fine = checkpointed(t.groupBy(*group, "_c", "_r").agg(F.count(F.lit(1)).alias("n")))

    def split(pairs: DataFrame, level: int, old: int) -> DataFrame:
        """Children of pairs of level ``old``; target tiles of few targets stay."""
        qs = q_fine.select(tile("_c", level).alias("qc"), tile("_r", level).alias("qr")).distinct().withColumns(
            {"qpc": F.floor(F.col("qc") / 2 ** (level - old)).cast("long"), "qpr": F.floor(F.col("qr") / 2 ** (level - old)).cast("long")})
        ts = t_fine.select(*group, "n", tile("_c", level).alias("tc"), tile("_r", level).alias("tr")).groupBy(*group, "tc", "tr").agg(F.sum("n").alias("n")).withColumns(
            {"tpc": F.floor(F.col("tc") / 2 ** (level - old)).cast("long"), "tpr": F.floor(F.col("tr") / 2 ** (level - old)).cast("long")})
        moved = pairs.where("NOT held").drop("ql").withColumnsRenamed({"qc": "qpc", "qr": "qpr"}).join(qs, ["qpc", "qpr"]).drop("qpc", "qpr")
        named = moved.withColumn("ql", F.lit(level)).unionByName(pairs.where("held"))
        large = named.where(F.col("n") > LEAF_TARGETS).drop("n", "tl").withColumnsRenamed({"tc": "tpc", "tr": "tpr"})
        children = large.join(ts, [*group, "tpc", "tpr"]).drop("tpc", "tpr").withColumn("tl", F.lit(level))
        return named.where(F.col("n") <= LEAF_TARGETS).unionByName(children).drop("held")

    def prune(pairs: DataFrame) -> DataFrame:
        # Everything in finest tiles. Shuffled first, so that the distances do not travel.
        key = [*group, "ql", "qc", "qr"]
        sized = pairs.repartition(*key).withColumns({
            "wide": F.pow(F.lit(2.0), F.lit(FINEST) - F.col("ql")), "size": F.pow(F.lit(2.0), F.lit(FINEST) - F.col("tl"))})
        at = sized.withColumns({c: F.col(tile) * F.col(by) for c, tile, by in (
            ("west", "qc", "wide"), ("south", "qr", "wide"), ("left", "tc", "size"), ("low", "tr", "size"))})
        wide, size, west, south, left, low = (F.col(c) for c in ("wide", "size", "west", "south", "left", "low"))

        def gap(x, y, side=0.0):
            """From a point, or from a square's south-west corner, to the nearest place in the target tile."""
            return F.hypot(*[F.greatest(a - p - side, p - a - size, F.lit(0.0)) for a, p in ((left, x), (low, y))])

        def farthest(x, y):
            return F.hypot(*[F.greatest(F.abs(a - p), F.abs(a + size - p)) for a, p in ((left, x), (low, y))])

        corners = [(west + wide * i, south + wide * j) for i in (0, 1) for j in (0, 1)]
        marked = at.select(
            *pairs.columns, farthest(west + wide / 2, south + wide / 2).alias("middle"), (gap(west, south, wide) / wide).alias("apart"),
            *[gap(x, y).alias(f"near{i}") for i, (x, y) in enumerate(corners)], *[farthest(x, y).alias(f"far{i}") for i, (x, y) in enumerate(corners)])
        # The tiles around the middle that hold enough targets: farther off all corners than these nothing is needed.
        # A query tile has few kept target tiles, so these windows stay small.
        whole = Window.partitionBy(*key)
        so_far = F.sum("n").over(whole.orderBy("middle").rangeBetween(Window.unboundedPreceding, 0))
        enough = F.min(F.when(F.col("so_far") >= need, F.col("middle"))).over(whole)
        counted = marked.withColumn("so_far", so_far).withColumn("enough", enough)
        reach = [F.max(F.when(F.col("middle") <= F.col("enough"), F.col(f"far{i}"))).over(whole) for i in range(4)]
        reached = counted.withColumns({f"reach{i}": r for i, r in enumerate(reach)})
        # The slack covers rounding of positions and distances.
        within = reduce(lambda a, b: a | b, [F.col(f"near{i}") <= F.col(f"reach{i}") * (1 + SLACK) + EDGE for i in range(4)])
        kept = reached.where(F.col("enough").isNull() | within)
        busy = (F.sum("n").over(whole) > scan) & (F.max("n").over(whole) > LEAF_TARGETS)
        held = F.min("apart").over(whole) >= FAR
        return kept.select(*key, "tl", "tc", "tr", "n", busy.alias("busy"), held.alias("held"))

    level = 0
    # Level 0 is tile (0, 0) on both sides, once per group.
    zero = F.lit(0).cast("long")
    # Written, so that the plan does not see constants and keeps joins on the tile.
    busy = checkpointed(t_fine.groupBy(*group).agg(F.sum("n").alias("n")).select(
        *group, F.lit(0).alias("ql"), zero.alias("qc"), zero.alias("qr"), F.lit(0).alias("tl"), zero.alias("tc"), zero.alias("tr"), "n",
        F.lit(False).alias("held")))
    done, levels, closed = [], [0], set()
    open_ = (busy.agg(F.max("n")).first()[0] or 0) > scan
    if not open_:  # few targets in all
        done.append(busy)
        closed.add(0)
    step = FIRST
    while open_ and level < FINEST:
        old, level = level, min(level + step, FINEST)
        levels.append(level)
        found = checkpointed(prune(split(busy, level, old)))
        at_levels = found.groupBy("busy").agg(F.collect_set("ql").alias("ql"), F.count(F.lit(1)).alias("n")).collect()  # at most one number per level
        ql = {x.busy: x.ql for x in at_levels}
        busy = found.where("busy").drop("busy")
        if False in ql:
            done.append(found.where("NOT busy").drop("busy"))
            closed.update(ql[False])
        open_ = True in ql
        step = 1 if any(x.busy and x.n > MANY_PAIRS for x in at_levels) else STEP
    if open_ and level == FINEST:
        done.append(busy)
        closed.update(ql[True])
    at = t.withColumn("tl", F.explode(F.array(*[F.lit(x) for x in levels])))
    shift = F.pow(F.lit(2.0), F.lit(FINEST) - F.col("tl"))
    at = at.withColumns({"tc": F.floor(F.col("_c") / shift).cast("long"), "tr": F.floor(F.col("_r") / shift).cast("long")})
    at = at.drop("_c", "_r").withColumnsRenamed({"_x": "_tx", "_y": "_ty"})
    pairs = reduce(DataFrame.unionByName, done).drop("n", "held").withColumnsRenamed({"ql": "_ql", "qc": "_qc", "qr": "_qr"})
    width = F.pow(F.lit(2.0), F.lit(FINEST) - F.col("_ql"))
    lists = (
        pairs.join(at, [*group, "tl", "tc", "tr"])
        .groupBy(*group, "_ql", "_qc", "_qr")
        .agg(F.collect_list(F.struct("_tx", "_ty", "_id", *[f"_a_{a}" for a in attributes])).alias("_cand"))
        .withColumns({"_wide": width / scale, "_west": F.lit(x0) + F.col("_qc") * width / scale, "_south": F.lit(y0) + F.col("_qr") * width / scale})
    )
    short = F.when(F.size("_cand") > SHORT_LIST, _needed(F.col("_cand"), F.col("_west"), F.col("_south"), F.col("_wide"), need, EDGE / scale)).otherwise(F.col("_cand"))
    lists = lists.withColumn("_cand", short).drop("_wide", "_west", "_south")
    # A row has one list (for each group), at one of the levels where lists were closed.
    placed = q.where(F.col("_c").isNotNull()).withColumn("_ql", F.explode(F.array(*[F.lit(x) for x in sorted(closed)])))
    placed = placed.withColumns({"_qc": F.floor(F.col("_c") / width).cast("long"), "_qr": F.floor(F.col("_r") / width).cast("long")})
    # Tiles of many rows are split by AQE; lists are never repeated. Neither side is broadcast: the queries' size is
    # guessed from the files they stem from, without their levels, and they may be as many as the input's rows.
    matched = placed.join(lists.hint("merge"), ["_ql", "_qc", "_qr"])
    nowhere = q.where(F.col("_c").isNull())
    matched = matched.unionByName(nowhere, allowMissingColumns=True)
    kept = F.col("_cand")
    if exclude_same_key:
        kept = F.filter(kept, lambda c: c["_id"] != F.col(query_key))

    def away(c: Column) -> Column:
        return F.hypot(c["_tx"] - F.col("_x"), c["_ty"] - F.col("_y"))

    def found(c: Column) -> Column:
        return F.struct(away(c).alias("distance"), c["_id"].alias("id"), *[c[f"_a_{a}"].alias(a) for a in attributes])

    if k == 1:
        first = F.transform(F.array(F.transform(kept, found)), lambda m: F.array_min(m))
        best = F.filter(first, lambda b: b.isNotNull())
    else:
        # Only what is no farther than the k-th distance is sorted as a whole.
        last = F.element_at(F.slice(F.array_sort(F.transform(kept, away)), 1, k), -1)
        best = let(F.struct(kept.alias("c"), last.alias("d")), lambda s: F.slice(F.array_sort(F.transform(
            F.filter(s["c"], lambda c: away(c) <= s["d"]), found)), 1, k))
    return matched.select(*queries.columns, *group, best.alias("neighbours"))


def _needed(cand: Column, west: Column, south: Column, wide: Column, need: int, edge: float) -> Column:
    """Candidates that some place of a tile needs, by the same test of its corners, on single targets."""
    def away(c: Column, x: Column, y: Column) -> Column:
        return F.hypot(c["_tx"] - x, c["_ty"] - y)

    corners = [(west + wide * i, south + wide * j) for i in (0, 1) for j in (0, 1)]
    middle = F.array_sort(F.transform(cand, lambda c: F.struct(away(c, west + wide / 2, south + wide / 2).alias("d"), c.alias("c"))))
    first = let(middle, lambda m: F.transform(F.slice(m, 1, need), lambda s: s["c"]))

    def farthest(near: Column, at: tuple[Column, Column]) -> Column:
        return F.array_max(F.transform(near, lambda c: away(c, *at)))

    reach = let(first, lambda near: F.array(*[farthest(near, at) for at in corners]))
    return let(reach, lambda far: F.filter(cand, lambda c: reduce(
        lambda a, b: a | b, [away(c, *at) <= far[i] * (1 + SLACK) + edge for i, at in enumerate(corners)])))


def nearest_one(queries: DataFrame, targets: DataFrame, query_key: str, target_key: str,
                attributes: Sequence[str] = (), prefix: str = "nearest") -> DataFrame:
    """Distance, id and attributes of the single nearest target."""
    found = nearest(queries, targets, query_key, target_key, 1, attributes)
    best = F.get(F.col("neighbours"), F.lit(0))
    return found.select(
        *queries.columns,
        best["distance"].alias(f"{prefix}_distance"),
        best["id"].alias(f"{prefix}_id"),
        *[best[a].alias(f"{prefix}_{a}") for a in attributes],
    )


def knn_edges(units: DataFrame, key: str, k: int) -> DataFrame:
    """Directed edges i -> j to the k nearest other units."""
    found = nearest(units.select(key, "x", "y"), units, key, key, k, exclude_same_key=True)
    return found.select(F.col(key).alias("i"), F.explode("neighbours").alias("nb")).select(
        "i", F.col("nb.id").alias("j"), F.col("nb.distance").alias("distance")
    )
