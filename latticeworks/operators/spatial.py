"""Spatial dependence: lags, Moran's I, permutation inference, error model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions.rings import let
from latticeworks.functions.tails import normal_two_sided
from latticeworks.operators import order
from latticeworks.operators.regression import Fit, ols
from latticeworks.session import checkpointed, range_count, ship_package, shuffles_freed

FEISTEL_ROUNDS = 4
WALK_LIMIT = 64
BLOCK_LEAST, BLOCK_MOST = 2048, 8192  # positions of a block
EXCHANGE_BYTES = 512 << 20  # that a batch of replicates moves between tasks; its shuffle files go with it
SLICE = 1 << 14  # rows, and pairs, that are looked at in one go: as many values at once as replicates and columns make of them


def lags(units: DataFrame, key: str, weights: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Units with ``<column>_lag`` = weighted neighbour sums; islands get zero.

    One join on the neighbour and one on the unit serve all columns.
    """
    values = units.select(F.col(key).alias("j"), *columns)
    sums = weights.join(values, "j").groupBy(F.col("i").alias(key)).agg(*[
        F.sum(F.col("w") * F.col(c)).alias(f"{c}_lag") for c in columns
    ])
    return units.join(sums, key, "left").na.fill(0.0, [f"{c}_lag" for c in columns])


@dataclass
class WeightSums:
    s0: float
    s1: float
    s2: float
    trace: float  # tr(W'W)


def weight_sums(weights: DataFrame) -> WeightSums:
    first = weights.agg(
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("s0"),
        F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("tr"),
    ).first()
    pair = weights.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("s"))
    s1 = pair.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).first()[0]
    ends = weights.select(F.explode(F.array("i", "j")).alias("u"), "w").groupBy("u").agg(F.sum("w").alias("s"))
    s2 = ends.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0))).first()[0]
    return WeightSums(first["s0"], s1, s2, first["tr"])


@dataclass
class Moran:
    n: int
    i: float
    expected: float
    z: float
    p: float


def moran(units: DataFrame, key: str, weights: DataFrame, value: str, sums: WeightSums | None = None) -> Moran:
    """Moran's I with its normal-approximation z and two-sided p."""
    sums = sums or weight_sums(weights)
    stats = units.agg(F.count(value).alias("n"), F.avg(value).alias("m")).first()
    centred = units.select(key, (F.col(value) - F.lit(stats["m"])).alias("z"))
    row = lags(centred, key, weights, ["z"]).agg(
        F.sum(F.col("z") * F.col("z_lag")).alias("num"), F.sum(F.col("z") * F.col("z")).alias("den")
    ).first()
    n = stats["n"]
    value_i = n / sums.s0 * row["num"] / row["den"]
    return _inference(n, value_i, sums)


def _inference(n: int, i: float, s: WeightSums) -> Moran:
    e = -1 / (n - 1)
    var = (n * n * s.s1 - n * s.s2 + 3 * s.s0**2) / ((n * n - 1) * s.s0**2) - e * e
    z = (i - e) / sqrt(var)
    return Moran(n, i, e, z, normal_two_sided(z))


def permuted_position(index: Column, rep: Column, n: int, seed: int) -> Column:
    """Keyed bijection of 0..n-1 for a replicate: no sort, no state.

    A Feistel network over a x b >= n pairs; positions at or beyond n walk on
    along their cycle. Rows that exceed the walk limit fail the job.
    """
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)

    def network(v: Column) -> Column:
        pair = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"))
        for k in range(FEISTEL_ROUNDS):
            salt = F.lit(seed * 1_000_003 + k)
            pair = let(pair, lambda s: F.struct(
                F.pmod(s.l + F.pmod(F.xxhash64(s.r, rep, salt), F.lit(a)), F.lit(a)).alias("l"), s.r.alias("r")
            ))
            pair = let(pair, lambda s: F.struct(
                s.l.alias("l"),
                F.pmod(s.r + F.pmod(F.xxhash64(s.l, rep, -salt - 1), F.lit(b)), F.lit(b)).alias("r"),
            ))
        return let(pair, lambda s: s.l * b + s.r)

    def walk(first: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(WALK_LIMIT))
        further = F.aggregate(steps, first, lambda v, _: F.when(v < n, v).otherwise(network(v)))
        return F.when(first < n, first).otherwise(further)

    def checked(v: Column) -> Column:
        lost = F.raise_error(F.lit("permutation walk did not return to range")).cast("long")
        return F.when(v < n, v).otherwise(lost)

    return let(let(network(index), walk), checked)


def _permuted(pos: np.ndarray, rep: int, n: int, seed: int) -> np.ndarray:
    """``permuted_position`` of many positions for one replicate; a round's hashes are looked up by the half they stem from."""
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    rounds = []
    for k in range(FEISTEL_ROUNDS):
        salt = seed * 1_000_003 + k
        rounds.append((_hashes(b, rep, salt) % a, _hashes(a, rep, -salt - 1) % b))

    def network(v: np.ndarray) -> np.ndarray:
        left, right = np.divmod(v, b)
        for of_right, of_left in rounds:
            left = (left + of_right[right]) % a
            right = (right + of_left[left]) % b
        return left * b + right

    out = network(pos.astype(np.int64))
    for _ in range(WALK_LIMIT):
        beyond = np.flatnonzero(out >= n)
        if not len(beyond):
            return out
        out[beyond] = network(out[beyond])
    if (out >= n).any():
        raise ValueError("permutation walk did not return to range")
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(v: np.ndarray, bits: int) -> np.ndarray:
    return (v << np.uint64(bits)) | (v >> np.uint64(64 - bits))


def _xxh64(v: np.ndarray, seed: np.ndarray, long: bool) -> np.ndarray:
    """XXH64 of a long or an int, as Spark's ``xxhash64`` has it."""
    if long:
        h = (seed + _P5 + np.uint64(8)) ^ (_rotated(v * _P2, 31) * _P1)
        h = _rotated(h, 27) * _P1 + _P4
    else:
        h = (seed + _P5 + np.uint64(4)) ^ ((v & np.uint64(0xFFFFFFFF)) * _P1)
        h = _rotated(h, 23) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hashes(m: int, rep: int, salt: int) -> np.ndarray:
    """``xxhash64(v, rep, salt)`` of the longs v below m; ``rep`` is an int, ``salt`` too if it fits."""
    h = _xxh64(np.arange(m, dtype=np.uint64), np.full(m, 42, np.uint64), True)
    for value, long in ((rep, False), (salt, not -(1 << 31) <= salt < 1 << 31)):
        h = _xxh64(np.full(m, value % (1 << 64), np.uint64), h, long)
    return h.view(np.int64)


@dataclass
class Blocks:
    """Unordered pairs of positions with the sum of their weights, by blocks of ``size`` consecutive positions.

    ``local`` (block, a, b, w, owner) has the pairs inside each block, and each position that a pair of two blocks
    needs, with the number of that pair of blocks in ``owner``; ``cross`` (owner, a, b, w) has these pairs.
    """

    size: int
    count: int
    local: DataFrame
    cross: DataFrame


@dataclass
class Moved:
    """Values that ``width`` permutations bring to each block: (block, at, z), packed, from each task."""

    rows: DataFrame
    width: int
    k: int


def _blocks(pairs: DataFrame, n: int, ranges: int) -> Blocks:
    size = min(max(n // (4 * ranges), BLOCK_LEAST), BLOCK_MOST)
    count = -(-n // size)

    def block(c: str) -> Column:
        return F.floor(F.col(c) / size).cast("long")

    placed = pairs.withColumns({"block": block("a"), "other": block("b")})
    cross = checkpointed(placed.where("block <> other").select((F.col("block") * count + F.col("other")).alias("owner"), "a", "b", "w"))
    needed = cross.select("owner", F.explode(F.array("a", "b")).alias("a")).distinct()
    inside = placed.where("block = other").select("block", "a", "b", "w", F.lit(-1).cast("long").alias("owner"))
    local = inside.unionByName(needed.select(block("a").alias("block"), "a", F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("w"), "owner"))
    return Blocks(size, count, checkpointed(local), cross)


def _moved(numbered: DataFrame, n: int, k: int, size: int, reps: range | None, seed: int = 0) -> Moved:
    """The values of ``numbered`` (pos, z) where the replicates put them; where they are if ``reps`` is None."""
    width = 1 if reps is None else len(reps)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                pos = part.column("pos").to_numpy(zero_copy_only=False)
                z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                to = pos[None, :] if reps is None else np.stack([_permuted(pos, rep, n, seed) for rep in reps])
                block, place = np.divmod(to, size)
                block, place = block.ravel(), (place * width + np.arange(width)[:, None]).ravel()
                order = np.argsort(block.astype(np.uint16) if n // size < 1 << 16 else block, kind="stable")
                block, place = block[order], place[order].astype(np.uint32)
                first = np.flatnonzero(np.diff(block, prepend=-1))
                ends = np.append(first, len(block))

                def packed(values, entry, ends=ends):
                    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * entry).astype(np.int32)), pa.py_buffer(values)])

                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[first]), packed(place, 4), packed(np.ascontiguousarray(z[order % len(pos)]), 8 * k)], ["block", "at", "z"])

    return Moved(numbered.select("pos", "z").mapInArrow(run, "block long, at binary, z binary"), width, k)


def _pair_sums(z: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For every column of z the sum of w * z_a * z_b."""
    total, step = np.zeros(z.shape[1]), max(1, (SLICE << 5) // max(1, z.shape[1]))
    for i in range(0, len(w), step):
        part = slice(i, i + step)
        total += w[part] @ (z[a[part]] * z[b[part]])
    return total


def _products(edges: Blocks, moved: Moved) -> DataFrame:
    """(at, num): for every place in a replicate's columns, the sum of w * z_a * z_b over the pairs.

    A block's values meet in one task, where the pairs inside it are summed up; of pairs of two blocks only the
    positions they need travel on. So values move once a replicate, however many pairs there are, and a task holds
    the values of one or two blocks.
    """
    size, count, width, k = edges.size, edges.count, moved.width, moved.k

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table[name].to_numpy()

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        block = (left if left.num_rows else right)["block"][0].as_py()
        z = np.zeros((size * width, k))
        for at, values in zip(left["at"], left["z"], strict=True):
            z[np.frombuffer(at.as_buffer(), np.uint32)] = np.frombuffer(values.as_buffer()).reshape(-1, k)
        z = z.reshape(size, width * k)
        a, b, w, owner = (column(right, c) for c in ("a", "b", "w", "owner"))
        own, asked = owner < 0, owner >= 0
        sums = _pair_sums(z, a[own] - block * size, b[own] - block * size, w[own])
        return pa.table({
            "owner": pa.array(np.append(owner[asked], block * count + block)), "pos": pa.array(np.append(a[asked], -1)),
            "z": pa.array([*(z[i].tobytes() for i in a[asked] - block * size), sums.tobytes()], pa.binary())})

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = column(left, "pos")
        z = np.frombuffer(b"".join(left["z"].to_pylist())).reshape(-1, width * k)
        total = z[pos < 0].sum(axis=0)
        if right.num_rows:
            order = np.argsort(pos)
            a, b = (order[np.searchsorted(pos, column(right, c), sorter=order)] for c in ("a", "b"))
            total += _pair_sums(z, a, b, column(right, "w"))
        return pa.table({"at": pa.array(np.arange(width * k)), "num": pa.array(total)})

    first = moved.rows.groupBy("block").cogroup(edges.local.groupBy("block")).applyInArrow(inside, "owner long, pos long, z binary")
    each = first.groupBy("owner").cogroup(edges.cross.groupBy("owner")).applyInArrow(across, "at long, num double")
    return each.groupBy("at").agg(F.sum("num").alias("num"))


def permutation_tests(
    units: DataFrame, key: str, weights: DataFrame, values: Sequence[str],
    replicates: int, seed: int, batch: int = 100,
) -> dict[str, dict[str, float]]:
    """Moran's I of several columns against random permutations of their values over the units.

    All columns share the permutations. Replicates go in batches of at most ``batch`` and ``EXCHANGE_BYTES``, whose
    values travel once to the blocks of positions where the pairs are; what leaves a task is one partial sum per
    replicate and column, and a batch's shuffle files go before the next begins.
    Rows with a null in any of the columns are left out. A column without
    spread has no test: its values are NaN.
    """
    values = list(values)
    units = units.na.drop(subset=values)
    spark = units.sparkSession
    ship_package(spark)
    sums = weight_sums(weights)
    stats = units.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in values]).first()
    n, k, ranges = stats["n"], len(values), range_count(spark)
    centred = F.array(*[(F.col(c) - F.lit(stats[c])).cast("double") for c in values])
    ranked = order.ordinals(units.select(key, centred.alias("z")), key, "pos")
    numbered = checkpointed(ranked.select(F.col(key).alias("_u"), F.col("pos").cast("long").alias("pos"), "z").repartition(ranges, "pos"))
    place = numbered.select("_u", "pos")
    ends = weights.join(place.withColumnsRenamed({"_u": "i", "pos": "pi"}), "i").join(place.withColumnsRenamed({"_u": "j", "pos": "pj"}), "j")
    edges = _blocks(ends.groupBy(F.least("pi", "pj").alias("a"), F.greatest("pi", "pj").alias("b")).agg(F.sum("w").alias("w")), n, ranges)
    squares = numbered.agg(*[F.sum(F.col("z")[c] * F.col("z")[c]) for c in range(k)]).first()
    sims = np.zeros((replicates, k))
    width = max(1, min(batch, EXCHANGE_BYTES // max(1, n * (8 * k + 4))))
    with shuffles_freed(spark):
        own = _products(edges, _moved(numbered, n, k, edges.size, None)).collect()  # one row per column
        observed = {g["at"]: g["num"] for g in own}
        for start in range(0, replicates, width):
            reps = range(start, min(start + width, replicates))
            for g in _products(edges, _moved(numbered, n, k, edges.size, reps, seed)).collect():  # batch x columns rows
                sims[start + g["at"] // k, g["at"] % k] = g["num"]
    out = {}
    for c, name in enumerate(values):
        out[name] = _against(n, observed.get(c, 0.0), squares[c], sims[:, c], sums)
    return out


def _against(n: int, num: float, square: float, nums: np.ndarray, sums: WeightSums) -> dict[str, float]:
    """The row of one column: its Moran's I, and the replicates' spread and p."""
    scale = n / sums.s0 / square if square and sums.s0 else float("nan")
    observed, arr, replicates = _inference(n, scale * num, sums), scale * nums, len(nums)
    larger = int((arr >= observed.i).sum())
    larger = min(larger, replicates - larger)
    mean, sd = float(arr.mean()), float(arr.std())
    return {
        "n": n, "moran_i": observed.i, "expected_i": observed.expected, "permutations": replicates,
        "mean_i_sim": mean, "sd_i_sim": sd, "z_sim": (observed.i - mean) / sd if sd else float("nan"),
        "p_sim": (larger + 1) / (replicates + 1), "z_norm": observed.z, "p_norm_two_sided": observed.p,
    }


def permutation_test(
    units: DataFrame, key: str, weights: DataFrame, value: str,
    replicates: int, seed: int, batch: int = 100,
) -> dict[str, float]:
    """``permutation_tests`` of one column."""
    return permutation_tests(units, key, weights, [value], replicates, seed, batch)[value]


MORAN_SCHEMA = (
    "n long, moran_i double, expected_i double, permutations long, mean_i_sim double, "
    "sd_i_sim double, z_sim double, p_sim double, z_norm double, p_norm_two_sided double"
)


# --- spatial error model ------------------------------------------------------------


@dataclass
class ErrorModel:
    n: int
    lam: float
    coef: np.ndarray
    se: np.ndarray
    pseudo_r2: float
    moran_ols: float
    moran_filtered: float
    ols_r2: float


@dataclass
class Lagged:
    """Second moments of standardised columns, of their lags and of the lags' lags, over the rows without nulls.

    ``blocks[a, b]`` holds the sums of products of the columns lagged a times with those lagged b times. The first
    column is one; whatever is linear in the columns has its sums, lags and Moran's I from these alone.
    """

    names: list[str]
    n: int
    mean: np.ndarray
    sd: np.ndarray
    blocks: dict[tuple[int, int], np.ndarray]
    sums: WeightSums

    def of(self, coefficients: dict[str, float], constant: float = 0.0) -> np.ndarray:
        """The vector over the standardised columns of a linear combination of the plain ones."""
        out = np.zeros(len(self.names) + 1)
        out[0] = constant
        for name, b in coefficients.items():
            at = self.names.index(name)
            out[0] += b * self.mean[at]
            out[at + 1] += b * self.sd[at]
        return out

    def moran(self, p: np.ndarray, q: np.ndarray | None = None) -> float:
        """Moran's I of ``p`` over the columns plus ``q`` over their lags."""
        m = self.blocks
        q = np.zeros_like(p) if q is None else q
        p = p.copy()
        p[0] -= (m[0, 0][0] @ p + m[0, 1][0] @ q) / self.n
        num = p @ m[0, 1] @ p + p @ m[0, 2] @ q + q @ m[1, 1] @ p + q @ m[1, 2] @ q
        den = p @ m[0, 0] @ p + 2 * (p @ m[0, 1] @ q) + q @ m[1, 1] @ q
        return float(self.n / self.sums.s0 * num / den)


def lagged_moments(units: DataFrame, key: str, weights: DataFrame, columns: Sequence[str], sums: WeightSums | None = None) -> Lagged:
    """``Lagged`` of all columns: the weights are joined twice, however many models are fitted from it."""
    sums = sums or weight_sums(weights)
    names = list(dict.fromkeys(columns))
    clean = units.select(key, *names).na.drop(subset=names)
    row = clean.agg(F.count(F.lit(1)).alias("n"), *[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    n, mean = row["n"], np.array(row[1::2], float)
    sd = np.array([v if v else 1.0 for v in row[2::2]], float)
    z = ["z0", *[f"z{i + 1}" for i in range(len(names))]]
    scaled = [((F.col(c) - F.lit(float(m))) / F.lit(float(d))).alias(name) for c, m, d, name in zip(names, mean, sd, z[1:], strict=True)]
    once = lags(clean.select(key, F.lit(1.0).alias("z0"), *scaled), key, weights, z).persist()
    twice = None
    try:
        twice = lags(once.select("*"), key, weights, [f"{c}_lag" for c in z]).persist()
        kinds = [[f"{c}{'_lag' * a}" for c in z] for a in range(3)]
        blocks = {}
        for a in range(3):
            for b in range(a, 3):  # one aggregate a block, so that its code stays compilable
                pairs = [(i, j) for i in range(len(z)) for j in range(i if a == b else 0, len(z))]
                got = twice.agg(*[F.sum(F.col(kinds[a][i]) * F.col(kinds[b][j])) for i, j in pairs]).first()
                block = np.zeros((len(z), len(z)))
                for (i, j), v in zip(pairs, got, strict=True):
                    block[i, j] = v
                    if a == b:
                        block[j, i] = v
                blocks[a, b] = block
        return Lagged(names, n, mean, sd, blocks, sums)
    finally:
        once.unpersist()
        if twice is not None:
            twice.unpersist()


def error_model(lagged: Lagged, base: Fit) -> ErrorModel:
    """Method-of-moments spatial error model (Kelejian and Prucha 1999) of a fit whose columns ``lagged`` has."""
    m, xs = lagged.blocks, base.xs
    u = lagged.of({base.y: 1.0, **{x: -float(b) for x, b in zip(xs, base.coef[1:], strict=True)}}, -float(base.coef[0]))
    lam = _solve_moments(base.n, {
        "uu": u @ m[0, 0] @ u, "vv": u @ m[1, 1] @ u, "uv": u @ m[0, 1] @ u,
        "ww": u @ m[2, 2] @ u, "uw": u @ m[0, 2] @ u, "vw": u @ m[1, 2] @ u}, lagged.sums.trace)
    # Moments of the filtered columns, by which the standardised outcome is fitted without a constant.
    f = m[0, 0] - lam * (m[0, 1] + m[0, 1].T) + lam * lam * m[1, 1]
    y, at = lagged.names.index(base.y), [lagged.names.index(x) for x in xs]
    kept = [0, *[i + 1 for i in at]]
    inner = np.linalg.inv(f[np.ix_(kept, kept)])
    slopes = inner @ f[kept, y + 1]
    ssr = float(f[y + 1, y + 1] - slopes @ f[kept, y + 1]) * lagged.sd[y] ** 2
    # Back to the plain columns.
    plain = np.diag([1.0, *(1 / lagged.sd[at])])
    plain[0, 1:] = -lagged.mean[at] / lagged.sd[at]
    coef = lagged.sd[y] * (plain @ slopes)
    coef[0] += lagged.mean[y]
    bread = plain @ inner @ plain.T
    fitted = lagged.of(dict(zip(xs, coef[1:], strict=True)), coef[0])
    own = lagged.of({base.y: 1.0})

    def cov(a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ m[0, 0] @ b / lagged.n - (m[0, 0][0] @ a) * (m[0, 0][0] @ b) / lagged.n**2)

    error = own - fitted
    return ErrorModel(
        base.n, lam, coef, np.sqrt(np.diag(bread) * ssr / base.n), cov(own, fitted) ** 2 / (cov(own, own) * cov(fitted, fitted)),
        lagged.moran(u), lagged.moran(error, -lam * error), base.r2)


def spatial_errors(units: DataFrame, key: str, weights: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], sums: WeightSums | None = None) -> tuple[list[Fit], list[ErrorModel], dict[str, float]]:
    """The least-squares fit and the error model of each (y, xs), and Moran's I of each y.

    All models share the two joins with the weights. Rows with a null in a column of any model are left out.
    """
    columns = list(dict.fromkeys(c for y, xs in specs for c in (y, *xs)))
    used = units.select(key, *columns).na.drop(subset=columns).persist()
    try:
        lagged = lagged_moments(used, key, weights, columns, sums)
        fits = [ols(used, y, xs) for y, xs in specs]
    finally:
        used.unpersist()
    return fits, [error_model(lagged, fit) for fit in fits], {y: lagged.moran(lagged.of({y: 1.0})) for y, _ in specs}


def spatial_error(
    units: DataFrame, key: str, weights: DataFrame, y: str, xs: Sequence[str], sums: WeightSums | None = None
) -> ErrorModel:
    """``spatial_errors`` of one model."""
    return spatial_errors(units, key, weights, [(y, xs)], sums)[1][0]


def _solve_moments(n: int, s: dict[str, float], trace: float) -> float:
    """lambda that minimises the three moment conditions (sigma2 profiled out)."""
    g = np.array([s["uu"], s["vv"], s["uv"]]) / n
    a = np.array([2 * s["uv"], 2 * s["vw"], s["uw"] + s["vv"]]) / n
    b = np.array([-s["vv"], -s["ww"], -s["vw"]]) / n
    c = np.array([n, trace, 0.0]) / n

    def loss(lam: float) -> float:
        target = g - a * lam - b * lam * lam
        sigma2 = max(float(c @ target / (c @ c)), 0.0)
        gap = target - c * sigma2
        return float(gap @ gap)

    grid = np.linspace(-0.999, 0.999, 401)
    best = grid[int(np.argmin([loss(x) for x in grid]))]
    lo, hi = best - 0.006, best + 0.006
    ratio = (5**0.5 - 1) / 2
    for _ in range(100):
        p, q = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, q) if loss(p) < loss(q) else (p, hi)
    return float((lo + hi) / 2)
