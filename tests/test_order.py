import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.operators import cells, order


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, half of them one value."""
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in np.r_[np.full(500, 12.5), rng.lognormal(3, 1, 500)].round(2)]
    rows += [(f"g{i % 40}", float(v)) for i, v in enumerate(rng.lognormal(3, 1.2, 2000).round(1))]
    rows += [("one", 5.0), ("flat", 3.0), ("flat", 3.0), (None, 1.0), ("hot", None)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def groups(rows):
    out = {}
    for g, v in rows:
        if g is not None and v is not None:
            out.setdefault(g, []).append(v)
    return {g: np.sort(v) for g, v in out.items()}


def gini(x):
    n = len(x)
    return float(np.clip(2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n, 0, 1))


def entropy(x, bins):
    if len(x) < 2:
        return None
    c, _ = np.histogram(np.log(x), bins=bins)
    p = c[c > 0] / c.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def test_grouped_statistics_match_numpy(skewed):
    rows, df = skewed
    dist = order.distribution(df, "v", ["g"])
    got = dist.groupBy("g").agg(
        *[order.quantile("v", p).alias(f"q{i}") for i, p in enumerate((0, 0.1, 1 / 3, 0.5, 0.99, 1))],
        order.gini("v").alias("gini"), order.theil("v").alias("theil"), order.spread("v").alias("sd"),
        order.binned_entropy("v", 20).alias("ent"), F.max("n").alias("n"),
    ).collect()
    want = groups(rows)
    assert {r.g for r in got} == set(want)
    for r in got:
        x = want[r.g]
        for i, p in enumerate((0, 0.1, 1 / 3, 0.5, 0.99, 1)):
            assert r[f"q{i}"] == pytest.approx(np.quantile(x, p), rel=1e-12)
        if len(x) < 2:
            assert r.gini is None and r.sd is None and r.ent is None
            continue
        assert r.gini == pytest.approx(gini(x), abs=1e-12)
        assert r.sd == pytest.approx(x.std(ddof=1), abs=1e-9)
        assert r.theil == pytest.approx(max((x / x.mean() * np.log(x / x.mean())).mean(), 0), abs=1e-12)
        if x[0] < x[-1]:
            assert r.ent == pytest.approx(entropy(x, min(20, len(x))), abs=1e-9)
        else:
            assert r.ent == 0.0


def test_two_entropy_forms_agree(skewed):
    _, df = skewed
    dist = order.distribution(df, "v", ["g"])
    a = {r.g: r.entropy for r in order.log_entropy(dist, "v", ["g"], 20, True).collect()}
    b = {r.g: r.e for r in dist.groupBy("g").agg(order.binned_entropy("v", 20).alias("e")).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_range_count_never_changes_positions(skewed, ranges):
    rows, df = skewed
    x = np.sort(np.concatenate(list(groups(rows).values())))
    got = order.distribution(df.na.drop(), "v", ranges=ranges).collect()
    assert sum(r.cnt for r in got) == len(x)
    for r in got:
        assert r.before == np.searchsorted(x, r.v)
        assert r.sum_before == pytest.approx(x[: r.before].sum())


def test_lorenz_is_exact_and_complete(spark):
    x = np.sort(np.array([1.0, 1, 2, 5, 9, 9, 9, 30, 31, 60]))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = order.lorenz(df, "v", 20).orderBy("population_share").collect()
    assert len(got) == 21
    cum = np.r_[0, np.cumsum(x)] / x.sum()
    for r in got:
        pos = r.population_share * len(x)
        assert r.value_share == pytest.approx(np.interp(pos, np.arange(11), cum))


def test_ordinals_and_ids_have_no_gaps(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 100_003).alias("k"))
    ranks = order.ordinals(df, "k", "r").orderBy("k").collect()
    assert [r.r for r in ranks] == list(range(5000))
    ids = order.stable_ids(df, ["k"], "name", "b_%08d")
    first = {r.k: r.name for r in ids.collect()}
    again = {r.k: r.name for r in order.stable_ids(df.repartition(3), ["k"], "name", "b_%08d").collect()}
    assert first == again and sorted(first.values()) == [f"b_{i:08d}" for i in range(5000)]


def test_no_unpartitioned_sort_over_rows(skewed):
    _, df = skewed
    plan = order.quantiles(df, "v", {"m": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_mode_breaks_ties_low_and_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, "z")], "g int, c string")
    assert {r.g: r.c for r in cells.modal_value(df, ["g"], "c").collect()} == {1: "a", 2: "z"}
    s = cells.class_shares(df, ["g"], "c", ["a", "b"]).collect()
    assert {r.g: (r.share_a, r.share_b) for r in s} == {1: (0.5, 0.5), 2: (None, None)}


def test_ordinals_break_ties_by_the_named_columns(spark):
    rows = [(int(i), int(i) * 7919 % 13) for i in np.random.default_rng(5).permutation(400)]
    want = {i: at for at, (k, i) in enumerate(sorted((k, i) for i, k in rows))}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "i long, k long").repartition(parts)
        got = order.ordinals(df, "k", "rank0", ["i"]).collect()
        assert {r.i: r.rank0 for r in got} == want
