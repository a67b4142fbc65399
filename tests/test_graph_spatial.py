import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.functions.tails import normal_two_sided, t_two_sided
from latticeworks.operators import graph, ranks, regression, spatial
from latticeworks.session import checkpointed


def cells(spark, at):
    rows = [(i, c, r, float(c), float(r)) for i, (c, r) in enumerate(at)]
    return spark.createDataFrame(rows, "id long, col long, row long, x double, y double")


def test_queen_repair_audit_components(spark):
    at = [(c, r) for c in range(3) for r in range(3)] + [(10, 10)] + [(20, 0), (21, 1)]
    df = cells(spark, at)
    edges = graph.queen_edges(df, "id")
    deg = {r.i: r["count"] for r in edges.groupBy("i").count().collect()}
    assert deg[4] == 8 and deg[0] == 3 and deg[1] == 5 and 9 not in deg
    a = graph.audit(df, "id", edges).first()
    assert (a.n_units, a.n_islands, a.n_components, a.max_neighbors) == (12, 1, 3, 8)
    fixed = graph.attach_islands(df, "id", edges)
    assert graph.audit(df, "id", fixed).first().n_islands == 0
    pairs = {(r.i, r.j) for r in fixed.collect()}
    assert all((j, i) in pairs for i, j in pairs)
    bands = graph.component_sizes(graph.components(df, "id", edges)).first()
    assert (bands.n_singletons, bands.n_2_to_5, bands.n_6_to_20, bands.largest_component) == (1, 1, 1, 9)


def test_audits_of_several_graphs_are_those_of_each(spark):
    at = [(c, r) for c in range(3) for r in range(3)] + [(10, 10)] + [(20, 0), (21, 1), (-30, 4)]
    df = cells(spark, at)
    queen, near = graph.queen_edges(df, "id"), graph.knn_edges(df, "id", 8)
    fixed = graph.attach_islands(df, "id", queen, near)
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, graph.attach_islands(df, "id", queen).collect()))
    specs = {"queen": queen, "fixed": fixed, "near": near.select("i", "j"), "none": queen.limit(0)}
    got = {r.spec: r for r in graph.audits(df, "id", specs).collect()}
    shape = {k: tuple(got[k][c] for c in ("n_units", "n_islands", "min_neighbors", "max_neighbors", "n_components")) for k in specs}
    assert shape == {"queen": (13, 2, 0, 8, 4), "fixed": (13, 0, 1, 8, 2), "near": (13, 0, 8, 8, 1), "none": (13, 13, 0, 0, 13)}
    for k, e in specs.items():
        assert graph.audit(df, "id", e).first().asDict() == {c: v for c, v in got[k].asDict().items() if c != "spec"}
    texts = df.withColumn("id", F.col("id").cast("string"))
    named = {k: e.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j")) for k, e in specs.items()}
    assert {r.spec: r for r in graph.audits(texts, "id", named).collect()} == got
    empty = graph.audit(df.limit(0), "id", queen.limit(0)).first()
    assert (empty.n_units, empty.n_components, empty.max_neighbors) == (0, 0, None)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 199)]
    star = [(1000, 1001 + i) for i in range(300)]
    edges = spark.createDataFrame(path + star, "i long, j long")
    ids = spark.createDataFrame([(i,) for i in [*range(200), *range(1000, 1301), 5000]], "id long")
    got = {r.id: r.component for r in graph.components(ids, "id", edges).collect()}
    assert {got[i] for i in range(200)} == {0} and {got[i] for i in range(1000, 1301)} == {1000} and got[5000] == 5000


def lattice_data(spark, side, lam, seed):
    rng = np.random.default_rng(seed)
    n = side * side
    w = np.zeros((n, n))
    for c in range(side):
        for r in range(side):
            near = [(c + a, r + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= c + a < side and 0 <= r + b < side]
            for cc, rr in near:
                w[c * side + r, cc * side + rr] = 1 / len(near)
    x = rng.normal(size=n)
    u = np.linalg.solve(np.eye(n) - lam * w, rng.normal(size=n))
    y = 1.5 + 2 * x + u
    rows = [(i, i // side, i % side, float(x[i]), float(y[i])) for i in range(n)]
    return w, x, y, spark.createDataFrame(rows, "id long, col long, row long, x1 double, y double")


def test_moran_matches_matrix_form(spark):
    w, x, y, df = lattice_data(spark, 12, 0.5, 1)
    weights = graph.row_standardised(graph.queen_edges(df, "id"))
    m = spatial.moran(df, "id", weights, "y")
    z = y - y.mean()
    n, s0 = len(z), w.sum()
    assert m.i == pytest.approx(n / s0 * (z @ w @ z) / (z @ z))
    s1 = ((w + w.T) ** 2).sum() / 2
    s2 = ((w.sum(0) + w.sum(1)) ** 2).sum()
    var = (n * n * s1 - n * s2 + 3 * s0**2) / ((n * n - 1) * s0**2) - 1 / (n - 1) ** 2
    assert m.z == pytest.approx((m.i + 1 / (n - 1)) / var**0.5)


def test_permutation_is_a_bijection_and_agrees_with_theory(spark):
    for n in (7, 100, 257):
        df = spark.range(n).crossJoin(spark.range(5).withColumnRenamed("id", "rep"))
        got = df.select("rep", spatial.permuted_position(F.col("id"), F.col("rep"), n, 11).alias("p"))
        stats = got.groupBy("rep").agg(F.count_distinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("b")).collect()
        assert all((r.d, r.a, r.b) == (n, 0, n - 1) for r in stats)
    _, _, _, data = lattice_data(spark, 12, 0.0, 5)
    weights = graph.row_standardised(graph.queen_edges(data, "id")).persist()
    out = spatial.permutation_test(data, "id", weights, "x1", 99, 2018)
    again = spatial.permutation_test(data, "id", weights, "x1", 99, 2018, batch=40)
    assert out["p_sim"] == again["p_sim"] and out["mean_i_sim"] == pytest.approx(again["mean_i_sim"])
    sd = (out["moran_i"] - out["expected_i"]) / out["z_norm"]
    assert out["mean_i_sim"] == pytest.approx(out["expected_i"], abs=4 * sd / 99**0.5)
    assert out["sd_i_sim"] == pytest.approx(sd, rel=0.35) and 0.01 <= out["p_sim"] <= 0.51


def test_permutations_agree_with_their_closed_forms(spark):
    """Mean and variance over all permutations (randomisation), for two columns at once."""
    w, x, y, data = lattice_data(spark, 10, 0.4, 3)
    weights = graph.row_standardised(graph.queen_edges(data, "id")).persist()
    got = spatial.permutation_tests(data, "id", weights, ["x1", "y"], 999, 2018)
    n, s0 = len(x), w.sum()
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    for name, v in (("x1", x), ("y", y)):
        z = v - v.mean()
        b2 = n * (z**4).sum() / (z**2).sum() ** 2
        upper = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)
        var = upper / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2
        assert got[name]["moran_i"] == pytest.approx(n / s0 * (z @ w @ z) / (z @ z))
        assert got[name]["mean_i_sim"] == pytest.approx(-1 / (n - 1), abs=4 * (var / 999) ** 0.5)
        assert got[name]["sd_i_sim"] == pytest.approx(var**0.5, rel=0.1)
    assert got["x1"] == pytest.approx(spatial.permutation_test(data, "id", weights, "x1", 999, 2018))


def test_permutations_leave_out_nulls_and_flat_columns_have_no_test(spark):
    df = spark.createDataFrame([(i, i, 0, float(i % 3), 1.0) for i in range(8)] + [(8, 8, 0, None, 1.0)], "id long, col long, row long, v double, flat double")
    weights = graph.row_standardised(graph.queen_edges(df.where("id < 8"), "id"))
    got = spatial.permutation_tests(df, "id", weights, ["v", "flat"], 19, 1, batch=7)
    assert got["v"]["n"] == 8 and got["v"]["moran_i"] == pytest.approx(got["v"]["moran_i"])
    assert np.isnan(got["flat"]["moran_i"]) and np.isnan(got["flat"]["z_sim"])


def test_spatial_error_recovers_lambda(spark):
    _, _, _, df = lattice_data(spark, 30, 0.5, 9)
    weights = graph.row_standardised(graph.queen_edges(df, "id")).persist()
    fit = spatial.spatial_error(df, "id", weights, "y", ["x1"])
    assert fit.lam == pytest.approx(0.5, abs=0.15)
    assert fit.coef[1] == pytest.approx(2.0, abs=0.12)
    assert abs(fit.moran_filtered) < 0.06 < fit.moran_ols


def test_ols_family_matches_numpy(spark):
    rng = np.random.default_rng(2)
    n = 400
    a, b = rng.normal(size=n), rng.normal(1000, 5, size=n)
    y = 3 + 0.5 * a - 0.2 * b + rng.normal(size=n) * (1 + abs(a))
    g = rng.integers(0, 25, size=n)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(y[i]), int(g[i])) for i in range(n)], "id int, a double, b double, y double, g int")
    fit = regression.ols(df, "y", ["a", "b"])
    x = np.column_stack([np.ones(n), a, b])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    assert fit.coef == pytest.approx(beta, rel=1e-6)
    assert fit.se == pytest.approx(np.sqrt(np.diag(inv) * (e @ e) / (n - 3)), rel=1e-6)
    assert fit.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    meat = (x * e[:, None]).T @ (x * e[:, None])
    assert regression.hc1_se(df, fit) == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv) * n / (n - 3)), rel=1e-5)
    s = np.array([(x * e[:, None])[g == k].sum(0) for k in np.unique(g)])
    k = len(s)
    want = np.sqrt(np.diag(inv @ s.T @ s @ inv) * k / (k - 1) * (n - 1) / (n - 3))
    got, groups = regression.clustered_se(df, fit, "g")
    assert groups == k and got == pytest.approx(want, rel=1e-5)
    single, _ = regression.clustered_se(df, fit, "id")
    assert single == pytest.approx(regression.hc1_se(df, fit), rel=1e-6)  # factors coincide for n clusters
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(2.5, 1e6) == pytest.approx(normal_two_sided(2.5), rel=1e-4)


def avg_rank(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_statistics_with_ties(spark):
    rng = np.random.default_rng(4)
    x = np.r_[np.zeros(80), rng.integers(0, 30, 160)].astype(float)
    y = x * 0.3 + rng.integers(0, 12, 240)
    first = rng.integers(0, 2, 240)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, first)], "x double, y double, f int")
    rho = ranks.spearman(df, "x", "y").first().spearman_rho
    assert rho == pytest.approx(np.corrcoef(avg_rank(x), avg_rank(y))[0, 1])
    u = ranks.mann_whitney(df, "x", F.col("f") == 1).first()
    a, b = x[first == 1], x[first == 0]
    assert u.u == sum((p > b).sum() + 0.5 * (p == b).sum() for p in a)
    assert 0 < u.p_greater < 1


def test_error_models_share_the_joins_with_the_weights(spark, monkeypatch):
    _, _, _, df = lattice_data(spark, 12, 0.4, 3)
    df = df.withColumn("x2", F.col("x1") * F.col("x1") + 1000.0).persist()
    weights = graph.row_standardised(graph.queen_edges(df, "id")).persist()
    rows = df.orderBy("id").collect()
    at, n = {r.id: k for k, r in enumerate(rows)}, len(rows)
    w = np.zeros((n, n))
    for r in weights.collect():
        w[at[r.i], at[r.j]] = r.w
    calls, lags = [], spatial.lags
    monkeypatch.setattr(spatial, "lags", lambda *a: calls.append(1) or lags(*a))
    specs = [("y", ["x1"]), ("y", ["x1", "x2"]), ("x2", ["x1"])]
    fits, errors, own = spatial.spatial_errors(df, "id", weights, specs)
    assert len(calls) == 2
    value = {c: np.array([r[c] for r in rows]) for c in ("y", "x1", "x2")}

    def moran(v):
        z = v - v.mean()
        return n / w.sum() * (z @ w @ z) / (z @ z)

    for (y, xs), fit, error in zip(specs, fits, errors):
        x = np.column_stack([np.ones(n), *[value[c] for c in xs]])
        u = value[y] - x @ np.linalg.lstsq(x, value[y], rcond=None)[0]
        a = np.eye(n) - error.lam * w
        beta = np.linalg.lstsq(a @ x, a @ value[y], rcond=None)[0]
        e = a @ (value[y] - x @ beta)
        assert error.coef == pytest.approx(beta, rel=1e-6)
        assert error.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ a.T @ a @ x)) * (e @ e) / n), rel=1e-6)
        assert error.moran_ols == pytest.approx(moran(u), abs=1e-9) and error.moran_filtered == pytest.approx(moran(e), abs=1e-8)
        assert error.pseudo_r2 == pytest.approx(np.corrcoef(value[y], x @ beta)[0, 1] ** 2, abs=1e-9)
        assert own[y] == pytest.approx(moran(value[y]), abs=1e-10) and fit.r2 == error.ols_r2


def test_checkpoints_do_not_carry_estimates_and_constraints(spark):
    """Each join multiplies the estimate of its sides: through an iteration the number's digits double every time."""
    df = spark.range(3).select("id", (F.col("id") * 2).alias("v"))
    for _ in range(8):
        df = checkpointed(df.join(df.select("id", F.col("v").alias("u")), "id").select("id", F.least("u", "v").alias("v")))
        plan = df._jdf.queryExecution().optimizedPlan()
        assert plan.stats().sizeInBytes().bit_length() <= 64 and plan.constraints().size() == 0
    assert sorted(map(tuple, df.collect())) == [(0, 0), (1, 2), (2, 4)]


def test_permutations_in_tasks_agree_with_brute_force_over_many_blocks(spark, monkeypatch):
    """Positions as ``permuted_position`` has them; pairs inside and across blocks, far ones and a hub too."""
    for n in (1, 7, 100, 257):
        df = spark.range(n).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("rep")))
        for seed in (11, 5_000):
            got = df.select("id", "rep", spatial.permuted_position(F.col("id"), F.col("rep"), n, seed).alias("p")).orderBy("rep", "id").collect()
            want = np.concatenate([spatial._permuted(np.arange(n), rep, n, seed) for rep in range(3)])
            assert [r.p for r in got] == want.tolist()
    monkeypatch.setattr(spatial, "BLOCK_LEAST", 7)
    monkeypatch.setattr(spatial, "BLOCK_MOST", 7)
    monkeypatch.setattr(spatial, "EXCHANGE_BYTES", 50 * 20 * 4)
    n, rng = 50, np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    w = {(i, int(j)): float(rng.random()) for i in range(n) for j in rng.choice(n, 4)} | {(0, j): 0.5 for j in range(1, n)}
    units = spark.createDataFrame([(3 * i, float(a), float(b)) for i, (a, b) in enumerate(x)], "u long, a double, b double")
    weights = spark.createDataFrame([(3 * i, 3 * j, v) for (i, j), v in w.items()], "i long, j long, w double")
    got = spatial.permutation_tests(units, "u", weights, ["a", "b"], 9, 2018)
    i, j, v = np.array([p[0] for p in w]), np.array([p[1] for p in w]), np.array(list(w.values()))
    for c, name in enumerate(("a", "b")):
        z = x[:, c] - x[:, c].mean()
        sims = []
        for rep in range(9):
            moved = np.empty(n)
            moved[spatial._permuted(np.arange(n), rep, n, 2018)] = z
            sims.append(n / v.sum() / (z @ z) * (v * moved[i] * moved[j]).sum())
        assert got[name]["moran_i"] == pytest.approx(n / v.sum() / (z @ z) * (v * z[i] * z[j]).sum())
        assert got[name]["mean_i_sim"] == pytest.approx(np.mean(sims)) and got[name]["sd_i_sim"] == pytest.approx(np.std(sims))
