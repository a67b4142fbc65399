"""Regressions, neighbour graphs and spatial dependence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from latticeworks.catalog.registry import query, r, rounded
from latticeworks.catalog.sqlmath import ols_sql
from latticeworks.catalog.tables import CELL_SQL, cell_table, sample
from latticeworks.operators import graph, lattice, regression, spatial
from latticeworks.plans import analysis as A
from latticeworks.plans import bindings as B
from latticeworks.plans import models as M
from latticeworks.session import checkpointed

_FITS = [(o, y, m, xs) for o, y in M.OUTCOMES.items() for m, xs in A.NESTED.items()]
OLS_SQL = ",\n ".join(ols_sql(f"{o}_{m}", "samp", y, xs) for o, y, m, xs in _FITS)


def _coef_sql():
    rows = []
    for o, _, m, xs in _FITS:
        src = f"{o}_{m}_fit"
        rows.append(f"SELECT '{o}' AS outcome, '{m}' AS model, 'const' AS variable, {r('c0')} AS coefficient, {r('sec')} AS std_error, {r('c0 - 1.96*sec')} AS ci_95_lo, {r('c0 + 1.96*sec')} AS ci_95_hi, NULL::DOUBLE AS standardized_coefficient, NULL::DOUBLE AS standardized_se FROM {src}")
        for i, x in enumerate(xs):
            rows.append(f"SELECT '{o}', '{m}', '{x}', {r(f'b{i}')}, {r(f'se{i}')}, {r(f'b{i} - 1.96*se{i}')}, {r(f'b{i} + 1.96*se{i}')}, {r(f'z{i}')}, {r(f'z{i}/b{i}*se{i}')} FROM {src}")
    return " UNION ALL ".join(rows)


@query(f"{CELL_SQL}, {OLS_SQL} {_coef_sql()}")
def ols_coefficients(spark, sf):
    """Nested models for two outcomes; t p-values are tested elsewhere."""
    return rounded(M.ols_table(sample(spark, sf)).drop("p_value"))


def _per_fit(cols):
    return " UNION ALL ".join(f"SELECT '{o}' AS outcome, '{m}' AS model, {cols(len(xs), o, m)} FROM {o}_{m}_fit" for o, _, m, xs in _FITS)


@query(f"{CELL_SQL}, {OLS_SQL} " + _per_fit(lambda k, o, m: f"n::BIGINT AS n, {r('r2')} AS r2, {r(f'1 - (1-r2)*(n-1)/(n-{k+1})')} AS adj_r2, {r(f'n*(ln(2*pi()) + ln(ssr/n) + 1) + 2*{k+1}', 4)} AS aic"))
def ols_fit_statistics(spark, sf):
    from latticeworks.functions.scalars import round_even
    out = M.fit_table(sample(spark, sf))
    return rounded(out.withColumn("aic", round_even(F.col("aic") + 1.7e-7, 4)))


@query(f"{CELL_SQL}, {OLS_SQL} " + " UNION ALL ".join(
    f"SELECT '{o}' AS outcome, '{m}' AS model, '{x}' AS variable, {r(f'vif{i}')} AS vif, vif{i} > 10 AS flag_high_vif FROM {o}_{m}_fit"
    for o, _, m, xs in _FITS if len(xs) > 1 for i, x in enumerate(xs)))
def variance_inflation(spark, sf):
    return rounded(M.vif_table(sample(spark, sf)))


def _sandwich_sql():
    xs = A.NESTED["C"]
    k = len(xs)
    e = "log_net - c0 - " + " - ".join(f"b{i}*{x}" for i, x in enumerate(xs))
    psi = ", ".join("(" + " + ".join(f"v{i}_{j}*({x} - mx{j})" for j, x in enumerate(xs)) + f")*e AS p{i}" for i in range(k))
    block = lambda s: f"floor(zcol*400/{s})::BIGINT || '_' || floor(zrow*400/{s})::BIGINT"
    ctes = f"""res AS (SELECT *, {e} AS e FROM samp, net_C_fit), sc AS (SELECT *, {psi} FROM res),
 h AS (SELECT {", ".join(f"sqrt(sum(p{i}*p{i}))/any_value(n)*sqrt(any_value(n)/(any_value(n)-{k+1})) AS s{i}" for i in range(k))} FROM sc)"""
    parts = [f"SELECT 'conventional' AS estimator, '{x}' AS variable, b{i} AS coef, se{i} AS se, se{i} AS c FROM net_C_fit" for i, x in enumerate(xs)]
    parts += [f"SELECT 'HC1', '{x}', b{i}, s{i}, se{i} FROM net_C_fit, h" for i, x in enumerate(xs)]
    for lab, size in (("block 2 km", 2000), ("block 3 km", 3000)):
        name = f"cl{size}"
        ctes += f""", {name}g AS (SELECT {block(size)} AS g, any_value(n) AS n, {", ".join(f"sum(p{i}) AS q{i}" for i in range(k))} FROM sc GROUP BY 1),
 {name} AS (SELECT {", ".join(f"sqrt(sum(q{i}*q{i}))/any_value(n)*sqrt(count(*)*1.0/(count(*)-1)*(any_value(n)-1)/(any_value(n)-{k+1})) AS s{i}" for i in range(k))} FROM {name}g)"""
        parts += [f"SELECT '{lab}', '{x}', b{i}, s{i}, se{i} FROM net_C_fit, {name}" for i, x in enumerate(xs)]
    return f"""{ctes}, al AS ({" UNION ALL ".join(parts)}) SELECT estimator, variable, {r('coef')} AS coef, {r('se')} AS se, {r('coef - 1.96*se')} AS ci_lo,
 {r('coef + 1.96*se')} AS ci_hi, {r('se/c')} AS se_ratio_to_conventional FROM al"""


@query(f"{CELL_SQL}, {OLS_SQL}, {_sandwich_sql()}")
def standard_error_comparison(spark, sf):
    """Conventional, HC1 and block-clustered errors of the full model."""
    x, y = F.col("zcol") * 400, F.col("zrow") * 400
    df = sample(spark, sf).withColumns({"b2": lattice.block_key(x, y, 2000), "b3": lattice.block_key(x, y, 3000)})
    return rounded(M.inference_table(df, None, {"block 2 km": "b2", "block 3 km": "b3"}))


EDGE_SQL = """qe AS (SELECT a.grid_id AS i, b.grid_id AS j FROM samp a JOIN samp b ON b.zcol BETWEEN a.zcol - 1 AND a.zcol + 1 AND b.zrow BETWEEN a.zrow - 1 AND a.zrow + 1
  AND a.grid_id <> b.grid_id), w AS (SELECT i, j, 1.0::DOUBLE/count(*) OVER (PARTITION BY i) AS w FROM qe)"""


@query(f"{CELL_SQL}, {EDGE_SQL} SELECT i, j, {r('w')} AS w FROM w")
def queen_weights(spark, sf):
    return rounded(graph.row_standardised(graph.queen_edges(sample(spark, sf), "grid_id", "zcol", "zrow")))


_MORAN_SQL = f"""ws AS (SELECT sum(w) AS s0 FROM w), w1 AS (SELECT sum(s*s) AS s1 FROM (SELECT sum(w) AS s FROM w GROUP BY least(i, j), greatest(i, j))),
 w2 AS (SELECT sum(s*s) AS s2 FROM (SELECT u, sum(w) AS s FROM (SELECT i AS u, w FROM w UNION ALL SELECT j, w FROM w) GROUP BY u)),
 vals AS (SELECT 'net' AS variable, grid_id, log_net - avg(log_net) OVER () AS z FROM samp UNION ALL SELECT 'gross', grid_id, log_gross - avg(log_gross) OVER () FROM samp
  UNION ALL SELECT 'ols_residual', grid_id, log_net - c0 - {" - ".join(f"b{i}*{x}" for i, x in enumerate(A.NESTED['C']))} FROM samp, net_C_fit),
 nm AS (SELECT a.variable, sum(w.w*a.z*b.z) AS num FROM w JOIN vals a ON a.grid_id = w.i JOIN vals b ON b.grid_id = w.j AND a.variable = b.variable GROUP BY 1),
 dn AS (SELECT variable, sum(z*z) AS den, count(*)::DOUBLE AS n FROM vals GROUP BY 1),
 mi AS (SELECT variable, n, n/s0*num/den AS i, -1/(n-1) AS e, sqrt((n*n*s1 - n*s2 + 3*s0*s0)/((n*n-1)*s0*s0) - 1/((n-1)*(n-1))) AS sd FROM nm JOIN dn USING (variable), ws, w1, w2)"""


@query(f"{CELL_SQL}, {OLS_SQL}, {EDGE_SQL}, {_MORAN_SQL} SELECT variable, n::BIGINT AS n, {r('i')} AS moran_i, {r('e')} AS expected_i, {r('(i-e)/sd')} AS z_norm FROM mi")
def morans_i(spark, sf):
    df = sample(spark, sf)
    w = M.queen_weights(df)
    fit = regression.ols(df, "log_net", A.NESTED["C"])
    vals = df.select("grid_id", F.col("log_net").alias("net"), F.col("log_gross").alias("gross"), fit.residual().alias("ols_residual"))
    sums = spatial.weight_sums(w)
    rows = []
    for v in ("net", "gross", "ols_residual"):
        m = spatial.moran(vals, "grid_id", w, v, sums)
        rows.append((v, m.n, m.i, m.expected, m.z))
    return rounded(spark.createDataFrame(rows, "variable string, n long, moran_i double, expected_i double, z_norm double"))


DENSE = 110  # buildings of a densely built cell


def sparse_units(spark, sf):
    """Densely built cells: a patchy sample with islands."""
    df = cell_table(spark, sf).where(F.col("building_count") >= DENSE)
    return checkpointed(df.select("grid_id", "zcol", "zrow", (F.col("zcol") * 400.0).alias("x"), (F.col("zrow") * 400.0).alias("y")))


UNIT_SQL = f"""un AS (SELECT grid_id, zcol, zrow FROM celltab WHERE building_count >= {DENSE}),
 ue AS (SELECT a.grid_id AS i, b.grid_id AS j FROM un a JOIN un b ON b.zcol BETWEEN a.zcol - 1 AND a.zcol + 1 AND b.zrow BETWEEN a.zrow - 1 AND a.zrow + 1 AND a.grid_id <> b.grid_id)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


REACH_SQL = """reach(a, b) AS (SELECT grid_id, grid_id FROM un UNION SELECT reach.a, ue.j FROM reach JOIN ue ON ue.i = reach.b),
 comp AS (SELECT a AS grid_id, min(b) AS component FROM reach GROUP BY a)"""


@query(f"{_recursive(CELL_SQL)}, {UNIT_SQL}, {REACH_SQL} SELECT grid_id, component FROM comp")
def connected_components(spark, sf):
    units = sparse_units(spark, sf)
    return graph.components(units, "grid_id", graph.queen_edges(units, "grid_id", "zcol", "zrow"))


@query(f"""{_recursive(CELL_SQL)}, {UNIT_SQL}, {REACH_SQL}, cs AS (SELECT component, count(*) AS s FROM comp GROUP BY 1)
SELECT count(*) AS n_components, count(*) FILTER (s = 1) AS n_singletons, count(*) FILTER (s BETWEEN 2 AND 5) AS n_2_to_5,
 count(*) FILTER (s BETWEEN 6 AND 20) AS n_6_to_20, count(*) FILTER (s > 20) AS n_above_20, max(s) AS largest_component FROM cs""")
def component_size_bands(spark, sf):
    units = sparse_units(spark, sf)
    return graph.component_sizes(graph.components(units, "grid_id", graph.queen_edges(units, "grid_id", "zcol", "zrow")))


NEAR_SQL = """nb AS (SELECT a.grid_id AS i, b.grid_id AS j FROM un a, un b WHERE a.grid_id <> b.grid_id
  QUALIFY row_number() OVER (PARTITION BY a.grid_id ORDER BY pow(a.zcol-b.zcol, 2) + pow(a.zrow-b.zrow, 2), b.grid_id) = 1),
 isl AS (SELECT nb.* FROM nb WHERE i NOT IN (SELECT i FROM ue)),
 fixed AS (SELECT i, j FROM ue UNION SELECT i, j FROM isl UNION SELECT j, i FROM isl)"""


@query(f"{CELL_SQL}, {UNIT_SQL}, {NEAR_SQL} SELECT i, j FROM fixed")
def island_repair(spark, sf):
    units = sparse_units(spark, sf)
    return graph.attach_islands(units, "grid_id", graph.queen_edges(units, "grid_id", "zcol", "zrow"))


@query(f"""{_recursive(CELL_SQL)}, {UNIT_SQL}, {REACH_SQL}, dg AS (SELECT un.grid_id, count(ue.j) AS d FROM un LEFT JOIN ue ON ue.i = un.grid_id GROUP BY 1)
SELECT 'queen' AS spec, count(*) AS n_units, count(*) FILTER (d = 0) AS n_islands, min(d) AS min_neighbors, max(d) AS max_neighbors,
 {r('avg(d)')} AS mean_neighbors, (SELECT count(DISTINCT component) FROM comp) AS n_components FROM dg""")
def weights_audit(spark, sf):
    units = sparse_units(spark, sf)
    queen = graph.queen_edges(units, "grid_id", "zcol", "zrow")
    return rounded(M.weights_audit(units, {"queen": queen}))


@query()
def weights_audit_all_graphs(spark, sf):
    """Audit of the Queen, repaired and eight-nearest graphs."""
    units = sparse_units(spark, sf)
    return M.weights_audit(units, M.weight_specs(units))


@query()
def moran_permutation_inference(spark, sf):
    """Seeded permutation p-values from 999 replicates."""
    df = sample(spark, sf)
    return M.moran_table(df, M.queen_weights(df))


@query()
def spatial_error_model(spark, sf):
    df = sample(spark, sf)
    return M.spatial_table(df, M.queen_weights(df), [(o, m) for o in ("net", "gross") for m in ("A", "B", "C")])


@query()
def model_fit_and_moran(spark, sf):
    df = sample(spark, sf)
    return M.fit_and_moran(df, M.queen_weights(df))


@query()
def weights_sensitivity(spark, sf):
    df = checkpointed(sample(spark, sf).withColumns({"x": F.col("zcol") * 400.0, "y": F.col("zrow") * 400.0}))
    return M.weights_sensitivity(df, M.weight_specs(df))


@query()
def signal_only_models(spark, sf):
    df = sample(spark, sf)
    return M.signal_only(df, M.queen_weights(df))


def coarse_sample(spark, sf, pixels_per_side: int):
    """The final sample at another cell size, from the same pixels."""
    k = pixels_per_side
    px = B.pixels(spark, sf).where(F.col("gross").isNotNull())
    c, rw = B.idiv(F.col("col"), k), B.idiv(F.col("row"), k)
    h = px.groupBy(c.alias("zcol"), rw.alias("zrow")).agg(
        F.count(F.lit(1)).alias("n_source_pixels"), F.avg("gross").alias("cell_agbh_mean_m"),
        F.sum("gross").alias("_g"), F.sum("fraction_raw").alias("_f"))
    stack = B.epoch_stack(spark, sf)
    cover = stack.groupBy(B.idiv(F.col("col"), k).alias("zcol"), B.idiv(F.col("row"), k).alias("zrow")).agg(
        *[F.avg(F.col(f"built_{e}") / 10_000).alias(f"built_coverage_{e}") for e in (1975, 2010, 2015)])
    cells = h.join(cover, ["zcol", "zrow"]).withColumns({
        "cell_anbh_derived_m": F.when(F.col("_f") > 0, F.col("_g") / F.col("_f")).otherwise(0.0),
        A.CENTRE_DISTANCE: F.hypot((F.col("zcol") + 0.5) * 100 * k - 4000, (F.col("zrow") + 0.5) * 100 * k - 3000),
        "in_national_footprint": F.lit(True),
        "grid_id": F.col("zrow") * (1 << 32) + F.col("zcol"),
    })
    return checkpointed(A.final_sample(cells))


@query()
def resolution_sensitivity(spark, sf):
    """One row per cell size: the same code on three lattices."""
    rows = [M.resolution_row(coarse_sample(spark, sf, k), 100 * k, "grid_id", "zcol", "zrow") for k in (3, 5, 10)]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"""WITH {B.SQL['px']}, {B.SQL['stack']}, """ + ", ".join(f"""h{k} AS (SELECT col // {k} AS zcol, "row" // {k} AS zrow, count(*) AS n, sum(gross) AS g, sum(fraction_raw) AS f, avg(gross) AS gm FROM px WHERE gross IS NOT NULL GROUP BY ALL),
 c{k} AS (SELECT col // {k} AS zcol, "row" // {k} AS zrow, avg(built_1975/10000) AS a, avg(built_2010/10000) AS b, avg(built_2015/10000) AS c FROM stack GROUP BY ALL),
 s{k} AS (SELECT *, CASE WHEN f > 0 THEN g/f ELSE 0 END AS net FROM h{k} JOIN c{k} USING (zcol, zrow) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)""" for k in (3, 5, 10)) + " " + " UNION ALL ".join(
    f"""SELECT {100*k} AS resolution, count(*) AS n_final, {r('avg(n)')} AS mean_pixels, {r('avg(net)')} AS anbh_mean_m, {r('stddev_samp(net)')} AS anbh_sd_m, {r('quantile_cont(net, 0.5)')} AS anbh_median_m FROM s{k}""" for k in (3, 5, 10)))
def resolution_moments(spark, sf):
    from latticeworks.operators import order
    parts = []
    for k in (3, 5, 10):
        df = coarse_sample(spark, sf, k)
        mid = order.quantile_values(df, "cell_anbh_derived_m", [0.5])[0]
        parts.append(df.agg(
            F.lit(100 * k).alias("resolution"), F.count(F.lit(1)).alias("n_final"), F.avg("n_source_pixels").alias("mean_pixels"),
            F.avg("cell_anbh_derived_m").alias("anbh_mean_m"), F.stddev_samp("cell_anbh_derived_m").alias("anbh_sd_m"), F.lit(mid).alias("anbh_median_m")))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))
