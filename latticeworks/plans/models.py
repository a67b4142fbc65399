"""Nested regressions, spatial diagnostics and their sensitivity tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.functions.tails import normal_two_sided
from latticeworks.operators import graph, order, regression, spatial
from latticeworks.plans import analysis as A
from latticeworks.session import checkpointed

OUTCOMES = {"net": "log_net", "gross": "log_gross"}


def nested_fits(df: DataFrame) -> dict[tuple[str, str], regression.Fit]:
    return {
        (o, m): regression.ols(df, y, xs) for o, y in OUTCOMES.items() for m, xs in A.NESTED.items()
    }


def _tag(frame: DataFrame, outcome: str, model: str) -> DataFrame:
    return frame.select(F.lit(outcome).alias("outcome"), F.lit(model).alias("model"), "*")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ols_table(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return _union([
        _tag(regression.coefficient_table(spark, f), o, m) for (o, m), f in nested_fits(df).items()
    ])


def fit_table(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return _union([_tag(regression.fit_row(spark, f), o, m) for (o, m), f in nested_fits(df).items()])


def vif_table(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return _union([
        _tag(regression.vif_table(spark, f), o, m)
        for (o, m), f in nested_fits(df).items() if len(f.xs) > 1
    ])


def queen_weights(df: DataFrame, key: str = "grid_id", col: str = "zcol", row: str = "zrow") -> DataFrame:
    return checkpointed(graph.row_standardised(graph.queen_edges(df, key, col, row)))


def moran_table(
    df: DataFrame, weights: DataFrame, replicates: int = 999, seed: int = 2018, key: str = "grid_id"
) -> DataFrame:
    """Moran's I of outcomes, OLS residuals and filtered residuals, permuted.

    An outcome is tested once; residuals once per nested model. All of them
    share one set of permutations.
    """
    tested = {}
    for (o, m), fit in nested_fits(df).items():
        if m == "A":
            tested[o, m, "outcome"] = F.col(fit.y)
        tested[o, m, "ols_residuals"] = fit.residual()
    names = {f"t{i}": label for i, label in enumerate(tested)}
    columns = df.select(key, *[tested[label].alias(c) for c, label in names.items()])
    got = spatial.permutation_tests(columns, key, weights, list(names), replicates, seed)
    rows = [(*label, *got[c].values()) for c, label in names.items()]
    return df.sparkSession.createDataFrame(
        rows, f"outcome string, model string, tested string, {spatial.MORAN_SCHEMA}"
    )


def spatial_table(df: DataFrame, weights: DataFrame, specs: Sequence[tuple[str, str]], key: str = "grid_id") -> DataFrame:
    """Spatial error coefficients with z and p; lambda carries no error."""
    rows = []
    _, errors, _ = spatial.spatial_errors(df, key, weights, [(OUTCOMES[o], A.NESTED[m]) for o, m in specs])
    for (o, m), fit in zip(specs, errors, strict=True):
        xs = A.NESTED[m]
        for name, b, s in zip(["const", *xs], fit.coef, fit.se):
            z = float(b / s)
            rows.append((o, m, name, float(b), float(s), float(b - 1.96 * s), float(b + 1.96 * s), z, normal_two_sided(z)))
        rows.append((o, m, "lambda", fit.lam, None, None, None, None, None))
    return df.sparkSession.createDataFrame(
        rows,
        "outcome string, model string, variable string, coefficient double, std_error double, "
        "ci_95_lo double, ci_95_hi double, z_statistic double, p_value double",
    )


def fit_and_moran(df: DataFrame, weights: DataFrame, models: Sequence[str] = ("A", "B", "C"),
                  outcomes: Sequence[str] = ("net", "gross"), key: str = "grid_id") -> DataFrame:
    """Per outcome and model: OLS fit, lambda, and the three Moran values."""
    specs = [(o, m) for o in outcomes for m in models]
    fits, errors, own = spatial.spatial_errors(df, key, weights, [(OUTCOMES[o], A.NESTED[m]) for o, m in specs])
    rows = [
        (o, m, fit.n, float(base.r2), float(base.adj_r2), float(base.aic), fit.pseudo_r2, fit.lam,
         own[OUTCOMES[o]], fit.moran_ols, fit.moran_filtered)
        for (o, m), base, fit in zip(specs, fits, errors, strict=True)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "outcome string, model string, n long, ols_r2 double, ols_adj_r2 double, ols_aic double, "
        "spatial_pseudo_r2 double, spatial_lambda double, moran_i_outcome double, "
        "moran_i_ols_residuals double, moran_i_spatial_residuals double",
    )


def weight_specs(df: DataFrame, key: str = "grid_id") -> dict[str, DataFrame]:
    """Queen, Queen with repaired islands, and eight-nearest graphs as edges."""
    queen = checkpointed(graph.queen_edges(df, key, "zcol", "zrow"))
    near = checkpointed(graph.knn_edges(df, key, 8))
    return {
        "queen": queen,
        "queen_knn1_islands": checkpointed(graph.attach_islands(df, key, queen, near)),
        "knn8": near.select("i", "j"),
    }


def weights_audit(df: DataFrame, specs: Mapping[str, DataFrame], key: str = "grid_id") -> DataFrame:
    return graph.audits(df, key, specs)


def weights_sensitivity(df: DataFrame, specs: Mapping[str, DataFrame], key: str = "grid_id") -> DataFrame:
    """The full net-height model under each neighbour graph."""
    xs = A.NESTED["C"]
    rows = []
    for name, edges in specs.items():
        w = checkpointed(graph.row_standardised(edges))
        _, (fit,), own = spatial.spatial_errors(df, key, w, [("log_net", xs)])
        for v, b in zip(["const", *xs], fit.coef):
            rows.append((name, v, float(b), fit.lam, fit.pseudo_r2, own["log_net"], fit.moran_ols, fit.moran_filtered))
    return df.sparkSession.createDataFrame(
        rows,
        "weights_spec string, variable string, coefficient double, lambda double, "
        "spatial_pseudo_r2 double, moran_i_outcome double, moran_i_ols_residuals double, "
        "moran_i_spatial_residuals double",
    )


def inference_table(df: DataFrame, weights: DataFrame | None, clusters: Mapping[str, str], key: str = "grid_id") -> DataFrame:
    """Conventional, robust, clustered and spatial errors of the full model."""
    fit = regression.ols(df, "log_net", A.NESTED["C"])
    extra = {}
    if weights is not None:
        sem = spatial.spatial_error(df, key, weights, "log_net", A.NESTED["C"])
        extra = {"spatial error": (sem.coef[1:], sem.se[1:])}
    return regression.standard_error_table(df, fit, dict(clusters), extra)


def signal_only(df: DataFrame, weights: DataFrame, key: str = "grid_id") -> DataFrame:
    """The full model on all cells and on cells with a height signal."""
    xs = A.NESTED["C"]
    rows = []
    positive = df.where(F.col("cell_anbh_derived_m") > 0)
    w_pos = queen_weights(positive, key)
    for label, part, w in (("all cells", df, weights), ("positive height", positive, w_pos)):
        base = regression.ols(part, "log_net", xs)
        sem = spatial.spatial_error(part, key, w, "log_net", xs)
        for i, x in enumerate(xs, start=1):
            rows.append((
                label, base.n, x, float(base.coef[i]), float(base.se[i]),
                float(base.coef[i] * base.sd_x[i - 1] / base.sd_y), float(sem.coef[i]), float(sem.se[i]),
                float(base.r2), sem.pseudo_r2, sem.lam, sem.moran_ols, sem.moran_filtered,
            ))
    return df.sparkSession.createDataFrame(
        rows,
        "sample string, n long, variable string, ols_coef double, ols_se double, "
        "ols_standardized double, sem_coef double, sem_se double, ols_r2 double, "
        "sem_pseudo_r2 double, sem_lambda double, moran_i_ols_resid double, moran_i_sem_filtered double",
    )


def resolution_row(cells: DataFrame, resolution: int, key: str, col: str, row: str) -> DataFrame:
    """Sample, moments, model and typology of one cell size, as one row.

    ``cells`` carries the final-sample columns plus ``n_source_pixels``.
    """
    net = "cell_anbh_derived_m"
    q = [0.25, 0.5, 0.75, 0.99]
    quant = order.quantile_values(cells, net, q)
    typed, _, _ = A.median_typology(cells, net, "growth_1975_2015")
    typed = checkpointed(typed)
    stats = typed.agg(
        F.count(F.lit(1)).alias("n_final"),
        F.avg("n_source_pixels").alias("mean_pixels_per_cell"),
        F.avg(net).alias("anbh_mean_m"), F.stddev_samp(net).alias("anbh_sd_m"),
        (100.0 * F.count_if(F.col(net) == 0) / F.count(F.lit(1))).alias("pct_anbh_zero"),
        (100.0 * F.count_if(F.col("v_class") == F.col("h_class")) / F.count(F.lit(1))).alias("typology_diagonal_pct"),
    ).first().asDict()
    mids = [r["m"] for r in order.quantiles(typed, net, {"m": 0.5}, ["typology_class"]).collect()]  # <= 4 rows
    edges = graph.queen_edges(typed, key, col, row)
    weights = checkpointed(graph.row_standardised(edges))
    fit = spatial.spatial_error(typed, key, weights, "log_net", A.NESTED["C"])
    islands = typed.join(weights.select(F.col("i").alias(key)).distinct(), key, "left_anti").count()
    out = {
        "resolution": resolution, **stats,
        **{f"anbh_p{int(p * 100)}_m": float(v) for p, v in zip(q, quant)},
        "class_median_min_m": min(mids), "class_median_max_m": max(mids),
        "ols_r2": float(fit.ols_r2), "spatial_pseudo_r2": float(fit.pseudo_r2), "spatial_lambda": float(fit.lam),
        "moran_i_ols_residuals": float(fit.moran_ols), "moran_i_filtered": float(fit.moran_filtered),
        "n_islands_queen": islands,
    }
    schema = ", ".join(
        f"{k} {'int' if k == 'resolution' else 'long' if isinstance(v, (int, np.integer)) else 'double'}"
        for k, v in out.items()
    )
    return cells.sparkSession.createDataFrame([tuple(out.values())], schema)
