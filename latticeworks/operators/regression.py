"""Least squares from executor-side moments; only k x k matrices reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import log, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.functions.tails import t_two_sided

COEFFICIENTS = (
    "variable string, coefficient double, std_error double, ci_95_lo double, ci_95_hi double, "
    "p_value double, standardized_coefficient double, standardized_se double"
)


@dataclass
class Fit:
    """An OLS fit with intercept; index 0 is the intercept."""

    y: str
    xs: list[str]
    n: int
    coef: np.ndarray
    bread: np.ndarray  # inverse of X'X, intercept included
    ssr: float
    sst: float
    sd_y: float
    sd_x: np.ndarray
    corr_x: np.ndarray

    @property
    def k(self) -> int:
        return len(self.xs) + 1

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.sst

    @property
    def adj_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - self.k)

    @property
    def aic(self) -> float:
        loglik = -self.n / 2 * (log(2 * pi) + log(self.ssr / self.n) + 1)
        return -2 * loglik + 2 * self.k

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.bread) * self.ssr / (self.n - self.k))

    def predicted(self) -> Column:
        terms = [F.lit(float(b)) * F.col(x) for b, x in zip(self.coef[1:], self.xs)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.coef[0])))

    def residual(self) -> Column:
        return F.col(self.y) - self.predicted()


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    """Fit y on xs and an intercept from one aggregate of centred moments."""
    xs = list(xs)
    names = [y, *xs]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    clean = df.na.drop(subset=names)
    row = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    mean = np.array([row[f"m{i}"] for i in range(len(names))], dtype=float)
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    sxx, sxy, syy = cov[1:, 1:], cov[1:, 0], cov[0, 0]
    inv = np.linalg.inv(sxx)
    slopes = inv @ sxy
    mx = mean[1:]
    bread = np.zeros((len(names), len(names)))
    bread[1:, 1:] = inv / n
    bread[0, 1:] = bread[1:, 0] = -(inv @ mx) / n
    bread[0, 0] = (1 + mx @ inv @ mx) / n
    sd = np.sqrt(np.diag(cov) * n / (n - 1))
    return Fit(
        y, xs, n, np.concatenate([[mean[0] - slopes @ mx], slopes]), bread,
        n * (syy - sxy @ slopes), n * syy, sd[0], sd[1:],
        sxx / np.sqrt(np.outer(np.diag(sxx), np.diag(sxx))),
    )


def coefficient_table(spark: SparkSession, fit: Fit, intercept: bool = True) -> DataFrame:
    """Coefficients with 1.96-SE intervals, t p-values and standardised values."""
    rows = []
    for i, name in enumerate(["const", *fit.xs]):
        b, se = float(fit.coef[i]), float(fit.se[i])
        scale = float(fit.sd_x[i - 1] / fit.sd_y) if i else None
        rows.append((
            name, b, se, b - 1.96 * se, b + 1.96 * se, t_two_sided(b / se, fit.n - fit.k),
            b * scale if i else None, se * scale if i else None,
        ))
    return spark.createDataFrame(rows if intercept else rows[1:], COEFFICIENTS)


def vif_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """Variance inflation: the diagonal of the inverse predictor correlation."""
    v = np.diag(np.linalg.inv(fit.corr_x))
    rows = [(x, float(a), bool(a > 10)) for x, a in zip(fit.xs, v)]
    return spark.createDataFrame(rows, "variable string, vif double, flag_high_vif boolean")


def fit_row(spark: SparkSession, fit: Fit) -> DataFrame:
    row = (fit.n, float(fit.r2), float(fit.adj_r2), float(fit.aic))
    return spark.createDataFrame([row], "n long, r2 double, adj_r2 double, aic double")


def _outer_sums(df: DataFrame, scores: Sequence[str]) -> np.ndarray:
    """Sum over rows of the outer product of the score columns."""
    k = len(scores)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(F.col(scores[i]) * F.col(scores[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"s{i}_{j}"]
    return out


def _scores(df: DataFrame, fit: Fit, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    clean = df.na.drop(subset=[fit.y, *fit.xs])
    regressors = [F.lit(1.0), *[F.col(x) for x in fit.xs]]
    names = [f"_s{i}" for i in range(fit.k)]
    return clean.select(*keep, *[(fit.residual() * x).alias(s) for x, s in zip(regressors, names)]), names


def hc1_se(df: DataFrame, fit: Fit) -> np.ndarray:
    """Heteroscedasticity-robust standard errors with the n/(n-k) factor."""
    rows, names = _scores(df, fit)
    cov = fit.bread @ _outer_sums(rows, names) @ fit.bread * fit.n / (fit.n - fit.k)
    return np.sqrt(np.diag(cov))


def clustered_se(df: DataFrame, fit: Fit, cluster: str) -> tuple[np.ndarray, int]:
    """Cluster-robust standard errors and the number of clusters."""
    rows, names = _scores(df, fit, [cluster])
    per = rows.groupBy(cluster).agg(*[F.sum(s).alias(s) for s in names])
    meat, groups = _outer_sums(per, names), per.count()
    factor = groups / (groups - 1) * (fit.n - 1) / (fit.n - fit.k)
    return np.sqrt(np.diag(fit.bread @ meat @ fit.bread * factor)), groups


def standard_error_table(
    df: DataFrame, fit: Fit, clusters: dict[str, str], extra: dict[str, tuple] | None = None
) -> DataFrame:
    """Estimator x variable: coefficient, SE, interval, ratio to conventional.

    ``clusters`` maps a label to a cluster column; ``extra`` maps a label to
    (coefficients, standard errors) of another estimator, slopes only.
    """
    conventional = fit.se[1:]
    rows = {"conventional": (fit.coef[1:], conventional), "HC1": (fit.coef[1:], hc1_se(df, fit)[1:])}
    for label, col in clusters.items():
        rows[label] = (fit.coef[1:], clustered_se(df, fit, col)[0][1:])
    rows.update(extra or {})
    out = [
        (est, x, float(b), float(s), float(b - 1.96 * s), float(b + 1.96 * s), float(s / c))
        for est, (coef, se) in rows.items()
        for x, b, s, c in zip(fit.xs, coef, se, conventional)
    ]
    return df.sparkSession.createDataFrame(
        out,
        "estimator string, variable string, coef double, se double, ci_lo double, ci_hi double, "
        "se_ratio_to_conventional double",
    )
