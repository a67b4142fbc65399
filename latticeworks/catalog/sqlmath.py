"""SQL text for least squares, so that DuckDB can check the fits on its own."""

from __future__ import annotations

from collections.abc import Sequence

from latticeworks.functions.projection import _ALPHA, _ECC, CENTRAL_MERIDIAN, FALSE_EASTING, SCALE, _RADIUS


def utm_sql(name: str, source: str) -> str:
    """CTEs that add ``ux``, ``uy`` (UTM 30N) to a source with lon, lat."""
    k = SCALE * _RADIUS
    east = " + ".join(f"{a!r}::DOUBLE*cos({2*j}*xi)*sinh({2*j}*eta)" for j, a in enumerate(_ALPHA, 1))
    north = " + ".join(f"{a!r}::DOUBLE*sin({2*j}*xi)*cosh({2*j}*eta)" for j, a in enumerate(_ALPHA, 1))
    return f"""{name}_a AS (SELECT *, sin(radians(lat)) AS sphi, radians(lon - ({CENTRAL_MERIDIAN})) AS lam FROM {source}),
 {name}_b AS (SELECT *, sinh(atanh(sphi) - {_ECC!r}::DOUBLE*atanh({_ECC!r}::DOUBLE*sphi)) AS tt FROM {name}_a),
 {name}_c AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1 + tt*tt)) AS eta FROM {name}_b),
 {name} AS (SELECT * EXCLUDE (sphi, lam, tt, xi, eta), {FALSE_EASTING} + {k!r}::DOUBLE*(eta + {east}) AS ux,
  {k!r}::DOUBLE*(xi + {north}) AS uy FROM {name}_c)"""


def lonlat_sql(name: str, source: str) -> str:
    """CTEs that add ``lon``, ``lat`` to a source with ``ux``, ``uy`` in UTM 30N.

    All constants are worked out in SQL from the two of the ellipsoid; latitude by Newton steps on the
    conformal latitude.
    """
    beta = ("n/2 - 2*n*n/3 + 37*pow(n,3)/96 - pow(n,4)/360", "n*n/48 + pow(n,3)/15 - 437*pow(n,4)/1440", "17*pow(n,3)/480 - 37*pow(n,4)/840", "4397*pow(n,4)/161280")
    xi = " - ".join(["xi0", *[f"({b})*sin({2 * j}*xi0)*cosh({2 * j}*eta0)" for j, b in enumerate(beta, 1)]])
    eta = " - ".join(["eta0", *[f"({b})*cos({2 * j}*xi0)*sinh({2 * j}*eta0)" for j, b in enumerate(beta, 1)]])
    steps = [f"{name}_n0 AS (SELECT *, tan(asin(sin(xi1)/cosh(eta1))) AS tc, tan(asin(sin(xi1)/cosh(eta1))) AS t0 FROM {name}_x)"]
    for i in range(4):
        sigma = f"sinh(e*atanh(e*t{i}/sqrt(1 + t{i}*t{i})))"
        now = f"(t{i}*sqrt(1 + {sigma}*{sigma}) - {sigma}*sqrt(1 + t{i}*t{i}))"
        steps.append(f"{name}_n{i + 1} AS (SELECT *, t{i} + (tc - {now})/sqrt(1 + {now}*{now})*(1 + (1 - e*e)*t{i}*t{i})/((1 - e*e)*sqrt(1 + t{i}*t{i})) AS t{i + 1} FROM {name}_n{i})")
    drop = "f, n, e, ra, xi0, eta0, xi1, eta1, tc, t0, t1, t2, t3, t4"
    return f"""{name}_c AS (SELECT *, 1/298.257223563::DOUBLE AS f FROM {source}),
 {name}_d AS (SELECT *, f/(2 - f) AS n, sqrt(f*(2 - f)) AS e FROM {name}_c),
 {name}_r AS (SELECT *, 0.9996::DOUBLE*6378137/(1 + n)*(1 + n*n/4 + pow(n,4)/64) AS ra FROM {name}_d),
 {name}_s AS (SELECT *, uy/ra AS xi0, (ux - 500000)/ra AS eta0 FROM {name}_r),
 {name}_x AS (SELECT *, {xi} AS xi1, {eta} AS eta1 FROM {name}_s),
 {", ".join(steps)},
 {name} AS (SELECT * EXCLUDE ({drop}), degrees(atan2(sinh(eta1), cos(xi1))) - 3 AS lon, degrees(atan(t4)) AS lat FROM {name}_n4)"""


def ols_sql(p: str, source: str, y: str, xs: Sequence[str]) -> str:
    """CTEs ``{p}_fit`` (one row: n, b0.., se0.., ssr, sst, inv, moments)."""
    k = len(xs)
    idx = range(k)
    cov = ", ".join(f"covar_pop({xs[i]}, {xs[j]}) AS s{i}_{j}" for i in idx for j in idx)
    base = f"""{p}_m AS (SELECT count(*)::DOUBLE AS n, avg({y}) AS my, var_pop({y}) AS syy, {", ".join(f"avg({x}) AS mx{i}, covar_pop({x}, {y}) AS t{i}" for i, x in enumerate(xs))}, {cov} FROM {source})"""
    steps = [base]
    keep = "n, my, syy, " + ", ".join(f"mx{i}, t{i}, s{i}_{i} AS d{i}" for i in idx)
    start = ", ".join(f"s{i}_{j} AS a{i}_{j}, {1.0 if i == j else 0.0}::DOUBLE AS v{i}_{j}" for i in idx for j in idx)
    steps.append(f"{p}_g0 AS (SELECT {keep}, {start} FROM {p}_m)")
    carried = "n, my, syy, " + ", ".join(f"mx{i}, t{i}, d{i}" for i in idx)
    for q in idx:
        cols = []
        for i in idx:
            for m in "av":
                for j in idx:
                    if i == q:
                        cols.append(f"{m}{q}_{j}/a{q}_{q} AS {m}{q}_{j}")
                    else:
                        cols.append(f"{m}{i}_{j} - a{i}_{q}*{m}{q}_{j}/a{q}_{q} AS {m}{i}_{j}")
        steps.append(f"{p}_g{q+1} AS (SELECT {carried}, {', '.join(cols)} FROM {p}_g{q})")
    slopes = ", ".join(f"{' + '.join(f'v{i}_{j}*t{j}' for j in idx)} AS b{i}" for i in idx)
    inv = ", ".join(f"v{i}_{j}" for i in idx for j in idx)
    steps.append(f"{p}_b AS (SELECT {carried}, {inv}, {slopes} FROM {p}_g{k})")
    fit = " + ".join(f"b{i}*t{i}" for i in idx)
    steps.append(f"{p}_c AS (SELECT *, n*(syy - ({fit})) AS ssr, n*syy AS sst, my - ({' + '.join(f'b{i}*mx{i}' for i in idx)}) AS c0, sqrt(syy*n/(n-1)) AS sdy FROM {p}_b)")
    se = ", ".join(f"sqrt(ssr/(n-{k+1})*v{i}_{i}/n) AS se{i}, b{i}*sqrt(d{i}*n/(n-1))/sdy AS z{i}, v{i}_{i}*d{i} AS vif{i}" for i in idx)
    quad = " + ".join(f"v{i}_{j}*mx{i}*mx{j}" for i in idx for j in idx)
    steps.append(f"{p}_fit AS (SELECT *, {se}, sqrt(ssr/(n-{k+1})*(1 + {quad})/n) AS sec, 1 - ssr/sst AS r2 FROM {p}_c)")
    return ",\n ".join(steps)
