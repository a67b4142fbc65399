"""Tail probabilities of the normal and t distributions for driver scalars."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def normal_upper(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation, from t with n - 2 degrees of freedom."""
    if n < 3 or r is None:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * sqrt((n - 2) / (1 - r * r)), n - 2)
