"""Query registry and the SQL fragments the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.functions.scalars import round_even

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name, with its SQL check."""

    def add(fn):
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


# Moves exact decimal ties off the rounding edge, in both engines alike.
NUDGE = 0.0017


def rounded(df: DataFrame, digits: int = 6, **others: int) -> DataFrame:
    """Round every double column, so that summation order cannot show; ``others`` names columns with other digits."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (round_even(F.col(f"`{c}`") + F.lit(NUDGE * 10.0 ** -others.get(c, digits)), others.get(c, digits)) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`")).alias(c)
        for c, t in kinds.items()
    ])


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    scale = f"1e{digits}"
    nudge = NUDGE * 10.0**-digits
    return f"(round_even((({expr}) + {nudge!r}::DOUBLE) * {scale}, 0) / {scale} + 0.0)"


def re(expr: str, digits: int) -> str:
    """Plain half-even rounding in SQL, the operators' own rounding."""
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0)"
