"""Grouped weighted moments: the aggregate nearly every estimator is made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import col


def gram(df: DataFrame, keys: list[str], xs: list, y, w=None) -> DataFrame:
    """Per group: n, sw, upper-triangle X'WX, X'Wy and y'Wy, in one aggregate.

    All sums are built-in aggregates, so partial sums combine before the
    shuffle and only one row per group and task moves."""
    xs = [col(x) for x in xs]
    y, w = col(y), F.lit(1.0) if w is None else col(w)
    k = len(xs)
    xtx = F.array(*[F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)])
    xty = F.array(*[F.sum(w * x * y) for x in xs])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), xtx.alias("xtx"), xty.alias("xty"), F.sum(w * y * y).alias("yty"))


def unpack(upper, k: int) -> np.ndarray:
    """Square symmetric matrix from its upper triangle."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = np.asarray(upper, dtype=float)
    return m + np.triu(m, 1).T


def solve_spd(a: np.ndarray, b: np.ndarray, what: str) -> np.ndarray:
    """Solve small normal equations; a singular design is an error."""
    if a.size == 0 or not np.all(np.isfinite(a)) or np.linalg.cond(a) > 1.0 / np.finfo(float).eps:
        raise ValueError(f"the {what} design matrix is singular; consider removing some covariates")
    return np.linalg.solve(a, b)


def means(df: DataFrame, exprs: dict[str, Column]) -> dict[str, float]:
    """Averages of expressions as one aggregate row."""
    return df.agg(*[F.avg(e).alias(n) for n, e in exprs.items()]).first().asDict()
