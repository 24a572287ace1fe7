"""p-values as columns: t, chi-square and F tails in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelwright.functions import distributions as D
from panelwright.functions.scalars import col


def _tail(fn: Callable[..., float]) -> Callable[..., Column]:
    """A pandas UDF of a tail function; null or undefined arguments give null."""

    def one(*xs) -> float | None:
        if any(x is None or math.isnan(x) for x in xs) or any(d <= 0 for d in xs[1:]):
            return None
        return fn(*xs)

    if fn is D.pf_upper:

        @F.pandas_udf(DoubleType())
        def three(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(*v) for v in zip(x, a, b)], dtype="float64")

        return lambda x, a, b: three(*[col(c).cast("double") for c in (x, a, b)])

    @F.pandas_udf(DoubleType())
    def two(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([one(*v) for v in zip(x, a)], dtype="float64")

    return lambda x, a: two(*[col(c).cast("double") for c in (x, a)])


p_t = _tail(D.two_sided_t)
p_chi2 = _tail(D.pchisq_upper)
p_f = _tail(D.pf_upper)


def p_t_sql(t: str, df: str) -> str:
    """Two-sided t tail for whole degrees of freedom as a finite trigonometric sum."""
    th, c = f"atan(abs({t})/sqrt({df}))", f"cos(atan(abs({t})/sqrt({df})))"
    even = f"sin({th}) * list_sum(list_transform(range(0, ({df})::BIGINT // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow({c}, 2 * j)))"
    odd = f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, (({df})::BIGINT - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow({c}, 2 * j + 1))), 0))"
    return f"(CASE WHEN {df} > 0 THEN 1 - CASE WHEN ({df})::BIGINT % 2 = 0 THEN {even} ELSE {odd} END END)"
