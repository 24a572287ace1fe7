"""Multiplier, weighted and cluster bootstraps as distributed sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelwright.functions.distributions import qnorm
from panelwright.functions.scalars import MIX_MODULUS, col, draw31_numpy, uniform

# The two-point multiplier distribution with unit variance and third moment.
GOLDEN = 0.5 * (1 + 5 ** 0.5)
MAMMEN_LOW = 1 - GOLDEN
MAMMEN_HIGH = GOLDEN
MAMMEN_P_LOW = GOLDEN / 5 ** 0.5
IQR_NORMAL = qnorm(0.75) - qnorm(0.25)


def collapse_to_clusters(psi: DataFrame, cluster: str, param: str = "param") -> DataFrame:
    """Mean influence per cluster and parameter: bootstrap over clusters moves
    clusters x parameters rows instead of units x parameters. ``units`` names
    one row per unit of the cluster, so zeros left out of ``psi`` still count."""
    return psi.groupBy(cluster, param).agg((F.sum("psi") / F.max("cluster_units")).alias("psi")).withColumnRenamed(cluster, "unit")


def multiplier_draws(psi: DataFrame, draws: int, n, seed: int = 1, kind: str = "rademacher") -> DataFrame:
    """(param, b, value) with value = sqrt(n) x mean of multiplier times influence.

    Multipliers depend on unit and draw alone, so a lost task recomputes the
    same numbers. Each task multiplies its batch by all draws and emits one
    partial sum per parameter and draw; influence rows never move."""

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        b = np.arange(draws, dtype=np.int64)[None, :]
        for f in batches:
            for lo in range(0, len(f), 4096):
                g = f.iloc[lo:lo + 4096]
                u = draw31_numpy(seed, g["unit"].to_numpy()[:, None], b)
                if kind == "mammen":
                    v = np.where((u + 0.5) / MIX_MODULUS < MAMMEN_P_LOW, MAMMEN_LOW, MAMMEN_HIGH)
                else:
                    v = np.where(u >= MIX_MODULUS // 2, 1.0, -1.0)
                v = v * g["psi"].to_numpy()[:, None]
                codes, at = np.unique(g["param"].to_numpy(), return_inverse=True)
                acc = np.zeros((len(codes), draws))
                np.add.at(acc, at, v)
                for c, row in zip(codes, acc):
                    sums[c] = sums[c] + row if c in sums else row
        for c, row in sums.items():
            yield pd.DataFrame({"param": int(c), "b": np.arange(draws), "value": row})

    unit = F.xxhash64("unit") if isinstance(psi.schema["unit"].dataType, StringType) else col("unit").cast("bigint")
    rows = psi.select(unit.alias("unit"), F.col("param").cast("bigint").alias("param"), F.col("psi").cast("double").alias("psi"))
    summed = rows.mapInPandas(part, "param bigint, b int, value double").groupBy("param", "b").agg(F.sum("value").alias("value"))
    return summed.withColumn("value", F.col("value") / F.sqrt(F.lit(n).cast("double") if not hasattr(n, "cast") else n))


def draw_summary(draws: DataFrame, n, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Standard errors from the interquartile range and the simultaneous critical
    value, from the draws (draws x parameters rows)."""
    q = draws.groupBy("param").agg(*[F.expr(f"percentile_disc({p}) within group (order by value)").alias(a) for a, p in (("q1", 0.25), ("q3", 0.75))], F.sum(F.col("value") * F.col("value")).alias("ss"))
    sigma = q.where(F.col("ss") > 10 * np.sqrt(np.finfo(float).eps)).select("param", ((F.col("q3") - F.col("q1")) / IQR_NORMAL).alias("sigma"))
    nn = F.sqrt(F.lit(n).cast("double") if not hasattr(n, "cast") else n)
    se = sigma.select("param", (F.col("sigma") / nn).alias("se"))
    top = draws.join(sigma, "param").groupBy("b").agg(F.max(F.abs(F.col("value") / F.col("sigma"))).alias("t"))
    crit = top.agg(F.expr(f"percentile_disc({1 - alpha}) within group (order by t)").alias("crit"))
    return se, crit


def usable_critical_value(crit: float | None, alpha: float = 0.05) -> tuple[float, str]:
    """Critical value for bands: pointwise when the simultaneous one is unusable."""
    point = qnorm(1 - alpha / 2)
    if crit is None or not np.isfinite(crit):
        return point, "simultaneous critical value is missing; pointwise used"
    if crit < point:
        return point, "simultaneous critical value is below the pointwise one; pointwise used"
    if crit >= 7:
        return crit, "simultaneous critical value is very large"
    return crit, "ok"


def weighted_draws(df: DataFrame, method: str, unit: str, draws: int, y, d, xs=None, w=None, post=None, seed: int = 1) -> DataFrame:
    """Estimates under exponential weights, one refit per draw, all draws as the
    cells of one grouped estimation."""
    from panelwright.operators.did2x2 import estimate_cells

    e = df.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    v = -F.ln(uniform(seed, unit, "_b"))
    base = F.lit(1.0) if w is None else col(w)
    r = estimate_cells(e.withColumn("_bw", base * v), method, y, d, xs, "_bw", post, cell="_b", cache=False)
    return r.point.select(F.col("_cell").alias("b"), "att")


def weighted_summary(draws: DataFrame, att: float, alpha: float = 0.05) -> DataFrame:
    """Interquartile standard error and critical value of centred refits."""
    q = draws.agg(F.expr("percentile(att, 0.75)").alias("q3"), F.expr("percentile(att, 0.25)").alias("q1"), F.count("att").alias("draws"))
    s = q.select("draws", ((F.col("q3") - F.col("q1")) / IQR_NORMAL).alias("se"))
    return s.withColumn("crit", draws.agg(F.expr(f"percentile(abs(att - {att!r}), {1 - alpha})")).scalar() / F.col("se"))
