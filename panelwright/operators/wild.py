"""Wild cluster bootstrap of a static two-way effect, on any panel.

With outcome and regressor residualised on unit and period effects, a draw flips
the null residuals of whole clusters. What a cluster contributes to a draw depends
on two inner products and two vectors over the periods, so units are read twice in
all: signs of a block of clusters are one matrix, multiplied with these vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import MIX_MODULUS, draw31_numpy
from panelwright.operators.fe import _blocks, fe_units, sum_arrays
from panelwright.session import keep

#: Clusters whose signs a task holds at once.
BLOCK = 512


def wild_cluster_bootstrap(df: DataFrame, unit: str, time: str, y: str, x: str, draws: int = 999, seed: int = 1, cluster: str | None = None) -> DataFrame:
    """estimate, t_stat, p_value (share of draws with a t at least as large in size), draws; null imposed, signs by ``cluster``
    (default: unit). Whole-number clusters draw by their value, others by a hash."""
    spark = df.sparkSession
    units, periods = fe_units(df, unit, time, y, dense=[x], cluster=cluster)
    ax, n = np.array(periods), len(periods)

    def gram(batches):
        a = np.zeros((n, n + 1))
        for z, yy, *_ in _blocks(batches, ax, 1, 0):
            d = z[:, 1:]
            a[1:, 1:n] += d.T @ d
            a[1:, 0] += d.T @ yy
            a[1:, n] += d.T @ z[:, 0]
        yield pd.DataFrame({"k": np.arange(n), "v": list(a)})

    a = np.zeros((n, n + 1))
    for r in sum_arrays(units.mapInPandas(gram, "k int, v array<double>"), "k").collect():
        a[r.k] = r.v
    inv = np.linalg.pinv(a[1:, 1:n], rcond=1e-11, hermitian=True)
    on_y, on_x = inv @ a[1:, 0], inv @ a[1:, n]

    def vectors(batches):
        """Per cluster: <x, y>, <x, x>, x and y per period, all residualised."""
        for z, yy, u, g, t in _blocks(batches, ax, 1, 0):
            xr, yr = z[:, 0] - z[:, 1:] @ on_x, yy - z[:, 1:] @ on_y
            v = np.zeros((len(g), 2 + 2 * n))
            np.add.at(v, (u, 0), xr * yr)
            np.add.at(v, (u, 1), xr * xr)
            np.add.at(v, (u, 2 + t), xr)
            np.add.at(v, (u, 2 + n + t), yr)
            by = pd.DataFrame(v).groupby(g["cluster"].to_numpy()).sum()
            yield pd.DataFrame({"key": by.index, "v": list(by.to_numpy())})

    kind = dict(units.dtypes)["cluster"]
    per = units.mapInPandas(vectors, f"key {kind}, v array<double>")
    if cluster is not None:
        per = sum_arrays(per, "key")
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    per = keep(per.select((F.col("key").cast("bigint") if whole else F.xxhash64("key")).alias("key"), "v"))

    def blocks(batches):
        for f in batches:
            for at in range(0, len(f), BLOCK):
                g = f.iloc[at : at + BLOCK]
                s = np.where(draw31_numpy(seed, np.mod(g["key"].to_numpy(), MIX_MODULUS)[:, None], np.arange(1, draws + 1)[None, :]) >= MIX_MODULUS // 2, 1.0, -1.0)
                yield np.vstack(g["v"].to_numpy()), s

    def first(batches):
        """Sums over clusters of sign x <x, y>, of sign x residual per period; then the plain totals."""
        total = np.zeros((draws + 1, n + 2))
        for v, s in blocks(batches):
            total[1:, 0] += s.T @ v[:, 0]
            total[1:, 2:] += s.T @ v[:, 2 + n :]
            total[0, :2] += v[:, :2].sum(axis=0)
        yield pd.DataFrame({"b": np.arange(draws + 1), "v": list(total)})

    total = np.zeros((draws + 1, n + 2))
    for r in sum_arrays(per.mapInPandas(first, "b int, v array<double>"), "b").collect():
        total[r.b] = r.v
    xy, xx = total[0, :2]
    betas = np.append(xy, total[1:, 0]) / xx
    # period effects of the flipped residuals; their unit means are zero already
    gamma = np.hstack([np.zeros((draws, 1)), total[1:, 3:] @ inv])

    def second(batches):
        """Sums of squared cluster scores: of the data, then of every draw."""
        out = np.zeros(draws + 1)
        for v, s in blocks(batches):
            out[0] += np.square(v[:, 0] - betas[0] * v[:, 1]).sum()
            score = s * v[:, :1] - v[:, 2 : 2 + n] @ gamma.T - v[:, 1:2] * betas[None, 1:]
            out[1:] += np.square(score).sum(axis=0)
        yield pd.DataFrame({"k": [0], "v": [out]})

    squares = np.array(sum_arrays(per.mapInPandas(second, "k int, v array<double>"), "k").first().v)
    # a draw that flips all clusters or none has the t of the data, up to rounding
    t = np.abs(betas) / (np.sqrt(squares) / xx)
    units.unpersist()
    return spark.createDataFrame([(float(betas[0]), float(t[0]), float(np.mean(t[1:] >= t[0] * (1 - 1e-10))), draws)], "estimate DOUBLE, t_stat DOUBLE, p_value DOUBLE, draws BIGINT")
