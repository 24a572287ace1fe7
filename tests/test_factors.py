"""Triangular factors: methods of the generalised linear model, rank, likelihoods."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.operators import factors as X
from panelwright.operators import glm as M


def data(spark, gap, n=2000, parts=5):
    r = np.random.default_rng(1)
    x1 = r.normal(size=n)
    x2 = x1 + gap * r.normal(size=n)
    x3 = r.normal(size=n)
    y = 1 + 2 * x1 + 3 * x3 + 0.1 * r.normal(size=n)
    rows = [tuple(map(float, v)) for v in zip(x1, x2, x3, y, r.poisson(np.exp(0.3 * x1)), r.gamma(2, size=n) + 0.1, r.random(n) < 1 / (1 + np.exp(-x1)), r.integers(1, 5, n))]
    return np.column_stack([np.ones(n), x1, x2, x3]), y, spark.createDataFrame(rows, "x1 double, x2 double, x3 double, y double, p double, g double, b double, w double").repartition(parts)



def design(*names):
    return [F.lit(1.0), *[F.col(n) if isinstance(n, str) else n for n in names]]


@pytest.mark.parametrize("method", ["qr", "pivoted_qr", "svd"])
def test_condition_of_1e9_keeps_rank_and_coefficients(spark, method):
    x, y, df = data(spark, 1e-9)
    f = M.glm_fit(df, "y", design("x1", "x2", "x3"), M.family("gaussian"), method=method)
    want = np.linalg.lstsq(x, y, rcond=1e-15)[0]
    assert f.rank == 4 and f.coef == pytest.approx(want, rel=1e-5) and f.deviance == pytest.approx(np.square(y - x @ want).sum(), rel=1e-8)
    assert M.glm_fit(df, "y", design("x1", "x2", "x3"), M.family("gaussian"), method="gram").rank == 3  # squared condition


def test_deficient_designs(spark):
    _, _, df = data(spark, 1.0)
    xs = design("x1", 2 * F.col("x1"), "x3")
    pivoted, svd, gram = (M.glm_fit(df, "y", xs, M.family("gaussian"), method=m) for m in ("pivoted_qr", "svd", "gram"))
    assert {f.rank for f in (pivoted, svd, gram)} == {3} and pivoted.deviance == pytest.approx(svd.deviance) == pytest.approx(gram.deviance)
    assert pivoted.estimated.tolist() == [True, False, True, True] and pivoted.summary()[1][1:] == (None,) * 4
    assert svd.coef == pytest.approx(gram.coef, abs=1e-8) and svd.coef[2] == pytest.approx(2 * svd.coef[1])
    with pytest.raises(np.linalg.LinAlgError):
        M.glm_fit(df, "y", xs, M.family("gaussian"), method="qr")
    with pytest.raises(ValueError):
        M.glm_fit(df, "y", xs, M.family("gaussian"), method="cholesky")


@pytest.mark.parametrize("fam,y,link", [("poisson", "p", None), ("gamma", "g", "log"), ("binomial", "b", None), ("inverse_gaussian", "g", "log"), ("gaussian", "y", None)])
def test_methods_agree_and_likelihoods_are_densities(spark, fam, y, link):
    x, _, df = data(spark, 1.0)
    fits = [M.glm_fit(df, y, design("x1", "x3"), M.family(fam, link), "w", tol=1e-12, method=m) for m in M.METHODS]
    for f in fits[1:]:
        assert f.coef == pytest.approx(fits[0].coef, abs=1e-7) and f.se == pytest.approx(fits[0].se, rel=1e-6)
        assert (f.loglik, f.null_deviance, f.deviance) == pytest.approx((fits[0].loglik, fits[0].null_deviance, fits[0].deviance), rel=1e-8)
    rows = df.select(y, "w", "x1", "x3").collect()
    yy, w = np.array([r[0] for r in rows]), np.array([r.w for r in rows])
    eta = fits[0].coef @ np.array([[1, r.x1, r.x3] for r in rows]).T
    mu = M.family(fam, link).arrays.mean(eta)
    lg = np.vectorize(math.lgamma)
    if fam == "poisson":
        want = (w * (yy * np.log(mu) - mu - lg(yy + 1))).sum()
    elif fam == "binomial":
        want = (w * np.where(yy > 0, np.log(mu), np.log(1 - mu))).sum()
    elif fam == "gaussian":
        s = fits[0].deviance / len(yy)
        want = (-0.5 * np.log(2 * np.pi * s / w) - w * np.square(yy - mu) / (2 * s)).sum()
    elif fam == "gamma":
        a = w.sum() / fits[0].deviance
        want = (w * (a * np.log(a * yy / mu) - a * yy / mu - np.log(yy) - lg(np.full(len(yy), a)))).sum()
    else:
        s = fits[0].deviance / w.sum()
        want = (w * -0.5 * (np.log(2 * np.pi * s * yy**3) + np.square(yy - mu) / (yy * mu * mu * s))).sum()
    assert fits[0].loglik == pytest.approx(want, rel=1e-8)


def test_many_small_factors_are_stacked_in_groups(spark, monkeypatch):
    _, _, df = data(spark, 1.0, parts=12)
    xs = design("x1", "x3")
    one = M.glm_fit(df, "p", xs, M.family("poisson"), method="qr")
    monkeypatch.setattr(X, "STACKED", 2)
    other = M.glm_fit(df, "p", xs, M.family("poisson"), method="qr")
    assert other.coef == pytest.approx(one.coef, abs=1e-12) and other.n == one.n
    assert X.independent(X.column_factor(df, design("x1", 2 * F.col("x1"), "x3", F.col("x1") - F.col("x3")))) == [0, 1, 3]


def test_few_partitions_are_dealt_once(spark):
    _, _, df = data(spark, 1.0, n=9000, parts=1)
    blocks, filled = M._blocks(df.select(F.col("x1").alias("_x0"), F.col("y").alias("_y"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("_o")), 1)
    assert filled == 5 and blocks.agg(F.sum("n")).first()[0] == 9000


def test_pivoted_factor_of_random_matrices():
    r = np.random.default_rng(3)
    for k in (1, 3, 6):
        a = np.linalg.qr(r.normal(size=(20, k)), mode="r")
        t, q, order, rank = X.pivoted(a)
        assert rank == k and np.allclose(q @ t, a[:, order]) and np.allclose(q @ q.T, np.eye(k)) and (np.abs(np.diag(t))[:-1] >= np.abs(np.diag(t))[1:] - 1e-12).all()
    assert X.pivoted(np.zeros((3, 3)))[3] == 0


def test_tasks_get_few_blocks_at_a_time(spark, monkeypatch):
    from panelwright import session

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(bound, None)
    spark.conf.unset(bound)
    monkeypatch.setattr(session, "BATCH_BYTES", 1 << 17)
    try:
        d = spark.range(200_000, numPartitions=2).select(F.col("id").cast("double").alias("_x0"), F.lit(1.0).alias("_y"), F.lit(1.0).alias("_w"), F.lit(0.0).alias("_o"))
        blocks, _ = M._blocks(d, 1)
        sizes = blocks.mapInArrow(lambda bs: (pa.record_batch({"n": [sum(x.size for x in b.column(1).buffers() if x)]}) for b in bs), "n long").collect()
    finally:
        spark.conf.set(bound, old) if old else spark.conf.unset(bound)
    assert max(r.n for r in sizes) <= 4 << 17 and sum(r.n for r in sizes) >= 200_000 * 32
