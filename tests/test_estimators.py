"""Estimators against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import did2x2 as E
from panelwright.operators import glm as M


def panel_fixture(n=70, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    d = (rng.uniform(size=n) < 1 / (1 + np.exp(-0.5 * x))).astype(float)
    dy = 0.3 * x + 0.7 * d + rng.normal(size=n)
    return x, d, dy, rng.uniform(0.5, 2.0, size=n), (rng.uniform(size=n) < 0.5).astype(float)


def logit(x, d, w):
    g = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ g))
        g = g + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (d - p)))
    return 1 / (1 + np.exp(-x @ g))


def wls(x, y, w):
    return np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * y))


@pytest.mark.parametrize("method", ["reg", "ipw", "sipw", "dr"])
def test_panel_estimates_match_numpy(spark, method):
    x, d, dy, w, _ = panel_fixture()
    X = np.column_stack([np.ones_like(x), x])
    m = X @ wls(X[d == 0], dy[d == 0], w[d == 0])
    p = logit(X, d, w)
    odds = w * p / (1 - p) * (1 - d)
    t = np.average(dy, weights=w * d)
    want = {"reg": t - np.average(m, weights=w * d), "ipw": t - (odds * dy).sum() / (w * d).sum(), "sipw": t - np.average(dy, weights=odds),
            "dr": np.average(dy - m, weights=w * d) - np.average(dy - m, weights=odds)}[method]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(dy, d, x, w)], "y double, d double, x double, w double")
    assert E.estimate_cells(df, method, "y", "d", ["x"], "w").rows()[0].att == pytest.approx(want, abs=1e-9)


# The doubly robust cross-section estimators leave out, as published, nuisance terms
# that vanish only in the limit; they are compared with closed forms in SQL and below.
CASES = [(m, False) for m in E.PANEL_METHODS] + [(m, True) for m in ("reg", "ipw", "sipw")]


@pytest.mark.parametrize("method,rc", CASES)
def test_influence_is_the_derivative_of_the_estimate(spark, method, rc):
    """Nudging one row's weight moves the estimate by its influence; all nudged
    samples are the cells of a single estimation."""
    n, eps = 40, 1e-4
    x, d, dy, w, post = panel_fixture(n)
    rows = [(c, i, float(dy[i]), float(d[i]), float(post[i]), float(x[i]), float(w[i] * (1 + (eps if c > 0 else -eps) * (abs(c) == i + 1))))
            for c in [0] + [k * s for k in range(1, n + 1) for s in (1, -1)] for i in range(n)]
    df = spark.createDataFrame(rows, "c int, i int, y double, d double, post double, x double, w double")
    kw = {"post": "post"} if rc else {}
    att = {r._cell: r.att for r in E.estimate_cells(df, method, "y", "d", ["x"], "w", cell="c", **kw).point.collect()}
    psi = {r.i: r.psi for r in E.estimate_cells(df.where("c = 0"), method, "y", "d", ["x"], "w", unit="i", **kw).influence.collect()}
    for i in range(n):
        num = n * (att[i + 1] - att[-(i + 1)]) / (2 * eps)
        if method == "ipw" and rc:
            # Two normalised shares in one denominator: the published influence takes
            # the weights' normalisation to mean one as given.
            num -= (w[i] / w.mean() - 1) * att[0]
        assert psi[i] == pytest.approx(num, abs=2e-5), (method, rc, i)


@pytest.mark.parametrize("method", ["dr", "dr1", "dr_imp", "dr_imp1"])
def test_cross_section_influence_tracks_the_derivative(spark, method):
    """Under stationarity the left-out terms are small, so with many rows the
    influence values follow the numerical derivative closely."""
    n, eps, some = 1500, 1e-3, range(0, 1500, 75)
    x, d, dy, w, post = panel_fixture(n)
    base = spark.createDataFrame([(i, float(dy[i]), float(d[i]), float(post[i]), float(x[i]), float(w[i])) for i in range(n)], "i int, y double, d double, post double, x double, w double")
    cells = F.explode(F.array(F.lit(0), *[F.lit(k + 1) for k in some]))
    df = base.withColumn("c", cells).withColumn("w", F.when(F.col("c") == F.col("i") + 1, F.col("w") * (1 + eps)).otherwise(F.col("w")))
    att = {r._cell: r.att for r in E.estimate_cells(df, method, "y", "d", ["x"], "w", post="post", cell="c").point.collect()}
    psi = {r.i: r.psi for r in E.estimate_cells(base, method, "y", "d", ["x"], "w", post="post", unit="i").influence.where(F.col("i").isin(list(some))).collect()}
    num = np.array([n * (att[i + 1] - att[0]) / eps for i in some])
    got = np.array([psi[i] for i in some])
    assert np.corrcoef(num, got)[0, 1] > 0.98


def test_estimators_agree_without_covariates(spark):
    _, d, dy, w, post = panel_fixture(200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(dy, d, post, w)], "y double, d double, post double, w double")
    for methods, kw in ((E.PANEL_METHODS, {}), ([m for m in E.RC_METHODS if m != "ipw"], {"post": "post"})):
        got = [E.estimate_cells(df, m, "y", "d", None, "w", **kw).rows()[0] for m in methods]
        for g in got[1:]:
            assert (g.att, g.se) == pytest.approx((got[0].att, got[0].se), abs=1e-8)


def test_failed_cells_do_not_fail_the_batch(spark):
    rows = [(0, 1.0, 1.0), (0, 2.0, 0.0), (0, 3.0, 1.0), (0, 1.0, 0.0), (1, 1.0, 1.0), (1, 2.0, 1.0)]
    r = {x._cell: x for x in E.estimate_cells(spark.createDataFrame(rows, "c int, y double, d double"), "reg", "y", "d", cell="c").rows()}
    assert r[0].att == pytest.approx(0.5) and r[1].att is None and "control" in r[1].reason


def test_separated_propensity_is_reported_not_raised(spark):
    rows = [(0, float(i), float(i > 4), float(i)) for i in range(10)] + [(1, float(i % 3), float(i % 2), float(i % 5)) for i in range(30)]
    r = {x._cell: x for x in E.estimate_cells(spark.createDataFrame(rows, "c int, y double, d double, x double"), "sipw", "y", "d", ["x"], cell="c").rows()}
    assert r[0].att is None and "propensity" in r[0].reason and r[1].att is not None


def test_wide_equals_long(spark):
    x, d, dy, w, _ = panel_fixture(80)
    wide = spark.createDataFrame([(i, 0.0, float(dy[i]), float(d[i]), float(x[i])) for i in range(80)], "id int, y0 double, y1 double, d double, x double")
    long = wide.select("id", "d", "x", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("t"), F.col("y1").alias("y")))).alias("o")).select("id", "d", "x", "o.*")
    a = E.did_2x2(wide, "dr", y1="y1", y0="y0", xs=["x"]).first()
    b = E.did_long(long, "dr", "y", "t", "d", unit="id", xs=["x"]).first()
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)


@pytest.mark.parametrize("fam,link,y", [("binomial", "logit", "d"), ("binomial", "cloglog", "d"), ("poisson", "log", "k"), ("poisson", "sqrt", "k"), ("gamma", "log", "z"), ("gamma", "inverse", "z"), ("gaussian", "identity", "z"), ("inverse_gaussian", "log", "z")])
def test_glm_solves_its_score_equations(spark, fam, link, y):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 300)
    cols = {"d": (rng.uniform(size=300) < 0.4).astype(float), "k": rng.poisson(2 + x).astype(float), "z": rng.gamma(3, 1, 300) + 0.5}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, cols[y])], "x double, y double")
    fit = M.glm_fit(df, "y", [F.lit(1.0), F.col("x")], M.family(fam, link), tol=1e-13)
    assert fit.converged
    b = fit.coef
    eta = b[0] + b[1] * x
    mu, slope = {"logit": (1 / (1 + np.exp(-eta)), None), "cloglog": (1 - np.exp(-np.exp(eta)), np.exp(eta - np.exp(eta))), "log": (np.exp(eta), np.exp(eta)), "sqrt": (eta**2, 2 * eta), "inverse": (1 / eta, -1 / eta**2), "identity": (eta, np.ones(300))}[link]
    slope = mu * (1 - mu) if slope is None else slope
    var = {"binomial": mu * (1 - mu), "poisson": mu, "gamma": mu**2, "gaussian": np.ones(300), "inverse_gaussian": mu**3}[fam]
    s = (cols[y] - mu) * slope / var
    assert abs(s.sum()) < 1e-5 and abs((s * x).sum()) < 1e-5


def test_wide_design_equals_narrow_solution(spark):
    rng = np.random.default_rng(2)
    X = np.column_stack([np.ones(400), rng.normal(size=(400, 29))])
    y = X @ rng.normal(size=30) + rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, [*r, v])) for r, v in zip(X, y)], ", ".join(f"x{i} double" for i in range(30)) + ", y double")
    fit = M.glm_fit(df, "y", [f"x{i}" for i in range(30)], M.family("gaussian"))
    assert np.allclose(fit.coef, np.linalg.lstsq(X, y, rcond=None)[0], atol=1e-8)


def test_rank_deficient_design_reports_its_rank(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i * i % 7)) for i in range(40)], "a double, b double, y double")
    assert M.glm_fit(df, "y", [F.lit(1.0), F.col("a"), F.col("b")], M.family("gaussian")).rank == 2
