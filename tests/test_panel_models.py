"""Group-time effects, fixed effects, bootstraps and sweeps against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggte as G
from panelwright.operators import attgt as A
from panelwright.operators import bootstrap as B
from panelwright.operators import fe as X
from panelwright.operators import influence as I
from panelwright.operators import placebo as PL
from panelwright.operators import sweep as W


def panel(spark, missing=0.0, seed=2, units=24, periods=8, never=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        g = [None, 4, 6][i % 3] if never else [4, 6, 7][i % 3]
        for t in range(1, periods + 1):
            y = rng.normal() + 0.1 * i + 0.3 * t + (0.5 * (t - g + 1) if g and t >= g else 0)
            if rng.uniform() >= missing:
                rows.append((i, t, g, float(y), float(1 + i % 2), i % 4))
    return rows, spark.createDataFrame(rows, "id bigint, t bigint, g bigint, y double, w double, region bigint")


def dummies(rows, extra):
    ids, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    cols = [np.array([float(r[0] == i) for r in rows]) for i in ids] + [np.array([float(r[1] == t) for r in rows]) for t in ts[1:]]
    return np.column_stack([*extra, *cols])


def test_panel_without_never_treated(spark):
    """The last cohort (7) stands in for the never treated, and periods end before it."""
    rows, df = panel(spark, never=False)
    y = {(r[0], r[1]): r[3] for r in rows}
    mean = lambda t, pre, pick: np.mean([y[i, t] - y[i, pre] for i in range(24) if pick(i % 3)])
    est = {(r.g, r.t): r for r in A.att_gt(df, A.Design()).collect()}
    assert {g for g, _ in est} == {4, 6} and max(t for _, t in est) == 6
    for (g, t), r in est.items():
        assert r.att == pytest.approx(mean(t, r.pre, lambda k: k == {4: 0, 6: 1}[g]) - mean(t, r.pre, lambda k: k == 2), abs=1e-9)
    late = A.att_gt(df, A.Design(control_group="notyettreated")).where("g = 4 and t = 5").first()
    assert late.att == pytest.approx(mean(5, 3, lambda k: k == 0) - mean(5, 3, lambda k: k != 0), abs=1e-9)


@pytest.mark.parametrize("code", [0, 99, float("inf")])
def test_codes_of_never_treated(spark, code):
    _, df = panel(spark)
    want = [tuple(r) for r in A.att_gt(df, A.Design()).orderBy("cell").collect()]
    coded = df.withColumn("g", F.coalesce(F.col("g").cast("double"), F.lit(float(code))))
    assert [tuple(r) for r in A.att_gt(coded, A.Design()).orderBy("cell").collect()] == want
    fit = G.fit_panel(coded, A.Design())
    assert {k: v for k, v in fit.att.items()} == pytest.approx({(r[1], r[2]): r[7] for r in want if r[7] is not None})


def test_units_treated_in_the_first_period_leave(spark):
    _, df = panel(spark)
    early = df.withColumn("g", F.when(F.col("id") < 3, F.lit(1)).otherwise(F.col("g")))
    got = [(r.g, r.t, r.att) for r in A.att_gt(early, A.Design()).orderBy("g", "t").collect()]
    want = [(r.g, r.t, r.att) for r in A.att_gt(df.where("id >= 3"), A.Design()).orderBy("g", "t").collect()]
    assert got == want


def test_string_units_and_clusters(spark):
    _, df = panel(spark)
    named = df.withColumns({"id": F.concat(F.lit("u"), F.col("id")), "region": F.concat(F.lit("r"), F.col("region"))})
    a, b = (G.fit_panel(d, A.Design(cluster="region")) for d in (df, named))
    params = G.cell_params(a)
    for by in (False, True):
        assert G.influence_products(b, params, by_cluster=by) == pytest.approx(G.influence_products(a, params, by_cluster=by))
    assert B.multiplier_draws(G.influence_long(b, params), 10, b.shares["n"]).count() == 10 * len(params)


def test_missing_post_for_a_cohort_gives_null_and_reason(spark):
    _, df = panel(spark)
    cut = df.where("not (g = 6 and t >= 6)")
    est = A.att_gt_safe(cut, A.Design(mode="unbalanced"), "reg").where("g = 6 and is_post").collect()
    assert est and all(r.att is None and "n_treat_post=0" in r.reason for r in est)
    with pytest.raises(ValueError):
        A.att_gt_safe(cut, A.Design(mode="unbalanced"), "reg", on_missing="fail")


def test_covariate_and_plain_paths_agree_on_a_constant(spark):
    _, df = panel(spark)
    plain = {(r.g, r.t): (r.att, r.se) for r in A.att_gt(df, A.Design(weight="w")).collect()}
    cov = {(r.g, r.t): (r.att, r.se) for r in A.att_gt(df, A.Design(weight="w"), "reg", ["region"]).collect()}
    assert plain.keys() == cov.keys()
    rows, _ = panel(spark)
    y = {(r[0], r[1]): r[3] for r in rows}
    i = np.arange(24)
    dy = np.array([y[k, 5] - y[k, 3] for k in i])
    w, d, c = 1.0 + i % 2, (i % 3 == 1), (i % 3 == 0)
    Z = np.column_stack([np.ones(24), i % 4])
    beta = np.linalg.solve((Z[c] * w[c, None]).T @ Z[c], Z[c].T @ (w[c] * dy[c]))
    assert cov[4, 5][0] == pytest.approx(np.average(dy[d] - Z[d] @ beta, weights=w[d]), abs=1e-9)


def test_full_covariance_diagonal_equals_cell_errors(spark):
    _, df = panel(spark)
    fit = G.fit_panel(df, A.Design(weight="w"))
    params = G.cell_params(fit)
    v = G.influence_products(fit, params, full=True)
    se = {(r.g, r.t): r.se for r in A.att_gt(df, A.Design(weight="w")).collect()}
    for p, x in zip(params, np.diag(v)):
        assert np.sqrt(x) / 24 == pytest.approx(se[next(iter(p.weights))], abs=1e-10)
    units = G.influence_products(fit, params)
    assert np.allclose(units, np.diag(v))


def test_cluster_products_add_members_first(spark):
    _, df = panel(spark)
    fit = G.fit_panel(df, A.Design(cluster="region"))
    p = G.build_params("simple", fit.att, fit.shares["share"], 8)
    psi = G.influence_long(fit, p).groupBy("cluster").agg(F.sum("psi").alias("s")).collect()
    assert G.influence_products(fit, p, by_cluster=True)[0] == pytest.approx(sum(r.s**2 for r in psi))


def test_bootstrap_error_is_close_to_analytic(spark):
    _, df = panel(spark, units=60)
    fit = G.fit_panel(df, A.Design())
    p = G.build_params("simple", fit.att, fit.shares["share"], 8)
    se = float(np.sqrt(G.influence_products(fit, p)[0]) / 60)
    for kind in ("rademacher", "mammen"):
        boot, crit = B.draw_summary(B.multiplier_draws(G.influence_long(fit, p), 999, 60, seed=3, kind=kind), 60)
        assert boot.first().se == pytest.approx(se, rel=0.15)
        assert 1.7 < crit.first().crit < 2.3


def test_holm(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double")
    got = {r.i: r.p_holm for r in G.holm(d, "p").collect()}
    assert got == pytest.approx({1: 0.03, 3: 0.06, 2: 0.06})


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_two_way_fit_matches_dummy_regression(spark, missing):
    rows, df = panel(spark, missing)
    x = np.array([float(r[2] is not None and r[1] >= r[2]) for r in rows])
    Z, y = dummies(rows, [x]), np.array([r[3] for r in rows])
    b, *_ = np.linalg.lstsq(Z, y, rcond=None)
    d = df.withColumn("x", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double"))
    f = X.static_effect(d, "id", "t", "y", "x")
    assert f.coef[0] == pytest.approx(b[0], abs=1e-9)
    e = y - Z @ b
    inv = np.linalg.pinv(Z.T @ Z)
    ids = np.array([r[0] for r in rows])
    s = np.array([(Z[ids == i] * e[ids == i, None]).sum(0) @ inv[0] for i in sorted(set(ids))])
    n, g, t = len(y), len(set(ids)), len({r[1] for r in rows})
    assert f.se[0] == pytest.approx(np.sqrt((s**2).sum() * (n - 1) / (n - 1 - t) * g / (g - 1)), abs=1e-9)
    iid = X.static_effect(d, "id", "t", "y", "x", kind="iid")
    assert iid.se[0] == pytest.approx(np.sqrt((e @ e) / (n - np.linalg.matrix_rank(Z)) * inv[0, 0]), abs=1e-9)
    base = dummies(rows, [])
    resid = y - base @ np.linalg.lstsq(base, y, rcond=None)[0]
    got = {(r.id, r.t): r.resid for r in X.residualize(df, "id", "t", "y").collect()}
    assert all(got[r[0], r[1]] == pytest.approx(v, abs=1e-9) for r, v in zip(rows, resid))


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_event_study_and_saturated_event_study(spark, missing):
    rows, df = panel(spark, missing)
    ev = [r[1] - r[2] if r[2] else None for r in rows]
    y = np.array([r[3] for r in rows])
    levels = sorted({e for e in ev if e is not None and e != -1})
    b, *_ = np.linalg.lstsq(dummies(rows, [np.array([float(e == k) for e in ev]) for k in levels]), y, rcond=None)
    f = X.event_study(df, "id", "t", "g", "y", -20, 20)
    assert f.names == levels and np.allclose(f.coef, b[:len(levels)], atol=1e-8)
    pairs = sorted({(r[2], e) for r, e in zip(rows, ev) if e is not None and e != -1})
    b, *_ = np.linalg.lstsq(dummies(rows, [np.array([float((r[2], e) == k) for r, e in zip(rows, ev)]) for k in pairs]), y, rcond=None)
    n = {k: sum((r[2], e) == k for r, e in zip(rows, ev)) for k in pairs}
    want = [sum(n[k] * b[i] for i, k in enumerate(pairs) if k[1] == e) / sum(n[k] for k in pairs if k[1] == e) for e in sorted({k[1] for k in pairs})]
    s = X.sun_abraham(df, "id", "t", "g", "y")
    assert np.allclose(s.coef, want, atol=1e-8)


def test_leave_one_out_equals_refits(spark):
    _, df = panel(spark)
    d = df.withColumn("x", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double"))
    loo = {r.unit: r.att_loo for r in I.leave_one_out(d, "id", "t", "y", "x").collect()}
    for i in (0, 1, 5):
        assert loo[i] == pytest.approx(X.static_effect(d.where(F.col("id") != i), "id", "t", "y", "x").coef[0], abs=1e-9)


def test_imputation_equals_manual_prediction(spark):
    rows, df = panel(spark)
    keep = [r for r in rows if r[2] is None or r[1] < r[2]]
    Z, y = dummies(keep, []), np.array([r[3] for r in keep])
    b, *_ = np.linalg.lstsq(Z, y, rcond=None)
    ids = sorted({r[0] for r in keep})
    hat = lambda i, t: b[ids.index(i)] + (b[len(ids) + t - 2] if t > 1 else 0)
    want = np.mean([r[3] - hat(r[0], r[1]) for r in rows if r[2] and r[1] >= r[2]])
    assert X.imputation_att(df, "id", "t", "g", "y").first().att == pytest.approx(want, abs=1e-9)


# Published power curves and the effect reaching 80 percent on each.
ONLINE = [(0.25, 0.39285714285714285), (0.5, 0.42857142857142855), (0.75, 0.7272727272727273), (1.0, 0.6666666666666666), (1.25, 0.625), (1.5, 0.8620689655172413), (2.0, 0.8846153846153846)]
FIRST = [(0.25, 0.74), (0.5, 0.7346938775510204), (0.75, 0.82), (1.0, 0.88), (1.25, 0.88)]


def test_minimum_detectable_effect_reproduces_published_values(spark):
    rows = [("online", e, p) for e, p in ONLINE] + [("first", e, p) for e, p in FIRST]
    got = {r.k: r.mde for r in W.mde(spark.createDataFrame(rows, "k string, effect double, power double"), ["k"]).collect()}
    assert got == pytest.approx({"online": 1.4345454545454546, "first": 0.6913875598086127}, abs=1e-12)


def test_placebo_schedule_treats_the_asked_number(spark):
    s = PL.placebo_schedule(spark.range(30).withColumnRenamed("id", "unit"), [5, 6], 8, 12, 1)
    assert {r.n for r in s.groupBy("rep").agg(F.count("g_placebo").alias("n")).collect()} == {8}


def test_ar1_draws_have_the_asked_persistence(spark):
    u = spark.range(300).withColumnRenamed("id", "unit")
    d = W.draw_ar1(u, 5, list(range(1, 41)), 0.6, F.lit(2.0), 3)
    from pyspark.sql import Window

    z = d.withColumn("l", F.lag("draw").over(Window.partitionBy("rep", "unit").orderBy("t")))
    r = z.agg(F.corr("draw", "l").alias("r"), F.stddev_samp("draw").alias("s")).first()
    assert r.r == pytest.approx(0.6, abs=0.02) and r.s == pytest.approx(2.0, abs=0.05)
