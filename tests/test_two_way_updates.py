"""Imputation, wild bootstrap and leave-one-out on unbalanced panels, against dummy regressions and refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.scalars import MIX_MODULUS, draw31_numpy
from panelwright.operators import fe as X
from panelwright.operators import imputation as M
from panelwright.operators import influence as I
from panelwright.operators import wild as W


def make(spark, missing, units=18, periods=9, seed=5):
    """Rows (id, t, g, y, cluster) with missing cells, their frame, and the dummy matrix."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        g = [None, 5, 7, 6][i % 4]
        for t in range(1, periods + 1):
            if r.random() >= missing:
                rows.append((i, t, g, float(r.normal() + i * 0.1 + t * 0.2 + (1.0 if g and t >= g else 0.0)), i % 5))
    df = spark.createDataFrame(rows, "id long, t long, g long, y double, cl long").repartition(3)
    ids, ts = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    z = np.zeros((len(rows), len(ids) + len(ts)))
    for k, x in enumerate(rows):
        z[k, ids.index(x[0])] = z[k, len(ids) + ts.index(x[1])] = 1
    return rows, df.withColumn("x", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double")), z


def key_of(rows, cluster):
    return np.array([x[4] if cluster else x[0] for x in rows])


@pytest.mark.parametrize("cluster", [None, "cl"])
def test_imputation_error_carries_the_first_stage(spark, cluster):
    rows, df, z = make(spark, 0.25)
    y, g = np.array([x[3] for x in rows]), np.array([x[2] or 0 for x in rows])
    on = np.array([x[2] is not None and x[1] >= x[2] for x in rows])
    e, key = np.array([x[1] - x[2] if x[2] else -99 for x in rows]), key_of(rows, cluster)
    res = y - z @ (np.linalg.pinv(z[~on]) @ y[~on])
    got = {r.e: r for r in M.imputation_effects(df, "id", "t", "g", "y", cluster).collect()}
    assert set(got) == {None, *map(int, set(e[on]))}
    for ee, q in got.items():
        mask = on if ee is None else on & (e == ee)
        w = mask / mask.sum()
        v = np.where(on, w, 0.0)
        v[~on] = -(np.linalg.pinv(z[~on]).T @ (z[on].T @ w[on]))
        assert q.att == pytest.approx((v * y).sum(), abs=1e-9) and q.n_treated_rows == mask.sum()
        cell = np.array([res[on & (g == a) & (e == b)].mean() if o else 0.0 for a, b, o in zip(g, e, on)])
        for name, centre in (("se", q.att), ("se_cells", cell)):
            u = np.where(on, res - centre, res)
            assert q[name] == pytest.approx(np.sqrt(sum((v * u)[key == c].sum() ** 2 for c in set(key))), abs=1e-9)


def test_imputation_weights_give_the_effect(spark):
    rows, df, _ = make(spark, 0.25)
    w = {(r.unit, r.t): r.weight for r in M.imputation_weights(df, "id", "t", "g", "y").collect()}
    assert len(w) == len(rows)
    att = X.imputation_att(df, "id", "t", "g", "y").first().att
    assert sum(w[r[0], r[1]] * r[3] for r in rows) == pytest.approx(att, abs=1e-10)


def test_rows_without_an_imputed_outcome_are_left_out(spark):
    rows = [(1, 1, None, 1.0), (1, 2, None, 2.0), (2, 1, 2, 1.5), (2, 2, 2, 4.0), (3, 2, 2, 9.0), (2, 3, 2, 9.0), (4, 1, None, None)]
    df = spark.createDataFrame(rows, "id long, t long, g long, y double")
    r = M.imputation_effects(df, "id", "t", "g", "y").where("e is null").first()  # unit 3 has no untreated row, period 3 none either
    assert (r.att, r.n_treated_rows, r.units) == (pytest.approx(1.5), 1, 1)


@pytest.mark.parametrize("missing,cluster", [(0.0, None), (0.3, None), (0.3, "cl")])
def test_wild_bootstrap_equals_brute_force_with_the_same_signs(spark, missing, cluster):
    rows, df, z = make(spark, missing)
    y, x = np.array([r[3] for r in rows]), np.array([float(r[2] is not None and r[1] >= r[2]) for r in rows])
    key, m = key_of(rows, cluster), np.eye(len(rows)) - z @ np.linalg.pinv(z)
    xr, null = m @ x, m @ y

    def stat(v):
        v = m @ v
        b = xr @ v / (xr @ xr)
        e = v - xr * b
        return b, abs(b) / (np.sqrt(sum((xr * e)[key == c].sum() ** 2 for c in set(key))) / (xr @ xr))

    b, t = stat(y)
    draws = [stat(np.where(draw31_numpy(3, key, np.int64(k)) >= MIX_MODULUS // 2, 1.0, -1.0) * null)[1] for k in range(1, 200)]
    r = W.wild_cluster_bootstrap(df, "id", "t", "y", "x", 199, 3, cluster).first()
    assert (r.estimate, r.t_stat, r.p_value, r.draws) == pytest.approx((b, t, np.mean(np.array(draws) >= t * (1 - 1e-9)), 199))


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_static_influence_equals_refits(spark, missing):
    _, df, _ = make(spark, missing)
    loo = I.leave_one_out(df, "id", "t", "y", "x")
    got = {r.unit: r for r in loo.collect()}
    assert len(got) == 18
    for i in (0, 1, 6):
        f = X.static_effect(df.where(F.col("id") != i), "id", "t", "y", "x")
        assert (got[i].att_loo, got[i].se_loo) == pytest.approx((f.coef[0], f.se[0]), abs=1e-9)
    steps = I.cumulative_drop(df, "id", "t", "y", "x", loo, most=2)
    assert [s[0] for s in steps] == [0, 1, 2]
    for _k, names, att, se, units, n in steps:
        gone = [int(v) for v in names.split(",")] if names else []
        f = X.static_effect(df.where(~F.col("id").isin(gone)) if gone else df, "id", "t", "y", "x")
        assert (att, se, units, n) == pytest.approx((f.coef[0], f.se[0], f.n_units, f.n), abs=1e-9)


def test_patterns_as_entries_give_the_same_errors(spark):
    """With more patterns of periods than entries the patterns' matrices are features themselves."""
    _, df, _ = make(spark, 0.4, units=60, periods=5, seed=9)
    units, periods = X.fe_units(df, "id", "t", "y", dense=["x"])
    assert I._Features(units, np.array(periods)).patterns is None
    got = {r.unit: r for r in I.leave_one_out(df, "id", "t", "y", "x").collect()}
    for i in (1, 2):
        f = X.static_effect(df.where(F.col("id") != i), "id", "t", "y", "x")
        assert (got[i].att_loo, got[i].se_loo) == pytest.approx((f.coef[0], f.se[0]), abs=1e-9)


def test_unit_that_alone_identifies_the_effect(spark):
    rows = [(i, t, 3 if i == 0 else None, float(i + t + (2 if i == 0 and t >= 3 else 0))) for i in range(4) for t in range(1, 5)]
    df = spark.createDataFrame(rows, "id long, t long, g long, y double").withColumn("x", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double"))
    got = {r.unit: r.att_loo for r in I.leave_one_out(df, "id", "t", "y", "x").collect()}
    assert got[0] is None and got[1] == pytest.approx(2.0)


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_saturated_influence_equals_refits(spark, missing):
    _, df, _ = make(spark, missing)
    events = {r.unit: r for r in I.leave_one_out_saturated(df, "id", "t", "g", "y").collect()}
    rows = {r.unit: r for r in I.leave_one_out_saturated(df, "id", "t", "g", "y", average="rows").collect()}
    for i in (0, 1):
        d = df.where(F.col("id") != i)
        f = X.sun_abraham(d, "id", "t", "g", "y")
        assert events[i].att_loo == pytest.approx(np.mean([c for n, c in zip(f.names, f.coef) if n >= 0]), abs=1e-8)
        assert rows[i].att_loo == pytest.approx(X.sun_abraham(d, "id", "t", "g", "y", agg="att").coef[0], abs=1e-8)
    assert events[0].treated is False and events[1].treated is True


@pytest.mark.parametrize("missing,room", [(0.0, None), (0.3, None), (0.3, 2000)])
def test_lead_tests_equal_refits(spark, monkeypatch, missing, room):
    if room:
        monkeypatch.setattr(I, "BROADCAST_BYTES", room)  # several blocks of solutions
    _, df, _ = make(spark, missing)
    got = {r.dropped: r for r in I.loo_lead_test(df, "id", "t", "g", "y", -4, 4).collect()}
    assert set(got) == {i for i in range(18) if i % 4}
    for i in (1, 6):
        f = X.event_study(df.where(F.col("id") != i), "id", "t", "g", "y", -4, 4)
        w = f.wald(lambda e: e < -1)
        assert (got[i].f, got[i].df1, got[i].p) == pytest.approx((w["statistic"], w["df1"], w["p_value"]), rel=1e-8, abs=1e-12)
        assert got[i].att == pytest.approx(np.mean([c for n, c in zip(f.names, f.coef) if n >= 0]), abs=1e-9)


def test_units_are_left_out_side_by_side(spark):
    """One block for all units with as many rows, with the solutions that each unit has alone."""
    _, df, _ = make(spark, 0.3, units=40, periods=6)
    units, periods = X.fe_units(df, "id", "t", "y", dense=["x"])
    ax, without = np.array(periods), I._Without(X.normal_equations(units, periods, 1, 0))
    frame = units.toPandas()
    blocks = list(I.like_units([frame], ax, 1))
    assert len(blocks) == frame["t"].map(len).nunique() and sum(len(b[1]) for b in blocks) == len(frame)
    without.inv[2:, 2:] *= 30  # some units no longer pass the test for the short way
    ways = set()
    for _g, _k, _at, z, y in blocks:
        theta, first, rank, known = without.each(z, y)
        for n in range(len(z)):
            t, inv, r, ok = without.solve(z[n], y[n])
            assert np.allclose(theta[n], t, atol=1e-9) and np.allclose(first[n], inv[0], atol=1e-9) and (rank[n], known[n]) == (r, ok[0])
            ways.add(bool(np.linalg.eigvalsh(np.eye(len(y[n])) - z[n] @ without.inv @ z[n].T)[0] > 1e-8))
    assert ways == {True, False}
