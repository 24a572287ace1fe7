"""Placebo treatments, threshold ladders and residual pools against refits and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.scalars import draw31_numpy
from panelwright.operators import fe as X
from panelwright.operators import placebo as P
from panelwright.operators import sweep as W
from tests.test_two_way_updates import make


@pytest.mark.parametrize("kind,missing", [("units", 0.0), ("units", 0.3), ("dates", 0.3)])
def test_fits_equal_refits(spark, kind, missing):
    rows, df, _ = make(spark, missing)
    got = {r.rep: r for r in P.placebo_fits(df, "id", "t", "g", "y", kind, 12, 50).collect()}
    units = sorted({r[0] for r in rows})
    own = {r[0]: r[2] for r in rows}
    cohorts, k = sorted({g for g in own.values() if g}), sum(g is not None for g in own.values())
    lo, hi = min(r[1] for r in rows), max(r[1] for r in rows)
    for rep in (1, 2, 7):
        u = {i: int(draw31_numpy(50, np.int64(rep), np.int64(i))) for i in units}
        if kind == "units":
            start = {i: cohorts[int(draw31_numpy(51, np.int64(rep), np.int64(i))) % len(cohorts)] for i in sorted(units, key=lambda i: (u[i], i))[:k]}
        else:
            valid = {i: [own[i] + m for m in range(-6, 7) if lo < own[i] + m <= hi] for i in units if own[i]}
            start = {i: v[u[i] % len(v)] for i, v in valid.items() if v}
        sched = spark.createDataFrame(list(start.items()), "id long, gp long")
        d = df.drop("x").join(sched, "id", "left").withColumn("x", F.coalesce(F.col("t") >= F.col("gp"), F.lit(False)).cast("double"))
        f = X.static_effect(d, "id", "t", "y", "x")
        assert (got[rep].att, got[rep].se, got[rep].p) == pytest.approx((f.coef[0], f.se[0], f.rows()[0][4]), abs=1e-9)
    share = P.rejection_share(P.placebo_fits(df, "id", "t", "g", "y", kind, 12, 50)).first()
    assert share.replicates == share.estimated == 12 and share.rejected == pytest.approx(np.mean([r.rejected for r in got.values()]))


@pytest.mark.parametrize("bins,limit", [(2048, 2000), (4, 1), (16, 3)])
def test_exact_choice_of_k_units(spark, monkeypatch, bins, limit):
    """However often the bins are refined."""
    monkeypatch.setattr(P, "BINS", bins)
    monkeypatch.setattr(P, "BIN", limit)
    u = spark.range(700).withColumnRenamed("id", "unit").repartition(5)
    got = P.placebo_schedule(u, [5, 6], 123, 4, 9).where("g_placebo is not null").groupBy("rep").agg(F.collect_set("unit").alias("u")).collect()
    for r in got:
        h = draw31_numpy(9, np.int64(r.rep), np.arange(700))
        assert set(r.u) == set(sorted(range(700), key=lambda i: (h[i], i))[:123])
    assert len(got) == 4


def test_many_units_in_bounded_memory(spark):
    """200,000 units of 20 periods and 200 replicates: only sums per (replicate, period) move."""
    df = spark.range(200_000).select("id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("t"))
    df = df.select("id", F.col("t").cast("bigint").alias("t"), F.when(F.col("id") % 4 != 0, 8 + 3 * (F.col("id") % 4)).alias("g"), F.sin(F.col("id") * 7.3 + F.col("t") * F.col("id") % 11).alias("y"))
    fits = P.placebo_fits(df.repartition(16, "id"), "id", "t", "g", "y", "units", 200, 3).collect()
    assert len(fits) == 200 and all(r.se > 0 for r in fits) and 0.0 <= np.mean([r.rejected for r in fits]) < 0.2


def test_panel_without_treated_units(spark):
    df = spark.createDataFrame([(i, t, None, float(i * t)) for i in range(4) for t in range(1, 5)], "id long, t long, g long, y double")
    assert {r.att for r in P.placebo_fits(df, "id", "t", "g", "y", "dates", 3, 1).collect()} == {None}


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_ladder_equals_fits_of_every_sample(spark, missing):
    _, df, _ = make(spark, missing)
    df = df.withColumn("level", (F.col("id") % 7).cast("double"))
    got = P.threshold_ladder(df, "id", "t", "y", "x", "level", [0, 1, 3, 5, 50]).collect()
    assert [(r.threshold, r.att is None) for r in got] == [(0, False), (1, False), (3, False), (5, False), (50, True)]
    for r in got[:4]:
        f = X.static_effect(df.where(F.col("level") >= r.threshold), "id", "t", "y", "x")
        assert (r.att, r.se, r.units, r.n) == pytest.approx((f.coef[0], f.se[0], f.n_units, f.n), abs=1e-9)


def test_pools_are_numbered_rows(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), int(t), float(r.normal())) for t in range(1, 9) for i in range(40 if t % 4 else 1)] + [(99, 3, None)]
    d = spark.createDataFrame(rows, "id long, t long, r double").repartition(6)
    pool, keys = W.residual_pools(d, "t", "r", "id", min_units=2)
    got = {(x.pool, x.i): x.r for x in pool.collect()}
    full = [x for x in rows if x[2] is not None]
    for k in keys.collect():
        want = [x[2] for x in sorted(full, key=lambda x: (x[1], x[0])) if k.pool is None or x[1] == k.t]
        assert k.size == len(want) and [got[k.pool, i] for i in range(k.size)] == want
    assert {k.t for k in keys.collect() if k.pool is None} == {4, 8}
