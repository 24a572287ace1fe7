"""Scalar semantics, distributions, quantiles."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import distributions as N
from panelwright.functions import scalars as S
from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators import panel as P


def test_month_parsing_accepts_every_layout(spark):
    texts = ["2018-06-15 10:00:00", "2018-06-15", "Jun-18", "Jun 2018", "Jan-99", "bad", None]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in d.select(S.parse_month("s")).collect()]
    j = dt.date(2018, 6, 1)
    assert got == [j, j, j, j, dt.date(1999, 1, 1), None, None]


@pytest.mark.parametrize("a,b,whole", [("2020-03-31", "2020-02-29", 1), ("2020-03-14", "2020-01-15", 1), ("2020-03-15", "2020-01-15", 2), ("2020-01-15", "2020-03-14", -1), ("2020-02-29", "2020-01-31", 0)])
def test_whole_months(spark, a, b, whole):
    d = spark.createDataFrame([(a, b)], "a string, b string").select(S.months_whole(F.col("a").cast("date"), F.col("b").cast("date")))
    assert d.first()[0] == whole


def test_null_semantics(spark):
    d = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None), (2, 4.0)], "k int, x double")
    r = {x.k: x for x in d.groupBy("k").agg(S.sum0("x").alias("s"), S.count_distinct_na("x").alias("d"), F.min("x").alias("m")).collect()}
    assert (r[1].s, r[1].d, r[1].m) == (0.0, 1, None)
    assert (r[2].s, r[2].d, r[2].m) == (7.0, 3, 3.0)


def test_half_to_even_and_near(spark):
    d = spark.range(1).select(F.bround(F.lit(2.5)).alias("a"), F.bround(F.lit(3.5)).alias("b"), S.near(F.lit(1.0), F.lit(1.0 + 1e-9)).alias("c"), S.near(F.lit(1.0), F.lit(1.0 + 1e-7)).alias("e")).first()
    assert (d.a, d.b, d.c, d.e) == (2, 4, True, False)


@pytest.mark.parametrize("got,want", [
    (N.pnorm(1.959963984540054), 0.975), (N.pt(2.228138851964939, 10), 0.975), (N.qt(0.975, 5), 2.570581835636314),
    (N.pchisq(3.841458820694124, 1), 0.95), (N.pchisq(18.307038053275146, 10), 0.95), (N.pf(4.964602743730711, 1, 10), 0.95), (N.qnorm(0.975), 1.959963984540054)])
def test_distribution_table_values(got, want):
    assert got == pytest.approx(want, abs=1e-9)


def test_portable_draws_agree_and_look_uniform(spark):
    ids = np.arange(400)
    mine = S.draw31_numpy(7, ids[:, None], np.arange(50)[None, :])
    got = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("b")).select("id", "b", S.draw31(7, "id", "b").alias("u")).toPandas()
    assert all(mine[i, b] == u for i, b, u in zip(got.id, got.b, got.u))
    u = mine / 2**31
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003
    signs = np.where(mine >= 2**30, 1.0, -1.0)
    corr = np.corrcoef(signs.T)
    off = corr[~np.eye(50, dtype=bool)]
    assert np.abs(off).max() < 0.25 and abs(off.mean()) < 0.01
    assert np.abs(np.corrcoef(signs)[np.triu_indices(400, 1)]).mean() < 0.16


@pytest.mark.parametrize("kind,method", [(7, "linear"), (1, "inverted_cdf")])
def test_quantiles_match_numpy_with_a_hot_group_and_ties(spark, kind, method):
    rng = np.random.default_rng(3)
    data = {0: rng.normal(size=60_001), 4: rng.normal(size=2003), 5: rng.exponential(size=20_001), 6: np.repeat([1.0, 2.0, 3.0], [9_000, 15_000, 6_000]), 1: np.repeat([1.0, 2.0, 2.0, 2.0, 9.0], 40), 2: np.array([5.0]), 3: rng.integers(0, 4, 999).astype(float)}
    import pandas as pd

    d = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in data.items()]))
    probs = {"a": 0.0, "b": 0.05, "c": 0.25, "t": 1 / 3, "m": 0.5, "d": 0.9, "z": 0.9999, "e": 1.0}
    for r in exact_quantiles(d, ["k"], "x", probs, kind).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.k], p, method=method), abs=1e-12), (r.k, name)


def test_dense_ids_rank_sorted_keys(spark):
    d = spark.createDataFrame([(f"k{i:03d}",) for i in range(150)] * 2, "k string")
    r = P.dense_ids(d, "k", "i").distinct().orderBy("k").collect()
    assert [x.i for x in r] == list(range(1, 151))


def test_first_source_wins_and_priority_union(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, v double")
    b = spark.createDataFrame([(2, 99.0), (3, 30.0)], "k int, v double")
    w = {r.k: (r.v, r.source) for r in P.first_source_wins([("a", a), ("b", b)], ["k"]).collect()}
    assert w == {1: (10.0, "a"), 2: (20.0, "a"), 3: (30.0, "b")}
    assert sorted((r.k, r.v) for r in P.priority_union(a, b, ["k"]).collect()) == [(1, 10.0), (2, 20.0), (3, 30.0)]


def test_standardize_without_never_treated(spark):
    rows = [(i, t, g) for i, g in ((1, 3), (2, 3), (3, 5), (4, 5)) for t in range(1, 7)]
    d = spark.createDataFrame(rows, "id int, t int, g int")
    out, log = P.standardize(d, "id", "t", "g")
    assert out.agg(F.max("t")).first()[0] == 4
    assert {r.g for r in out.select("g").distinct().collect()} == {3, None}
    assert [r.step for r in log.collect()][0] == "input"


def test_activity_thresholds(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 10.0), ("a", 3, 100.0), ("b", 1, 0.0)], "u string, t int, v double")
    r = {x.u: x for x in P.activity_dates(d, "u", "t", "v", [0.05, 0.5], [15]).collect()}
    assert (r["a"].at_5pct, r["a"].at_50pct, r["a"].at_total_15) == (1, 3, 2)
    assert (r["b"].at_5pct, r["b"].at_total_15) == (None, None)


def test_standardize_leaves_the_last_cohort_its_name_for_not_yet_treated(spark):
    rows = [(i, t, g) for i, g in ((1, 3), (2, 3), (3, 5), (4, 5)) for t in range(1, 7)]
    d = spark.createDataFrame(rows, "id int, t int, g int")
    out, _ = P.standardize(d, "id", "t", "g", control_group="notyettreated")
    assert out.agg(F.max("t")).first()[0] == 4 and {r.g for r in out.select("g").distinct().collect()} == {3, 5}


def test_tails_keep_their_digits(spark):
    assert N.pchisq_upper(200.0, 2) == pytest.approx(math.exp(-100), rel=1e-12)
    assert N.pf_upper(400.0, 1, 30) == pytest.approx(N.two_sided_t(20.0, 30), rel=1e-10) and 0 < N.pf_upper(1e6, 3, 40) < 1e-80
    assert N.pchisq_upper(3.84, 1) == pytest.approx(1 - N.pchisq(3.84, 1), rel=1e-12)
    from panelwright.functions.pvalues import p_chi2, p_f, p_t

    d = spark.createDataFrame([(2.0, 10.0, 3.0), (None, 5.0, 2.0), (1.0, 0.0, 1.0)], "x double, a double, b double")
    got = d.select(p_t("x", "a"), p_chi2("x", "a"), p_f("x", "a", "b")).collect()
    assert list(got[0]) == pytest.approx([N.two_sided_t(2, 10), N.pchisq_upper(2, 10), N.pf_upper(2, 10, 3)]) and list(got[1]) == list(got[2]) == [None] * 3


@pytest.mark.parametrize("sent", [3, 2])
def test_quantile_rows_are_not_dealt_by_group_alone(spark, monkeypatch, sent):
    """Three groups: brackets sent to the tasks, or copied so that a group's rows are spread; the same quantiles."""
    from pyspark.sql import functions as F

    from panelwright.functions import quantiles as Q

    monkeypatch.setattr(Q, "SENT_GROUPS", sent)
    d = spark.range(90_000, numPartitions=6).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 30_011).cast("double").alias("x"))
    data = d.toPandas()
    rows = Q._beside(d.withColumnRenamed("x", "_v"), spark.createDataFrame([(k, 0.0) for k in range(3)], "k long, _lo0 double"), ["k"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (sent == 3) and rows.count() == 90_000
    if sent < 3:
        assert "_s" in plan
    for r in Q.exact_quantiles(d, ["k"], "x", {"a": 0.05, "m": 0.5, "z": 0.95}).collect():
        assert (r.a, r.m, r.z) == pytest.approx(tuple(np.quantile(data.x[data.k == r.k], (0.05, 0.5, 0.95))))
