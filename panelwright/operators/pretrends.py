"""Pre-trend diagnostics, specifications, coverage and comparison summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import pnorm, qnorm, two_sided_t
from panelwright.functions.scalars import rnd
from panelwright.operators.summaries import mean_se_ci

HORIZONS = (-3, -6, -9, -12, -18, -24, -30, -36, -48, -60)


def spec_panel(df: DataFrame, spec: dict, time: str = "t", cohort: str = "g") -> DataFrame:
    """Panel under a named specification: windows are predicates, cohorts that
    fall outside the allowed adoption years or dates become untreated."""
    d = df
    if spec.get("treatment"):
        d = d.withColumn(cohort, F.col(spec["treatment"]))
    if spec.get("adoption_years"):
        year = F.floor((F.col(cohort) - 1) / 12)
        d = d.withColumn(cohort, F.when(year.isin(*spec["adoption_years"]), F.col(cohort)))
    if spec.get("drop"):
        a, b = spec["drop"]
        d = d.where(~F.col(time).between(a, b))
    if spec.get("window"):
        a, b = spec["window"]
        d = d.where(F.col(time).between(a, b))
    e = F.col(time) - F.col(cohort)
    if spec.get("event_window"):
        a, b = spec["event_window"]
        d = d.where(e.isNull() | e.between(a, b))
    return d.withColumn("e", e)


def equivalence_bound(rows: DataFrame, alpha: float = 0.05, estimate: str = "estimate", se: str = "se") -> DataFrame:
    """Smallest bound at which every coefficient is inside: each one-sided test
    rejects from |b| + z s on, so the bound is the largest of these."""
    z = qnorm(1 - alpha)
    return rows.where(f"{se} is not null").agg(F.max(F.abs(F.col(estimate)) + z * F.col(se)).alias("delta_star"))


def equivalence_max(rows: DataFrame, grid: list[float], alpha: float = 0.05, estimate: str = "estimate", se: str = "se") -> DataFrame:
    """Largest one-sided p over the coefficients for each bound of ``grid``."""
    r = rows.where(f"{se} is not null").select(estimate, se).collect()
    out = [(float(d), float(max(pnorm((abs(x[0]) - d) / x[1]) for x in r))) for d in grid]
    t = rows.sparkSession.createDataFrame(out, "delta DOUBLE, p_value DOUBLE")
    return t.withColumn("equivalent", F.col("p_value") < alpha)


def equivalence_average(beta: np.ndarray, sigma: np.ndarray, delta: float) -> dict:
    """Test that the mean coefficient is inside the bound, with the full covariance."""
    avg = float(np.mean(beta))
    se = float(np.sqrt(np.ones(len(beta)) @ sigma @ np.ones(len(beta)))) / len(beta)
    return {"mean": avg, "se": se, "p_value": pnorm((abs(avg) - delta) / se)}


def assessment(f_p: Column, mde: Column, delta: Column) -> Column:
    """Traffic light of one specification."""
    return (F.when(f_p.isNull(), "Unknown").when((f_p > 0.10) & (mde < 0.10) & (delta < 0.10), "GREEN")
            .when((f_p > 0.05) & (mde < 0.15) & (delta < 0.15), "YELLOW").otherwise("RED"))


def compare_pre_post(coefs: DataFrame) -> DataFrame:
    """One-row comparison of leads and lags: sizes, slopes, phases, extrapolation.

    Input rows are (e, estimate); everything is a conditional aggregate except
    the fitted line, which is joined back as constants."""
    pre, post = F.col("e") < 0, F.col("e") >= 0
    b = F.col("estimate")
    on = lambda cond, x: F.when(cond, x)
    c = coefs.withColumns({"pe": on(pre, F.col("e").cast("double")), "pb": on(pre, b), "qe": on(post, F.col("e").cast("double")), "qb": on(post, b)})
    a = c.agg(
        F.max(F.abs("pb")).alias("pre_max"), F.avg(F.abs("pb")).alias("pre_mean_abs"), F.sqrt(F.avg(F.col("pb") * F.col("pb"))).alias("pre_rms"), F.stddev_samp("pb").alias("pre_sd"),
        F.regr_slope("pb", "pe").alias("pre_slope"), F.regr_intercept("pb", "pe").alias("pre_intercept"), F.regr_r2("pb", "pe").alias("pre_r2"),
        F.avg("qb").alias("post_mean"), F.max(F.abs("qb")).alias("post_max"), F.avg(F.abs("qb")).alias("post_mean_abs"), F.sqrt(F.avg(F.col("qb") * F.col("qb"))).alias("post_rms"), F.regr_slope("qb", "qe").alias("post_slope"),
        F.avg(on(F.col("e").between(0, 6), b)).alias("early"), F.avg(on(F.col("e").between(7, 12), b)).alias("mid"), F.avg(on(F.col("e") > 12, b)).alias("late"),
        # the extrapolated line is linear in e, so its correlation with the lags is that of e up to sign
        F.corr("qb", "qe").alias("_r"))
    return a.withColumns({"ratio_mean": F.col("post_mean_abs") / F.col("pre_max"), "ratio_max": F.col("post_max") / F.col("pre_max"), "ratio_rms": F.col("post_rms") / F.col("pre_rms"),
                          "slope_ratio": F.abs(F.col("post_slope") / F.col("pre_slope")), "extrapolation_corr": F.signum("pre_slope") * F.col("_r")}).drop("_r")


def quadratic_trend(coefs: DataFrame) -> DataFrame:
    """Quadratic fit of the leads from one aggregate of power sums."""
    from panelwright.operators.moments import gram, solve_spd, unpack

    d = coefs.where("e < 0").withColumn("x", F.col("e").cast("double"))
    g = gram(d, [], [F.lit(1.0), F.col("x"), F.col("x") * F.col("x")], F.col("estimate")).first()
    a = unpack(g.xtx, 3)
    beta = solve_spd(a, np.array(g.xty), "quadratic trend")
    rss = g.yty - beta @ np.array(g.xty)
    se = float(np.sqrt(rss / (g.n - 3) * np.linalg.inv(a)[2, 2]))
    return coefs.sparkSession.createDataFrame([(float(beta[2]), se, float(two_sided_t(beta[2] / se, g.n - 3)))], "quadratic DOUBLE, se DOUBLE, p_value DOUBLE")


def split_half(coefs: DataFrame) -> DataFrame:
    """Mean of the earlier and later half of the leads and their difference."""
    cut = coefs.where("e < 0").agg((F.min("e") + F.max("e")) / 2).scalar()
    d = coefs.where("e < 0").withColumn("late", F.col("e") > cut)
    return d.agg(F.avg(F.when(~F.col("late"), F.col("estimate"))).alias("early_half"), F.avg(F.when(F.col("late"), F.col("estimate"))).alias("late_half")).withColumn("difference", F.col("late_half") - F.col("early_half"))


def breakdown(rows: DataFrame) -> DataFrame:
    """Widths relative to M = 0 and the first M whose interval holds zero."""
    w0 = rows.where("m = 0").agg(F.max(F.col("ub") - F.col("lb"))).scalar()
    out = (F.col("lb") > 0) | (F.col("ub") < 0)
    first = rows.where(~out).agg(F.min("m")).scalar()
    return rows.withColumns({"width": F.col("ub") - F.col("lb"), "excludes_zero": out}).withColumn("width_rel", F.col("width") / w0).withColumn("breakdown_m", first)


def coverage_by_horizon(df: DataFrame, unit: str = "id", time: str = "t", cohort: str = "g") -> DataFrame:
    """Treated units observed at each lead: one distinct pass, then a short list."""
    hs = F.expr("array(" + ", ".join(str(h) for h in HORIZONS) + ")")
    d = df.where(F.col(cohort).isNotNull()).select(unit, (F.col(time) - F.col(cohort)).alias("e"))
    total = d.agg(F.count_distinct(unit)).scalar()
    hit = d.where(F.col("e").isin(*HORIZONS)).groupBy("e").agg(F.count_distinct(unit).alias("units"))
    base = df.sparkSession.range(1).select(F.explode(hs).alias("h")).select(F.col("h").cast("bigint").alias("e"))
    return base.join(hit, "e", "left").select("e", F.coalesce("units", F.lit(0)).alias("units")).withColumn("pct", 100.0 * F.col("units") / total)


def coverage_by_unit(df: DataFrame, unit: str = "id", time: str = "t", cohort: str = "g") -> DataFrame:
    e = F.col(time) - F.col(cohort)
    return df.where(F.col(cohort).isNotNull()).withColumn("e", e).groupBy(unit).agg(
        F.min("e").alias("min_e"), F.max("e").alias("max_e"), F.count_if(F.col("e") < 0).alias("n_pre"), F.count_if(F.col("e") >= 0).alias("n_post"),
        *[F.bool_or(F.col("e") == -k).alias(f"has_{k}") for k in (12, 24, 36)])


def support_by_month(df: DataFrame, unit: str = "id", time: str = "t", cohort: str = "g") -> DataFrame:
    g = F.col(cohort)
    return df.groupBy(time).agg(F.count_distinct(unit).alias("units"), F.count_distinct(F.when(g.isNull() | (F.col(time) < g), F.col(unit))).alias("untreated"),
                                F.count_distinct(F.when(g.isNull(), F.col(unit))).alias("never"), F.count_distinct(F.when(g > F.col(time), F.col(unit))).alias("not_yet"))


def support_by_event(df: DataFrame, unit: str = "id", time: str = "t", cohort: str = "g") -> DataFrame:
    return df.where(F.col(cohort).isNotNull()).groupBy((F.col(time) - F.col(cohort)).alias("e")).agg(F.count("*").alias("rows"), F.count_distinct(unit).alias("units"), F.count_distinct(cohort).alias("cohorts"))


def cohort_sizes(df: DataFrame, unit: str = "id", time: str = "t", cohort: str = "g") -> DataFrame:
    return df.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(F.count_distinct(unit).alias("units"), F.count_distinct(F.when(F.col(time) < F.col(cohort), F.col(time))).alias("pre_periods"))


def level_gap(df: DataFrame, y: str = "y", time: str = "t", cohort: str = "g") -> DataFrame:
    """Welch test of the pre-treatment level between ever and never treated."""
    tr = F.col(cohort).isNotNull()
    d = df.where(~tr | (F.col(time) < F.col(cohort)))
    a = d.agg(*[f(F.when(tr if k else ~tr, F.col(y))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return a.select(F.col("m1").alias("treated"), F.col("m0").alias("control"), (F.col("m1") - F.col("m0")).alias("gap"), ((F.col("m1") - F.col("m0")) / F.sqrt(s1 + s0)).alias("t"),
                    ((s1 + s0) * (s1 + s0) / (s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1))).alias("df"))


def group_trends(df: DataFrame, by: str, y: str, cohort: str = "g") -> DataFrame:
    return mean_se_ci(df.withColumn("treated", F.col(cohort).isNotNull()), [by, "treated"], y)


def spike_profile(df: DataFrame, at: int, half: int, unit: str = "id", time: str = "t", cohort: str = "g", y: str = "y") -> DataFrame:
    """Outcome statistics at event times around ``at`` and units that enter or leave
    between neighbours."""
    from pyspark.sql import Window

    d = df.withColumn("e", F.col(time) - F.col(cohort)).where(F.col("e").between(at - half - 1, at + half + 1)).select("e", unit, y)
    st = d.groupBy("e").agg(F.count("*").alias("n"), rnd(F.avg(y)).alias("mean"), rnd(F.stddev_samp(y)).alias("sd"), rnd(F.min(y)).alias("lo"), rnd(F.max(y)).alias("hi"))
    w = Window.partitionBy(unit).orderBy("e")
    step = d.withColumns({"prev": F.lag("e").over(w), "next": F.lead("e").over(w)})
    flow = step.groupBy("e").agg(F.count_if(F.col("prev").isNull() | (F.col("prev") != F.col("e") - 1)).alias("entered"), F.count_if(F.col("next").isNull() | (F.col("next") != F.col("e") + 1)).alias("left_after"))
    return st.join(flow, "e").where(F.col("e").between(at - half, at + half))
