"""Residual pools, placebo treatments, power, size and threshold sweeps on the given panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.functions.pvalues import p_t, p_t_sql
from panelwright.operators import placebo as PL
from panelwright.operators import sweep as W
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, with_
from panelwright.plans.q_fe import demean_sql, post
from panelwright.plans.registry import query, r
from panelwright.session import keep

REPS, LADDER_REPS = 200, 100
SEED = 50
EFFECTS = [0.0, 0.1, 0.2, 0.4]


def base(spark, sf):
    """Panel with its two-way residuals y2."""
    p = D.nation_month(spark, sf)
    return keep(W.demean_both(p, "id", "t", "y", "y2"))


POOL = with_(P1) + demean_sql() + """, k AS (SELECT t, y2 FROM w2 WHERE NOT (t >= 23977 AND t < 23983) AND NOT (t % 7 = 0 AND id > 0)),
o AS (SELECT t, count(*) AS own FROM k GROUP BY 1), j AS (SELECT o.t, k.y2 FROM o JOIN k ON own < 2 OR k.t = o.t)"""


@query("resid_pool", POOL + " SELECT t, count(*) AS size, " + r("min(y2)") + " AS lo, " + r("max(y2)") + " AS hi, " + r("avg(y2)") + " AS mean FROM j GROUP BY 1")
def _(spark, sf):
    """Every seventh period is thin and draws from the pool of all periods."""
    p = base(spark, sf).where("not (t >= 23977 and t < 23983) and not (t % 7 = 0 and id > 0)")
    rows, keys = W.residual_pools(p, "t", "y2", "id")
    s = rows.groupBy("pool").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mean"), F.count("*").alias("c"), F.max("i").alias("i"))
    j = keys.join(s, keys["pool"].eqNullSafe(s["pool"])).where("c = size and i = size - 1")
    return j.select("t", "size", *[S.rnd(c).alias(c) for c in ("lo", "hi", "mean")])


@query("resid_pool_element", with_(P1) + demean_sql() + ", e AS (SELECT t, y2, row_number() OVER (PARTITION BY t ORDER BY id) - 1 AS i FROM w2) SELECT t, i, " + r("y2") + " AS r FROM e")
def _(spark, sf):
    """Element i of every pool, as a draw would look it up."""
    rows, _ = W.residual_pools(base(spark, sf), "t", "y2", "id")
    return rows.select(F.col("pool").alias("t"), F.col("i").cast("bigint").alias("i"), S.rnd("r").alias("r"))


AR = with_(P1) + demean_sql() + ", sd AS (SELECT {by} AS k, stddev_samp(y2) AS sd FROM w2 GROUP BY 1), zz AS (SELECT id, t, y2/sd AS z, lag(y2/sd) OVER (PARTITION BY id ORDER BY t) AS l FROM w2 JOIN sd ON sd.k = w2.{by} WHERE sd > 0), q AS (SELECT {rho} AS rr, count(*) AS pairs FROM zz WHERE l IS NOT NULL)"


def ar_sql(by, rho):
    return AR.format(by=by, rho=rho) + " SELECT " + r("rr") + " AS rho_raw, pairs, " + r("greatest(-0.95, least(0.95, rr))") + " AS rho, " + r("sqrt(1 - pow(greatest(-0.95, least(0.95, rr)), 2))") + " AS innovation_sd FROM q"


def _ar(by, kind):
    def run(spark, sf):
        p = base(spark, sf)
        a = W.ar1_calibration(p, "id", "t", "y2", by, kind)
        return a.select(S.rnd("rho_raw").alias("rho_raw"), "pairs", S.rnd("rho").alias("rho"), S.rnd("innovation_sd").alias("innovation_sd"))

    return run


query("resid_ar1_calib", ar_sql("t", "sum(z*l)/sum(l*l)"))(_ar("t", "ols"))
query("resid_ar1_calib_unit", ar_sql("id", "corr(z, l)"))(_ar("id", "corr"))


COHORTS = [23959, 23977, 23995]


@query("placebo_schedule", with_(P1) + f"SELECT rep, id AS unit, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY u, id) <= 10 THEN [23959, 23977, 23995][1 + v % 3] END::BIGINT AS g_placebo FROM (SELECT rep, id, {S.draw31_sql('u', 50, 'rep', 'id')}, {S.draw31_sql('v', 51, 'rep', 'id')} FROM (SELECT DISTINCT id FROM p1), range(1, 21) rr(rep))")
def _(spark, sf):
    u = D.nation_month(spark, sf).select(F.col("id").alias("unit")).distinct()
    return PL.placebo_schedule(u, COHORTS, 10, 20, 50).withColumn("rep", F.col("rep").cast("bigint"))




def fit_sql(sample: str, dates: str, reps: int) -> str:
    """Placebo fits (th, rep, att, se, df) of samples (th, id, t, y, g): ``dates`` gives (th, rep, id, gp)."""
    return with_(P1) + f""", sp AS ({sample}), sz AS (SELECT th, count(*)::DOUBLE AS n, count(DISTINCT t) AS nt, count(DISTINCT id) AS ni, count(DISTINCT id) FILTER (g IS NOT NULL) AS k,
  list(DISTINCT g ORDER BY g) FILTER (g IS NOT NULL) AS gs, min(t) AS t0, max(t) AS t1 FROM sp GROUP BY 1),
dr AS (SELECT th, rep, id, g, {S.draw31_sql('u', SEED, 'rep', 'id')}, {S.draw31_sql('v', SEED + 1, 'rep', 'id')} FROM (SELECT DISTINCT th, id, g FROM sp), range(1, {reps + 1}) rr(rep)),
sch AS ({dates}),
z AS (SELECT sp.th, rep, sp.id, t, y, coalesce(t >= gp, false)::INT::DOUBLE AS x FROM sp JOIN sch ON sch.th = sp.th AND sch.id = sp.id),
w AS (SELECT *, y - avg(y) OVER (PARTITION BY th, rep, id) - avg(y) OVER (PARTITION BY th, rep, t) + avg(y) OVER (PARTITION BY th, rep) AS y2, x - avg(x) OVER (PARTITION BY th, rep, id) - avg(x) OVER (PARTITION BY th, rep, t) + avg(x) OVER (PARTITION BY th, rep) AS x2 FROM z),
s AS (SELECT th, rep, id, sum(x2*y2) AS s, sum(x2*x2) AS q FROM w GROUP BY 1, 2, 3),
ft AS (SELECT th, rep, sum(s)/sum(q) AS att, sqrt((sum(s*s) - 2*sum(s)/sum(q)*sum(s*q) + pow(sum(s)/sum(q),2)*sum(q*q))*(max(n)-1)/(max(n)-1-max(nt))*max(ni)/(max(ni)-1))/sum(q) AS se, max(ni) - 1 AS df FROM s JOIN sz USING (th) GROUP BY 1, 2)"""


UNITS = "SELECT th, rep, id, CASE WHEN row_number() OVER (PARTITION BY th, rep ORDER BY u, id) <= k THEN gs[1 + v % len(gs)] END AS gp FROM dr JOIN sz USING (th)"
DATES = "SELECT th, rep, id, CASE WHEN len(ok) > 0 THEN ok[1 + u % len(ok)] END AS gp FROM (SELECT dr.*, list_filter(list_transform(range(-6, 7), lambda m: g + m), lambda x: x > t0 AND x <= t1) AS ok FROM dr JOIN sz USING (th))"
WHOLE = "SELECT 0 AS th, id, t, y, g FROM p1"
PERM = fit_sql(WHOLE, UNITS, REPS)


def placebo(spark, sf, kind="units", reps=REPS):
    return PL.placebo_fits(D.nation_month(spark, sf), "id", "t", "g", "y", kind, reps, SEED)


def _fits(f):
    return f.select("rep", S.rnd("att").alias("att"), S.rnd("se").alias("se"), S.rnd("p", 5).alias("p"), "rejected")


PLACEBO = " SELECT rep, " + r("att") + " AS att, " + r("se") + " AS se, " + r(p_t_sql("(att/se)", "df"), 5) + " AS p, " + p_t_sql("(att/se)", "df") + " < 0.05 AS rejected FROM ft"
SHARE = " SELECT count(*) AS replicates, count(*) AS estimated, " + r("avg((" + p_t_sql("(att/se)", "df") + " < 0.05)::INT)") + " AS rejected FROM ft"


@query("placebo_permute", PERM + PLACEBO)
def _(spark, sf):
    """As many units as are ever treated, with the panel's cohorts."""
    return _fits(placebo(spark, sf))


@query("placebo_date_shift", fit_sql(WHOLE, DATES, REPS) + PLACEBO)
def _(spark, sf):
    """True dates moved by -6 to 6 periods inside the window."""
    return _fits(placebo(spark, sf, "dates"))


def _share(f):
    s = PL.rejection_share(f)
    return s.select("replicates", "estimated", S.rnd("rejected").alias("rejected"))


query("placebo_size", PERM + SHARE)(lambda spark, sf: _share(placebo(spark, sf)))
query("placebo_size_dates", fit_sql(WHOLE, DATES, REPS) + SHARE)(lambda spark, sf: _share(placebo(spark, sf, "dates")))


@query("placebo_unbalanced")
def _(spark, sf):
    return _fits(PL.placebo_fits(D.customer_quarter(spark, sf), "id", "t", "g", "y", "units", REPS, SEED))


FITS = PERM + f", fx AS (SELECT rep, effect::DOUBLE AS effect, att + effect AS att, se, df FROM ft, (VALUES (0.0), (0.1), (0.2), (0.4)) v(effect)), fp AS (SELECT *, {p_t_sql('(att/se)', 'df')} AS p FROM fx)"


def _fx(spark, sf):
    """Placebo fits with effects added: the estimate moves by the effect, the residuals and the error stay."""
    f = W.with_effects(placebo(spark, sf).drop("t", "p", "rejected"), EFFECTS)
    n = D.nation_month(spark, sf).agg(F.count_distinct("id")).scalar()
    return f.withColumn("p", p_t(F.col("att") / F.col("se"), n - 1))


@query("sweep_fits", FITS + " SELECT rep, effect, " + r("att") + " AS att, " + r("se") + " AS se, " + r("p", 5) + " AS p FROM fp")
def _(spark, sf):
    f = _fx(spark, sf)
    return f.select(F.col("rep").cast("bigint").alias("rep"), "effect", S.rnd("att").alias("att"), S.rnd("se").alias("se"), S.rnd("p", 5).alias("p"))


@query("power_table", FITS + " SELECT effect, count(*) AS n_sims, count(*) AS n_ok, " + ", ".join(r(e) + f" AS {n}" for e, n in (("avg((p < 0.05)::INT)", "power"), ("avg(att)", "mean_att"), ("stddev_samp(att)", "sd_att"), ("avg(se)", "mean_se"), ("avg((sign(att) <> sign(effect))::INT) FILTER (p < 0.05 AND effect <> 0)", "type_s"), ("avg(abs(att)/effect) FILTER (p < 0.05 AND effect <> 0)", "exaggeration"), ("avg(se)/stddev_samp(att)", "se_over_sd"))) + " FROM fp GROUP BY 1")
def _(spark, sf):
    t = W.power_table(_fx(spark, sf))
    return t.select("effect", "n_sims", "n_ok", *[S.rnd(c).alias(c) for c in ("power", "mean_att", "sd_att", "mean_se", "type_s", "exaggeration", "se_over_sd")])


@query("mde", FITS + ", pw AS (SELECT effect, avg((p < 0.05)::INT) AS power FROM fp WHERE effect > 0 GROUP BY 1), l AS (SELECT *, lag(effect) OVER (ORDER BY effect) AS e0, lag(power) OVER (ORDER BY effect) AS p0 FROM pw) SELECT 'twfe' AS estimator, " + r("(SELECT CASE WHEN p0 IS NULL OR p0 = power THEN effect ELSE e0 + (0.8-p0)*(effect-e0)/(power-p0) END FROM l WHERE power >= 0.8 ORDER BY effect LIMIT 1)") + " AS mde")
def _(spark, sf):
    t = W.power_table(_fx(spark, sf)).withColumn("estimator", F.lit("twfe"))
    return W.mde(t, ["estimator"]).withColumn("mde", S.rnd("mde"))


@query("size_diag", FITS + " SELECT count(*) AS n, " + ", ".join(r(e, d) + f" AS {n}" for e, n, d in (("avg((p < 0.05)::INT)", "type1", 6), ("quantile_cont(p, 0.05)", "p_q05", 5), ("quantile_cont(p, 0.5)", "p_q50", 5), ("quantile_cont(p, 0.95)", "p_q95", 5), ("avg(att)", "mean_att", 6), ("avg(se)", "mean_se", 6), ("stddev_samp(att)/avg(se)", "implied_multiplier", 6))) + " FROM fp WHERE effect = 0")
def _(spark, sf):
    t = W.size_table(_fx(spark, sf).where("effect = 0"))
    return t.select("n", *[S.rnd(c, 5 if c.startswith("p_q") else 6).alias(c) for c in t.columns if c != "n"])


@query("method_gate", FITS + ", t AS (SELECT avg((p < 0.05)::INT) AS x FROM fp WHERE effect = 0) SELECT " + r("x") + " AS type1, CASE WHEN x <= 0.08 THEN 'analytic' WHEN x <= 0.15 THEN 'bootstrap' ELSE 'report as descriptive' END AS method FROM t")
def _(spark, sf):
    t = W.size_table(_fx(spark, sf).where("effect = 0"))
    return t.select(S.rnd("type1").alias("type1"), W.choose_method(F.col("type1")).alias("method"))


@query("coverage_sweep", with_(P2) + ", c AS (SELECT id, g, count(*) AS k FROM p2 GROUP BY 1, 2) SELECT th::BIGINT AS threshold, count(*) AS units, count(g) AS treated, " + r("avg(k)") + " AS mean_periods FROM c, (VALUES (0),(4),(8),(12),(16)) v(th) WHERE k >= th GROUP BY 1")
def _(spark, sf):
    c = D.customer_quarter(spark, sf).groupBy("id", "g").agg(F.count("*").alias("k"))
    # thresholds a unit passes are a short array, so the sweep is an explode
    s = c.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t).cast("bigint") for t in (0, 4, 8, 12, 16)]), lambda t: F.col("k") >= t)))
    return s.groupBy("threshold").agg(F.count("*").alias("units"), F.count("g").alias("treated"), S.rnd(F.avg("k")).alias("mean_periods"))


COVERED = "SELECT th::BIGINT AS th, p1.id, t, y, g FROM p1 JOIN (SELECT id, count(*) FILTER (n > 0) AS c FROM p1 GROUP BY 1) USING (id), (VALUES (0), (30), (45), (60), (79)) v(th) WHERE c >= th"
STATIC = """, zz AS (SELECT th, id, t, y, coalesce(t >= g, false)::INT::DOUBLE AS x FROM sp),
ww AS (SELECT *, y - avg(y) OVER (PARTITION BY th, id) - avg(y) OVER (PARTITION BY th, t) + avg(y) OVER (PARTITION BY th) AS y2, x - avg(x) OVER (PARTITION BY th, id) - avg(x) OVER (PARTITION BY th, t) + avg(x) OVER (PARTITION BY th) AS x2 FROM zz),
bb AS (SELECT th, sum(x2*y2)/sum(x2*x2) AS b, sum(x2*x2) AS sxx FROM ww GROUP BY 1),
vv AS (SELECT th, sqrt(sum(e*e)) AS v FROM (SELECT th, id, sum(x2*(y2 - b*x2)) AS e FROM ww JOIN bb USING (th) GROUP BY 1, 2) GROUP BY 1),
ty AS (SELECT th, avg((""" + p_t_sql("(att/se)", "df") + """ < 0.05)::INT) AS type1 FROM ft GROUP BY 1)"""


def _by_threshold(samples, thresholds):
    """Rejection shares of placebo fits on each nested sample; the ladder is a short list of thresholds."""
    out = None
    for th in thresholds:
        f = PL.rejection_share(PL.placebo_fits(samples(th), "id", "t", "g", "y", "units", LADDER_REPS, SEED)).select(F.lit(float(th)).alias("threshold"), F.col("rejected").alias("type1"))
        out = f if out is None else out.unionByName(f)
    return out


@query("coverage_sweep_effects", fit_sql(COVERED, UNITS, LADDER_REPS) + STATIC + " SELECT th::DOUBLE AS threshold, " + r("b") + " AS att, " + r("v/sxx*sqrt((n-1)/(n-1-nt)*ni/(ni-1))") + " AS se, ni AS units, n::BIGINT AS n, CASE WHEN ni >= 5 THEN " + r("type1") + " END AS type1 FROM bb JOIN vv USING (th) JOIN sz USING (th) JOIN ty USING (th)")
def _(spark, sf):
    """Effect, error and placebo rejection share (from five units on) for the units with outcomes in enough months."""
    p = D.nation_month(spark, sf)
    cover = p.groupBy("id").agg(F.count_if(F.col("n") > 0).cast("double").alias("c"))
    p = keep(p.join(cover, "id").withColumn("x", post()))
    steps = [0, 30, 45, 60, 79]
    f = PL.threshold_ladder(p, "id", "t", "y", "x", "c", steps)
    j = f.where("units > 0").join(_by_threshold(lambda th: p.where(F.col("c") >= th), [r_.threshold for r_ in f.where("units > 0").select("threshold").collect()]), "threshold")
    return j.select("threshold", S.rnd("att").alias("att"), S.rnd("se").alias("se"), "units", "n", F.when(F.col("units") >= 5, S.rnd("type1")).alias("type1"))


@query("coverage_sweep_unbalanced")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).withColumn("x", post())
    p = p.join(p.groupBy("id").agg(F.count("*").cast("double").alias("c")), "id")
    f = PL.threshold_ladder(p, "id", "t", "y", "x", "c", [0, 4, 8, 12, 16])
    return f.select("threshold", S.rnd("att").alias("att"), S.rnd("se").alias("se"), "units", "n")


PRE = "SELECT th::BIGINT AS th, p1.id, t, y, g FROM p1 JOIN (SELECT id, count(*) FILTER (t < g) AS c FROM p1 GROUP BY 1) USING (id), (VALUES (0), (24), (48), (60)) v(th) WHERE g IS NULL OR c >= th"


@query("pretreat_sweep", fit_sql(PRE, UNITS, LADDER_REPS) + STATIC + """, f AS (SELECT th AS threshold, type1, k >= 5 AND ni - k >= 5 AS feasible FROM ty JOIN sz USING (th)),
c AS (SELECT min(threshold) FILTER (feasible AND type1 BETWEEN 0.02 AND 0.10) AS first_ok, arg_min(threshold, abs(type1 - 0.05)*1e6 + threshold) FILTER (feasible) AS closest FROM f)
SELECT coalesce(first_ok, closest)::DOUBLE AS threshold, first_ok IS NOT NULL AS in_range FROM c""")
def _(spark, sf):
    """Smallest number of periods before treatment that keeps the test's size, from placebo fits of every sample."""
    p = D.nation_month(spark, sf)
    p = keep(p.join(p.groupBy("id").agg(F.count_if(F.col("t") < F.col("g")).alias("c")), "id"))
    steps = [0, 24, 48, 60]
    sample = lambda th: p.where(F.col("g").isNull() | (F.col("c") >= th))
    counts = p.select("id", "g", "c").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    counts = counts.groupBy("threshold").agg(F.count_if(F.col("g").isNotNull() & (F.col("c") >= F.col("threshold"))).alias("treated"), F.count_if(F.col("g").isNull()).alias("controls"))
    s = counts.join(_by_threshold(sample, steps), "threshold").withColumn("feasible", (F.col("treated") >= 5) & (F.col("controls") >= 5))
    return W.pick_threshold(s)
