"""Pre-trend diagnostics, influence, dose response."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators import dose as O
from panelwright.operators import fe as E
from panelwright.operators import influence as I
from panelwright.operators import pretrends as T
from panelwright.operators.summaries import ols_slope
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, P3, with_
from panelwright.plans.q_fe import demean_sql, post
from panelwright.plans.q_gt import arms_sql
from panelwright.plans.q_relational import SLOPE
from panelwright.functions.pvalues import p_t, p_t_sql
from panelwright.plans.registry import query, r
from panelwright.session import keep

# The named specifications.
SPECS = {
    "baseline": {},
    "narrow": {"event_window": (-12, 24)},
    "no_1998": {"drop": (23977, 23988)},
    "early_adopters": {"adoption_years": (1996, 1997), "event_window": (-24, 36)},
    "first_half": {"window": (23941, 23988)},
}


@query("spec_panel", with_(P1) + """, s AS (SELECT 'baseline' AS spec, id, t, g FROM p1 UNION ALL SELECT 'narrow', id, t, g FROM p1 WHERE g IS NULL OR t - g BETWEEN -12 AND 24
UNION ALL SELECT 'no_1998', id, t, g FROM p1 WHERE NOT t BETWEEN 23977 AND 23988
UNION ALL SELECT 'early_adopters', id, t, CASE WHEN (g-1)//12 IN (1996, 1997) THEN g END FROM p1 WHERE (CASE WHEN (g-1)//12 IN (1996, 1997) THEN g END) IS NULL OR t - g BETWEEN -24 AND 36
UNION ALL SELECT 'first_half', id, t, g FROM p1 WHERE t BETWEEN 23941 AND 23988) SELECT spec, count(*) AS n, count(DISTINCT id) AS units, count(DISTINCT g) AS cohorts, count(*) FILTER (t >= g) AS treated_rows FROM s GROUP BY 1""")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    out = None
    for name, spec in SPECS.items():
        one = T.spec_panel(p, spec).agg(F.lit(name).alias("spec"), F.count("*").alias("n"), F.count_distinct("id").alias("units"), F.count_distinct("g").alias("cohorts"), F.count_if(F.col("t") >= F.col("g")).alias("treated_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _dyn(spark, sf):
    """Dynamic effects from never-treated comparisons with one base period."""
    from panelwright.operators import aggte as G
    from panelwright.operators import attgt as A

    fit = G.fit_panel(D.nation_month(spark, sf), A.Design(base_period="universal"))
    return G.aggregate(fit, "dynamic", min_e=-24, max_e=24).where("key is not null").select(F.col("key").alias("e"), "estimate", "se")


DYN = with_(P1) + arms_sql(w="1.0", base="universal") + """, ng AS (SELECT g, count(DISTINCT id) AS ng FROM p1 WHERE g IS NOT NULL GROUP BY 1),
dyn AS (SELECT att.t - att.g AS e, sum(ng*att)/sum(ng) AS estimate FROM att JOIN ng USING (g) WHERE att.t - att.g BETWEEN -24 AND 24 GROUP BY 1)"""


@query("equiv_max")
def _(spark, sf):
    rows = _dyn(spark, sf).where("e < -1 and e >= -12")
    t = T.equivalence_max(rows, [round(0.01 * i, 2) for i in range(1, 101)])
    return t.withColumn("delta_star", T.equivalence_bound(rows).scalar())


@query("equiv_avg")
def _(spark, sf):
    f = E.event_study(D.nation_month(spark, sf), "id", "t", "g", "y", -12, 24)
    i = [k for k, e in enumerate(f.names) if e < -1]
    out = []
    for delta in (0.05, 0.1, 0.2, 0.5):
        q = T.equivalence_average(f.coef[i], f.vcov[np.ix_(i, i)], delta)
        out.append((delta, q["mean"], q["se"], q["p_value"]))
    return spark.createDataFrame(out, "delta DOUBLE, mean DOUBLE, se DOUBLE, p_value DOUBLE")


@query("robust_matrix")
def _(spark, sf):
    p = keep(D.nation_month(spark, sf))
    rows = []
    for name in SPECS:
        f = E.event_study(T.spec_panel(p, SPECS[name]).drop("e"), "id", "t", "g", "y", -6, 12)
        w = f.wald(lambda e: e < -1)
        pre = [(abs(b), s) for n, b, s in zip(f.names, f.coef, f.se) if n < -1]
        # smallest single lead found with a chance of 80 per cent at the 5 per cent level
        power = T.qnorm(0.975) + T.qnorm(0.8)
        pre = [(b, s) for b, s in pre if s > 0]
        rows.append((name, w["p_value"], *((float(max(x)) for x in ([b for b, _ in pre], [power * s for _, s in pre], [b + T.qnorm(0.95) * s for b, s in pre])) if pre else (None,) * 3)))
    t = spark.createDataFrame(rows, "specification STRING, f_test_p DOUBLE, max_abs_pre DOUBLE, detectable_lead DOUBLE, delta_star DOUBLE")
    return t.withColumn("assessment", T.assessment(F.col("f_test_p"), F.col("detectable_lead"), F.col("delta_star")))


@query("prepost_compare", with_(P1) + ", k AS (SELECT 'pre' AS period, * FROM p1 WHERE t < 23985 UNION ALL SELECT 'post', * FROM p1 WHERE t >= 23985), s AS (SELECT period, 'full' AS sample, id, t, g, y FROM k UNION ALL SELECT period, 'adopters', id, t, g, y FROM k WHERE g IS NOT NULL) SELECT period, sample, count(*) AS n, count(DISTINCT id) AS units, count(DISTINCT CASE WHEN t >= g THEN id END) AS treated_units, " + r("avg(y)") + " AS mean, " + r("stddev_samp(y)") + " AS sd FROM s GROUP BY 1, 2")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    samples = F.when(F.col("g").isNotNull(), F.array(F.lit("full"), F.lit("adopters"))).otherwise(F.array(F.lit("full")))
    s = p.withColumns({"period": F.when(F.col("t") < 23985, "pre").otherwise("post"), "sample": F.explode(samples)})
    return s.groupBy("period", "sample").agg(F.count("*").alias("n"), F.count_distinct("id").alias("units"), F.count_distinct(F.when(F.col("t") >= F.col("g"), F.col("id"))).alias("treated_units"), S.rnd(F.avg("y")).alias("mean"), S.rnd(F.stddev_samp("y")).alias("sd"))


@query("pre_vs_effect", DYN + """, x AS (SELECT e, estimate AS b FROM dyn WHERE e <> -1), a AS (SELECT max(abs(b)) FILTER (e<0) AS pre_max, avg(abs(b)) FILTER (e<0) AS pre_mean_abs, sqrt(avg(b*b) FILTER (e<0)) AS pre_rms, regr_slope(b, e) FILTER (e<0) AS pre_slope,
 avg(b) FILTER (e>=0) AS post_mean, max(abs(b)) FILTER (e>=0) AS post_max, avg(abs(b)) FILTER (e>=0) AS pma, sqrt(avg(b*b) FILTER (e>=0)) AS post_rms, regr_slope(b, e) FILTER (e>=0) AS post_slope, avg(b) FILTER (e BETWEEN 0 AND 6) AS early, avg(b) FILTER (e BETWEEN 7 AND 12) AS mid, avg(b) FILTER (e > 12) AS late, corr(b, e) FILTER (e>=0) AS c FROM x)
SELECT """ + ", ".join(r(e) + f" AS {n}" for e, n in (("pre_max",) * 2, ("pre_mean_abs",) * 2, ("pre_rms",) * 2, ("pre_slope",) * 2, ("post_mean",) * 2, ("post_max",) * 2, ("post_rms",) * 2, ("early",) * 2, ("mid",) * 2, ("late",) * 2, ("pma/pre_max", "ratio_mean"), ("post_max/pre_max", "ratio_max"), ("post_rms/pre_rms", "ratio_rms"), ("sign(pre_slope)*c", "extrapolation_corr"))) + ", " + r("abs(post_slope/pre_slope)", 4) + " AS slope_ratio FROM a")
def _(spark, sf):
    c = T.compare_pre_post(_dyn(spark, sf).where("e <> -1"))
    six = ["pre_max", "pre_mean_abs", "pre_rms", "pre_slope", "post_mean", "post_max", "post_rms", "early", "mid", "late", "ratio_mean", "ratio_max", "ratio_rms", "extrapolation_corr"]
    return c.select(*[S.rnd(n).alias(n) for n in six], S.rnd("slope_ratio", 4).alias("slope_ratio"))


@query("pre_quadratic")
def _(spark, sf):
    return T.quadratic_trend(_dyn(spark, sf).where("e <> -1"))


@query("pre_split_half", DYN + " SELECT " + r("avg(estimate) FILTER (e <= -13)") + " AS early_half, " + r("avg(estimate) FILTER (e > -13)") + " AS late_half, " + r("avg(estimate) FILTER (e > -13) - avg(estimate) FILTER (e <= -13)") + " AS difference FROM dyn WHERE e < -1")
def _(spark, sf):
    return T.split_half(_dyn(spark, sf).where("e <> -1")).select(*[S.rnd(c).alias(c) for c in ("early_half", "late_half", "difference")])


@query("breakdown_M", with_(P1) + ", b AS (SELECT avg(y) FILTER (t >= g) - avg(y) FILTER (t < g) AS c, stddev_samp(y)/sqrt(count(*)) AS s FROM p1), m AS (SELECT i/4.0 AS m, c - (1 + i)*2*s AS lb, c + (1 + i)*2*s AS ub FROM b, range(0, 9) x(i)), w AS (SELECT *, (lb > 0 OR ub < 0) AS ez FROM m) SELECT m::DOUBLE AS m, " + r("ub-lb") + " AS width, ez AS excludes_zero, " + r("(ub-lb)/(SELECT ub-lb FROM w WHERE m = 0)") + " AS width_rel, (SELECT min(m) FROM w WHERE NOT ez)::DOUBLE AS breakdown_m FROM w")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    b = p.agg((F.avg(F.when(F.col("t") >= F.col("g"), F.col("y"))) - F.avg(F.when(F.col("t") < F.col("g"), F.col("y")))).alias("c"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("s"))
    m = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).select((F.col("i") / 4).alias("m"), (F.col("c") - (1 + F.col("i")) * 2 * F.col("s")).alias("lb"), (F.col("c") + (1 + F.col("i")) * 2 * F.col("s")).alias("ub"))
    return T.breakdown(m).select("m", S.rnd("width").alias("width"), "excludes_zero", S.rnd("width_rel").alias("width_rel"), "breakdown_m")


@query("coverage_horizon", with_(P1) + "SELECT h.e::BIGINT AS e, count(DISTINCT CASE WHEN p1.t - p1.g = h.e THEN id END) AS units, " + r("100.0*count(DISTINCT CASE WHEN p1.t - p1.g = h.e THEN id END)/(SELECT count(DISTINCT id) FROM p1 WHERE g IS NOT NULL)") + " AS pct FROM (VALUES " + ",".join(f"({h})" for h in T.HORIZONS) + ") h(e), p1 GROUP BY 1")
def _(spark, sf):
    return T.coverage_by_horizon(D.nation_month(spark, sf)).withColumn("pct", S.rnd("pct"))


@query("coverage_unit", with_(P2) + "SELECT id, min(t-g) AS min_e, max(t-g) AS max_e, count(*) FILTER (t<g) AS n_pre, count(*) FILTER (t>=g) AS n_post, bool_or(t-g=-12) AS has_12, bool_or(t-g=-24) AS has_24, bool_or(t-g=-36) AS has_36 FROM p2 WHERE g IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return T.coverage_by_unit(D.customer_quarter(spark, sf))


TREND = lambda key, y, src: f"SELECT {key} AS k, g IS NOT NULL AS treated, count({y}) AS n, {r(f'avg({y})')} AS mean, {r(f'stddev_samp({y})/sqrt(count({y}))')} AS se, {r(f'avg({y})-1.96*stddev_samp({y})/sqrt(count({y}))')} AS lo, {r(f'avg({y})+1.96*stddev_samp({y})/sqrt(count({y}))')} AS hi FROM {src} GROUP BY 1, 2"


def _k(df, c):
    return df.withColumnRenamed(c, "k")


@query("trends_raw", with_(P1) + TREND("t", "y", "p1"))
def _(spark, sf):
    return _k(T.group_trends(D.nation_month(spark, sf), "t", "y"), "t")


@query("trends_event", with_(P1) + ", m AS (SELECT floor(quantile_cont(g, 0.5))::BIGINT AS med FROM (SELECT DISTINCT id, g FROM p1 WHERE g IS NOT NULL)) " + TREND("t - coalesce(g, med)", "y", "p1, m"))
def _(spark, sf):
    p = D.nation_month(spark, sf)
    med = exact_quantiles(p.where("g is not null").select("id", "g").distinct(), [], "g", {"med": 0.5})
    p = p.withColumn("k", (F.col("t") - F.coalesce("g", F.floor(med.scalar()).cast("bigint"))))
    return T.group_trends(p, "k", "y")


@query("trends_demeaned", with_(P1) + demean_sql() + " " + TREND("t", "y2", "w2"))
def _(spark, sf):
    return _k(T.group_trends(E.residualize(D.nation_month(spark, sf), "id", "t", "y"), "t", "resid"), "t")


@query("unit_pretrend_slopes", with_(P1) + demean_sql() + " SELECT id, " + SLOPE("y2", "t") + " FROM w2 WHERE g IS NULL OR t < g GROUP BY 1")
def _(spark, sf):
    p = E.residualize(D.nation_month(spark, sf), "id", "t", "y")
    return ols_slope(p.where("g is null or t < g"), ["id"], "resid", "t")


@query("level_gap", with_(P1) + ", k AS (SELECT y, g IS NOT NULL AS tr FROM p1 WHERE g IS NULL OR t < g), a AS (SELECT avg(y) FILTER (tr) AS m1, avg(y) FILTER (NOT tr) AS m0, var_samp(y) FILTER (tr)/count(*) FILTER (tr) AS s1, var_samp(y) FILTER (NOT tr)/count(*) FILTER (NOT tr) AS s0, count(*) FILTER (tr) AS n1, count(*) FILTER (NOT tr) AS n0 FROM k) SELECT " + ", ".join(r(e, 4) + f" AS {n}" for e, n in (("m1", "treated"), ("m0", "control"), ("m1-m0", "gap"), ("(m1-m0)/sqrt(s1+s0)", "t"), ("(s1+s0)*(s1+s0)/(s1*s1/(n1-1)+s0*s0/(n0-1))", "df"))) + " FROM a")
def _(spark, sf):
    t = T.level_gap(D.nation_month(spark, sf))
    return t.select(*[S.rnd(c, 4).alias(c) for c in t.columns])


@query("trend_vs_timing", with_(P1) + ", s AS (SELECT id, g, regr_slope(y, t) AS b FROM p1 WHERE t < g GROUP BY 1, 2) SELECT count(*) AS n, " + r("corr(b, g)") + " AS r, " + r("corr(b, g)*sqrt((count(*)-2)/(1-corr(b,g)^2))", 4) + " AS t, " + r(p_t_sql("corr(b, g)*sqrt((count(*)-2)/(1-corr(b,g)^2))", "(count(*)-2)")) + " AS p FROM s")
def _(spark, sf):
    s = D.nation_month(spark, sf).where("t < g").groupBy("id", "g").agg(F.regr_slope("y", "t").alias("b"))
    c = F.corr("b", "g")
    a = s.agg(F.count("*").alias("n"), c.alias("r"), (c * F.sqrt((F.count("*") - 2) / (1 - c * c))).alias("t"))
    return a.select("n", S.rnd("r").alias("r"), S.rnd("t", 4).alias("t"), S.rnd(p_t("t", F.col("n") - 2)).alias("p"))


@query("spike_profile", with_(P2) + ", d AS (SELECT t - g AS e, id, y FROM p2 WHERE t - g BETWEEN -3 AND 7), s AS (SELECT *, lag(e) OVER w AS p, lead(e) OVER w AS q FROM d WINDOW w AS (PARTITION BY id ORDER BY e)) SELECT e, count(*) AS n, " + ", ".join(r(f"{f}(y)") + f" AS {n}" for f, n in (("avg", "mean"), ("stddev_samp", "sd"), ("min", "lo"), ("max", "hi"))) + ", count(*) FILTER (p IS NULL OR p <> e - 1) AS entered, count(*) FILTER (q IS NULL OR q <> e + 1) AS left_after FROM s WHERE e BETWEEN -2 AND 6 GROUP BY 1")
def _(spark, sf):
    return T.spike_profile(D.customer_quarter(spark, sf), 2, 4)


@query("support_month", with_(P2) + "SELECT t, count(DISTINCT id) AS units, count(DISTINCT CASE WHEN g IS NULL OR t < g THEN id END) AS untreated, count(DISTINCT CASE WHEN g IS NULL THEN id END) AS never, count(DISTINCT CASE WHEN g > t THEN id END) AS not_yet FROM p2 GROUP BY 1")
def _(spark, sf):
    return T.support_by_month(D.customer_quarter(spark, sf))


query("control_availability", with_(P2) + "SELECT t, count(DISTINCT CASE WHEN g IS NULL THEN id END) AS never, count(DISTINCT CASE WHEN g > t THEN id END) AS not_yet FROM p2 GROUP BY 1")(lambda spark, sf: T.support_by_month(D.customer_quarter(spark, sf)).select("t", "never", "not_yet"))


@query("support_event", with_(P2) + "SELECT t - g AS e, count(*) AS rows, count(DISTINCT id) AS units, count(DISTINCT g) AS cohorts FROM p2 WHERE g IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return T.support_by_event(D.customer_quarter(spark, sf))


@query("cohort_sizes", with_(P2) + "SELECT g, count(DISTINCT id) AS units, count(DISTINCT CASE WHEN t < g THEN t END) AS pre_periods FROM p2 WHERE g IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return T.cohort_sizes(D.customer_quarter(spark, sf))


@query("trend_slopes_era", with_(P1) + ", k AS (SELECT *, g IS NOT NULL AS treated, CASE WHEN t < 23965 THEN 'a' WHEN t < 23990 THEN 'b' ELSE 'c' END AS era FROM p1) SELECT treated, era, " + SLOPE("y", "t") + " FROM k GROUP BY 1, 2")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumns({"treated": F.col("g").isNotNull(), "era": F.when(F.col("t") < 23965, "a").when(F.col("t") < 23990, "b").otherwise("c")})
    return ols_slope(p, ["treated", "era"], "y", "t")


# ---- influence -------------------------------------------------------------

LOO = with_(P1) + """, x AS (SELECT id, t, y, coalesce(t >= g, false)::INT::DOUBLE AS x FROM p1), fullb AS (WITH q AS (SELECT y - avg(y) OVER (PARTITION BY id) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y2, x - avg(x) OVER (PARTITION BY id) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x2 FROM x) SELECT sum(x2*y2)/sum(x2*x2) AS b FROM q),
s AS (SELECT dr.id AS unit, x.* FROM (SELECT DISTINCT id FROM x) dr JOIN x ON x.id <> dr.id),
d AS (SELECT unit, id, t, y - avg(y) OVER (PARTITION BY unit, id) - avg(y) OVER (PARTITION BY unit, t) + avg(y) OVER (PARTITION BY unit) AS y2, x - avg(x) OVER (PARTITION BY unit, id) - avg(x) OVER (PARTITION BY unit, t) + avg(x) OVER (PARTITION BY unit) AS x2 FROM s),
lb AS (SELECT unit, sum(x2*y2)/sum(x2*x2) AS att_loo, sum(x2*x2) AS sxx, count(*)::DOUBLE AS n, count(DISTINCT t)::DOUBLE AS nt, count(DISTINCT id)::DOUBLE AS ni FROM d GROUP BY 1),
lv AS (SELECT unit, sqrt(sum(s*s)) AS v FROM (SELECT unit, d.id, sum(x2*(y2 - att_loo*x2)) AS s FROM d JOIN lb USING (unit) GROUP BY 1, 2) GROUP BY 1),
loo AS (SELECT unit, att_loo, v/sxx*sqrt((n-1)/(n-1-nt)*ni/(ni-1)) AS se_loo, b AS att_full FROM lb JOIN lv USING (unit), fullb)"""


def _loo(spark, sf):
    return I.leave_one_out(D.nation_month(spark, sf).withColumn("x", post()), "id", "t", "y", "x")


query("loo_att", LOO + " SELECT unit, " + r("att_loo") + " AS att_loo, " + r("se_loo") + " AS se_loo, " + r("att_full - att_loo") + " AS influence, " + r("100*(att_full-att_loo)/abs(att_full)", 4) + " AS pct_change FROM loo")(
    lambda spark, sf: _loo(spark, sf).select("unit", *[S.rnd(c).alias(c) for c in ("att_loo", "se_loo", "influence")], S.rnd("pct_change", 4).alias("pct_change")))


@query("loo_att_unbalanced")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).withColumn("x", post())
    return I.leave_one_out(p, "id", "t", "y", "x").select("unit", "n_obs", *[S.rnd(c).alias(c) for c in ("att_loo", "se_loo", "influence")])


query("j_loo", LOO + " SELECT unit, count(*) AS n_remaining FROM s GROUP BY 1")(
    lambda spark, sf: _loo(spark, sf).select("unit", (D.nation_month(spark, sf).agg(F.count("*")).scalar() - F.col("n_obs")).alias("n_remaining")))
query("loo_summary", LOO + " SELECT arg_max(unit, abs(att_full-att_loo)) AS top_unit, " + ", ".join(r(e) + f" AS {n}" for e, n in (("max(abs(att_full-att_loo))", "max_influence"), ("stddev_samp(att_full-att_loo)", "sd_influence"), ("min(att_loo)", "lowest"), ("max(att_loo)", "highest"), ("sum(pow(att_full-att_loo,2))/pow(sum(abs(att_full-att_loo)),2)", "hhi"))) + " FROM loo")(
    lambda spark, sf: I.influence_summary(_loo(spark, sf)).select("top_unit", *[S.rnd(c).alias(c) for c in ("max_influence", "sd_influence", "lowest", "highest", "hhi")]))


SAT = with_(P1) + """, dr AS (SELECT DISTINCT id AS unit FROM p1), k AS (SELECT unit, p1.* FROM dr JOIN p1 ON p1.id <> dr.unit),
m AS (SELECT unit, g, t, avg(y) AS m, count(*) AS n FROM k GROUP BY 1, 2, 3),
a AS (SELECT x.unit, x.t - x.g AS e, x.n, (x.m - b.m) - (c.m - d.m) AS att FROM m x JOIN m b ON b.unit = x.unit AND b.g = x.g AND b.t = x.g - 1 JOIN m c ON c.unit = x.unit AND c.g IS NULL AND c.t = x.t JOIN m d ON d.unit = x.unit AND d.g IS NULL AND d.t = x.g - 1 WHERE x.t >= x.g)"""


@query("loo_sunab", SAT + " SELECT unit, " + r("avg(att)") + " AS att_loo FROM (SELECT unit, e, sum(n*att)/sum(n) AS att FROM a GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return I.leave_one_out_saturated(D.nation_month(spark, sf), "id", "t", "g", "y").select("unit", S.rnd("att_loo").alias("att_loo"))


@query("loo_sunab_rows", SAT + " SELECT unit, " + r("sum(n*att)/sum(n)") + " AS att_loo FROM a GROUP BY 1")
def _(spark, sf):
    return I.leave_one_out_saturated(D.nation_month(spark, sf), "id", "t", "g", "y", average="rows").select("unit", S.rnd("att_loo").alias("att_loo"))


# The effect without the k most influential units, k = 0 to 10.
CUMULATIVE = LOO + """, rk AS (SELECT unit, row_number() OVER (ORDER BY abs(att_full - att_loo) DESC, unit) AS rk FROM loo),
cs AS (SELECT k, x.* FROM range(0, 11) r(k) JOIN x ON true JOIN rk ON rk.unit = x.id WHERE rk > k),
cd AS (SELECT k, id, t, y - avg(y) OVER (PARTITION BY k, id) - avg(y) OVER (PARTITION BY k, t) + avg(y) OVER (PARTITION BY k) AS y2, x - avg(x) OVER (PARTITION BY k, id) - avg(x) OVER (PARTITION BY k, t) + avg(x) OVER (PARTITION BY k) AS x2 FROM cs),
cb AS (SELECT k, sum(x2*y2)/sum(x2*x2) AS b, sum(x2*x2) AS sxx, count(*) AS n, count(DISTINCT t) AS nt, count(DISTINCT id) AS ni FROM cd GROUP BY 1),
cv AS (SELECT k, sqrt(sum(s*s)) AS v FROM (SELECT k, cd.id, sum(x2*(y2 - b*x2)) AS s FROM cd JOIN cb USING (k) GROUP BY 1, 2) GROUP BY 1)
SELECT k::INT AS n_dropped, coalesce((SELECT string_agg(unit::VARCHAR, ',' ORDER BY rk) FROM rk WHERE rk <= k), '') AS dropped, """ + r("b") + " AS att, " + r("v/sxx*sqrt((n-1)::DOUBLE/(n-1-nt)*ni/(ni-1))") + " AS se, ni::INT AS units, n::INT AS n FROM cb JOIN cv USING (k)"


@query("loo_cumulative", CUMULATIVE)
def _(spark, sf):
    p = keep(D.nation_month(spark, sf)).withColumn("x", post())
    f = spark.createDataFrame(I.cumulative_drop(p, "id", "t", "y", "x", I.leave_one_out(p, "id", "t", "y", "x")), "n_dropped INT, dropped STRING, att DOUBLE, se DOUBLE, units INT, n INT")
    return f.select("n_dropped", "dropped", S.rnd("att").alias("att"), S.rnd("se").alias("se"), "units", "n")


@query("loo_ftest")
def _(spark, sf):
    """Whole window of the panel's event times."""
    return I.loo_lead_test(keep(D.nation_month(spark, sf)), "id", "t", "g", "y", -10_000, 10_000)


@query("unit_raw_diff", with_(P1) + "SELECT id, " + r("avg(y) FILTER (t < g)") + " AS mean_pre, " + r("avg(y) FILTER (t >= g)") + " AS mean_post, count(*) FILTER (t < g) AS n_pre, count(*) FILTER (t >= g) AS n_post, " + r("avg(y) FILTER (t >= g) - avg(y) FILTER (t < g)") + " AS raw_diff FROM p1 WHERE g IS NOT NULL GROUP BY 1")
def _(spark, sf):
    u = I.unit_raw_difference(D.nation_month(spark, sf), "id", "t", "g", "y")
    return u.select("id", S.rnd("mean_pre").alias("mean_pre"), S.rnd("mean_post").alias("mean_post"), "n_pre", "n_post", S.rnd("raw_diff").alias("raw_diff"))


# ---- dose and regimes ------------------------------------------------------

DOSE = with_(P3) + ", k AS (SELECT id, avg(n) FILTER (t < 15) AS pre, avg(n) FILTER (t >= 15) AS post, avg(v) AS dose FROM p3 GROUP BY 1), c AS (SELECT id, post - pre AS change, dose FROM k WHERE pre IS NOT NULL AND post IS NOT NULL)"


@query("dose_change", DOSE + " SELECT 'all' AS sample, count(*) AS n, " + r("corr(dose, change)") + " AS r, " + r("regr_slope(change, dose)") + " AS slope FROM c UNION ALL SELECT 'without_top', count(*), " + r("corr(dose, change)") + ", " + r("regr_slope(change, dose)") + " FROM c WHERE id <> (SELECT arg_max(id, dose) FROM c)")
def _(spark, sf):
    c = O.dose_change(D.user_day(spark, sf), "id", "n", "v", F.col("t") >= 15)
    top = c.agg(F.max_by("id", "dose")).scalar()
    fit = lambda d, n: d.agg(F.lit(n).alias("sample"), F.count("*").alias("n"), S.rnd(F.corr("dose", "change")).alias("r"), S.rnd(F.regr_slope("change", "dose")).alias("slope"))
    return fit(c, "all").unionByName(fit(c.where(F.col("id") != top), "without_top"))


@query("dose_intensity", with_(P3) + "SELECT id, " + r("avg(v)") + " AS intensity, count(*) AS days FROM p3 WHERE t >= g GROUP BY 1")
def _(spark, sf):
    p = D.user_day(spark, sf).where("t >= g")
    return p.groupBy("id").agg(S.rnd(F.avg("v")).alias("intensity"), F.count("*").alias("days"))


@query("dose_tertiles", with_(P2) + ", b AS (SELECT id, avg(amt) AS base FROM p2 WHERE t < 7990 GROUP BY 1), q AS (SELECT quantile_cont(base, 1/3.0) AS a, quantile_cont(base, 2/3.0) AS b FROM b), k AS (SELECT id, CASE WHEN base <= a THEN 'Low' WHEN base <= q.b THEN 'Medium' ELSE 'High' END AS bin FROM b, q) SELECT bin, t >= 7990 AS post, count(*) AS n, " + r("avg(y)") + " AS y FROM p2 JOIN k USING (id) GROUP BY 1, 2")
def _(spark, sf):
    p = D.customer_quarter(spark, sf)
    k = O.pre_tertiles(p, "id", "amt", F.col("t") < 7990)
    return p.join(k, "id").groupBy("bin", (F.col("t") >= 7990).alias("post")).agg(F.count("*").alias("n"), S.rnd(F.avg("y")).alias("y"))


@query("dose_tertile_event_study")
def _(spark, sf):
    p = keep(D.nation_month(spark, sf))
    k = O.pre_tertiles(p.where("g is not null"), "id", "amt", F.col("t") < F.col("g"))
    out = None
    for name in ("Low", "Medium", "High"):
        d = p.join(k.where(F.col("bin") == name), "id", "left").where("g is null or bin is not null")
        one = E.sun_abraham(d.drop("bin"), "id", "t", "g", "y", agg="att").frame(spark).withColumn("bin", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


REGIME = "CASE WHEN g IS NULL OR t < g THEN 'none' WHEN t < g + 12 THEN 'first' ELSE 'both' END"


def regime():
    return F.when(F.col("g").isNull() | (F.col("t") < F.col("g")), "none").when(F.col("t") < F.col("g") + 12, "first").otherwise("both")


@query("regime_summary", with_(P1) + f"SELECT {REGIME} AS regime, count(*) AS n, count(DISTINCT id) AS units, " + r("avg(amt)", 5) + " AS mean, " + r("median(amt)", 5) + " AS median, " + r("stddev_samp(amt)", 5) + " AS sd FROM p1 GROUP BY 1")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumn("regime", regime())
    a = p.groupBy("regime").agg(F.count("*").alias("n"), F.count_distinct("id").alias("units"), S.rnd(F.avg("amt"), 5).alias("mean"), S.rnd(F.stddev_samp("amt"), 5).alias("sd"))
    return a.join(exact_quantiles(p, ["regime"], "amt", {"median": 0.5}).withColumn("median", S.rnd("median", 5)), "regime")


@query("staggered_regime", with_(P1) + f", k AS (SELECT id, {REGIME} AS regime, amt FROM p1 WHERE g IS NOT NULL), a AS (SELECT id, avg(amt) FILTER (regime = 'first') AS f, avg(amt) FILTER (regime = 'both') AS b FROM k GROUP BY 1) SELECT id, " + r("ln(f)") + " AS log_first, " + r("ln(b)") + " AS log_both, " + r("b/nullif(f,0)") + " AS ratio FROM a WHERE f > 0 AND b > 0")
def _(spark, sf):
    p = D.nation_month(spark, sf).where("g is not null").withColumn("regime", regime())
    a = p.groupBy("id").pivot("regime", ["first", "both"]).agg(F.avg("amt")).where("first > 0 and both > 0")
    return a.select("id", S.rnd(F.ln("first")).alias("log_first"), S.rnd(F.ln("both")).alias("log_both"), S.rnd(F.col("both") / F.nullif("first", F.lit(0.0))).alias("ratio"))


@query("event_index", with_(P1) + ", b AS (SELECT id, avg(amt) AS base FROM p1 WHERE t - g BETWEEN -6 AND -1 GROUP BY 1) SELECT t - g AS e, count(*) AS n, " + r("avg(100*amt/base)", 4) + " AS idx FROM p1 JOIN b USING (id) WHERE base > 0 AND t - g BETWEEN -12 AND 24 GROUP BY 1")
def _(spark, sf):
    p = D.nation_month(spark, sf).where("g is not null").withColumn("e", F.col("t") - F.col("g"))
    return O.event_index(p, "id", "e", "amt", -6, -1, -12, 24).withColumn("idx", S.rnd("idx", 4))


@query("pure_compare", with_(P1) + "SELECT CASE WHEN g IS NULL THEN 'never' WHEN g <= 23977 THEN 'early' ELSE 'late' END AS kind, count(DISTINCT id) AS units, " + r("sum(amt)/sum(n)", 5) + " AS per_event, " + r("avg(y)") + " AS y FROM p1 WHERE t >= 24013 GROUP BY 1")
def _(spark, sf):
    kind = F.when(F.col("g").isNull(), "never").when(F.col("g") <= 23977, "early").otherwise("late")
    p = D.nation_month(spark, sf).where("t >= 24013")
    return p.groupBy(kind.alias("kind")).agg(F.count_distinct("id").alias("units"), S.rnd(F.sum("amt") / F.sum("n"), 5).alias("per_event"), S.rnd(F.avg("y")).alias("y"))
