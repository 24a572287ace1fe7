"""Two-way fixed effects, event studies, cluster inference, generalised linear models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import fe as E
from panelwright.operators import glm as M
from panelwright.operators import imputation as P
from panelwright.operators import wild as W
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, P4, with_
from panelwright.plans.q_gt import arms_sql
from panelwright.plans.registry import query, r
from panelwright.session import keep
from panelwright.sources import tables as T



def post():
    return F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double")


def demean_sql(src="p1", extra_where="") -> str:
    """Both-way demeaned outcome y2 and treatment x2 on a balanced panel."""
    return f""", z AS (SELECT id, t, g, region, y, coalesce(t >= g, false)::INT::DOUBLE AS x FROM {src} {extra_where}),
w2 AS (SELECT *, y - avg(y) OVER (PARTITION BY id) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y2, x - avg(x) OVER (PARTITION BY id) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x2 FROM z),
be AS (SELECT sum(x2*y2)/sum(x2*x2) AS b, sum(x2*x2) AS sxx, count(*)::DOUBLE AS n, count(DISTINCT id)::DOUBLE AS gi, count(DISTINCT t)::DOUBLE AS gt, count(DISTINCT region)::DOUBLE AS gr FROM w2)"""


CLUSTER = lambda key, count: f"(SELECT sqrt(sum(s*s))/max(sxx)*sqrt((max(n)-1)/(max(n)-1-max(gt))*max({count})/(max({count})-1)) FROM (SELECT {key}, sum(x2*(y2-b*x2)) AS s FROM w2, be GROUP BY 1), be)"


@query("fe_twoway_resid", with_(P1) + demean_sql() + " SELECT id, t, " + r("y2") + " AS resid FROM w2")
def _(spark, sf):
    return E.residualize(D.nation_month(spark, sf), "id", "t", "y").select("id", "t", S.rnd("resid").alias("resid"))


@query("fe_twoway_resid_unbalanced")
def _(spark, sf):
    return E.residualize(D.customer_quarter(spark, sf), "id", "t", "y", recentre=True).select("id", "t", "resid")


@query("fe_threeway", with_(P1) + demean_sql() + " SELECT id, t, " + r("y2 + avg(y) OVER ()") + " AS deseasonalised FROM w2")
def _(spark, sf):
    # the calendar month is a function of the period, so its effect is already in there
    return E.residualize(D.nation_month(spark, sf), "id", "t", "y", recentre=True).select("id", "t", S.rnd("resid").alias("deseasonalised"))


@query("fe_predict_all", with_(P1) + ", c AS (SELECT t, avg(y) AS m FROM p1 WHERE g IS NULL GROUP BY 1) SELECT p1.id, p1.t, " + r("(SELECT avg(b.y) FROM p1 b WHERE b.id = p1.id AND b.t < 23959) + c.m - (SELECT avg(m) FROM c WHERE t < 23959)") + " AS yhat FROM p1 JOIN c ON c.t = p1.t WHERE p1.g IS NOT NULL AND p1.t >= 23959")
def _(spark, sf):
    # controls in every period plus treated units before the first cohort
    p = E.predict_all(D.nation_month(spark, sf), "id", "t", "y", F.col("g").isNull() | (F.col("t") < 23959))
    return p.where("g is not null and t >= 23959").select("id", "t", S.rnd("yhat").alias("yhat"))


@query("twfe_static", with_(P1) + demean_sql() + " SELECT " + r("b") + " AS estimate, " + r(CLUSTER("id", "gi")) + " AS se FROM be")
def _(spark, sf):
    f = E.static_effect(D.nation_month(spark, sf).withColumn("x", post()), "id", "t", "y", "x")
    return f.frame(spark).select(S.rnd("estimate").alias("estimate"), S.rnd("se").alias("se"))


@query("twfe_static_unbalanced")
def _(spark, sf):
    f = E.static_effect(D.customer_quarter(spark, sf).withColumn("x", post()), "id", "t", "y", "x")
    return f.frame(spark)


VC = with_(P1) + demean_sql() + " SELECT 'cluster_id' AS kind, " + r(CLUSTER("id", "gi")) + " AS se FROM be UNION ALL SELECT 'cluster_region', " + r(CLUSTER("region", "gr")) + " FROM be UNION ALL SELECT 'iid', " + r("(SELECT sqrt(sum(pow(y2-b*x2,2))/(max(n)-max(gi)-max(gt))/max(sxx)) FROM w2, be)") + " FROM be UNION ALL SELECT 'hc1', " + r("(SELECT sqrt(sum(pow(x2*(y2-b*x2),2))*max(n)/(max(n)-max(gi)-max(gt)))/max(sxx) FROM w2, be)") + " FROM be UNION ALL SELECT 'twoway', " + r("""(SELECT sqrt((a.v + c.v - d.v)*(n-1)/(n-gi-gt)*gi/(gi-1))/sxx FROM (SELECT sum(s*s) AS v FROM (SELECT sum(x2*(y2-b*x2)) AS s FROM w2, be GROUP BY id)) a, (SELECT sum(s*s) AS v FROM (SELECT sum(x2*(y2-b*x2)) AS s FROM w2, be GROUP BY t)) c, (SELECT sum(pow(x2*(y2-b*x2),2)) AS v FROM w2, be) d)""") + " FROM be"


@query("vcov_cluster", VC)
def _(spark, sf):
    p = keep(D.nation_month(spark, sf)).withColumn("x", post())
    rows = []
    for label, kw in (("cluster_id", {}), ("cluster_region", {"cluster": "region"}), ("iid", {"kind": "iid"}), ("hc1", {"kind": "hc1"}), ("twoway", {"kind": "twoway"})):
        rows.append((label, float(E.static_effect(p, "id", "t", "y", "x", **kw).se[0])))
    return spark.createDataFrame(rows, "kind STRING, se DOUBLE").withColumn("se", S.rnd("se"))


@query("twfe_event")
def _(spark, sf):
    return E.event_study(D.nation_month(spark, sf), "id", "t", "g", "y", -12, 24).frame(spark, "BIGINT")


@query("twfe_event_bins")
def _(spark, sf):
    f = E.event_study(D.nation_month(spark, sf), "id", "t", "g", "y", -12, 24, drop_reference_rows=True).frame(spark, "BIGINT")
    from panelwright.operators.summaries import with_reference_row

    return with_reference_row(f, term=-1, estimate=0.0, se=0.0)


@query("twfe_wald")
def _(spark, sf):
    f = E.event_study(D.nation_month(spark, sf), "id", "t", "g", "y", -6, 24)
    w = f.wald(lambda e: e < -1)
    return spark.createDataFrame([(w["statistic"], w["df1"], float(w["df2"]), w["p_value"])], "f DOUBLE, df1 INT, df2 DOUBLE, p DOUBLE")


SUN = with_(P1) + arms_sql(w="1.0", base="universal") + """, ng AS (SELECT g, count(DISTINCT id) AS ng FROM p1 WHERE g IS NOT NULL GROUP BY 1),
cw AS (SELECT att.g, att.t, att.t - att.g AS e, att, ng::DOUBLE/sum(ng) OVER (PARTITION BY att.t - att.g) AS wt FROM att JOIN ng USING (g) WHERE att.t <> att.pre),
inf AS (SELECT cw.e, psi.id, sum(wt*psi) AS v FROM cw JOIN psi ON psi.g = cw.g AND psi.t = cw.t GROUP BY 1, 2),
adj AS (SELECT sqrt((count(*)-1)/(count(*) - (SELECT count(*) FROM cw) - count(DISTINCT t))*count(DISTINCT id)/(count(DISTINCT id)-1)) AS a FROM p1),
est AS (SELECT e, sum(wt*att) AS est FROM cw GROUP BY 1)"""


@query("sunab", SUN + " SELECT inf.e AS term, " + r("max(est)") + " AS estimate, " + r("sqrt(sum(v*v))/max(nn.n)*max(a)") + " AS se FROM inf JOIN est USING (e), nn, adj GROUP BY 1")
def _(spark, sf):
    f = E.sun_abraham(D.nation_month(spark, sf), "id", "t", "g", "y").frame(spark, "BIGINT")
    return f.select("term", S.rnd("estimate").alias("estimate"), S.rnd("se").alias("se"))


@query("sunab_att", SUN + ", aw AS (SELECT cw.g, cw.t, att, ng.ng::DOUBLE/sum(ng.ng) OVER () AS wt FROM cw JOIN ng USING (g) WHERE e >= 0), ai AS (SELECT psi.id, sum(wt*psi) AS v FROM aw JOIN psi ON psi.g = aw.g AND psi.t = aw.t GROUP BY 1) SELECT " + r("(SELECT sum(wt*att) FROM aw)") + " AS estimate, " + r("sqrt(sum(v*v))/max(nn.n)*max(a)") + " AS se FROM ai, nn, adj")
def _(spark, sf):
    f = E.sun_abraham(D.nation_month(spark, sf), "id", "t", "g", "y", agg="att").frame(spark)
    return f.select(S.rnd("estimate").alias("estimate"), S.rnd("se").alias("se"))


@query("sunab_support", with_(P2) + "SELECT t - g AS e, count(DISTINCT g) AS cohorts, count(DISTINCT id) AS units, string_agg(DISTINCT g::VARCHAR, ',' ORDER BY g::VARCHAR) AS which, CASE WHEN count(DISTINCT g) >= 4 THEN 'ok' WHEN count(DISTINCT g) >= 2 THEN 'thin' ELSE 'single cohort' END AS category FROM p2 WHERE g IS NOT NULL GROUP BY 1")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).where("g is not null").withColumn("e", F.col("t") - F.col("g"))
    who = p.select("e", F.col("g").cast("string").alias("gs")).distinct().groupBy("e").agg(F.count("*").alias("cohorts"), F.array_join(F.array_sort(F.collect_list("gs")), ",").alias("which"))
    n = p.groupBy("e").agg(F.count_distinct("id").alias("units"))
    cat = F.when(F.col("cohorts") >= 4, "ok").when(F.col("cohorts") >= 2, "thin").otherwise("single cohort")
    return who.join(n, "e").withColumn("category", cat)


WILD = 999


def wild_sql(cluster: str) -> str:
    """Null residuals flipped by cluster and residualised again, every draw a panel of its own; draws that flip all clusters
    or none tie with the data up to rounding."""
    return with_(P1) + demean_sql() + f""", cl AS (SELECT *, {cluster} AS c FROM w2), u AS (SELECT c, sum(x2*y2) AS a, sum(x2*x2) AS q FROM cl GROUP BY 1),
th AS (SELECT abs(max(b))/(sqrt(sum(pow(a-b*q,2)))/max(sxx)) AS t FROM u, be),
sg AS (SELECT c, b AS bb, {S.draw31_sql('d', 4, 'c', 'b')} FROM (SELECT DISTINCT c FROM cl), range(1, {WILD + 1}) x(b)),
e AS (SELECT sg.bb, c, t, x2, (CASE WHEN d >= 1073741824 THEN 1 ELSE -1 END)*y2 AS e FROM cl JOIN sg USING (c)),
s AS (SELECT bb, c, sum(x2*(e-m)) AS s FROM (SELECT *, avg(e) OVER (PARTITION BY bb, t) AS m FROM e) GROUP BY 1, 2),
f AS (SELECT bb, sum(s)/max(sxx) AS b1, sum(s*s) AS ss, sum(s*q) AS sq, sum(q*q) AS qq, max(sxx) AS sxx FROM s JOIN u USING (c), be GROUP BY 1)
SELECT {r('max(be.b)')} AS estimate, {r('max(th.t)')} AS t_stat, {r('avg((abs(f.b1)/(sqrt(ss-2*f.b1*sq+f.b1*f.b1*qq)/f.sxx) >= th.t*(1-1e-10))::INT)')} AS p_value, count(*) AS draws FROM f, th, be"""


def _wild(w):
    return w.select(*[S.rnd(c).alias(c) for c in ("estimate", "t_stat", "p_value")], "draws")


@query("boot_wild_cluster", wild_sql("id"))
def _(spark, sf):
    return _wild(W.wild_cluster_bootstrap(D.nation_month(spark, sf).withColumn("x", post()), "id", "t", "y", "x", WILD, seed=4))


@query("boot_wild_cluster_region", wild_sql("region"))
def _(spark, sf):
    """Clusters of several units."""
    return _wild(W.wild_cluster_bootstrap(D.nation_month(spark, sf).withColumn("x", post()), "id", "t", "y", "x", WILD, seed=4, cluster="region"))


@query("boot_wild_cluster_unbalanced")
def _(spark, sf):
    return _wild(W.wild_cluster_bootstrap(D.customer_quarter(spark, sf).withColumn("x", post()), "id", "t", "y", "x", WILD, seed=4))


@query("interact_trend", with_(P1) + ", u AS (SELECT id, (g IS NOT NULL)::INT AS d, regr_sxx(y,t) AS sxx, regr_sxy(y,t) AS sxy, count(*) AS n FROM p1 GROUP BY 1, 2), b AS (SELECT d, sum(sxy)/sum(sxx) AS b, sum(sxx) AS sx FROM u GROUP BY 1) SELECT " + r("max(CASE WHEN u.d=0 THEN b END)") + " AS base_slope, " + r("max(CASE WHEN u.d=1 THEN b END)-max(CASE WHEN u.d=0 THEN b END)") + " AS difference, " + r("sqrt(sum(pow((sxy-b*sxx)/sx,2))*(sum(n)-1)/(sum(n)-3)*count(*)/(count(*)-1))") + " AS se, count(*) AS units FROM u JOIN b USING (d)")
def _(spark, sf):
    x = E.unit_slope_difference(D.nation_month(spark, sf), "id", "y", "t", F.col("g").isNotNull())
    return x.select(*[S.rnd(c).alias(c) for c in ("base_slope", "difference", "se")], "units")


@query("fe_predict_components", with_(P1) + """, k AS (SELECT id, t, y, id < 10 AS a, t < 23980 AS b FROM p1), f AS (SELECT * FROM k WHERE a = b),
i AS (SELECT id, a, avg(y) AS m FROM f GROUP BY 1, 2), p AS (SELECT t, b, avg(y) AS m FROM f GROUP BY 1, 2), o AS (SELECT a, avg(y) AS m FROM f GROUP BY 1)
SELECT k.id, k.t, """ + r("CASE WHEN k.a = k.b THEN i.m + p.m - o.m END") + " AS yhat FROM k JOIN i USING (id) JOIN p USING (t) JOIN o ON o.a = k.a")
def _(spark, sf):
    """Two blocks of units and periods without a common row: nothing is predicted across them."""
    p = D.nation_month(spark, sf)
    f = E.predict_all(p, "id", "t", "y", (F.col("id") < 10) == (F.col("t") < 23980))
    return f.select("id", "t", S.rnd("yhat").alias("yhat"))


@query("fe_lag_dose")
def _(spark, sf):
    w = Window.partitionBy("id").orderBy("t")
    p = D.nation_month(spark, sf).withColumn("dose", F.log1p("amt"))
    p = p.withColumns({"lag1": F.lag("dose", 1).over(w), "lag3": F.lag("dose", 3).over(w)}).where("lag3 is not null")
    return E.fit_fe(p, "id", "t", "y", dense=["dose", "lag1", "lag3"], names=["dose", "lag1", "lag3"]).frame(spark)


@query("placebo_fake_post", with_("p1 AS (SELECT * FROM p0 WHERE g IS NULL OR t < g)") .replace("WITH p1", "WITH " + P1.strip().replace("p1 AS", "p0 AS", 1) + ", p1") + ", k AS (SELECT id, t, y, coalesce(t >= g - 5, false)::INT AS x FROM p1) SELECT count(*) AS n, sum(x)::BIGINT AS fake_post, count(DISTINCT id) AS units FROM k")
def _(spark, sf):
    p = D.nation_month(spark, sf).where("g is null or t < g").withColumn("x", F.coalesce(F.col("t") >= F.col("g") - 5, F.lit(False)).cast("double"))
    f = E.static_effect(p, "id", "t", "y", "x")
    return p.agg(F.count("*").alias("n"), F.sum("x").cast("bigint").alias("fake_post")).withColumn("units", F.lit(f.n_units).cast("bigint"))


@query("placebo_estimate")
def _(spark, sf):
    p = D.nation_month(spark, sf).where("g is null or t < g").withColumn("x", F.coalesce(F.col("t") >= F.col("g") - 5, F.lit(False)).cast("double"))
    return E.static_effect(p, "id", "t", "y", "x").frame(spark)


STEPS = 400

# Untreated rows of the balanced panel: unit and period effects by repeated demeaning of cohort means, and the weights that the
# treated rows' averages carry back to them (per event time e; null: all treated rows) by the same steps on the weights.
IMP = "WITH RECURSIVE " + P1.strip() + f""",
u AS (SELECT coalesce(g, 0) AS g, t, avg(y) AS m, count(*) AS nn FROM p1 GROUP BY 1, 2),
f AS (SELECT * FROM u WHERE g = 0 OR t < g),
ia AS (SELECT 0 AS k, g, 0.0::DOUBLE AS a FROM (SELECT DISTINCT g FROM f) UNION ALL
  SELECT k + 1, g, avg(m - lam) FROM (SELECT ia.k, f.g, f.m, sum(nn*(m - a)) OVER (PARTITION BY f.t)/sum(nn) OVER (PARTITION BY f.t) AS lam FROM ia JOIN f USING (g) WHERE k < {STEPS}) GROUP BY 1, 2),
la AS (SELECT t, sum(nn*(m - a))/sum(nn) AS l FROM f JOIN (SELECT g, a FROM ia WHERE k = {STEPS}) USING (g) GROUP BY 1),
ai AS (SELECT id, avg(y - l) AS a FROM p1 JOIN la USING (t) WHERE g IS NULL OR t < g GROUP BY 1),
tau AS (SELECT id, g, t, t - g AS e, y - a - l AS tau FROM p1 JOIN la USING (t) JOIN ai USING (id) WHERE t >= g),
lv AS (SELECT e, count(*) AS n, avg(tau) AS att FROM tau GROUP BY 1 UNION ALL SELECT NULL, count(*), avg(tau) FROM tau),
rq AS (SELECT lv.e, f.g, f.t, nn, coalesce((SELECT count(DISTINCT t) FROM tau x WHERE x.g = f.g AND (lv.e IS NULL OR x.e = lv.e)), 0)/lv.n AS r,
  coalesce((SELECT count(*) FROM tau x WHERE x.t = f.t AND (lv.e IS NULL OR x.e = lv.e)), 0)/lv.n AS q FROM lv, f),
ib AS (SELECT 0 AS k, e, g, 0.0::DOUBLE AS b FROM (SELECT DISTINCT e, g FROM rq) UNION ALL
  SELECT k + 1, e, g, (max(r) - sum(mu))/count(*) FROM (
    SELECT ib.k, rq.e, rq.g, rq.r, (rq.q - sum(nn*b) OVER (PARTITION BY rq.e, rq.t))/sum(nn) OVER (PARTITION BY rq.e, rq.t) AS mu
    FROM ib JOIN rq ON ib.g = rq.g AND ib.e IS NOT DISTINCT FROM rq.e WHERE k < {STEPS}) GROUP BY 1, 2, 3),
mu AS (SELECT rq.e, t, (max(q) - sum(nn*b))/sum(nn) AS mu FROM rq JOIN (SELECT * FROM ib WHERE k = {STEPS}) z ON z.g = rq.g AND z.e IS NOT DISTINCT FROM rq.e GROUP BY 1, 2),
cm AS (SELECT g, e, avg(tau) AS c FROM tau GROUP BY 1, 2),
sc AS (SELECT lv.e, id, sum((tau - att)/n) AS s1, sum((tau - c)/n) AS s2, 1 AS hit FROM tau JOIN cm USING (g, e) JOIN lv ON lv.e IS NULL OR lv.e = tau.e GROUP BY 1, 2
  UNION ALL SELECT mu.e, id, -sum(mu*(y - a - l)), -sum(mu*(y - a - l)), 0 FROM p1 JOIN la USING (t) JOIN ai USING (id) JOIN mu USING (t) WHERE g IS NULL OR p1.t < g GROUP BY 1, 2),
se AS (SELECT e, sqrt(sum(s1*s1)) AS se, sqrt(sum(s2*s2)) AS se_cells, sum(hit)::BIGINT AS units FROM (SELECT e, id, sum(s1) AS s1, sum(s2) AS s2, max(hit) AS hit FROM sc GROUP BY 1, 2) GROUP BY 1)
SELECT lv.e, """ + r("att") + " AS att, " + r("se") + " AS se, " + r("se_cells") + " AS se_cells, n AS n_treated_rows, units FROM lv JOIN se ON lv.e IS NOT DISTINCT FROM se.e"


def _imputed(f):
    return f.select("e", *[S.rnd(c).alias(c) for c in ("att", "se", "se_cells")], "n_treated_rows", "units")


@query("imputation_att", IMP + " WHERE lv.e IS NULL")
def _(spark, sf):
    return _imputed(P.imputation_effects(D.nation_month(spark, sf), "id", "t", "g", "y")).where("e is null")


@query("imputation_event", IMP + " WHERE lv.e IS NOT NULL")
def _(spark, sf):
    return _imputed(P.imputation_effects(D.nation_month(spark, sf), "id", "t", "g", "y")).where("e is not null")


@query("imputation_unbalanced")
def _(spark, sf):
    return _imputed(P.imputation_effects(D.customer_quarter(spark, sf), "id", "t", "g", "y"))


@query("imputation_weights", IMP.rsplit("SELECT lv.e", 1)[0] + f""", bg AS (SELECT g, b FROM ib WHERE k = {STEPS} AND e IS NULL)
SELECT id AS unit, p1.t, coalesce(p1.t >= p1.g, false) AS treated, """ + r("CASE WHEN p1.t >= p1.g THEN 1.0/nt ELSE -(b + mu) END", 9) + """ AS weight
FROM p1 JOIN bg ON bg.g = coalesce(p1.g, 0) LEFT JOIN mu ON mu.t = p1.t AND mu.e IS NULL, (SELECT n AS nt FROM lv WHERE e IS NULL)""")
def _(spark, sf):
    w = P.imputation_weights(D.nation_month(spark, sf), "id", "t", "g", "y")
    return w.select("unit", "t", "treated", S.rnd("weight", 9).alias("weight"))


# ---- generalised linear models -------------------------------------------

# A saturated binary design: fitted means are cell means, coefficients their links.
GLM_COEF = lambda link: with_(P4) + ", m AS (SELECT x1, sum(w*{y})/sum(w) AS m FROM p4 GROUP BY 1) SELECT 'const' AS term, " + r(link + "(max(CASE WHEN x1=0 THEN m END))") + " AS estimate FROM m UNION ALL SELECT 'x1', " + r(link + "(max(CASE WHEN x1=1 THEN m END)) - " + link + "(max(CASE WHEN x1=0 THEN m END))") + " FROM m"


def one():
    return [F.lit(1.0), F.col("x1")]


def _glm(spark, sf, fam, y="d", w="w", link=None):
    return M.glm_fit(D.cross_section(spark, sf), y, one(), M.family(fam, link), w, tol=1e-12, names=["const", "x1"])


def _coefs(spark, fit):
    return spark.createDataFrame([(n, float(b)) for n, b in zip(fit.names, fit.coef)], "term STRING, estimate DOUBLE").withColumn("estimate", S.rnd("estimate"))


LOGIT = with_(P4) + ", m AS (SELECT x1, sum(w*d)/sum(w) AS m FROM p4 GROUP BY 1) SELECT 'const' AS term, " + r("ln(max(CASE WHEN x1=0 THEN m/(1-m) END))") + " AS estimate FROM m UNION ALL SELECT 'x1', " + r("ln(max(CASE WHEN x1=1 THEN m/(1-m) END)) - ln(max(CASE WHEN x1=0 THEN m/(1-m) END))") + " FROM m"
query("glm_fit", LOGIT)(lambda spark, sf: _coefs(spark, _glm(spark, sf, "binomial")))
query("glm_fit_poisson", GLM_COEF("ln").replace("{y}", "y"))(lambda spark, sf: _coefs(spark, _glm(spark, sf, "poisson", "y")))
query("glm_fit_gamma", GLM_COEF("sqrt").replace("{y}", "y"))(lambda spark, sf: _coefs(spark, _glm(spark, sf, "gamma", "y", link="sqrt")))
query("glm_fit_gaussian", GLM_COEF("").replace("{y}", "y"))(lambda spark, sf: _coefs(spark, _glm(spark, sf, "gaussian", "y")))


@query("udf_family", GLM_COEF("ln").replace("{y}", "y"))
def _(spark, sf):
    # a user family: variance proportional to the mean squared, log link
    fam = M.Family("user", F.ln, F.exp, F.exp, lambda m: m * m, lambda y, m: 2 * ((y - m) / m - F.ln(y / m)), lambda y: y)
    return _coefs(spark, M.glm_fit(D.cross_section(spark, sf), "y", one(), fam, "w", tol=1e-12, names=["const", "x1"]))


# Outcome on x1 and on z = x1 + 1e-9 h: the same fit as on x1 and h, whose coefficient is that of h around its mean per x1.
ILL = with_(P4) + """, m AS (SELECT y, x1, (w > 25)::INT::DOUBLE AS h, avg(y) OVER (PARTITION BY x1) AS my, avg((w > 25)::INT::DOUBLE) OVER (PARTITION BY x1) AS mh FROM p4),
c AS (SELECT sum((h-mh)*y)/sum((h-mh)*(h-mh)) AS c, sum((y-my)*(y-my)) AS s, sum((h-mh)*(h-mh)) AS hh FROM m)
SELECT """ + r("c", 4) + " AS slope_h, " + r("s - c*c*hh", 3) + " AS deviance, 3 AS rank FROM c"


def _ill(method):
    def run(spark, sf):
        p = D.cross_section(spark, sf).withColumn("h", (F.col("w") > 25).cast("double"))
        f = M.glm_fit(p, "y", [F.lit(1.0), F.col("x1"), F.col("x1") + F.col("h") * 1e-9], M.family("gaussian"), method=method)
        return spark.createDataFrame([(float(f.coef[2] * 1e-9), f.deviance, f.rank)], "slope_h DOUBLE, deviance DOUBLE, rank INT").select(S.rnd("slope_h", 4).alias("slope_h"), S.rnd("deviance", 3).alias("deviance"), "rank")

    return run


query("glm_fit_qr", ILL)(_ill("qr"))
query("glm_fit_pivoted_qr", ILL)(_ill("pivoted_qr"))
query("glm_fit_svd", ILL)(_ill("svd"))


@query("glm_aliased", with_(P4) + "SELECT unnest(['const', 'x1', 'x1_twice']) AS term, unnest([" + r("max(CASE WHEN x1=0 THEN m END)") + ", NULL, " + r("(max(CASE WHEN x1=1 THEN m END) - max(CASE WHEN x1=0 THEN m END))/2") + "]) AS estimate, 2 AS rank FROM (SELECT x1, avg(y) AS m FROM p4 GROUP BY 1)")
def _(spark, sf):
    f = M.glm_fit(D.cross_section(spark, sf), "y", [F.lit(1.0), F.col("x1"), 2 * F.col("x1")], M.family("gaussian"), names=["const", "x1", "x1_twice"], method="pivoted_qr")
    return spark.createDataFrame([(t[0], t[1], f.rank) for t in f.summary()], "term STRING, estimate DOUBLE, rank INT").withColumn("estimate", S.rnd("estimate"))


# Fitted means of the saturated design are cell means; the dispersion of the likelihood is deviance over rows.
LOGLIK = with_(P4) + """, m AS (SELECT d, y, avg(d) OVER (PARTITION BY x1) AS md, avg(y) OVER (PARTITION BY x1) AS my FROM p4),
v AS (SELECT count(*)::DOUBLE AS n, sum((y-my)*(y-my)) AS s, sum(-2*(ln(y/my) - (y-my)/my)) AS g, sum(ln(y)) AS ly, sum(ln(my)) AS lm, sum(y/my) AS ry, sum(CASE WHEN d=1 THEN ln(md) ELSE ln(1-md) END) AS b FROM m)
SELECT 'binomial' AS family, """ + r("b", 3) + " AS loglik FROM v UNION ALL SELECT 'gaussian', " + r("-n/2*(ln(2*pi()*s/n)+1)", 3) + " FROM v UNION ALL SELECT 'gamma', " + r("n/g*n*ln(n/g) - n*lgamma(n/g) + (n/g-1)*ly - n/g*lm - n/g*ry", 3) + " FROM v"


@query("glm_loglik", LOGLIK)
def _(spark, sf):
    rows = [("binomial", "d", None), ("gaussian", "y", None), ("gamma", "y", "sqrt")]
    got = [(n, M.glm_fit(D.cross_section(spark, sf), y, one(), M.family(n, link), tol=1e-12).loglik) for n, y, link in rows]
    return spark.createDataFrame(got, "family STRING, loglik DOUBLE").withColumn("loglik", S.rnd("loglik", 3))


@query("glm_big")
def _(spark, sf):
    """Forty columns: cross products go through Arrow batches."""
    li = T.table(spark, sf, "lineitem")
    dummies = [(F.pmod(F.col("l_suppkey"), F.lit(38)) == i).cast("double") for i in range(1, 38)]
    xs = [F.lit(1.0), F.col("l_discount"), F.col("l_tax"), *dummies]
    fit = M.glm_fit(li, (F.col("l_returnflag") == "R").cast("double"), xs, M.family("binomial"))
    return spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(fit.names, fit.coef, fit.se)], "term STRING, estimate DOUBLE, se DOUBLE")


@query("glm_summary", with_(P4) + ", m AS (SELECT x1, avg(d) AS m, count(*) AS n FROM p4 GROUP BY 1), k AS (SELECT max(CASE WHEN x1=0 THEN m END) AS a, max(CASE WHEN x1=1 THEN m END) AS b, max(CASE WHEN x1=0 THEN n END) AS na, max(CASE WHEN x1=1 THEN n END) AS nb FROM m) SELECT 'const' AS term, " + r("ln(a/(1-a))") + " AS estimate, " + r("1/sqrt(na*a*(1-a))") + " AS se, " + r("ln(a/(1-a))*sqrt(na*a*(1-a))", 4) + " AS stat FROM k UNION ALL SELECT 'x1', " + r("ln(b/(1-b))-ln(a/(1-a))") + ", " + r("sqrt(1/(na*a*(1-a))+1/(nb*b*(1-b)))") + ", " + r("(ln(b/(1-b))-ln(a/(1-a)))/sqrt(1/(na*a*(1-a))+1/(nb*b*(1-b)))", 4) + " FROM k")
def _(spark, sf):
    s = _glm(spark, sf, "binomial", w=None).summary()
    t = spark.createDataFrame([x[:4] for x in s], "term STRING, estimate DOUBLE, se DOUBLE, stat DOUBLE")
    return t.select("term", S.rnd("estimate").alias("estimate"), S.rnd("se").alias("se"), S.rnd("stat", 4).alias("stat"))


@query("glm_deviance", with_(P4) + ", m AS (SELECT *, avg(d) OVER (PARTITION BY x1) AS m, avg(d) OVER () AS m0 FROM p4) SELECT " + r("-2*sum(CASE WHEN d=1 THEN ln(m) ELSE ln(1-m) END)", 4) + " AS deviance, " + r("-2*sum(CASE WHEN d=1 THEN ln(m0) ELSE ln(1-m0) END)", 4) + " AS null_deviance, " + r("-2*sum(CASE WHEN d=1 THEN ln(m) ELSE ln(1-m) END) + 4", 4) + " AS aic, count(*) - 2 AS df_residual FROM m")
def _(spark, sf):
    f = _glm(spark, sf, "binomial", w=None)
    return spark.createDataFrame([(f.deviance, f.null_deviance, f.deviance + 2 * f.rank, f.df_residual)], "deviance DOUBLE, null_deviance DOUBLE, aic DOUBLE, df_residual BIGINT").select(*[S.rnd(c, 4).alias(c) for c in ("deviance", "null_deviance", "aic")], "df_residual")


@query("glm_predict", with_(P4) + "SELECT x1, " + r("sum(w*d)/sum(w)") + " AS response, " + r("ln((sum(w*d)/sum(w))/(1-sum(w*d)/sum(w)))") + " AS link, count(*) AS n FROM p4 GROUP BY 1")
def _(spark, sf):
    f = _glm(spark, sf, "binomial")
    p = D.cross_section(spark, sf).groupBy("x1").agg(F.count("*").alias("n"))
    return p.select("x1", S.rnd(f.predict(one())).alias("response"), S.rnd(f.predict(one(), "link")).alias("link"), "n")


@query("glm_residuals", with_(P4) + ", m AS (SELECT *, sum(w*d) OVER (PARTITION BY x1)/sum(w) OVER (PARTITION BY x1) AS m FROM p4) SELECT x1, d, " + r("avg(d-m)") + " AS response, " + r("avg((d-m)/(m*(1-m)))") + " AS working, " + r("avg((d-m)/sqrt(m*(1-m)))") + " AS pearson, " + r("avg(CASE WHEN d=1 THEN sqrt(-2*ln(m)) ELSE -sqrt(-2*ln(1-m)) END)") + " AS deviance FROM m GROUP BY 1, 2")
def _(spark, sf):
    f = _glm(spark, sf, "binomial")
    return D.cross_section(spark, sf).groupBy("x1", "d").agg(*[S.rnd(F.avg(f.residual("d", one(), k))).alias(k) for k in ("response", "working", "pearson", "deviance")])


@query("mat_ops", "SELECT 'l_quantity' AS \"column\", " + r("sum(l_quantity)", 2) + " AS total, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem UNION ALL SELECT 'l_discount', " + r("sum(l_discount)", 2) + ", max(l_discount), min(l_discount) FROM lineitem")
def _(spark, sf):
    return M.column_bounds(T.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]).withColumn("total", S.rnd("total", 2))
