"""Two-period estimators.

The SQL side uses one binary covariate, which makes logit and least squares
equal to stratum means, so every estimator has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import did2x2 as E
from panelwright.operators.design import model_matrix
from panelwright.operators.glm import family, glm_fit
from panelwright.operators.factors import column_factor, independent
from panelwright.plans import panels as D
from panelwright.plans.panels import P2, P4, P5, with_
from panelwright.plans.registry import query, r


def shown(df, digits=6):
    return df.select("n", *[S.rnd(c, digits).alias(c) for c in ("att", "se", "lci", "uci")])


OUT = f"count(*) AS n, {r('max(att)')} AS att, {r('max(se)')} AS se, {r('max(att) - 1.96*max(se)')} AS lci, {r('max(att) + 1.96*max(se)')} AS uci"
FINAL = " SELECT n, " + ", ".join(r(e) + f" AS {a}" for e, a in (("att", "att"), ("se", "se"), ("att - 1.96*se", "lci"), ("att + 1.96*se", "uci"))) + " FROM res"

PANEL_SQL = with_(P5) + """, a AS (SELECT *, y1 - y0 AS dy, w / avg(w) OVER () AS wn FROM p5),
b AS (SELECT *, sum(wn*(1-d)*dy) OVER s / sum(wn*(1-d)) OVER s AS m, sum(wn*d) OVER s / sum(wn*(1-d)) OVER s AS odds FROM a WINDOW s AS (PARTITION BY x1)),
att AS (SELECT sum(wn*d*(dy-m))/sum(wn*d) AS att, avg(wn*d) AS wd FROM b),
psi AS (SELECT att, (wn*d*(dy - m - att) - wn*(1-d)*odds*(dy-m))/wd AS psi FROM b, att),
res AS (SELECT count(*) AS n, max(att) AS att, stddev_samp(psi)*sqrt(count(*)-1)/count(*) AS se FROM psi)""" + FINAL


def _panel(method):
    def run(spark, sf):
        return shown(E.did_2x2(D.two_period(spark, sf), method, y1="y1", y0="y0", d="d", xs=["x1"], w="w"))

    return run


for _m in E.PANEL_METHODS:
    query({"reg": "did_reg_panel", "ipw": "did_ipw_panel", "sipw": "did_sipw_panel", "dr": "did_dr_panel", "dr_imp": "did_dr_imp_panel"}[_m], PANEL_SQL)(_panel(_m))

RC_BASE = with_(P4) + """, a AS (SELECT *, 1 - post AS q, w / avg(w) OVER () AS wn FROM p4),
b AS (SELECT *, sum(wn*d) OVER s / sum(wn) OVER s AS ps,
  sum(wn*(1-d)*post*y) OVER s / sum(wn*(1-d)*post) OVER s AS mc1, sum(wn*(1-d)*q*y) OVER s / sum(wn*(1-d)*q) OVER s AS mc0,
  sum(wn*d*post*y) OVER s / sum(wn*d*post) OVER s AS mt1, sum(wn*d*q*y) OVER s / sum(wn*d*q) OVER s AS mt0,
  sum(wn*d) OVER s AS w1s, sum(wn*(1-d)*post) OVER s AS g01, sum(wn*(1-d)*q) OVER s AS g00, sum(wn*d*post) OVER s AS g11, sum(wn*d*q) OVER s AS g10,
  count(*) OVER () AS n FROM a WINDOW s AS (PARTITION BY x1)),
c AS (SELECT *, sum(wn*ps*(1-ps)) OVER (PARTITION BY x1) AS hs, wn*d AS wd, wn*d*post AS wt1, wn*d*q AS wt0, wn*ps/(1-ps)*(1-d)*post AS wc1, wn*ps/(1-ps)*(1-d)*q AS wc0 FROM b)"""
SE = ", res AS (SELECT count(*) AS n, max(att) AS att, stddev_samp(psi)*sqrt(count(*)-1)/count(*) AS se FROM psi)" + FINAL

RC_SQL = {
    "reg": RC_BASE + """, m AS (SELECT sum(wt1*y)/sum(wt1) AS e1, sum(wt0*y)/sum(wt0) AS e0, sum(wd*(mc1-mc0))/sum(wd) AS ec, avg(wt1) AS t1, avg(wt0) AS t0, avg(wd) AS d1 FROM c),
psi AS (SELECT e1-e0-ec AS att, wt1*(y-e1)/t1 - wt0*(y-e0)/t0 - (wd*(mc1-mc0-ec) + wn*(1-d)*post*(y-mc1)*w1s/g01 - wn*(1-d)*q*(y-mc0)*w1s/g00)/d1 AS psi FROM c, m)""" + SE,
    "ipw": RC_BASE + """, m AS (SELECT avg(wd) AS pi, avg(wn*post) AS l1, avg(wn*q) AS l0, avg(wt1*y) AS a, avg(wt0*y) AS b, avg(wc1*y) AS e, avg(wc0*y) AS f FROM c),
k AS (SELECT *, a/(pi*l1) AS t1, b/(pi*l0) AS t0, e/(pi*l1) AS u1, f/(pi*l0) AS u0 FROM m),
z AS (SELECT c.*, k.*, sum(-wc1*y/(pi*l1) + wc0*y/(pi*l0)) OVER (PARTITION BY x1)/hs AS v FROM c, k),
psi AS (SELECT (t1-t0)-(u1-u0) AS att,
 ((wt1-wc1)*y/(pi*l1) - (t1-u1) - (wd-pi)*(t1-u1)/pi - (wn*post-l1)*(t1-u1)/l1) - ((wt0-wc0)*y/(pi*l0) - (t0-u0) - (wd-pi)*(t0-u0)/pi - (wn*q-l0)*(t0-u0)/l0) + wn*(d-ps)*v AS psi FROM z)""" + SE,
}


def _rc_general(u: str, score: bool, full: bool, ols: str | None) -> str:
    return RC_BASE + f""", cu AS (SELECT *, {u} AS u FROM c),
m AS (SELECT sum(wt1*u)/sum(wt1) AS e1, sum(wt0*u)/sum(wt0) AS e0, sum(wc1*u)/sum(wc1) AS u1, sum(wc0*u)/sum(wc0) AS u0,
 sum(wt1) AS st1, sum(wt0) AS st0, sum(wc1) AS sc1, sum(wc0) AS sc0, sum(wd) AS sd,
 sum(wd*(mt1-mc1))/sum(wd) AS q1, sum(wt1*(mt1-mc1))/sum(wt1) AS r1, sum(wd*(mt0-mc0))/sum(wd) AS q0, sum(wt0*(mt0-mc0))/sum(wt0) AS r0 FROM cu),
z AS (SELECT cu.*, m.*,
 sum(wc1*(u-u1)/sc1 - wc0*(u-u0)/sc0) OVER (PARTITION BY x1)*n/hs AS v,
 sum(-wt1/st1 + wc1/sc1) OVER (PARTITION BY x1) AS net1, sum(-wt0/st0 + wc0/sc0) OVER (PARTITION BY x1) AS net0,
 sum(wd/sd - wt1/st1) OVER (PARTITION BY x1) AS mom1, sum(wd/sd - wt0/st0) OVER (PARTITION BY x1) AS mom0 FROM cu, m),
psi AS (SELECT (e1-e0)-(u1-u0){' + (q1-r1) - (q0-r0)' if full else ''} AS att,
 n*(wt1*(u-e1)/st1 - wt0*(u-e0)/st0 - wc1*(u-u1)/sc1 + wc0*(u-u0)/sc0)
 {'+ n*(wd*(mt1-mc1-q1)/sd - wt1*(mt1-mc1-r1)/st1 - wd*(mt0-mc0-q0)/sd + wt0*(mt0-mc0-r0)/st0)' if full else ''}
 {'- wn*(d-ps)*v' if score else ''}
 {'' if ols is None else '+ n*wn*(1-d)*(post*(y-mc1)*(net1' + ('-mom1' if ols == 'full' else '') + ')/g01 + q*(y-mc0)*(net0' + ('+mom0' if ols == 'full' else '') + ')/g00)'}
 {'+ n*wn*d*(post*(y-mt1)*mom1/g11 - q*(y-mt0)*mom0/g10)' if ols == 'full' else ''} AS psi FROM z)""" + SE


RESID = "y - (post*mc1 + q*mc0)"
RC_SQL.update({
    "sipw": _rc_general("y", True, False, None),
    "dr": _rc_general(RESID, True, True, "full"),
    "dr1": _rc_general(RESID, True, False, "control"),
    "dr_imp": _rc_general(RESID, False, True, None),
    "dr_imp1": _rc_general(RESID, False, False, None),
})
RC_NAMES = {"reg": "did_reg_rc", "ipw": "did_ipw_rc", "sipw": "did_sipw_rc", "dr": "did_dr_rc", "dr1": "did_dr_rc1", "dr_imp": "did_dr_imp_rc", "dr_imp1": "did_dr_imp_rc1"}


def _rc(method):
    def run(spark, sf):
        return shown(E.did_2x2(D.cross_section(spark, sf), method, y="y", d="d", post="post", xs=["x1"], w="w"))

    return run


for _m, _n in RC_NAMES.items():
    query(_n, RC_SQL[_m])(_rc(_m))

# Without covariates the product coefficient is the difference of mean differences.
TWFE_SQL = lambda cte, src: with_(cte) + f""", a AS (SELECT *, w/avg(w) OVER () AS wn FROM ({src})),
b AS (SELECT *, sum(wn*y) OVER g / sum(wn) OVER g AS m, sum(wn) OVER g AS sw, count(*) OVER () AS n FROM a WINDOW g AS (PARTITION BY d, post)),
psi AS (SELECT n*wn*(y-m)/sw*(CASE WHEN d = post THEN 1 ELSE -1 END) AS psi FROM b),
pt AS (SELECT sum(CASE WHEN d = post THEN m ELSE -m END) AS att FROM (SELECT DISTINCT d, post, m FROM b)),
res AS (SELECT count(*) AS n, max(att) AS att, stddev_samp(psi)/sqrt(count(*)) AS se FROM psi, pt)""" + FINAL


@query("did_twfe_panel", TWFE_SQL(P5, "SELECT y0 AS y, d, 0.0 AS post, w FROM p5 UNION ALL SELECT y1, d, 1.0, w FROM p5"))
def _(spark, sf):
    p = D.two_period(spark, sf).select("d", "w", F.explode(F.array(F.struct(F.lit(0.0).alias("post"), F.col("y0").alias("y")), F.struct(F.lit(1.0).alias("post"), F.col("y1").alias("y")))).alias("o"))
    return shown(E.twfe_2x2(p.select("d", "w", "o.*"), "y", "d", "post", w="w"))


@query("did_twfe_rc", TWFE_SQL(P4, "SELECT y, d, post, w FROM p4"))
def _(spark, sf):
    return shown(E.twfe_2x2(D.cross_section(spark, sf), "y", "d", "post", w="w"))


@query("did_formula", PANEL_SQL.replace("SELECT n,", "SELECT 'dr' AS method, n,").replace("FROM res", "FROM res UNION ALL SELECT 'reg', n, round(att,6)+0.0, round(se,6)+0.0, round(att-1.96*se,6)+0.0, round(att+1.96*se,6)+0.0 FROM res"))
def _(spark, sf):
    p = D.two_period(spark, sf)
    long = p.select("id", "d", "x1", "w", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("t"), F.col("y1").alias("y")))).alias("o")).select("id", "d", "x1", "w", "o.*")
    a = [shown(E.did_long(long, m, "y", "t", "d", unit="id", xs=["x1"], w="w")).withColumn("method", F.lit(m)) for m in ("dr", "reg")]
    return a[0].unionByName(a[1])


@query("did_preprocess", with_(P2) + """, z AS (SELECT id, (t // 4) AS yr, max((id % 3 = 0)::INT)::DOUBLE AS d, avg(y) AS y, max(id % 2)::DOUBLE AS x FROM p2 WHERE t // 4 IN (1996, 1999) GROUP BY 1, 2),
u AS (SELECT id, count(DISTINCT yr) AS p, max(d) AS d FROM z GROUP BY 1)
SELECT 'periods' AS "check", count(DISTINCT yr) AS found, 2::BIGINT AS wanted, count(DISTINCT yr) = 2 AS ok FROM z UNION ALL SELECT 'groups', count(DISTINCT d), 2, count(DISTINCT d) = 2 FROM z
UNION ALL SELECT 'missing_outcomes', count(*) FILTER (y IS NULL), 0, count(*) FILTER (y IS NULL) = 0 FROM z
UNION ALL SELECT 'unbalanced_units', count(*) FILTER (p <> 2), 0, count(*) FILTER (p <> 2) = 0 FROM u UNION ALL SELECT 'time_varying_units', 0, 0, true
UNION ALL SELECT 'smallest_group', least(count(*) FILTER (p = 2 AND d = 1), count(*) FILTER (p = 2 AND d = 0)), 6, least(count(*) FILTER (p = 2 AND d = 1), count(*) FILTER (p = 2 AND d = 0)) >= 6 FROM u""")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).withColumn("yr", F.floor(F.col("t") / 4)).where(F.col("yr").isin(1996, 1999))
    z = p.groupBy("id", "yr").agg(F.avg("y").alias("y")).withColumns({"d": (F.col("id") % 3 == 0).cast("double"), "x": (F.col("id") % 2).cast("double")})
    return E.preprocess_report(z, "y", "yr", "d", "id", ["x"])


@query("did_support_safe", with_(P4) + "SELECT x1, count(*) FILTER (d=1 AND post=0) AS n_treat_pre, count(*) FILTER (d=1 AND post=1) AS n_treat_post, count(*) FILTER (d=0 AND post=0) AS n_control_pre, count(*) FILTER (d=0 AND post=1) AS n_control_post, CASE WHEN x1 = 1 THEN NULL ELSE " + r("avg(y) FILTER (d=1 AND post=1) - avg(y) FILTER (d=1 AND post=0) - avg(y) FILTER (d=0 AND post=1) + avg(y) FILTER (d=0 AND post=0)") + " END AS att, CASE WHEN x1 = 1 THEN 'n_treat_post=0' END AS reason FROM p4 WHERE NOT (x1 = 1 AND d = 1 AND post = 1) GROUP BY 1")
def _(spark, sf):
    p = D.cross_section(spark, sf).where("not (x1 = 1 and d = 1 and post = 1)")
    res = E.estimate_cells(p, "reg", "y", "d", post="post", cell=F.col("x1").cast("bigint")).table
    q = lambda a, b: F.count_if((F.col("d") == a) & (F.col("post") == b))
    n = p.groupBy("x1").agg(q(1, 0).alias("n_treat_pre"), q(1, 1).alias("n_treat_post"), q(0, 0).alias("n_control_pre"), q(0, 1).alias("n_control_post"))
    return n.join(res, n.x1.cast("bigint") == res._cell).select("x1", "n_treat_pre", "n_treat_post", "n_control_pre", "n_control_post", S.rnd("att").alias("att"), "reason")


PS = ", s AS (SELECT x1, sum(w*d)/sum(w*(1-d)) AS odds FROM p5 GROUP BY 1)"


@query("pscore_calibrated", with_(P5) + PS + " SELECT x1, " + r("odds/(1+odds)") + " AS ps, 0 AS flag FROM s")
def _(spark, sf):
    p = D.two_period(spark, sf)
    base = p.select(F.lit(0).cast("bigint").alias(E.CELL), F.col("d").alias(E.D), F.col("w").alias(E.W), F.lit(1.0).alias("_x0"), F.col("x1").alias("_x1"))
    job = E._Job(base, 2, True)
    gamma, flag = E.batched_calibrated(job, base, [0])
    return p.select("x1").distinct().select("x1", S.rnd(S.logistic(S.linear(gamma[0], [F.lit(1.0), F.col("x1")]))).alias("ps"), F.lit(flag[0]).alias("flag"))


@query("did_aipw", with_(P5) + PS + ", m AS (SELECT x1, sum(w*(1-d)*(y1-y0))/sum(w*(1-d)) AS m FROM p5 GROUP BY 1) SELECT " + r("sum(w*(d - odds*(1-d))*(y1-y0-m))/sum(w*d)") + " AS att FROM p5 JOIN s USING (x1) JOIN m USING (x1)")
def _(spark, sf):
    p = D.two_period(spark, sf).withColumn("dy", F.col("y1") - F.col("y0"))
    # x1 is 0 or 1: two small rows go to the tasks, the rows stay where they are.
    strata = p.groupBy("x1").agg((F.sum(F.expr("w*d")) / F.sum("w")).alias("ps"), (F.sum(F.expr("w*(1-d)*dy")) / F.sum(F.expr("w*(1-d)"))).alias("m"))
    return p.join(F.broadcast(strata), "x1").agg(S.rnd(E.aipw_panel("dy", "d", "ps", "m", "w")).alias("att"))


@query("did_aipw_rc", RC_BASE + " SELECT " + r("sum(wt1*(y-mc1))/sum(wt1) - sum(wt0*(y-mc0))/sum(wt0) - sum(wc1*(y-mc1))/sum(wc1) + sum(wc0*(y-mc0))/sum(wc0)") + " AS att1, " + r("sum(wt1*(y-mc1))/sum(wt1) - sum(wt0*(y-mc0))/sum(wt0) - sum(wc1*(y-mc1))/sum(wc1) + sum(wc0*(y-mc0))/sum(wc0) + sum(wd*(mt1-mc1))/sum(wd) - sum(wt1*(mt1-mc1))/sum(wt1) - sum(wd*(mt0-mc0))/sum(wd) + sum(wt0*(mt0-mc0))/sum(wt0)") + " AS att FROM c")
def _(spark, sf):
    p = D.cross_section(spark, sf)
    m = lambda a, b: (F.sum(F.when((F.col("d") == a) & (F.col("post") == b), F.col("w") * F.col("y"))) / F.sum(F.when((F.col("d") == a) & (F.col("post") == b), F.col("w"))))
    st = p.groupBy("x1").agg((F.sum(F.expr("w*d")) / F.sum("w")).alias("ps"), m(0, 1).alias("c1"), m(0, 0).alias("c0"), m(1, 1).alias("t1"), m(1, 0).alias("t0"))
    return p.join(F.broadcast(st), "x1").agg(S.rnd(E.aipw_rc("y", "post", "d", "ps", "w", "c1", "c0")).alias("att1"), S.rnd(E.aipw_rc("y", "post", "d", "ps", "w", "c1", "c0", "t1", "t0")).alias("att"))


@query("did_wols", RC_BASE + ", k AS (SELECT x1, max(mc1) AS m FROM c GROUP BY 1) SELECT 0 AS position, " + r("max(CASE WHEN x1 = 0 THEN m END)") + " AS coef FROM k UNION ALL SELECT 1, " + r("max(CASE WHEN x1 = 1 THEN m END) - max(CASE WHEN x1 = 0 THEN m END)") + " FROM k")
def _(spark, sf):
    p = D.cross_section(spark, sf)
    p = p.join(F.broadcast(p.groupBy("x1").agg((F.sum(F.expr("w*d")) / F.sum("w")).alias("ps"))), "x1")
    return E.wls_odds(p, "y", ["x1"], "ps", "w", (F.col("d") == 0) & (F.col("post") == 1)).select("position", S.rnd("coef").alias("coef"))


BAND = "CASE WHEN w <= 8 THEN 'few' WHEN w <= 11 THEN 'many' ELSE 'most' END"


def banded(spark, sf):
    return D.two_period(spark, sf).withColumn("band", F.expr(BAND))


@query("p_covariate_matrix", with_(P5) + f"SELECT id, 1.0::DOUBLE AS c0, x1 AS c1, x2 AS c2, ({BAND} = 'many')::INT::DOUBLE AS c3, ({BAND} = 'most')::INT::DOUBLE AS c4, x1*x2 AS c5 FROM p5")
def _(spark, sf):
    p = banded(spark, sf)
    m = model_matrix(p, "~ x1 * x2 + band")
    return p.select("id", *[c.alias(f"c{i}") for i, c in enumerate(m.columns)])


BANDED = PANEL_SQL.replace("FROM p5)", f"FROM (SELECT *, {BAND} AS band FROM p5))", 1).replace("PARTITION BY x1)", "PARTITION BY x1, band)")


@query("did_formula_factor", BANDED)
def _(spark, sf):
    return shown(E.did_2x2(banded(spark, sf), "reg", y1="y1", y0="y0", d="d", xs="~ x1 * band", w="w"))


@query("udf_formula", with_(P5) + f""", b AS (SELECT *, y1 - y0 AS dy, {BAND} AS band FROM p5),
m AS (SELECT x1, band, sum(w*dy)/sum(w) AS m FROM b GROUP BY 1, 2),
c AS (SELECT max(m) FILTER (x1=0 AND band='few') AS a, max(m) FILTER (x1=1 AND band='few') AS b, max(m) FILTER (x1=0 AND band='many') AS c, max(m) FILTER (x1=0 AND band='most') AS e,
  max(m) FILTER (x1=1 AND band='many') AS f, max(m) FILTER (x1=1 AND band='most') AS g FROM m)
""" + " UNION ALL ".join(f"SELECT '{t}' AS term, {r(e)} AS estimate FROM c" for t, e in (
    ("(Intercept)", "a"), ("x1", "b - a"), ("bandmany", "c - a"), ("bandmost", "e - a"), ("x1:bandmany", "f - c - b + a"), ("x1:bandmost", "g - e - b + a"))))
def _(spark, sf):
    fit = glm_fit(banded(spark, sf), F.expr("y1 - y0"), "~ x1 * band", family("gaussian"), "w", tol=1e-12)
    return spark.createDataFrame([(n, float(b)) for n, b in zip(fit.names, fit.coef)], "term STRING, estimate DOUBLE").withColumn("estimate", S.rnd("estimate"))


# A column is kept if those before it leave some of its variance: squared (multiple) correlations below one.
@query("p_collinear_drop", with_(P5) + """, x AS (SELECT x1, x2, 2*x1 AS a, x1 + x2 AS b FROM p5),
c AS (SELECT corr(x1, a) AS r1a, corr(x1, x2) AS r12, corr(x1, b) AS r1b, corr(x2, b) AS r2b, var_pop(x1) AS v1 FROM x)
SELECT kept FROM (SELECT unnest(['const','x1','x1_twice','x2','x1_plus_x2']) AS kept, unnest([1.0, v1, 1 - r1a*r1a, 1 - r12*r12, 1 - (r1b*r1b + r2b*r2b - 2*r1b*r2b*r12)/(1 - r12*r12)]) AS rest FROM c) WHERE rest > 1e-9""")
def _(spark, sf):
    p = D.two_period(spark, sf)
    names = ["const", "x1", "x1_twice", "x2", "x1_plus_x2"]
    r_ = column_factor(p, [F.lit(1.0), F.col("x1"), 2 * F.col("x1"), F.col("x2"), F.col("x1") + F.col("x2")])
    return spark.createDataFrame([(names[i],) for i in independent(r_)], "kept STRING")


# Every treated unit with z has a score of one in the limit and leaves; among the others the score is the treated share of the stratum.
@query("panel_overlap_trim", with_(P5) + "SELECT x1, " + r("sum(w*d)/sum(w)", 5) + " AS ps, sum(d)::BIGINT AS treated, count(*) - sum(d)::BIGINT AS controls FROM p5 WHERE NOT (d = 1 AND id % 7 = 0) GROUP BY 1")
def _(spark, sf):
    p = D.two_period(spark, sf).withColumn("z", F.expr("d * int(id % 7 = 0)"))
    kept = E.overlap_trim(p, "d", "~ x1 + z", "w")
    return kept.groupBy("x1").agg(S.rnd(F.max("ps"), 5).alias("ps"), F.count_if(F.col("d") == 1).alias("treated"), F.count_if(F.col("d") == 0).alias("controls"))
