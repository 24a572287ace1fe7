"""Group-time effects, their summaries and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.functions.distributions import qnorm
from panelwright.operators import aggte as G
from panelwright.operators import attgt as A
from panelwright.operators import bootstrap as B
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, with_
from panelwright.functions.pvalues import p_chi2, p_f, p_t, p_t_sql
from panelwright.plans.registry import query, r

WEIGHTED = A.Design(weight="w")
PLAIN = A.Design()


def cells_sql(src: str = "p1", base: str = "varying") -> str:
    pre = "CASE WHEN t >= g THEN (SELECT max(b.t) FROM tt b WHERE b.t < g) ELSE prev END" if base == "varying" else "(SELECT max(b.t) FROM tt b WHERE b.t < g)"
    where = "WHERE prev IS NOT NULL" if base == "varying" else ""
    return f""", tt AS (SELECT t, lag(t) OVER (ORDER BY t) AS prev FROM (SELECT DISTINCT t FROM {src})),
cells AS (SELECT g, t, {pre} AS pre FROM (SELECT DISTINCT g FROM {src} WHERE g IS NOT NULL), tt {where})"""


def arms_sql(src: str = "p1", w: str = "w", notyet: bool = False, base: str = "varying") -> str:
    """cells, unit changes with side, arm sums, att/se per cell and influence per unit."""
    ctrl = "a.g IS NULL OR (a.g > greatest(c.t, c.pre) AND a.g <> c.g)" if notyet else "a.g IS NULL"
    return cells_sql(src, base) + f""", ch AS (SELECT c.g, c.t, c.pre, a.id, a.g AS cohort, {w.replace('w', 'a.w') if w == 'w' else w} AS w, coalesce(a.g = c.g, false) AS treated, a.y - b.y AS dy
  FROM cells c JOIN {src} a ON a.t = c.t AND (a.g = c.g OR {ctrl}) JOIN {src} b ON b.t = c.pre AND b.id = a.id),
arm AS (SELECT g, t, treated, count(*) AS n, sum(w) AS sw, sum(w*dy)/sum(w) AS m FROM ch GROUP BY 1, 2, 3),
nn AS (SELECT count(DISTINCT id) AS n FROM {src}),
psi AS (SELECT ch.g, ch.t, ch.id, ch.cohort, (CASE WHEN ch.treated THEN 1 ELSE -1 END) * nn.n * ch.w * (dy - m) / sw AS psi FROM ch JOIN arm USING (g, t, treated), nn),
att AS (SELECT c.g, c.t, c.pre, max(CASE WHEN treated THEN arm.n END) AS n_treated, max(CASE WHEN NOT treated THEN arm.n END) AS n_control,
  CASE WHEN c.t = c.pre THEN 0 ELSE max(CASE WHEN treated THEN m END) - max(CASE WHEN NOT treated THEN m END) END AS att
  FROM cells c JOIN arm ON arm.g = c.g AND arm.t = c.t GROUP BY 1, 2, 3),
se AS (SELECT g, t, sqrt(sum(psi*psi))/max(nn.n) AS se FROM psi, nn GROUP BY 1, 2)"""


GT_OUT = " SELECT g, t, pre, n_treated, n_control, " + r("att") + " AS att, " + r("CASE WHEN t <> pre AND se > 1.5e-7 THEN se END") + " AS se FROM att JOIN se USING (g, t)"


def gt_out(df):
    return df.select("g", "t", "pre", "n_treated", "n_control", S.rnd("att").alias("att"), S.rnd("se").alias("se"))


@query("gt_cells", with_(P1) + cells_sql("p1").replace(", tt AS", ", tt AS", 1) + " SELECT g, t, pre, t >= g AS is_post FROM cells")
def _(spark, sf):
    return A.gt_cells(D.nation_month(spark, sf), PLAIN).select("g", "t", "pre", "is_post")


@query("gt_cells_universal", with_(P1) + cells_sql("p1", "universal") + " SELECT g, t, pre, t >= g AS is_post FROM cells")
def _(spark, sf):
    return A.gt_cells(D.nation_month(spark, sf), A.Design(base_period="universal")).select("g", "t", "pre", "is_post")


CONTROL = with_(P1) + cells_sql("p1") + " SELECT c.g, c.t, count(*) FILTER (u.g IS NULL) AS never, count(*) FILTER (u.g > greatest(c.t, c.pre) AND u.g <> c.g) AS not_yet FROM cells c, (SELECT DISTINCT g FROM p1) u GROUP BY 1, 2"


def _controls(spark, sf):
    p = D.nation_month(spark, sf)
    d = A.Design(control_group="notyettreated")
    m = A.control_cohorts(A.gt_cells(p, d), A.contract(*A.axes(p, d), d).controls, d)
    return m.groupBy("g", "t").agg(F.count_if(~F.col("treated") & F.col("cohort").isNull()).alias("never"), F.count_if(~F.col("treated") & F.col("cohort").isNotNull()).alias("not_yet"))


query("j_control_range", CONTROL)(_controls)


@query("gt_controls", with_(P1) + arms_sql(notyet=True) + " SELECT g, t, count(*) FILTER (treated) AS treated_units, count(*) FILTER (NOT treated) AS control_units FROM ch GROUP BY 1, 2")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    d = A.Design(control_group="notyettreated")
    m = A.control_cohorts(A.gt_cells(p, d), A.contract(*A.axes(p, d), d).controls, d)
    sizes = p.groupBy(F.col("g").alias("_g")).agg(F.count_distinct("id").alias("u"))
    j = m.join(sizes, F.col("cohort").eqNullSafe(F.col("_g")))
    return j.groupBy("g", "t").agg(F.sum(F.when(F.col("treated"), F.col("u"))).alias("treated_units"), F.sum(F.when(~F.col("treated"), F.col("u"))).alias("control_units"))


@query("att_gt", with_(P1) + arms_sql() + GT_OUT)
def _(spark, sf):
    return gt_out(A.att_gt(D.nation_month(spark, sf), WEIGHTED))


@query("att_gt_zero_coded", with_(P1) + arms_sql() + GT_OUT)
def _(spark, sf):
    return gt_out(A.att_gt(D.nation_month(spark, sf).withColumn("g", F.coalesce("g", F.lit(0))), WEIGHTED))


@query("att_gt_future_cohort", with_(P1) + arms_sql() + GT_OUT)
def _(spark, sf):
    p = D.nation_month(spark, sf)
    late = F.when(F.col("id") % 2 == 0, F.lit(30000.0)).otherwise(F.lit(float("inf")))
    return gt_out(A.att_gt(p.withColumn("g", F.coalesce(F.col("g").cast("double"), late)), WEIGHTED))


NO_NEVER = with_(P1.replace("p1 AS (", "p0 AS (", 1)) + ", p1 AS (SELECT id, t, {g} AS g, y, w FROM p0 WHERE g IS NOT NULL AND t < (SELECT max(g) FROM p0))"


@query("att_gt_no_never", NO_NEVER.format(g="CASE WHEN g < (SELECT max(g) FROM p0) THEN g END") + arms_sql() + GT_OUT)
def _(spark, sf):
    return gt_out(A.att_gt(D.nation_month(spark, sf).where("g is not null"), WEIGHTED))


@query("att_gt_no_never_notyettreated", NO_NEVER.format(g="g") + arms_sql(w="1.0", notyet=True) + GT_OUT.replace("FROM att", "FROM (SELECT * FROM att WHERE g < (SELECT max(g) FROM p1)) att"))
def _(spark, sf):
    return gt_out(A.att_gt(D.nation_month(spark, sf).where("g is not null"), A.Design(control_group="notyettreated")))


@query("att_gt_notyettreated", with_(P1) + arms_sql(w="1.0", notyet=True) + GT_OUT)
def _(spark, sf):
    return gt_out(A.att_gt(D.nation_month(spark, sf), A.Design(control_group="notyettreated")))


@query("att_gt_universal", with_(P1) + arms_sql(w="1.0", base="universal") + GT_OUT)
def _(spark, sf):
    return gt_out(A.att_gt(D.nation_month(spark, sf), A.Design(base_period="universal")))


STRATA = """, st AS (SELECT c.g, c.t, a.id, (a.id // 5) % 2 AS x, coalesce(a.g = c.g, false)::INT AS d, a.y - b.y AS dy FROM cells c JOIN p1 a ON a.t = c.t AND (a.g = c.g OR a.g IS NULL) JOIN p1 b ON b.t = c.pre AND b.id = a.id),
ms AS (SELECT *, avg(CASE WHEN d = 0 THEN dy END) OVER s AS m, sum(d) OVER s / sum(1 - d) OVER s AS odds FROM st WINDOW s AS (PARTITION BY g, t, x)),
av AS (SELECT g, t, sum(d*(dy-m))/sum(d) AS att, count(*) AS n, avg(d) AS dbar FROM ms GROUP BY 1, 2)
SELECT ms.g, ms.t, """ + r("max(att)") + " AS att, " + r("sqrt(sum(pow((d*(dy-m-att) - (1-d)*odds*(dy-m))/dbar, 2)))/max(n)") + " AS se FROM ms JOIN av USING (g, t) GROUP BY 1, 2"


def _cov(method):
    def run(spark, sf):
        p = D.nation_month(spark, sf).withColumn("x", (F.floor(F.col("id") / 5) % 2).cast("double"))
        e = A.att_gt(p, PLAIN, method, ["x"])
        return e.where("att is not null").select("g", "t", S.rnd("att").alias("att"), S.rnd("se").alias("se"))

    return run


for _m in ("reg", "ipw", "dr"):
    query(f"gt_2x2_panel_{_m}", with_(P1) + cells_sql() + STRATA)(_cov({"ipw": "sipw"}.get(_m, _m)))

RC_SQL = with_(P2) + cells_sql("p2") + """, q AS (SELECT c.g, c.t, a.t = c.t AS post, coalesce(a.g = c.g, false) AS tr, a.y FROM cells c JOIN p2 a ON (a.t = c.t OR a.t = c.pre) AND (a.g = c.g OR a.g IS NULL)),
k AS (SELECT g, t, tr, post, count(*) AS n, avg(y) AS m, sum(y*y)/count(*) - avg(y)*avg(y) AS v FROM q GROUP BY 1, 2, 3, 4)
SELECT g, t, CASE WHEN count(*) = 4 THEN """ + r("sum(CASE WHEN tr = post THEN m ELSE -m END)") + " END AS att, CASE WHEN count(*) = 4 AND sqrt(sum(greatest(v, 0)/n)) > 1.5e-7 THEN " + r("sqrt(sum(greatest(v, 0)/n))", 5) + " END AS se, sum(CASE WHEN tr THEN n END)::BIGINT AS n_treated FROM k GROUP BY 1, 2"


@query("gt_2x2_rc", RC_SQL)
def _(spark, sf):
    e = A.att_gt(D.customer_quarter(spark, sf), A.Design(unit=None, mode="rc"), "reg")
    return e.where("pre is not null").select("g", "t", S.rnd("att").alias("att"), S.rnd("se", 5).alias("se"), "n_treated")


UNB_SQL = with_(P2) + cells_sql("p2") + """, q AS (SELECT c.g, c.t, a.id, a.t = c.t AS post, coalesce(a.g = c.g, false) AS tr, a.y FROM cells c JOIN p2 a ON (a.t = c.t OR a.t = c.pre) AND (a.g = c.g OR a.g IS NULL)),
k AS (SELECT g, t, tr, post, count(*) AS n, avg(y) AS m FROM q GROUP BY 1, 2, 3, 4),
u AS (SELECT q.g, q.t, q.id, sum((CASE WHEN q.tr = q.post THEN 1 ELSE -1 END)*(q.y - k.m)/k.n) AS psi FROM q JOIN k ON k.g = q.g AND k.t = q.t AND k.tr = q.tr AND k.post = q.post GROUP BY 1, 2, 3),
e AS (SELECT g, t, sqrt(sum(psi*psi)) AS se FROM u GROUP BY 1, 2)
SELECT k.g, k.t, CASE WHEN count(*) = 4 THEN """ + r("sum(CASE WHEN tr = post THEN m ELSE -m END)") + " END AS att, CASE WHEN count(*) = 4 AND max(se) > 1.5e-7 THEN " + r("max(se)", 5) + " END AS se FROM k JOIN e ON e.g = k.g AND e.t = k.t GROUP BY 1, 2"


@query("gt_2x2_unbalanced", UNB_SQL)
def _(spark, sf):
    e = A.att_gt(D.customer_quarter(spark, sf), A.Design(mode="unbalanced"), "reg")
    return e.where("pre is not null").select("g", "t", S.rnd("att").alias("att"), S.rnd("se", 5).alias("se"))


# One cohort lies beyond all controls in x, so its scores reach one; elsewhere x has two values and controls in both.
GUARD_X = "CASE WHEN id % 5 = 4 THEN 2 WHEN id >= 15 THEN 1 ELSE 0 END"


@query("gt_v1_guards", with_(P1) + arms_sql(w="1.0") + f""", xs AS (SELECT *, {GUARD_X} AS x FROM ch), mc AS (SELECT g, t, x, avg(dy) AS m FROM xs WHERE NOT treated GROUP BY 1, 2, 3)
SELECT xs.g, xs.t, CASE WHEN count(m) = count(*) THEN """ + r("avg(dy - m)") + " END AS att, CASE WHEN count(m) < count(*) THEN 'overlap condition violated' END AS reason FROM xs LEFT JOIN mc ON mc.g = xs.g AND mc.t = xs.t AND mc.x = xs.x WHERE treated GROUP BY 1, 2")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumn("x", F.expr(GUARD_X).cast("double"))
    e = A.att_gt(p, PLAIN, "dr", "~ x", guard=0.999)
    return e.where("pre is not null").select("g", "t", S.rnd("att").alias("att"), "reason")


@query("gt_se_analytic", with_(P1) + arms_sql() + " SELECT g, t, " + r("max(se)") + " AS se, " + r("max(se)*max(se)*max(nn.n)") + " AS v FROM se, nn WHERE se > 1.5e-7 GROUP BY 1, 2")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    fit = G.fit_panel(p, WEIGHTED)
    params = G.cell_params(fit)
    diag = G.influence_products(fit, params)
    n = fit.shares["n"]
    rows = [(*next(iter(q.weights)), float((v ** 0.5) / n), float(v / n)) for q, v in zip(params, diag)]
    t = spark.createDataFrame(rows, "g BIGINT, t BIGINT, se DOUBLE, v DOUBLE")
    return t.where("se > 1.5e-7").select("g", "t", S.rnd("se").alias("se"), S.rnd("v").alias("v"))


@query("gt_psi", with_(P1) + arms_sql() + " SELECT id, count(*) FILTER (abs(psi) > 1e-9) AS cells, " + r("sum(psi*psi)", 4) + " AS ss FROM psi GROUP BY 1")
def _(spark, sf):
    fit = G.fit_panel(D.nation_month(spark, sf), WEIGHTED)
    psi = G.influence_long(fit, G.cell_params(fit))
    return psi.groupBy(F.col("unit").alias("id")).agg(F.count_if(F.abs("psi") > 1e-9).alias("cells"), S.rnd(F.sum(F.col("psi") * F.col("psi")), 4).alias("ss"))


@query("gt_pretest_wald")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    w = G.pretest_wald(G.fit_panel(P_half(p), PLAIN))
    return spark.createDataFrame([(w["statistic"], w["df"], w["p_value"])], "statistic DOUBLE, df INT, p_value DOUBLE")


def P_half(p):
    """Eighteen-month periods, so that there are fewer cells than units."""
    h = (F.col("t") / 18).cast("bigint")
    return p.groupBy("id", h.alias("t")).agg(F.avg("y").alias("y"), F.floor(F.min("g") / 18).cast("bigint").alias("g"), F.max("w").alias("w"), F.max("region").alias("region"))


@query("gt_tidy", with_(P1) + arms_sql() + " SELECT 'ATT(' || g || ',' || t || ')' AS term, " + r("att") + " AS estimate, " + r("se") + " AS std_error, " + r("att - 1.96*se") + " AS conf_low, " + r("att + 1.96*se") + " AS conf_high FROM att JOIN se USING (g, t) WHERE se > 1.5e-7")
def _(spark, sf):
    t = A.tidy(A.att_gt(D.nation_month(spark, sf), WEIGHTED))
    return t.where("std_error is not null").select("term", *[S.rnd(c).alias(c) for c in ("estimate", "std_error", "conf_low", "conf_high")])


@query("gt_glance", with_(P1) + arms_sql() + " SELECT max(nn.n) AS nobs, count(DISTINCT g) AS ngroup, count(DISTINCT t) + 1 AS ntime, 'nevertreated' AS control_group, 'dr' AS est_method FROM cells, nn")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    return p.agg(F.count_distinct("id").alias("nobs"), F.count_distinct("g").alias("ngroup"), F.count_distinct("t").alias("ntime"), F.lit("nevertreated").alias("control_group"), F.lit("dr").alias("est_method"))


def support_sql(notyet: bool) -> str:
    ctrl = "(a.g IS NULL OR a.g > c.t)" if notyet else "a.g IS NULL"
    cnt = lambda who, when: f"(SELECT count(*) FROM p2 a WHERE {who} AND a.t = {when} AND a.y IS NOT NULL)"
    return with_(P2) + f""", c0 AS (SELECT g, t FROM (SELECT DISTINCT g FROM p2 WHERE g IS NOT NULL), (SELECT DISTINCT t FROM p2) WHERE t >= g),
sup AS (SELECT g, t, t - g AS event_time, {cnt('a.g = c.g', 'c.g - 1')} AS n_treat_pre, {cnt('a.g = c.g', 'c.t')} AS n_treat_post, {cnt(ctrl, 'c.g - 1')} AS n_control_pre, {cnt(ctrl, 'c.t')} AS n_control_post FROM c0 c),
support AS (SELECT *, n_treat_pre + n_treat_post + n_control_pre + n_control_post AS n_total, least(n_treat_pre, n_treat_post, n_control_pre, n_control_post) > 0 AS identifiable,
 CASE WHEN least(n_treat_pre, n_treat_post, n_control_pre, n_control_post) = 0 THEN concat_ws(', ', CASE WHEN n_treat_pre=0 THEN 'n_treat_pre=0' END, CASE WHEN n_treat_post=0 THEN 'n_treat_post=0' END, CASE WHEN n_control_pre=0 THEN 'n_control_pre=0' END, CASE WHEN n_control_post=0 THEN 'n_control_post=0' END) END AS reason FROM sup)"""


@query("gt_support", support_sql(False) + " SELECT * FROM support")
def _(spark, sf):
    return A.support_table(D.customer_quarter(spark, sf), PLAIN)


@query("gt_support_notyettreated", support_sql(True) + " SELECT * FROM support")
def _(spark, sf):
    return A.support_table(D.customer_quarter(spark, sf), A.Design(control_group="notyettreated"))


@query("gt_support_summary", support_sql(False).replace("FROM p2 a WHERE", "FROM (SELECT * FROM p2 WHERE NOT (g IS NULL AND t % 5 = 0)) a WHERE") + " SELECT 'event_time' AS level, event_time AS key, count(*) AS cells, count(*) FILTER (identifiable) AS identifiable_cells, " + r("100.0*avg(identifiable::INT)") + " AS pct FROM support GROUP BY 2 UNION ALL SELECT 'cohort', g, count(*), count(*) FILTER (identifiable), " + r("100.0*avg(identifiable::INT)") + " FROM support GROUP BY 2")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).where("not (g is null and t % 5 = 0)")
    s = A.support_table(p, PLAIN)
    parts = [A.support_summary(s, [k]).select(F.lit(n).alias("level"), F.col(k).alias("key"), "cells", "identifiable_cells", S.rnd("pct").alias("pct")) for n, k in (("event_time", "event_time"), ("cohort", "g"))]
    return parts[0].unionByName(parts[1])


@query("gt_panel_balance", with_(P2) + "SELECT count(*) AS n_units, sum(tr)::BIGINT AS n_treated, min(k) AS min_obs, max(k) AS max_obs, " + r("avg(k)") + " AS mean_obs, sum(k)::BIGINT AS n_obs, (SELECT count(DISTINCT t) FROM p2) AS n_periods, " + r("100.0*sum(k)/(count(*)*(SELECT count(DISTINCT t) FROM p2))") + " AS balance_pct FROM (SELECT id, count(y) AS k, max((g IS NOT NULL)::INT) AS tr FROM p2 GROUP BY 1)")
def _(spark, sf):
    b = A.panel_balance(D.customer_quarter(spark, sf), PLAIN)
    return b.withColumns({c: S.rnd(c) for c in ("mean_obs", "balance_pct")})


@query("gt_cell_support_instr", support_sql(False) + " SELECT * FROM support WHERE (g, t) IN ((7983, 7984), (7986, 7990), (7989, 7989))")
def _(spark, sf):
    s = A.support_table(D.customer_quarter(spark, sf), PLAIN)
    return s.where("(g = 7983 and t = 7984) or (g = 7986 and t = 7990) or (g = 7989 and t = 7989)")


@query("gt_safe", with_("p1 AS (SELECT * FROM (" + "SELECT * FROM p0) WHERE NOT (coalesce(g, 0) = 23995 AND t = 23994))".replace("(", "(", 1)).replace("WITH p1", "WITH " + P1.strip().replace("p1 AS", "p0 AS", 1) + ", p1") + arms_sql(w="1.0") + ", bad AS (SELECT g, t FROM cells WHERE g = 23995 AND t >= g) SELECT c.g, c.t, CASE WHEN b.g IS NULL THEN " + r("att") + " END AS att, CASE WHEN b.g IS NOT NULL THEN 'n_treat_pre=0' END AS reason FROM cells c LEFT JOIN att ON att.g = c.g AND att.t = c.t LEFT JOIN bad b ON b.g = c.g AND b.t = c.t WHERE NOT (c.g = 23995 AND c.t < c.g)")
def _(spark, sf):
    p = D.nation_month(spark, sf).where("not (coalesce(g, 0) = 23995 and t = 23994)")
    e = A.att_gt_safe(p, PLAIN)
    return e.where("not (g = 23995 and t < g)").select("g", "t", S.rnd("att").alias("att"), "reason")


@query("gt_custom", with_(P1) + arms_sql(w="1.0") + " SELECT g, t, " + r("max(CASE WHEN treated THEN m END) - 0.5*max(CASE WHEN NOT treated THEN m END)") + " AS att FROM arm GROUP BY 1, 2")
def _(spark, sf):
    e = A.custom_att(D.nation_month(spark, sf), PLAIN, lambda t, c: t["mean"] - 0.5 * c["mean"])
    return e.select("g", "t", S.rnd("att").alias("att"))


query("udf_est_method", with_(P1) + arms_sql(w="1.0") + " SELECT g, t, " + r("max(CASE WHEN treated THEN m END) / max(CASE WHEN NOT treated THEN m END)", 4) + " AS att FROM arm GROUP BY 1, 2 HAVING abs(max(CASE WHEN NOT treated THEN m END)) > 0.001")(
    lambda spark, sf: A.custom_att(D.nation_month(spark, sf), PLAIN, lambda t, c: F.when(F.abs(c["mean"]) > 0.001, t["mean"] / c["mean"])).where("att is not null").select("g", "t", S.rnd("att", 4).alias("att")))

# ---- summaries -------------------------------------------------------------

SHARES = """, sh AS (SELECT g, sum(w)/(SELECT sum(w) FROM p1 WHERE t = (SELECT min(t) FROM p1)) AS pg FROM p1 WHERE t = (SELECT min(t) FROM p1) AND g IS NOT NULL GROUP BY 1),
wb AS (SELECT avg(w) AS wbar FROM p1 WHERE t = (SELECT min(t) FROM p1)), uu AS (SELECT id, g AS cohort, w FROM p1 WHERE t = (SELECT min(t) FROM p1)),
ca AS (SELECT att.g, att.t, att.att, sh.pg FROM att JOIN sh USING (g))"""


def agg_sql(key: str, where: str = "true") -> str:
    """Share-weighted summary by ``key`` with its influence per unit."""
    return with_(P1) + arms_sql() + SHARES + f""", sel AS (SELECT *, {key} AS key FROM ca WHERE {where}),
th AS (SELECT key, sum(pg*att)/sum(pg) AS est, sum(pg) AS s FROM sel GROUP BY 1),
cw AS (SELECT sel.*, pg/s AS cw, (att - est)/s AS cor FROM sel JOIN th USING (key)),
i1 AS (SELECT cw.key, psi.id, sum(cw.cw*psi.psi) AS v FROM cw JOIN psi ON psi.g = cw.g AND psi.t = cw.t GROUP BY 1, 2),
i2 AS (SELECT cw.key, uu.id, sum(cw.cor)*max(uu.w)/max(wbar) AS v FROM cw JOIN uu ON uu.cohort = cw.g, wb GROUP BY 1, 2),
inf AS (SELECT key, id, sum(v) AS v FROM (SELECT * FROM i1 UNION ALL SELECT * FROM i2) GROUP BY 1, 2),
res AS (SELECT key, max(est) AS est, sqrt(sum(v*v))/max(nn.n) AS se FROM inf JOIN th USING (key), nn GROUP BY 1)"""


OVER = """, ov AS (SELECT avg(est) AS est FROM res WHERE {w}), ovi AS (SELECT id, sum(v)/(SELECT count(*) FROM res WHERE {w}) AS v FROM inf WHERE {w} GROUP BY 1)
SELECT key::BIGINT AS key, """ + r("est") + " AS estimate, " + r("se") + " AS se FROM res UNION ALL SELECT NULL, " + r("max(ov.est)") + ", " + r("sqrt(sum(v*v))/max(nn.n)") + " FROM ovi, ov, nn"


def agg_out(df):
    return df.select("key", S.rnd("estimate").alias("estimate"), S.rnd("se").alias("se"))


def _agg(kind, **kw):
    return lambda spark, sf: agg_out(G.aggregate(G.fit_panel(D.nation_month(spark, sf), WEIGHTED), kind, **kw))


query("agg_simple", agg_sql("0", "t >= g") + " SELECT NULL::BIGINT AS key, " + r("est") + " AS estimate, " + r("se") + " AS se FROM res")(_agg("simple"))
query("agg_dynamic", agg_sql("t - g") + OVER.format(w="key >= 0"))(_agg("dynamic"))


@query("agg_dynamic_string_ids", agg_sql("t - g") + OVER.format(w="key >= 0"))
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumns({"id": F.concat(F.lit("unit "), F.col("id")), "region": F.concat(F.lit("r"), F.col("region"))})
    fit = G.fit_panel(p, A.Design(weight="w", cluster="region"))
    G.influence_products(fit, G.cell_params(fit)[:3], by_cluster=True)  # string clusters
    return agg_out(G.aggregate(fit, "dynamic"))


query("agg_dynamic_balanced", agg_sql("t - g", "80 + 23940 - g >= 6 AND t - g <= 6 AND t - g >= -12") + OVER.format(w="key >= 0"))(_agg("dynamic", balance_e=6, min_e=-12))
query("agg_calendar", agg_sql("t", "t >= g") + OVER.format(w="true"))(_agg("calendar"))
query("agg_group", with_(P1) + arms_sql() + SHARES + """, sel AS (SELECT *, 1.0/count(*) OVER (PARTITION BY g) AS cw FROM ca WHERE t >= g),
th AS (SELECT g AS key, avg(att) AS est, max(pg) AS pg FROM sel GROUP BY 1),
inf AS (SELECT sel.g AS key, psi.id, sum(cw*psi) AS v FROM sel JOIN psi ON psi.g = sel.g AND psi.t = sel.t GROUP BY 1, 2),
ov AS (SELECT sum(pg*est)/sum(pg) AS est, sum(pg) AS s FROM th),
oi AS (SELECT id, sum(v) AS v FROM (SELECT inf.id, inf.v*th.pg/ov.s AS v FROM inf JOIN th USING (key), ov UNION ALL SELECT uu.id, (th.est - ov.est)/ov.s*uu.w/wbar FROM uu JOIN th ON th.key = uu.cohort, ov, wb) GROUP BY 1)
SELECT key, """ + r("max(est)") + " AS estimate, " + r("sqrt(sum(v*v))/max(nn.n)") + " AS se FROM inf JOIN th USING (key), nn GROUP BY 1 UNION ALL SELECT NULL, " + r("max(ov.est)") + ", " + r("sqrt(sum(v*v))/max(nn.n)") + " FROM oi, ov, nn")(_agg("group"))


@query("agg_na", with_(P1) + arms_sql(w="1.0") + SHARES.replace("sum(w)", "count(*)").replace("avg(w)", "1.0") + " SELECT t - g AS e, count(*) AS cells, " + r("sum(pg*att)/sum(pg)") + " AS estimate FROM ca WHERE NOT (g = 23959 AND t >= g) AND t >= g GROUP BY 1")
def _(spark, sf):
    e = A.att_gt(D.nation_month(spark, sf), PLAIN).withColumn("att", F.when(~((F.col("g") == 23959) & F.col("is_post")), F.col("att")))
    sizes = D.nation_month(spark, sf).groupBy("g").agg(F.count_distinct("id").alias("u"))
    return e.where("is_post and att is not null").join(sizes, "g").groupBy((F.col("t") - F.col("g")).alias("e")).agg(F.count("*").alias("cells"), S.rnd(F.sum(F.col("att") * F.col("u")) / F.sum("u")).alias("estimate"))


@query("agg_weight_if", agg_sql("t - g") + " SELECT key, cohort, " + r("max(x.v)") + " AS wif FROM (SELECT i2.key, uu.cohort, i2.v/uu.w*wbar AS v FROM i2 JOIN uu USING (id), wb) x GROUP BY 1, 2")
def _(spark, sf):
    fit = G.fit_panel(D.nation_month(spark, sf), WEIGHTED)
    ps = G.build_params("dynamic", fit.att, fit.shares["share"], fit.periods[-1])
    rows = [(p.key, int(g), float(v)) for p in ps if p.key is not None for g, v in p.correction.items()]
    return spark.createDataFrame(rows, "key BIGINT, cohort BIGINT, wif DOUBLE").withColumn("wif", S.rnd("wif"))


@query("agg_if", agg_sql("0", "t >= g") + " SELECT id, " + r("v") + " AS psi FROM inf")
def _(spark, sf):
    fit = G.fit_panel(D.nation_month(spark, sf), WEIGHTED)
    ps = G.build_params("simple", fit.att, fit.shares["share"], fit.periods[-1])
    return G.influence_long(fit, ps).select(F.col("unit").alias("id"), S.rnd("psi").alias("psi"))


@query("agg_se", agg_sql("t - g") + " SELECT key, " + r("se") + " AS se FROM res")
def _(spark, sf):
    fit = G.fit_panel(D.nation_month(spark, sf), WEIGHTED)
    ps = [p for p in G.build_params("dynamic", fit.att, fit.shares["share"], fit.periods[-1]) if p.key is not None]
    v = G.influence_products(fit, ps)
    return spark.createDataFrame([(p.key, float(x ** 0.5) / fit.shares["n"]) for p, x in zip(ps, v)], "key BIGINT, se DOUBLE").withColumn("se", S.rnd("se"))


@query("agg_se_clustered", agg_sql("t - g") + ", cs AS (SELECT inf.key, n_regionkey, sum(inf.v) AS v FROM inf JOIN nation ON n_nationkey = inf.id GROUP BY 1, 2) SELECT key, " + r("max(est)") + " AS estimate, " + r("sqrt(sum(v*v))/max(nn.n)") + " AS se FROM cs JOIN th USING (key), nn GROUP BY 1")
def _(spark, sf):
    fit = G.fit_panel(D.nation_month(spark, sf), A.Design(weight="w", cluster="region"))
    ps = [p for p in G.build_params("dynamic", fit.att, fit.shares["share"], fit.periods[-1]) if p.key is not None]
    v = G.influence_products(fit, ps, by_cluster=True)
    t = spark.createDataFrame([(p.key, float(p.estimate), float(x ** 0.5) / fit.shares["n"]) for p, x in zip(ps, v)], "key BIGINT, estimate DOUBLE, se DOUBLE")
    return agg_out(t)


BOOT_DRAWS = 199
Z = qnorm(0.75) - qnorm(0.25)


def _boot(spark, sf, kind="rademacher"):
    fit = G.fit_panel(D.nation_month(spark, sf), WEIGHTED)
    ps = [p for p in G.build_params("dynamic", fit.att, fit.shares["share"], fit.periods[-1]) if p.key is not None]
    psi = G.influence_long(fit, ps)
    return fit, ps, B.multiplier_draws(psi, BOOT_DRAWS, fit.shares["n"], seed=7, kind=kind)


DRAW_SQL = agg_sql("t - g") + f""", us AS (SELECT id, b, {S.draw31_sql('u', 7, 'id', 'b')} FROM (SELECT DISTINCT id FROM p1), range(0, {BOOT_DRAWS}) bb(b)),
dr AS (SELECT inf.key, us.b, sum(inf.v * (CASE WHEN u >= 1073741824 THEN 1 ELSE -1 END))/sqrt(max(nn.n)) AS value FROM inf JOIN us USING (id), nn GROUP BY 1, 2),
sg AS (SELECT key, (quantile_disc(value, 0.75) - quantile_disc(value, 0.25))/{Z!r} AS sigma FROM dr GROUP BY 1)"""


@query("boot_multiplier", DRAW_SQL + " SELECT key, " + r("sigma/sqrt(nn.n)") + " AS se FROM sg, nn")
def _(spark, sf):
    fit, ps, draws = _boot(spark, sf)
    se, _ = B.draw_summary(draws, fit.shares["n"])
    keys = spark.createDataFrame([(i, p.key) for i, p in enumerate(ps)], "param BIGINT, key BIGINT")
    return se.join(keys, "param").select("key", S.rnd("se").alias("se"))


@query("band_uniform", DRAW_SQL + ", tm AS (SELECT b, max(abs(value/sigma)) AS t FROM dr JOIN sg USING (key) GROUP BY 1), cv AS (SELECT quantile_disc(t, 0.95) AS crit FROM tm) SELECT key, " + r("est") + " AS estimate, " + r("est - crit*sigma/sqrt(nn.n)") + " AS lo, " + r("est + crit*sigma/sqrt(nn.n)") + " AS hi, 'ok' AS note FROM sg JOIN th USING (key), nn, cv")
def _(spark, sf):
    fit, ps, draws = _boot(spark, sf)
    se, crit = B.draw_summary(draws, fit.shares["n"])
    cv, note = B.usable_critical_value(crit.first().crit)
    keys = spark.createDataFrame([(i, p.key, float(p.estimate)) for i, p in enumerate(ps)], "param BIGINT, key BIGINT, estimate DOUBLE")
    j = se.join(keys, "param")
    return j.select("key", S.rnd("estimate").alias("estimate"), S.rnd(F.col("estimate") - cv * F.col("se")).alias("lo"), S.rnd(F.col("estimate") + cv * F.col("se")).alias("hi"), F.lit(note).alias("note"))


@query("boot_cluster", agg_sql("t - g") + f""", cm AS (SELECT key, n_regionkey AS c, sum(inf.v)/(SELECT count(*) FROM nation k WHERE k.n_regionkey = nation.n_regionkey) AS v FROM inf JOIN nation ON n_nationkey = inf.id GROUP BY 1, 2, nation.n_regionkey),
us AS (SELECT c, b, {S.draw31_sql('u', 3, 'c', 'b')} FROM (SELECT DISTINCT c FROM cm), range(0, {BOOT_DRAWS}) bb(b)), dr AS (SELECT key, us.b, sum(cm.v*(CASE WHEN u >= 1073741824 THEN 1 ELSE -1 END))/sqrt(5) AS value FROM cm JOIN us ON us.c = cm.c GROUP BY 1, 2)
SELECT key, {r(f'(quantile_disc(value, 0.75) - quantile_disc(value, 0.25))/{Z!r}/sqrt(5)')} AS se FROM dr GROUP BY 1 HAVING sum(value*value) > 1.4901161193847656e-7""")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    fit = G.fit_panel(p, A.Design(weight="w", cluster="region"))
    ps = [q for q in G.build_params("dynamic", fit.att, fit.shares["share"], fit.periods[-1]) if q.key is not None]
    sizes = fit.units.groupBy("cluster").agg(F.count("*").alias("cluster_units"))
    psi = B.collapse_to_clusters(G.influence_long(fit, ps).join(sizes, "cluster"), "cluster")
    n = sizes.count()
    se, crit = B.draw_summary(B.multiplier_draws(psi, BOOT_DRAWS, n, seed=3), n)
    keys = spark.createDataFrame([(i, q.key) for i, q in enumerate(ps)], "param BIGINT, key BIGINT")
    return se.join(keys, "param").select("key", S.rnd("se").alias("se"))


@query("boot_mammen", with_(D.P5) + f""", a AS (SELECT id, y1 - y0 AS dy, d FROM p5), m AS (SELECT avg(dy) FILTER (d=1) AS m1, avg(dy) FILTER (d=0) AS m0, avg(d) AS db, count(*) AS n FROM a),
psi AS (SELECT id, CASE WHEN d = 1 THEN (dy-m1)/db ELSE -(dy-m0)/(1-db) END AS psi FROM a, m),
us AS (SELECT id, b, {S.draw31_sql('u', 11, 'id', 'b')} FROM p5, range(0, 199) bb(b)),
dr AS (SELECT b, sum(psi*(CASE WHEN (u+0.5)/2147483648 < {B.MAMMEN_P_LOW!r} THEN {B.MAMMEN_LOW!r} ELSE {B.MAMMEN_HIGH!r} END))/sqrt(max(n)) AS value FROM psi JOIN us USING (id), m GROUP BY 1)
SELECT count(*) AS draws, {r(f'(quantile_disc(value, 0.75) - quantile_disc(value, 0.25))/{Z!r}/sqrt(max(n))')} AS se FROM dr, m""")
def _(spark, sf):
    from panelwright.operators.did2x2 import estimate_cells

    p = D.two_period(spark, sf)
    res = estimate_cells(p, "reg", F.col("y1") - F.col("y0"), "d", unit="id")
    n = res.rows()[0].n
    draws = B.multiplier_draws(res.influence.select(F.col("id").alias("unit"), F.lit(0).alias("param"), "psi"), 199, n, seed=11, kind="mammen")
    se, _ = B.draw_summary(draws, n)
    return se.select(F.lit(199).cast("bigint").alias("draws"), S.rnd("se").alias("se"))


@query("boot_weighted", with_(D.P5) + f""", e AS (SELECT id, y1-y0 AS dy, d, x1, w, b, {S.draw31_sql('u', 5, 'id', 'b')} FROM p5, range(1, 51) bb(b)),
v AS (SELECT *, w * -ln((u+0.5)/2147483648.0) AS bw FROM e), s AS (SELECT b, x1, sum(bw*(1-d)*dy)/sum(bw*(1-d)) AS m FROM v GROUP BY 1, 2),
a AS (SELECT b, sum(bw*d*(dy-m))/sum(bw*d) AS att FROM v JOIN s USING (b, x1) GROUP BY 1) SELECT b::BIGINT AS b, {r('att')} AS att FROM a""")
def _(spark, sf):
    d = B.weighted_draws(D.two_period(spark, sf), "reg", "id", 50, F.col("y1") - F.col("y0"), "d", ["x1"], "w", seed=5)
    return d.select("b", S.rnd("att").alias("att"))


@query("boot_weighted_dr_rc")
def _(spark, sf):
    li = D.cross_section(spark, sf)
    rows = D.table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.ln("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("d"),
                                                 (F.col("l_shipdate") >= F.lit(D.CUT_DATE).cast("timestamp")).cast("double").alias("post"), (F.col("l_linestatus") == "F").cast("double").alias("x1"), F.col("l_quantity").alias("w"))
    draws = B.weighted_draws(rows, "dr", "id", 8, "y", "d", ["x1"], "w", "post", seed=5)
    return draws.select("b", "att")


@query("tidy_agg", agg_sql("t", "t >= g") + " SELECT 'ATT(' || key || ')' AS term, key AS time, " + r("est") + " AS estimate, " + r("se") + " AS std_error, " + r("est - 1.96*se") + " AS conf_low, " + r("est + 1.96*se") + " AS conf_high FROM res")
def _(spark, sf):
    a = G.aggregate(G.fit_panel(D.nation_month(spark, sf), WEIGHTED), "calendar").where("key is not null")
    return a.select(F.concat(F.lit("ATT("), F.col("key"), F.lit(")")).alias("term"), F.col("key").alias("time"), S.rnd("estimate").alias("estimate"), S.rnd("se").alias("std_error"), S.rnd("lo").alias("conf_low"), S.rnd("hi").alias("conf_high"))


@query("joint_chi2", agg_sql("t - g", "t - g BETWEEN -12 AND -2") + " SELECT " + r("sum(pow(est/se,2))", 4) + " AS statistic, count(*) AS df FROM res")
def _(spark, sf):
    a = G.aggregate(G.fit_panel(D.nation_month(spark, sf), WEIGHTED), "dynamic", min_e=-12, max_e=-2).where("key is not null")
    return G.joint_chi2(a).select(S.rnd("statistic", 4).alias("statistic"), "df")


@query("joint_wald_full")
def _(spark, sf):
    w = G.dynamic_wald(G.fit_panel(D.nation_month(spark, sf), WEIGHTED), before=-2, min_e=-6)
    return spark.createDataFrame([(w["statistic"], w["df"], w["p_value"])], "statistic DOUBLE, df INT, p_value DOUBLE")


@query("joint_holm", agg_sql("t - g", "t - g BETWEEN -12 AND -2") + ", h AS (SELECT key, est, se, " + p_t_sql("(est/se)", "(nn.n-1)") + " AS p FROM res, nn WHERE se > 1e-12), a AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS adj FROM h) SELECT key AS e, " + r("est") + " AS estimate, " + r("se") + " AS se, " + r("p") + " AS p, " + r("least(max(adj) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 1)") + " AS p_holm FROM a")
def _(spark, sf):
    fit = G.fit_panel(D.nation_month(spark, sf), WEIGHTED)
    a = G.aggregate(fit, "dynamic", min_e=-12, max_e=-2).where("key is not null and se is not null")
    a = a.select(F.col("key").alias("e"), "estimate", "se", p_t(F.col("estimate") / F.col("se"), F.lit(fit.shares["n"] - 1)).alias("p"))
    return G.holm(a, "p").select("e", *[S.rnd(c).alias(c) for c in ("estimate", "se", "p", "p_holm")])



@query("lead_lag_split", agg_sql("t - g", "t - g BETWEEN -12 AND 12") + " SELECT key AS e, " + r("est") + " AS estimate, " + r("est - 1.96*se") + " AS ci_lower, " + r("est + 1.96*se") + " AS ci_upper, key < 0 AS is_pre, (est - 1.96*se > 0 OR est + 1.96*se < 0) AS significant FROM res")
def _(spark, sf):
    a = G.aggregate(G.fit_panel(D.nation_month(spark, sf), WEIGHTED), "dynamic", min_e=-12, max_e=12)
    e = G.event_study_frame(a)
    return e.select("e", S.rnd("estimate").alias("estimate"), S.rnd("ci_lower").alias("ci_lower"), S.rnd("ci_upper").alias("ci_upper"), "is_pre", "significant")


@query("heatmap_cells", with_(P1) + arms_sql() + ", k AS (SELECT g, count(*) AS c FROM att GROUP BY 1 ORDER BY c DESC, g LIMIT 3) SELECT g, t - g AS e, " + r("att") + " AS att FROM att WHERE g IN (SELECT g FROM k)")
def _(spark, sf):
    from panelwright.operators.summaries import rows_of_top_groups

    e = A.att_gt(D.nation_month(spark, sf), WEIGHTED).where("att is not null")
    return rows_of_top_groups(e, "g", 3).select("g", (F.col("t") - F.col("g")).alias("e"), S.rnd("att").alias("att"))


CVM = 49


@query("pretest_cvm", with_(P1) + arms_sql(w="1.0") + f""", pr AS (SELECT *, id // 5 AS x, sum(1.0) OVER (PARTITION BY g, t, treated) AS sw, (CASE WHEN treated THEN 1 ELSE -1 END) AS sg FROM ch WHERE g > t),
sh AS (SELECT id // 5 AS u, count(*)/25.0 AS share FROM (SELECT DISTINCT id FROM p1) GROUP BY 1),
ja AS (SELECT u, share, g, t, treated, sum(CASE WHEN x <= u THEN sg*dy/sw ELSE 0 END) AS j FROM pr, sh GROUP BY 1, 2, 3, 4, 5),
st AS (SELECT 25*sum(share*j*j) AS s FROM (SELECT u, share, g, t, sum(j) AS j FROM ja GROUP BY 1, 2, 3, 4)),
sn AS (SELECT id, b, {S.draw31_sql('v', 9, 'id', 'b')} FROM (SELECT DISTINCT id FROM p1), range(0, {CVM}) bb(b)),
jb AS (SELECT b, ja.u, ja.share, pr.g, pr.t, sum((CASE WHEN v >= 1073741824 THEN 1 ELSE -1 END)*((CASE WHEN x <= ja.u THEN sg*dy/sw ELSE 0 END) - ja.j/sw)) AS jb FROM pr JOIN sn USING (id) JOIN ja ON ja.g = pr.g AND ja.t = pr.t AND ja.treated = pr.treated GROUP BY 1, 2, 3, 4, 5),
cb AS (SELECT b, 25*sum(share*jb*jb) AS s FROM jb GROUP BY 1)
SELECT {r('max(st.s)')} AS statistic, {r('quantile_disc(cb.s, 0.95)')} AS critical, {r('avg((cb.s > st.s)::INT)')} AS p_value, count(*) AS draws FROM cb, st""")
def _(spark, sf):
    from panelwright.operators.pretest import cvm_pretest

    p = D.nation_month(spark, sf).withColumn("x", F.floor(F.col("id") / 5).cast("double"))
    t = cvm_pretest(p, PLAIN, "x", CVM, seed=9)
    return t.select(*[S.rnd(c).alias(c) for c in ("statistic", "critical", "p_value")], "draws")


@query("j_cell_reason", support_sql(False).replace("FROM p2 a WHERE", "FROM (SELECT * FROM p2 WHERE NOT (g IS NULL AND t % 5 = 0)) a WHERE") + " SELECT g, t, reason FROM support WHERE NOT identifiable")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).where("not (g is null and t % 5 = 0)")
    est = A.att_gt(p, A.Design(mode="unbalanced"), "reg").where("is_post and att is null").select("g", "t")
    sup = A.support_table(p, PLAIN).select("g", "t", F.col("reason").alias("why"), "identifiable")
    grid = sup.where("not identifiable").select("g", "t")
    return grid.join(est, ["g", "t"], "left").join(sup, ["g", "t"], "left").select("g", "t", F.col("why").alias("reason"))


@query("group_dynamics", with_(P1) + arms_sql(w="1.0") + ", s AS (SELECT g, count(DISTINCT id) AS u FROM p1 WHERE g IS NOT NULL GROUP BY 1) SELECT att.g, att.t - att.g AS e, " + r("att") + " AS att, u AS units, row_number() OVER (PARTITION BY att.g ORDER BY att.t)::INT AS step FROM att JOIN s USING (g) WHERE att.t >= att.g")
def _(spark, sf):
    from pyspark.sql import Window

    p = D.nation_month(spark, sf)
    sizes = p.where("g is not null").groupBy("g").agg(F.count_distinct("id").alias("units"))
    e = A.att_gt(p, PLAIN).where("is_post").join(sizes, "g")
    return e.select("g", (F.col("t") - F.col("g")).alias("e"), S.rnd("att").alias("att"), "units", F.row_number().over(Window.partitionBy("g").orderBy("t")).alias("step"))


@query("f_distribution", with_(P1) + ", k AS (SELECT id, avg(y)/stddev_samp(y) AS z, count(*) AS n FROM p1 GROUP BY 1) SELECT id, " + r("z") + " AS z, " + r(p_t_sql("z", "(n-1)")) + " AS p_t, " + r(p_t_sql("z", "(n-1)")) + " AS p_f, " + r("exp(-z*z/2)") + " AS p_chi2 FROM k")
def _(spark, sf):
    """Upper tails of observed statistics; an F with one numerator degree is a squared t, a chi-square with two is exponential."""
    p = D.nation_month(spark, sf).groupBy("id").agg((F.avg("y") / F.stddev_samp("y")).alias("z"), F.count("*").alias("n"))
    z2 = F.col("z") * F.col("z")
    return p.select("id", S.rnd("z").alias("z"), S.rnd(p_t("z", F.col("n") - 1)).alias("p_t"), S.rnd(p_f(z2, F.lit(1), F.col("n") - 1)).alias("p_f"), S.rnd(p_chi2(z2, F.lit(2))).alias("p_chi2"))
