"""Joins, aggregations, windows, sorts, set operations, reshaping and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators import panel as P
from panelwright.operators import summaries as A
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, P3, P4, with_
from panelwright.functions.pvalues import p_t, p_t_sql
from panelwright.plans.registry import query, r
from panelwright.sources import tables as T

# ---- joins ---------------------------------------------------------------


@query("j_left_eq", "SELECT n_nationkey::BIGINT AS id, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("s_suppkey").alias("suppliers"))
    n = T.table(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"), "n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("j_inner", with_(D.P6) + "SELECT o_orderkey, " + r("vold.o_totalprice", 2) + " AS o_totalprice_old, " + r("vnew.o_totalprice", 2) + " AS o_totalprice_new FROM vold JOIN vnew USING (o_orderkey)")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    j = old.select("o_orderkey", F.col("o_totalprice").alias("a")).join(new.select("o_orderkey", F.col("o_totalprice").alias("b")), "o_orderkey")
    return j.select("o_orderkey", S.rnd("a", 2).alias("o_totalprice_old"), S.rnd("b", 2).alias("o_totalprice_new"))


@query("j_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')")
def _(spark, sf):
    o = T.table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return T.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')")
def _(spark, sf):
    o = T.table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return T.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("j_in_set", with_(P2) + "SELECT id, t FROM p2 WHERE id IN (SELECT id FROM p2 WHERE n >= 4)")
def _(spark, sf):
    p = D.customer_quarter(spark, sf)
    return p.join(p.where("n >= 4").select("id").distinct(), "id", "left_semi").select("id", "t")


@query("j_match_lookup", with_(P1) + "SELECT id, t, " + r("y - (SELECT avg(b.y) FROM p1 b WHERE b.t = p1.t)") + " AS dev FROM p1")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    return p.join(p.groupBy("t").agg(F.avg("y").alias("m")), "t").select("id", "t", S.rnd(F.col("y") - F.col("m")).alias("dev"))


@query("j_cross_grid", with_(P1) + "SELECT g, t, s.eff::DOUBLE AS effect FROM (SELECT DISTINCT g FROM p1 WHERE g IS NOT NULL) a, (SELECT DISTINCT t FROM p1) b, (VALUES (0.0), (0.1), (0.2)) s(eff)")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    axis = p.agg(F.array_sort(F.collect_set("t")).alias("a")).scalar()
    g = p.where("g is not null").select("g").distinct()
    return g.withColumn("t", F.explode(axis)).withColumn("effect", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2))))


# ---- aggregations --------------------------------------------------------

@query("a_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, " + ", ".join(
    r(f"{f}(l_discount)") + f" AS {n}" for f, n in (("avg", "mean"), ("min", "lo"), ("max", "hi"), ("stddev_samp", "sd"), ("var_samp", "var"), ("median", "med"))) + ", " + r("sum(l_quantity)", 2) + " AS qty FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    c = F.col("l_discount")
    a = li.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), S.rnd(F.avg(c)).alias("mean"), S.rnd(F.min(c)).alias("lo"),
                              S.rnd(F.max(c)).alias("hi"), S.rnd(F.stddev_samp(c)).alias("sd"), S.rnd(F.var_samp(c)).alias("var"), S.rnd(F.sum("l_quantity"), 2).alias("qty"))
    med = exact_quantiles(li, keys, "l_discount", {"med": 0.5})
    return a.join(med.withColumn("med", S.rnd("med")), keys)


@query("a_cond", with_(P2) + "SELECT g, min(CASE WHEN n >= 2 THEN t END) AS first_busy, bool_or(n >= 5) AS any_five, count(*) FILTER (t < g) AS pre, count(DISTINCT CASE WHEN t >= g THEN id END) AS post_units FROM p2 GROUP BY 1")
def _(spark, sf):
    p = D.customer_quarter(spark, sf)
    return p.groupBy("g").agg(F.min(F.when(F.col("n") >= 2, F.col("t"))).alias("first_busy"), F.bool_or(F.col("n") >= 5).alias("any_five"),
                              F.count_if(F.col("t") < F.col("g")).alias("pre"), F.count_distinct(F.when(F.col("t") >= F.col("g"), F.col("id"))).alias("post_units"))


@query("a_count", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("a_dup_audit", "WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT 'lineitem' AS label, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_dup_keys, max(n) AS max_rows, sum(n - 1)::BIGINT AS extra_rows FROM c")
def _(spark, sf):
    return A.dup_audit(T.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


@query("a_wmean", "SELECT l_shipdate::DATE AS d, " + r("sum(l_discount*l_quantity)/sum(l_quantity)") + " AS disc FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(S.rnd(A.weighted_mean("l_discount", "l_quantity")).alias("disc"))


@query("a_wratio", "SELECT l_returnflag, " + r("sum(l_quantity*l_tax)/sum(l_quantity*l_discount)") + " AS ratio FROM lineitem GROUP BY 1")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(S.rnd(F.sum(F.expr("l_quantity*l_tax")) / F.sum(F.expr("l_quantity*l_discount"))).alias("ratio"))


@query("a_quantile", "SELECT l_returnflag, " + ", ".join(r(f"quantile_cont(l_extendedprice, {p})", 4) + f" AS q{round(p*100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", " + r("quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)", 4) + " AS iqr FROM lineitem GROUP BY 1")
def _(spark, sf):
    q = exact_quantiles(T.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"q{round(p*100)}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)})
    return q.select("l_returnflag", *[S.rnd(f"q{k}", 4).alias(f"q{k}") for k in (5, 25, 50, 75, 95)], S.rnd(F.col("q75") - F.col("q25"), 4).alias("iqr"))


@query("a_quantile_type1", "SELECT o_orderpriority, " + ", ".join(r(f"quantile_disc(o_totalprice, {p})", 2) + f" AS q{round(p*100)}" for p in (0.25, 0.75)) + " FROM orders GROUP BY 1")
def _(spark, sf):
    q = exact_quantiles(T.table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", {"q25": 0.25, "q75": 0.75}, kind=1)
    return q.select("o_orderpriority", S.rnd("q25", 2).alias("q25"), S.rnd("q75", 2).alias("q75"))


@query("a_concat", with_(P2) + "SELECT t - g AS e, count(DISTINCT g) AS k, string_agg(DISTINCT g::VARCHAR, ',' ORDER BY g::VARCHAR) AS cohorts FROM p2 WHERE g IS NOT NULL GROUP BY 1")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).where("g is not null").select((F.col("t") - F.col("g")).alias("e"), F.col("g").cast("string").alias("gs")).distinct()
    return p.groupBy("e").agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_list("gs")), ",").alias("cohorts"))


SLOPE_SE = lambda y, x: f"sqrt(greatest(regr_syy({y},{x}) - regr_slope({y},{x})*regr_sxy({y},{x}), 0)/(count(*)-2)/regr_sxx({y},{x}))"
SLOPE = lambda y, x: (f"count(*) AS n, {r(f'regr_slope({y},{x})')} AS slope, {r(f'regr_intercept({y},{x})', 4)} AS intercept, {r(f'regr_r2({y},{x})')} AS r2, "
                      + r(SLOPE_SE(y, x)) + " AS se, " + r(p_t_sql(f"regr_slope({y},{x})/nullif({SLOPE_SE(y, x)}, 0)", "(count(*)-2)")) + " AS p")


@query("a_slope", with_(P1) + "SELECT id, " + SLOPE("y", "t") + " FROM p1 WHERE g IS NULL OR t < g GROUP BY 1")
def _(spark, sf):
    return A.ols_slope(D.nation_month(spark, sf).where("g is null or t < g"), ["id"], "y", "t")


CORR_T = "corr(l_quantity, l_extendedprice)*sqrt((count(*)-2)/(1-corr(l_quantity, l_extendedprice)^2))"


@query("a_corr", "SELECT l_returnflag, count(*) AS n, " + r("corr(l_quantity, l_extendedprice)") + " AS r, " + r(CORR_T, 3) + " AS t, " + r(p_t_sql(CORR_T, "(count(*)-2)")) + " AS p FROM lineitem GROUP BY 1")
def _(spark, sf):
    rr = F.corr("l_quantity", "l_extendedprice")
    a = T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), rr.alias("r"), (rr * F.sqrt((F.count("*") - 2) / (1 - rr * rr))).alias("t"))
    return a.select("l_returnflag", "n", S.rnd("r").alias("r"), S.rnd("t", 3).alias("t"), S.rnd(p_t("t", F.col("n") - 2)).alias("p"))


@query("a_mean_se_ci", with_(P1) + "SELECT t, g IS NOT NULL AS treated, count(*) AS n, " + r("avg(y)") + " AS mean, " + r("stddev_samp(y)/sqrt(count(*))") + " AS se, " + r("avg(y) - 1.96*stddev_samp(y)/sqrt(count(*))") + " AS lo, " + r("avg(y) + 1.96*stddev_samp(y)/sqrt(count(*))") + " AS hi FROM p1 GROUP BY 1, 2")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumn("treated", F.col("g").isNotNull())
    return A.mean_se_ci(p, ["t", "treated"], "y")


@query("a_sum_by_cluster", with_(P1) + "SELECT region, t, count(*) AS n, " + r("sum(y)") + " AS total, " + r("sum(y)/count(*)") + " AS mean FROM p1 GROUP BY 1, 2")
def _(spark, sf):
    return D.nation_month(spark, sf).groupBy("region", "t").agg(F.count("*").alias("n"), S.rnd(F.sum("y")).alias("total"), S.rnd(F.sum("y") / F.count("*")).alias("mean"))


@query("a_gram", with_(P4) + "SELECT d, count(*) AS n, " + ", ".join(r(f"sum({e}) / count(*)") + f" AS {n}" for e, n in (("w", "w00"), ("w*x1", "w01"), ("w*post", "w02"), ("w*x1*x1", "w11"), ("w*x1*post", "w12"), ("w*post*post", "w22"), ("w*y", "b0"), ("w*x1*y", "b1"), ("w*post*y", "b2"))) + " FROM p4 GROUP BY 1")
def _(spark, sf):
    from panelwright.operators.moments import gram

    g = gram(D.cross_section(spark, sf), ["d"], [F.lit(1.0), F.col("x1"), F.col("post")], F.col("y"), F.col("w"))
    at = lambda a, i: S.rnd(F.col(a)[i] / F.col("n"))
    return g.select("d", "n", *[at("xtx", i).alias(n) for i, n in enumerate(("w00", "w01", "w02", "w11", "w12", "w22"))], *[at("xty", i).alias(f"b{i}") for i in range(3)])


@query("a_hhi", "WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT " + r("sum((v/(SELECT sum(v) FROM s))^2)", 8) + " AS hhi, " + "arg_max(l_suppkey, v) AS top FROM s")
def _(spark, sf):
    s = T.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    # sum of squared shares needs the total once: a ratio of two sums.
    return s.agg(S.rnd(F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v")), 8).alias("hhi"), F.max_by("l_suppkey", "v").alias("top"))


@query("a_regime_ts", with_(P1) + "SELECT t, CASE WHEN g IS NULL THEN 'never' WHEN g < 23980 THEN 'early' ELSE 'late' END AS regime, " + r("avg(y)") + " AS y FROM p1 GROUP BY 1, 2")
def _(spark, sf):
    regime = F.when(F.col("g").isNull(), "never").when(F.col("g") < 23980, "early").otherwise("late")
    return D.nation_month(spark, sf).groupBy("t", regime.alias("regime")).agg(S.rnd(F.avg("y")).alias("y"))


# ---- windows -------------------------------------------------------------

@query("w_lag", with_(P2) + "SELECT id, t, lag(n, 1) OVER w AS lag1, lag(n, 3) OVER w AS lag3 FROM p2 WINDOW w AS (PARTITION BY id ORDER BY t)")
def _(spark, sf):
    w = Window.partitionBy("id").orderBy("t")
    return D.customer_quarter(spark, sf).select("id", "t", F.lag("n", 1).over(w).alias("lag1"), F.lag("n", 3).over(w).alias("lag3"))


@query("w_gap", with_(P3) + "SELECT id, d, " + r("(d - lag(d) OVER (PARTITION BY id ORDER BY d))/30.44") + " AS gap_months, coalesce((d - lag(d) OVER (PARTITION BY id ORDER BY d))/30.44 > 0.05, false) AS is_gap FROM p3")
def _(spark, sf):
    w = Window.partitionBy("id").orderBy("d")
    gap = S.months_real(F.col("d"), F.lag("d").over(w))
    return D.user_day(spark, sf).select("id", "d", S.rnd(gap).alias("gap_months"), F.coalesce(gap > 0.05, F.lit(False)).alias("is_gap"))


@query("w_cumsum", with_(P3) + "SELECT id, d, " + r("sum(v) OVER (PARTITION BY id ORDER BY d)", 4) + " AS cum FROM p3")
def _(spark, sf):
    w = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return D.user_day(spark, sf).select("id", "d", S.rnd(F.sum("v").over(w), 4).alias("cum"))


@query("w_share_of_peak", with_(P3) + "SELECT id, d, " + r("v / max(v) OVER (PARTITION BY id)") + " AS share FROM p3")
def _(spark, sf):
    p = D.user_day(spark, sf)
    return p.join(p.groupBy("id").agg(F.max("v").alias("peak")), "id").select("id", "d", S.rnd(F.col("v") / F.col("peak")).alias("share"))


@query("w_row_number", with_(P2) + "SELECT t, (row_number() OVER (ORDER BY t))::INT AS seq FROM (SELECT DISTINCT t FROM p2)")
def _(spark, sf):
    # The distinct periods are one short array; its positions are the row numbers.
    axis = D.customer_quarter(spark, sf).agg(F.array_sort(F.collect_set("t")).alias("a"))
    return axis.select(F.posexplode("a").alias("p", "t")).select("t", (F.col("p") + 1).alias("seq"))


@query("w_first_in_group", "SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_order FROM orders GROUP BY 1")
def _(spark, sf):
    return T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("w_min_over_unit", with_(P3) + "SELECT id, d, min(CASE WHEN n >= 3 THEN d END) OVER (PARTITION BY id) AS start FROM p3")
def _(spark, sf):
    p = D.user_day(spark, sf).withColumn("hit", F.when(F.col("n") >= 3, F.col("d")))
    return P.attach_min(p, "id", "hit", "start").select("id", "d", "start")


@query("w_within_demean", with_(P1) + "SELECT id, t, " + r("y - avg(y) OVER (PARTITION BY id) - avg(y) OVER (PARTITION BY t) + avg(y) OVER ()") + " AS resid FROM p1")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    mi, mt = p.groupBy("id").agg(F.avg("y").alias("mi")), p.groupBy("t").agg(F.avg("y").alias("mt"))
    x = p.join(mi, "id").join(mt, "t").withColumn("m", p.agg(F.avg("y")).scalar())
    return x.select("id", "t", S.rnd(F.col("y") - F.col("mi") - F.col("mt") + F.col("m")).alias("resid"))


@query("w_index_base", with_(P1) + ", b AS (SELECT id, avg(amt) AS base FROM p1 WHERE t < 23953 GROUP BY 1) SELECT p1.id, t, " + r("CASE WHEN base > 0 THEN 100 * amt / base END", 4) + " AS idx FROM p1 JOIN b ON b.id = p1.id")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    base = p.where("t < 23953").groupBy("id").agg(F.avg("amt").alias("base"))
    return p.join(base, "id").select("id", "t", S.rnd(F.when(F.col("base") > 0, 100 * F.col("amt") / F.col("base")), 4).alias("idx"))


@query("w_tertiles", "WITH c AS (SELECT quantile_cont(c_acctbal, 1/3.0) AS a, quantile_cont(c_acctbal, 2/3.0) AS b FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'Low' WHEN c_acctbal <= b THEN 'Medium' ELSE 'High' END AS tertile FROM customer, c")
def _(spark, sf):
    c = T.table(spark, sf, "customer")
    q = exact_quantiles(c, [], "c_acctbal", {"a": 1 / 3.0, "b": 2 / 3.0}).select(F.array(F.lit(float("-inf")), "a", "b", F.lit(float("inf"))).alias("cuts"))
    x = c.withColumn("cuts", q.scalar())
    return x.select("c_custkey", P.breakpoint_bins("c_acctbal", F.col("cuts"), ["Low", "Medium", "High"]).alias("tertile"))


# ---- sorts and top-k -----------------------------------------------------

@query("s_arrange", "SELECT s_suppkey, " + r("s_acctbal", 2) + " AS s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC NULLS LAST, s_suppkey")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").orderBy(F.abs("s_acctbal").desc_nulls_last(), "s_suppkey")
    return s.select("s_suppkey", S.rnd("s_acctbal", 2).alias("s_acctbal"))


@query("s_head", "SELECT o_orderkey, " + r("o_totalprice", 2) + " AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    o = T.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return o.select("o_orderkey", S.rnd("o_totalprice", 2).alias("o_totalprice"))


@query("s_topk_groups", with_(P2) + ", k AS (SELECT id, count(*) AS c FROM p2 GROUP BY 1 ORDER BY c DESC, id LIMIT 5) SELECT id, t, n FROM p2 WHERE id IN (SELECT id FROM k)")
def _(spark, sf):
    p = D.customer_quarter(spark, sf)
    return A.rows_of_top_groups(p, "id", 5).select("id", "t", "n")


@query("s_argmax", with_(P1) + "SELECT id, arg_max(t, n * 100000 - t) AS peak_month, max(n) AS peak FROM p1 GROUP BY 1")
def _(spark, sf):
    return D.nation_month(spark, sf).groupBy("id").agg(F.max_by("t", F.col("n") * 100000 - F.col("t")).alias("peak_month"), F.max("n").alias("peak"))


# ---- set operations and reshaping ----------------------------------------

@query("u_union", "SELECT s_suppkey AS k, s_nationkey::BIGINT AS nation, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_nationkey::BIGINT, c_mktsegment FROM customer")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("nation"))
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("seg"))
    return s.unionByName(c, allowMissingColumns=True)


@query("u_setdiff", "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("k")).subtract(o.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")).select(F.col("o_custkey").alias("k")))


@query("u_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("u_distinct", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("u_reference_row", with_(P1) + "SELECT t - g AS e, " + r("avg(y)") + " AS estimate FROM p1 WHERE t - g BETWEEN -5 AND 5 AND t - g <> -1 GROUP BY 1 UNION ALL SELECT -1, 0.0")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumn("e", F.col("t") - F.col("g")).where("e between -5 and 5 and e <> -1")
    return A.with_reference_row(p.groupBy("e").agg(S.rnd(F.avg("y")).alias("estimate")), e=-1, estimate=0.0)


@query("r_longer", "SELECT c_custkey, 'c_nationkey' AS variable, c_nationkey::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer")
def _(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_acctbal")
    return c.unpivot(["c_custkey"], ["c_nationkey", "c_acctbal"], "variable", "value")


@query("r_wider", "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (l_returnflag = '{x}') AS {x}_n, {r(f'avg(l_quantity) FILTER (l_returnflag = {chr(39)}{x}{chr(39)})')} AS {x}_qty" for x in "ANR") + " FROM lineitem GROUP BY 1")
def _(spark, sf):
    w = T.table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)).alias("n"), S.rnd(F.avg("l_quantity")).alias("qty"))
    return w.select("l_suppkey", *[F.coalesce(f"{x}_n", F.lit(0)).alias(f"{x}_n") for x in "ANR"], *[f"{x}_qty" for x in "ANR"])


# ---- scalar families -----------------------------------------------------

@query("f_string", "SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z]', '', 'g') AS letters, lpad((c_nationkey)::VARCHAR, 5, '0') AS code, substr(c_mktsegment, 2, 3) AS mid, split_part(c_name, '#', 2) AS part, upper(substr(c_mktsegment,1,2)) AS suffix FROM customer")
def _(spark, sf):
    c = T.table(spark, sf, "customer")
    tagged = F.concat("c_name", F.lit(", "), F.upper(F.substring("c_mktsegment", 1, 2)))
    return c.select("c_custkey", S.letters_key("c_name").alias("letters"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("code"),
                    F.substring("c_mktsegment", 2, 3).alias("mid"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"), S.trailing_code(tagged).alias("suffix"))


@query("f_date", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS iso, date_trunc('month', o_orderdate)::DATE AS short, date_trunc('month', o_orderdate)::DATE AS long, (year(o_orderdate)*12+month(o_orderdate))::BIGINT AS ym, " + r("(DATE '2002-01-01' - o_orderdate::DATE)/30.44") + " AS real_months, (2002*12+1 - year(o_orderdate)*12 - month(o_orderdate) - (1 < day(o_orderdate))::INT)::BIGINT AS whole_months FROM orders")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    d, ref = F.col("o_orderdate").cast("date"), F.lit("2002-01-01").cast("date")
    return o.select("o_orderkey", S.parse_month(F.date_format(d, "yyyy-MM-dd")).alias("iso"), S.parse_month(F.date_format(d, "MMM-yy")).alias("short"),
                    S.parse_month(F.date_format(d, "MMM yyyy")).alias("long"), S.month_index(d).alias("ym"), S.rnd(S.months_real(ref, d)).alias("real_months"),
                    S.months_whole(ref, d).alias("whole_months"))


@query("f_math", "SELECT l_orderkey, l_linenumber, l_partkey, " + r("ln(l_quantity)") + " AS a, " + r("greatest(least(l_quantity, 40), 10)") + " AS b, sign(l_quantity - 25)::INT AS c, " + r("1/(1+exp(-(l_quantity-25)/10))") + " AS d, abs(l_tax - l_discount) < 1.4901161193847656e-8 AS same FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity")
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.rnd(F.ln(q)).alias("a"), S.rnd(F.greatest(F.least(q, F.lit(40.0)), F.lit(10.0))).alias("b"),
                                                 F.signum(q - 25).cast("int").alias("c"), S.rnd(S.logistic((q - 25) / 10)).alias("d"), S.near("l_tax", "l_discount").alias("same"))


@query("f_na", with_(P2) + "SELECT g IS NULL AS never, (count(DISTINCT g) + max((g IS NULL)::INT))::BIGINT AS levels, coalesce(sum(CASE WHEN g IS NULL THEN NULL ELSE n END), 0)::DOUBLE AS total, count(*) FILTER (isfinite(ln(n::DOUBLE))) AS finite_rows FROM p2 GROUP BY 1")
def _(spark, sf):
    p = D.customer_quarter(spark, sf)
    return p.groupBy(F.col("g").isNull().alias("never")).agg(S.count_distinct_na("g").alias("levels"), S.sum0(F.when(F.col("g").isNull(), None).otherwise(F.col("n")).cast("double")).alias("total"),
                                                           F.count_if(S.is_finite(F.ln(F.col("n").cast("double")))).alias("finite_rows"))


@query("f_array", with_(P1) + "SELECT t, len(list(y)) AS size, " + r("list_sort(list(y))[1 + (t * 7919) % 25]") + " AS pick FROM p1 GROUP BY 1")
def _(spark, sf):
    p = D.nation_month(spark, sf).groupBy("t").agg(F.array_sort(F.collect_list("y")).alias("pool"))
    return p.select("t", F.size("pool").cast("bigint").alias("size"), S.rnd(F.element_at("pool", (1 + F.pmod(F.col("t") * 7919, F.size("pool"))).cast("int"))).alias("pick"))


@query("f_factor", with_(P2) + "SELECT coalesce(g::VARCHAR, 'never') AS level, count(*) AS n, sum((g = 7983)::INT)::BIGINT AS is_7983 FROM p2 GROUP BY 1")
def _(spark, sf):
    p = D.customer_quarter(spark, sf)
    return p.groupBy(F.coalesce(F.col("g").cast("string"), F.lit("never")).alias("level")).agg(F.count("*").alias("n"), F.sum((F.col("g") == 7983).cast("bigint")).alias("is_7983"))
