"""Panel construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators import panel as P
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, P3, PC, with_
from panelwright.plans.registry import query, r
from panelwright.sources import tables as T


@query("panel_collapse", "SELECT l_orderkey, l_linenumber, " + r("coalesce(sum(l_quantity),0)", 2) + " AS l_quantity, " + r("coalesce(sum(l_extendedprice),0)", 2) + " AS l_extendedprice, arg_min(l_returnflag, l_partkey::VARCHAR || '|' || l_suppkey::VARCHAR || '|' || l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    order = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag")
    c = P.collapse(T.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"], ["l_returnflag"], order)
    return c.withColumns({"l_quantity": S.rnd("l_quantity", 2), "l_extendedprice": S.rnd("l_extendedprice", 2)})


@query("panel_county", with_(PC) + "SELECT nation, seg, t, n_name AS place, " + r("CASE WHEN stock > 0 THEN 1000.0*filings/stock END") + " AS rate FROM pc JOIN nation ON n_nationkey = nation WHERE seg <> 'MACHINERY'")
def _(spark, sf):
    names = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_name").alias("place"))
    p = D.segment_month(spark, sf).where("seg <> 'MACHINERY'").join(names, "nation")
    return p.select("nation", "seg", "t", "place", S.rnd(S.rate_per_1000("filings", "stock")).alias("rate"))


@query("panel_rollup", with_(PC) + "SELECT nation, t, " + r("sum(filings)::DOUBLE") + " AS filings, " + r("sum(stock)::DOUBLE") + " AS stock, " + r("sum(CASE WHEN bal > 4400 THEN bal*stock END)/sum(CASE WHEN bal > 4400 THEN stock END)", 9) + " AS bal FROM pc GROUP BY 1, 2")
def _(spark, sf):
    c = D.segment_month(spark, sf).withColumn("bal", F.when(F.col("bal") > 4400, F.col("bal")))
    p = P.rollup_weighted(c, ["nation", "t"], ["filings", "stock"], {"bal": "stock"})
    return p.select("nation", "t", S.rnd("filings").alias("filings"), S.rnd("stock").alias("stock"), S.rnd("bal", 9).alias("bal"))


@query("panel_states_ets", "SELECT regexp_extract(s_name, '[0-9]+') AS site, s_nationkey::BIGINT AS state, count(*) AS n, " + r("sum(s_acctbal)", 2) + " AS filings FROM supplier GROUP BY 1, 2")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.regexp_extract("s_name", "[0-9]+", 0).alias("site"), F.col("s_nationkey").cast("bigint").alias("state"), "s_acctbal")
    return s.groupBy("site", "state").agg(F.count("*").alias("n"), S.rnd(F.sum("s_acctbal"), 2).alias("filings"))


@query("panel_sites_ets", "WITH s AS (SELECT c_name || ', ' || upper(substr(c_mktsegment, 1, 2)) AS city, c_acctbal FROM customer) SELECT right(city, 2) AS state_abb, regexp_replace(city, ', [A-Z]{2}$', '') AS city_name, count(*) AS n, " + r("sum(c_acctbal)", 2) + " AS filings FROM s GROUP BY 1, 2")
def _(spark, sf):
    s = T.table(spark, sf, "customer").select(F.concat("c_name", F.lit(", "), F.upper(F.substring("c_mktsegment", 1, 2))).alias("city"), "c_acctbal")
    return s.groupBy(S.trailing_code("city").alias("state_abb"), F.regexp_replace("city", r",\s[A-Z]{2}$", "").alias("city_name")).agg(
        F.count("*").alias("n"), S.rnd(F.sum("c_acctbal"), 2).alias("filings"))


PRIORITY = """, sup AS (SELECT s_nationkey::BIGINT AS id, count(*)::DOUBLE AS v FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1),
cus AS (SELECT c_nationkey::BIGINT AS id, count(*)::DOUBLE AS v FROM customer GROUP BY 1)"""


def _sources(spark, sf):
    sup = T.table(spark, sf, "supplier").where("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").cast("bigint").alias("id")).agg(F.count("*").cast("double").alias("v"))
    cus = T.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("id")).agg(F.count("*").cast("double").alias("v"))
    return sup, cus


@query("panel_priority_union", "WITH" + PRIORITY[1:] + " SELECT id, v FROM sup UNION ALL SELECT id, v FROM cus WHERE id NOT IN (SELECT id FROM sup)")
def _(spark, sf):
    sup, cus = _sources(spark, sf)
    return P.priority_union(sup, cus, ["id"])


@query("panel_source_merge", "WITH" + PRIORITY[1:] + " SELECT id, v, 'supplier_level' AS source FROM sup UNION ALL SELECT id, v, 'customer_level' FROM cus WHERE id NOT IN (SELECT id FROM sup)")
def _(spark, sf):
    sup, cus = _sources(spark, sf)
    return P.first_source_wins([("supplier_level", sup), ("customer_level", cus)], ["id"]).select("id", "v", "source")


@query("panel_hist_merge", with_(P2) + "SELECT id, t, CASE WHEN t < 7992 THEN n ELSE n * 10 END AS n, CASE WHEN t < 7992 THEN 'historical' ELSE 'current' END AS source FROM p2 WHERE t < 7992 OR t >= 7988")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).select("id", "t", "n")
    hist = p.where("t < 7992")
    cur = p.where("t >= 7988").withColumn("n", F.col("n") * 10)
    return P.first_source_wins([("historical", hist), ("current", cur)], ["id", "t"])


@query("treat_schedule", with_(P1) + ", s AS (SELECT c_nationkey::BIGINT AS id, min(year(o_orderdate)*12+month(o_orderdate))::BIGINT AS first FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 AND c_nationkey % 4 <> 1 GROUP BY 1) SELECT p1.id, t, coalesce(first, 0)::BIGINT AS g_first FROM p1 LEFT JOIN s ON p1.id = s.id")
def _(spark, sf):
    o = T.table(spark, sf, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    c = T.table(spark, sf, "customer").where("c_nationkey % 4 <> 1").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("id"))
    sched = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("id").agg(S.month_index(F.min("d")).alias("g_first"))
    return P.attach_schedule(D.nation_month(spark, sf), sched, "id", "g_first").select("id", "t", "g_first")


@query("treat_min_by_unit", with_(P2) + "SELECT id, t, min(CASE WHEN n >= 3 THEN t END) OVER (PARTITION BY id) AS start FROM p2")
def _(spark, sf):
    p = D.customer_quarter(spark, sf).withColumn("hit", F.when(F.col("n") >= 3, F.col("t")))
    return P.attach_min(p, "id", "hit", "start").select("id", "t", "start")


@query("treat_activity_pct", with_(P3) + ", k AS (SELECT id, max(v) AS peak FROM p3 GROUP BY 1) SELECT p3.id, " + ", ".join(f"min(CASE WHEN peak > 0 AND v >= {p} * peak THEN d END) AS at_{round(p*100)}pct" for p in (0.1, 0.25, 0.5, 0.75)) + " FROM p3 JOIN k ON p3.id = k.id GROUP BY 1")
def _(spark, sf):
    return P.activity_dates(D.user_day(spark, sf), "id", "d", "v", [0.1, 0.25, 0.5, 0.75], [])


@query("treat_activity_cum", with_(P3) + ", k AS (SELECT id, d, sum(n) OVER (PARTITION BY id ORDER BY d) AS cum FROM p3) SELECT id, " + ", ".join(f"min(CASE WHEN cum >= {x} THEN d END) AS at_total_{x}" for x in (10, 50, 60)) + " FROM k GROUP BY 1")
def _(spark, sf):
    return P.activity_dates(D.user_day(spark, sf), "id", "d", "n", [], [10, 50, 60])


LAG_SQL = """, k AS (SELECT id, sum(CASE WHEN o_orderdate IS NOT NULL THEN 1 END) AS n, min(o_orderdate)::DATE AS legal, max(o_orderdate)::DATE AS active
  FROM (SELECT c_custkey AS id, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey) GROUP BY 1),
m AS (SELECT id, (year(active)*12+month(active) - year(legal)*12 - month(legal) - (day(active) < day(legal) AND date_trunc('month', active) > date_trunc('month', legal))::INT)::BIGINT AS lag FROM k)"""


@query("treat_lag", "WITH" + LAG_SQL[1:] + " SELECT count(*) AS n, " + r("avg(lag)") + " AS mean_lag, " + ", ".join(r(f"quantile_cont(lag, {p})") + f" AS q{round(p*100)}" for p in (0.25, 0.5, 0.75)) + ", min(lag) AS lo, max(lag) AS hi FROM m")
def _(spark, sf):
    k = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("legal"), F.max("o_orderdate").cast("date").alias("active"))
    m = k.select(S.months_whole("active", "legal").alias("lag"))
    q = exact_quantiles(m, [], "lag", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    a = m.agg(F.count("*").alias("n"), S.rnd(F.avg("lag")).alias("mean_lag"), F.min("lag").alias("lo"), F.max("lag").alias("hi"))
    return a.withColumn("k", F.lit(1)).join(q.withColumn("k", F.lit(1)), "k").select("n", "mean_lag", *[S.rnd(c).alias(c) for c in ("q25", "q50", "q75")], "lo", "hi")


@query("treat_restrict_years", with_(P1) + "SELECT id, t, CASE WHEN g // 12 IN (1996, 1999) THEN g END AS g FROM p1")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    return p.select("id", "t", F.when(F.floor(F.col("g") / 12).isin(1996, 1999), F.col("g")).alias("g"))


@query("handle_merge", with_(P1) + ", h AS (SELECT c_nationkey::BIGINT AS id, (year(o_orderdate)*12+month(o_orderdate))::BIGINT AS t, sum(o_totalprice) AS handle FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_totalprice > 400000 GROUP BY 1,2), f AS (SELECT id, min(t) AS first FROM h GROUP BY 1) SELECT p1.id, p1.t, " + r("CASE WHEN handle IS NULL AND p1.t < first THEN 0 ELSE handle END", 2) + " AS handle, " + r("CASE WHEN handle IS NULL AND p1.t < first THEN 0 ELSE handle END", 2) + " / w" + " AS handle_per_unit FROM p1 LEFT JOIN h ON p1.id=h.id AND p1.t=h.t LEFT JOIN f ON f.id=p1.id")
def _(spark, sf):
    big = T.table(spark, sf, "orders").where("o_totalprice > 400000").groupBy("o_custkey", S.month_index("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("amt"))
    c = T.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("id"))
    h = c.join(big, F.col("c_custkey") == F.col("o_custkey")).groupBy("id", "t").agg(F.sum("amt").alias("handle"))
    first = h.groupBy("id").agg(F.min("t").alias("first"))
    p = D.nation_month(spark, sf).join(h, ["id", "t"], "left").join(first, "id", "left")
    filled = F.when(F.col("handle").isNull() & (F.col("t") < F.col("first")), F.lit(0.0)).otherwise(F.col("handle"))
    return p.select("id", "t", S.rnd(filled, 2).alias("handle"), F.when(F.col("w") > 0, S.rnd(filled, 2) / F.col("w")).alias("handle_per_unit"))


@query("panel_balance_common", with_(P1) + ", u AS (SELECT * FROM p1 WHERE NOT (id = 4 AND t % 7 = 0) AND n > 0) SELECT id, t FROM u WHERE t IN (SELECT t FROM u GROUP BY 1 HAVING count(DISTINCT id) = (SELECT count(DISTINCT id) FROM u))")
def _(spark, sf):
    u = D.nation_month(spark, sf).where("not (id = 4 and t % 7 = 0) and n > 0")
    return P.balance_common(u, "id", "t").select("id", "t")


@query("panel_balance_units", with_(P1) + ", u AS (SELECT * FROM p1 WHERE NOT (id % 6 = 4 AND t % 7 = 0)) SELECT id, t FROM u WHERE id IN (SELECT id FROM u GROUP BY 1 HAVING count(DISTINCT t) = (SELECT count(DISTINCT t) FROM u))")
def _(spark, sf):
    return P.balance_units(D.nation_month(spark, sf).where("not (id % 6 = 4 and t % 7 = 0)"), "id", "t").select("id", "t")


@query("panel_coverage_filter", with_(P2) + ", c AS (SELECT id, count(*) AS k FROM p2 GROUP BY 1) SELECT id, t, n FROM p2 WHERE id IN (SELECT id FROM c WHERE k >= 0.8 * (SELECT max(k) FROM c))")
def _(spark, sf):
    return P.coverage_filter(D.customer_quarter(spark, sf), "id", share_of_max=0.8).select("id", "t", "n")


@query("panel_untreated", with_(P2) + "SELECT id, t, n FROM p2 WHERE g IS NULL OR t < g")
def _(spark, sf):
    return P.untreated_rows(D.customer_quarter(spark, sf), "t", "g").select("id", "t", "n")


STD = """, s0 AS (SELECT id, t, CASE WHEN id = 1 THEN 23941 WHEN id = 2 THEN 30000 ELSE g END AS g FROM p1 WHERE NOT (id = 3 AND t = 24000)),
s1 AS (SELECT id, t, CASE WHEN g <= (SELECT max(t) FROM s0) THEN g END AS g FROM s0),
s3 AS (SELECT * FROM s1 WHERE g IS NULL OR g > (SELECT min(t) FROM s1)),
s4 AS (SELECT * FROM s3 WHERE id IN (SELECT id FROM s3 GROUP BY 1 HAVING count(DISTINCT t) = (SELECT count(DISTINCT t) FROM s3)))"""


def _dirty(spark, sf):
    p = D.nation_month(spark, sf).where("not (id = 3 and t = 24000)")
    return p.withColumn("g", F.when(F.col("id") == 1, F.lit(23941)).when(F.col("id") == 2, F.lit(30000)).otherwise(F.col("g")).cast("bigint"))


@query("panel_did_standardize", with_(P1) + STD + " SELECT 'input' AS step, count(*) AS rows_left, count(DISTINCT id) AS units_left FROM s0 UNION ALL SELECT 'as_if_never_treated', count(*), count(DISTINCT id) FROM s1 UNION ALL SELECT 'truncate_without_never_treated', count(*), count(DISTINCT id) FROM s1 UNION ALL SELECT 'treated_in_first_period', count(*), count(DISTINCT id) FROM s3 UNION ALL SELECT 'incomplete_units', count(*), count(DISTINCT id) FROM s4")
def _(spark, sf):
    return P.standardize(_dirty(spark, sf), "id", "t", "g")[1]


@query("panel_small_cohorts", with_(P1) + "SELECT g, count(DISTINCT id) AS units, count(DISTINCT id) < 6 AS too_small FROM p1 GROUP BY 1")
def _(spark, sf):
    return P.small_cohorts(D.nation_month(spark, sf), "id", "g", 1)


@query("panel_cohort_counts", with_(P2) + "SELECT coalesce(g, 0)::BIGINT AS g, t, count(*) AS n, count(DISTINCT id) AS units FROM p2 GROUP BY 1, 2")
def _(spark, sf):
    return D.customer_quarter(spark, sf).groupBy(F.coalesce("g", F.lit(0)).alias("g"), "t").agg(F.count("*").alias("n"), F.count_distinct("id").alias("units"))


@query("panel_wide2", with_(P2) + "SELECT a.id, " + r("a.y") + " AS y0, " + r("b.y") + " AS y1, " + r("b.y - a.y") + " AS dy FROM p2 a JOIN p2 b ON a.id = b.id AND a.t = 7990 AND b.t = 7995")
def _(spark, sf):
    w = P.wide_two_periods(D.customer_quarter(spark, sf), "id", "t", "y", 7990, 7995)
    return w.select("id", *[S.rnd(c).alias(c) for c in ("y0", "y1", "dy")])
