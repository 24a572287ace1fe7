"""Data set comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import diff as X
from panelwright.plans import panels as D
from panelwright.plans.panels import P2, P6, with_
from panelwright.plans.registry import query, r
from panelwright.sources import tables as T


@query("diff_schema", "SELECT * FROM (VALUES ('c_acctbal','only_old'),('c_custkey','only_old'),('c_mktsegment','only_old'),('c_name','only_old'),('c_nationkey','only_old'),('s_acctbal','only_new'),('s_name','only_new'),('s_nationkey','only_new'),('s_suppkey','only_new')) v(\"column\", side)")
def _(spark, sf):
    return X.schema_diff(T.table(spark, sf, "customer"), T.table(spark, sf, "supplier"))


@query("diff_keys", with_(P6) + "SELECT coalesce(a.yr, b.yr) AS yr, count(*) FILTER (b.o_orderkey IS NULL) AS dropped, count(*) FILTER (a.o_orderkey IS NULL) AS added, count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS shared FROM vold a FULL JOIN vnew b ON a.o_orderkey = b.o_orderkey GROUP BY 1")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    s = X.key_sides(old, new, ["o_orderkey", "yr"])
    return s.groupBy("yr").agg(F.count_if(F.col("n_new") == 0).alias("dropped"), F.count_if(F.col("n_old") == 0).alias("added"),
                               F.count_if((F.col("n_new") > 0) & (F.col("n_old") > 0)).alias("shared"))


@query("diff_added_rows", with_(P6) + "SELECT o_orderkey, yr, o_orderstatus FROM vnew WHERE o_orderkey NOT IN (SELECT o_orderkey FROM vold)")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    return new.join(old.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", "yr", "o_orderstatus")


@query("diff_dropped_rows", with_(P6) + "SELECT o_orderkey FROM vold WHERE o_orderkey NOT IN (SELECT o_orderkey FROM vnew)")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    return X.dropped_keys(old, new, ["o_orderkey"])


@query("diff_dups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return X.duplicates(T.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


CELLS = """, j AS (SELECT o_orderkey, a.o_totalprice AS po, b.o_totalprice AS pn, a.o_orderstatus AS so, b.o_orderstatus AS sn FROM vold a JOIN vnew b USING (o_orderkey)),
cells AS (SELECT o_orderkey, 'o_totalprice' AS variable, po AS old_num, pn AS new_num FROM j WHERE (po IS NULL) <> (pn IS NULL) OR abs(po - pn) >= 1.4901161193847656e-8
  UNION ALL SELECT o_orderkey, 'o_orderstatus', NULL, NULL FROM j WHERE so <> sn)"""


@query("diff_cells", with_(P6) + CELLS + " SELECT o_orderkey, variable, " + r("old_num", 2) + " AS old_num, " + r("new_num", 2) + " AS new_num FROM cells")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    c = X.changed_cells(old, new, ["o_orderkey"])
    num = lambda x: S.rnd(F.when(F.col("variable") == "o_totalprice", F.col(x).cast("double")), 2)
    return c.select("o_orderkey", "variable", num("old").alias("old_num"), num("new").alias("new_num"))


@query("diff_cells_summary", with_(P6) + CELLS + " SELECT variable, count(*) AS changed, count(DISTINCT o_orderkey) AS keys FROM cells GROUP BY 1")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    return X.changed_cells(old, new, ["o_orderkey"]).groupBy("variable").agg(F.count("*").alias("changed"), F.count_distinct("o_orderkey").alias("keys"))


@query("diff_cells_agg", """WITH a AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1, 2),
b AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT 'l_quantity' AS variable, count(*) AS changed FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE abs(a.q - b.q) >= 1.4901161193847656e-8
UNION ALL SELECT 'l_returnflag', count(*) FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.f <> b.f""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey")
    k = ["l_orderkey", "l_linenumber"]
    old = X.aggregate_duplicates(li.where("l_partkey % 5 <> 0").drop("l_partkey"), k)
    return X.changed_cells(old, X.aggregate_duplicates(li.drop("l_partkey"), k), k).groupBy("variable").agg(F.count("*").alias("changed"))


@query("diff_headline", with_(P6) + "SELECT 'rows_old' AS metric, count(*)::DOUBLE AS value FROM vold UNION ALL SELECT 'rows_new', count(*)::DOUBLE FROM vnew UNION ALL SELECT 'keys_added', count(*)::DOUBLE FROM vnew WHERE o_orderkey NOT IN (SELECT o_orderkey FROM vold) UNION ALL SELECT 'keys_dropped', count(*)::DOUBLE FROM vold WHERE o_orderkey NOT IN (SELECT o_orderkey FROM vnew)")
def _(spark, sf):
    old, new = D.vintages(spark, sf)
    from panelwright.sources.sinks import report_rows

    s = X.key_sides(old, new, ["o_orderkey"])
    return report_rows(s.agg(F.sum("n_old").alias("rows_old"), F.sum("n_new").alias("rows_new"), F.count_if(F.col("n_old") == 0).alias("keys_added"),
                             F.count_if(F.col("n_new") == 0).alias("keys_dropped")))


@query("merge_verify", with_(P2) + ", a AS (SELECT * FROM p2 WHERE t < 7995), b AS (SELECT id, t, CASE WHEN id % 11 = 0 THEN n + 1 ELSE n END AS n FROM p2 WHERE t >= 7985) SELECT t, count(*) FILTER (a.id IS NOT NULL) AS in_a, count(*) FILTER (b.id IS NOT NULL) AS in_b, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS overlap, count(*) FILTER (a.n = b.n) AS matching FROM a FULL JOIN b ON a.id = b.id AND a.t = b.t GROUP BY coalesce(a.t, b.t), t".replace("SELECT t, count", "SELECT coalesce(a.t, b.t) AS t, count").replace("GROUP BY coalesce(a.t, b.t), t", "GROUP BY 1"))
def _(spark, sf):
    p = D.customer_quarter(spark, sf).select("id", "t", "n")
    a, b = p.where("t < 7995"), p.where("t >= 7985").withColumn("n", F.when(F.col("id") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    j = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), ["id", "t"], "full")
    return j.groupBy("t").agg(F.count("na").alias("in_a"), F.count("nb").alias("in_b"), F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("overlap"),
                              F.count_if(F.col("na") == F.col("nb")).alias("matching"))
