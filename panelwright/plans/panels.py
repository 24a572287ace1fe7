"""Panels the queries run on, derived from the given tables in Spark, with the
same derivations as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalars import month_index
from panelwright.sources.tables import table

# Fixed values of the derived panels.
FIRST_COHORT = 23941
COHORT_STEP = 18
CUT_DATE = "1998-06-01"


def monthly_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Orders summed per customer and month before anything is joined, so a
    customer holding a large share of all orders shrinks to one row a month."""
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey", month_index("o_orderdate").alias("t"))
        .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amt"))
    )


def nation_month(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced panel nation x month, zero filled: id, t, g, n, amt, y, region, w."""
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("id"))
    cell = (
        cust.join(monthly_by_customer(spark, sf), F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy("id", "t")
        .agg(F.sum("n").alias("n"), F.sum("amt").alias("amt"))
    )
    weight = cust.groupBy("id").agg(F.count("*").cast("double").alias("w"))
    months = cell.agg(F.array_sort(F.collect_set("t")).alias("months"))
    grid = cell.select("id").distinct().withColumn("t", F.explode(months.scalar()))
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("region"))
    k = F.pmod(F.col("id"), F.lit(5))
    return (
        grid.join(cell, ["id", "t"], "left")
        .join(weight, "id")
        .join(nat, "id")
        .select(
            "id", "t",
            F.when(k != 0, F.lit(FIRST_COHORT) + F.lit(COHORT_STEP) * k).cast("bigint").alias("g"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("amt", F.lit(0.0)).alias("amt"),
            F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("y"),
            "region", "w",
        )
    )


P1 = """
p1 AS (
  WITH cell AS (
    SELECT c_nationkey AS id, year(o_orderdate)*12 + month(o_orderdate) AS t, count(*) AS n, sum(o_totalprice) AS amt
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  grid AS (
    SELECT i.id, s.t FROM (SELECT DISTINCT c_nationkey AS id FROM customer) i CROSS JOIN (SELECT DISTINCT t FROM cell) s)
  SELECT grid.id::BIGINT AS id, grid.t::BIGINT AS t,
         (CASE WHEN grid.id % 5 = 0 THEN NULL ELSE 23941 + 18*(grid.id % 5) END)::BIGINT AS g,
         coalesce(cell.n, 0)::BIGINT AS n, coalesce(cell.amt, 0.0) AS amt, ln(1 + coalesce(cell.n, 0)) AS y,
         n_regionkey::BIGINT AS region, wt.w
  FROM grid LEFT JOIN cell ON grid.id = cell.id AND grid.t = cell.t
  JOIN nation ON n_nationkey = grid.id
  JOIN (SELECT c_nationkey AS id, count(*)::DOUBLE AS w FROM customer GROUP BY 1) wt ON wt.id = grid.id)"""


def customer_quarter(spark: SparkSession, sf: str) -> DataFrame:
    """Unbalanced panel customer x quarter, observed cells only: id, t, g, n, amt, y."""
    q = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("bigint")
    k = F.pmod(F.col("id"), F.lit(7))
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("id"), q.alias("t"))
        .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amt"))
        .select("id", "t", F.when(k != 0, F.lit(7980) + F.lit(3) * k).cast("bigint").alias("g"), "n", "amt",
                F.log1p(F.col("n").cast("double")).alias("y"))
    )


P2 = """
p2 AS (
  SELECT o_custkey AS id, (year(o_orderdate)*4 + quarter(o_orderdate))::BIGINT AS t,
         (CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 7980 + 3*(o_custkey % 7) END)::BIGINT AS g,
         count(*)::BIGINT AS n, sum(o_totalprice) AS amt, ln(1 + count(*)) AS y
  FROM orders GROUP BY 1, 2, 3)"""


def user_day(spark: SparkSession, sf: str) -> DataFrame:
    """Panel user x day: id, d (date), t (day index), n, v, g."""
    d = F.col("ts").cast("date")
    k = F.pmod(F.col("id"), F.lit(4))
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("id"), d.alias("d"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        .select("id", "d", F.datediff("d", F.lit("2024-01-01").cast("date")).cast("bigint").alias("t"), "n", "v",
                F.when(k != 0, F.lit(6) * k).cast("bigint").alias("g"))
    )


P3 = """
p3 AS (
  SELECT user_id AS id, ts::DATE AS d, (ts::DATE - DATE '2024-01-01')::BIGINT AS t, count(*)::BIGINT AS n, sum(value) AS v,
         (CASE WHEN user_id % 4 = 0 THEN NULL ELSE 6 * (user_id % 4) END)::BIGINT AS g
  FROM events GROUP BY 1, 2, 3, 6)"""


def cross_section(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated cross-sections, one line item each: y, d, post, x1, w."""
    return table(spark, sf, "lineitem").select(
        F.ln("l_extendedprice").alias("y"),
        (F.col("l_returnflag") == "R").cast("double").alias("d"),
        (F.col("l_shipdate") >= F.lit(CUT_DATE).cast("timestamp")).cast("double").alias("post"),
        (F.col("l_linestatus") == "F").cast("double").alias("x1"),
        F.col("l_quantity").alias("w"),
    )


P4 = """
p4 AS (
  SELECT ln(l_extendedprice) AS y, (l_returnflag = 'R')::INT::DOUBLE AS d,
         (l_shipdate >= TIMESTAMP '1998-06-01')::INT::DOUBLE AS post, (l_linestatus = 'F')::INT::DOUBLE AS x1, l_quantity AS w
  FROM lineitem)"""


def two_period(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer with orders in both halves: id, y0, y1, d, x1, w."""
    late = F.col("o_orderdate") >= F.lit(CUT_DATE).cast("timestamp")
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("x1"),
        (F.col("c_acctbal") > 0).cast("double").alias("x2"))
    halves = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(F.sum(F.when(~late, F.col("o_totalprice"))).alias("a0"), F.sum(F.when(late, F.col("o_totalprice"))).alias("a1"),
             F.count("*").alias("k"))
        .where("a0 is not null and a1 is not null")
    )
    return halves.join(cust, "id").select(
        "id", F.ln("a0").alias("y0"), F.ln("a1").alias("y1"),
        (F.pmod(F.col("id"), F.lit(3)) == 0).cast("double").alias("d"), "x1", "x2", F.col("k").cast("double").alias("w"))


P5 = """
p5 AS (
  SELECT id, ln(a0) AS y0, ln(a1) AS y1, (id % 3 = 0)::INT::DOUBLE AS d, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS x1,
         (c_acctbal > 0)::INT::DOUBLE AS x2, k::DOUBLE AS w
  FROM (SELECT o_custkey AS id, sum(CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN o_totalprice END) AS a0,
               sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-06-01' THEN o_totalprice END) AS a1, count(*) AS k
        FROM orders GROUP BY 1) h
  JOIN customer ON c_custkey = id WHERE a0 IS NOT NULL AND a1 IS NOT NULL)"""


def vintages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An older vintage of the orders, with changed cells, and the current one."""
    new = table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("yr"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    old = (
        new.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp"))
        .withColumn("o_totalprice", F.when(F.pmod(key, F.lit(97)) == 0, F.col("o_totalprice") + 10.0)
                    .when(F.pmod(key, F.lit(89)) == 0, F.lit(None)).otherwise(F.col("o_totalprice")))
        .withColumn("o_orderstatus", F.when(F.pmod(key, F.lit(101)) == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    )
    dropped = F.pmod(key, F.lit(53)) == 0
    return old, new.where(~(dropped & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))))


P6 = """
vnew AS (
  SELECT o_orderkey, year(o_orderdate)::BIGINT AS yr, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
  WHERE NOT (o_orderkey % 53 = 0 AND o_orderdate < TIMESTAMP '1996-01-01')),
vold AS (
  SELECT o_orderkey, year(o_orderdate)::BIGINT AS yr, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 10.0 WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')"""


def segment_month(spark: SparkSession, sf: str) -> DataFrame:
    """County-like panel: nation x market segment x month with a denominator and a covariate."""
    cust = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    stock = cust.groupBy("nation", "seg").agg(F.count("*").alias("stock"), F.avg("c_acctbal").alias("bal"))
    flow = (
        cust.join(monthly_by_customer(spark, sf), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("nation", "seg", "t").agg(F.sum("n").alias("filings"))
    )
    return flow.join(stock, ["nation", "seg"])


PC = """
pc AS (
  SELECT f.nation, f.seg, f.t, f.filings, s.stock, s.bal
  FROM (SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS seg, (year(o_orderdate)*12 + month(o_orderdate))::BIGINT AS t, count(*)::BIGINT AS filings
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) f
  JOIN (SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS seg, count(*)::BIGINT AS stock, avg(c_acctbal) AS bal FROM customer GROUP BY 1, 2) s
  USING (nation, seg))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
