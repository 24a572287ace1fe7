"""Sources, sinks, projections and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators import panel as P
from panelwright.plans import panels as D
from panelwright.plans.panels import P1, P2, P4, PC, with_
from panelwright.plans.registry import query, r
from panelwright.session import output_folder
from panelwright.sources import sinks, tables as T


@query("src_parquet", "SELECT o_orderpriority, count(*) AS n, " + r("sum(o_totalprice)", 2) + " AS total FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def _(spark, sf):
    o = T.table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), S.rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("src_csv", "SELECT c_mktsegment, count(*) AS n, " + r("sum(c_acctbal)", 2) + " AS bal FROM customer GROUP BY 1")
def _(spark, sf):
    path = output_folder(spark, "csv")
    sinks.write_csv(T.table(spark, sf, "customer"), path)
    c = T.csv_scan(spark, path, "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), S.rnd(F.sum("c_acctbal"), 2).alias("bal"))


@query("src_csv_select", "SELECT c_custkey AS unit, " + r("c_acctbal", 2) + " AS bal, CAST(NULL AS INTEGER) AS bad FROM customer")
def _(spark, sf):
    path = output_folder(spark, "csv")
    sinks.write_csv(T.table(spark, sf, "customer"), path)
    c = T.csv_select(spark, path, {"unit": ("c_custkey", "bigint"), "bal": ("c_acctbal", "double"), "bad": ("c_name", "int")})
    return c.withColumn("bal", S.rnd("bal", 2))


@query("src_alt_layout", "SELECT 'supplier' AS layout, s_nationkey::BIGINT AS place, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'customer', c_nationkey::BIGINT, count(*) FROM customer GROUP BY 2")
def _(spark, sf):
    out = None
    for name in ("supplier", "customer"):
        df = T.table(spark, sf, name)
        lay = {}
        if "s_nationkey" in df.columns:
            lay["s_nationkey"] = [F.lit("supplier").alias("layout"), F.col("s_nationkey").cast("bigint").alias("place")]
        if "c_nationkey" in df.columns:
            lay["c_nationkey"] = [F.lit("customer").alias("layout"), F.col("c_nationkey").cast("bigint").alias("place")]
        one = T.by_layout(df, lay)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("layout", "place").agg(F.count("*").alias("n"))


@query("src_wide", with_(P1) + "SELECT id, t::VARCHAR AS month_str, n FROM p1")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    months = p.agg(F.array_sort(F.collect_set("t")).alias("a")).first().a  # the calendar
    wide = p.groupBy("id").pivot("t", months).agg(F.first("n"))
    return T.wide_to_long(wide, ["id"], r"\d{5}", "month_str", "n")


@query("src_fallback", "SELECT n_nationkey, n_name, NULL::DOUBLE AS extra FROM nation")
def _(spark, sf):
    return T.optional_enrichment(T.table(spark, sf, "nation").select("n_nationkey", "n_name"), spark, f"{sf}/absent.parquet",
                                 "n_nationkey INT, extra DOUBLE", ["n_nationkey"])


# Segment codes.
SEGMENT_CODES = [("AUTOMOBILE", "AU"), ("BUILDING", "BU"), ("FURNITURE", "FU"), ("HOUSEHOLD", "HO"), ("MACHINERY", "MA")]


@query("src_crosswalk", "SELECT m.code, count(*) AS n FROM customer JOIN (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in SEGMENT_CODES) + ") m(seg, code) ON seg = c_mktsegment GROUP BY 1")
def _(spark, sf):
    x = T.crosswalk(spark, SEGMENT_CODES, "c_mktsegment STRING, code STRING")
    return T.table(spark, sf, "customer").join(x, "c_mktsegment").groupBy("code").agg(F.count("*").alias("n"))


@query("sink_csv", with_(P2) + "SELECT t, count(*) AS units, sum(n)::BIGINT AS n FROM p2 GROUP BY 1")
def _(spark, sf):
    path = output_folder(spark, "csv")
    sinks.write_csv(D.customer_quarter(spark, sf).select("id", "t", "n"), path)
    return T.csv_scan(spark, path, "id BIGINT, t BIGINT, n BIGINT").groupBy("t").agg(F.count("*").alias("units"), F.sum("n").alias("n"))


@query("sink_append", with_(P2) + "SELECT t % 4 AS batch, count(*) AS n_rows, sum(n)::BIGINT AS n FROM p2 GROUP BY 1")
def _(spark, sf):
    path = output_folder(spark, "progress")
    panel = D.customer_quarter(spark, sf).select(F.pmod("t", F.lit(4)).alias("batch"), "id", "t", "n")
    sinks.append_batches(panel.where("batch < 2"), path, ["batch"])
    todo = sinks.unfinished(spark, panel.select("batch").distinct(), path, ["batch"])
    sinks.append_batches(panel.join(todo, "batch", "left_semi"), path, ["batch"])
    back = spark.read.schema("id BIGINT, t BIGINT, n BIGINT, batch BIGINT").parquet(path)
    return back.groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))


@query("sink_partial", with_(P2) + ", b AS (SELECT t % 4 AS batch, count(*) AS n_rows, sum(n)::BIGINT AS n FROM p2 GROUP BY 1) SELECT a.batch AS after, count(*) AS batches, sum(b.n_rows)::BIGINT AS n_rows, sum(b.n)::BIGINT AS n FROM b a JOIN b ON b.batch <= a.batch GROUP BY 1")
def _(spark, sf):
    path = output_folder(spark, "partial")
    panel = D.customer_quarter(spark, sf).select(F.pmod("t", F.lit(4)).alias("batch"), "id", "t", "n")
    out = []
    for k in range(4):
        if k:  # the batch before once more, as a restarted run writes it
            sinks.write_part(panel.where(F.col("batch") == k - 1), path, ["batch"])
        sinks.write_part(panel.where(F.col("batch") == k), path, ["batch"])
        back = spark.read.schema("id BIGINT, t BIGINT, n BIGINT, batch BIGINT").parquet(path)
        total = back.agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("n_rows"), F.sum("n").alias("n"))
        out.append(spark.createDataFrame(total.collect(), "batches BIGINT, n_rows BIGINT, n BIGINT").withColumn("after", F.lit(k).cast("bigint")))
    return reduce(DataFrame.unionByName, out)


@query("sink_report_table", with_(P1) + "SELECT * FROM (SELECT 'units' AS metric, count(DISTINCT id)::DOUBLE AS value FROM p1 UNION ALL SELECT 'periods', count(DISTINCT t)::DOUBLE FROM p1 UNION ALL SELECT 'rows', count(*)::DOUBLE FROM p1 UNION ALL SELECT 'treated_rows', count(*) FILTER (t >= g)::DOUBLE FROM p1)")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    return sinks.report_rows(p.agg(F.count_distinct("id").alias("units"), F.count_distinct("t").alias("periods"),
                                   F.count("*").alias("rows"), F.count_if(F.col("t") >= F.col("g")).alias("treated_rows")))


# ---- projections and predicates -------------------------------------------

@query("p_coerce", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority,1,1) AS INTEGER) AS prio, TRY_CAST(o_orderstatus AS DOUBLE) AS bad, lpad(o_custkey::VARCHAR, 7, '0') AS code FROM orders")
def _(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("prio"),
                                            F.col("o_orderstatus").alias("bad"), F.col("o_custkey").alias("code"))
    return P.coerce(o, {"prio": "int", "bad": "double"}, {"code": 7})


@query("p_normalize_keys", "SELECT lpad(c_nationkey::VARCHAR,2,'0') AS fips_state, lpad((c_custkey % 1000)::VARCHAR,3,'0') AS fips_county, count(*) AS n FROM customer GROUP BY 1, 2")
def _(spark, sf):
    c = T.table(spark, sf, "customer").select((F.col("c_nationkey") * 1000 + F.pmod("c_custkey", F.lit(1000))).alias("GEOID"))
    k = P.normalize_keys(c, {"fips": ("fips", "geoid", "fipscode")})
    return k.groupBy("fips_state", "fips_county").agg(F.count("*").alias("n"))


@query("p_pick_outcome", "SELECT o_orderkey, " + r("o_totalprice", 2) + " AS outcome FROM orders")
def _(spark, sf):
    o = P.pick_outcome(T.table(spark, sf, "orders"), ["filings", "o_totalprice", "o_custkey"])
    return o.select("o_orderkey", S.rnd("outcome", 2).alias("outcome"))


@query("p_rate", with_(PC) + "SELECT nation, seg, t, " + r("CASE WHEN stock > 0 THEN 1000.0 * filings / stock END") + " AS rate FROM pc")
def _(spark, sf):
    p = D.segment_month(spark, sf)
    return p.select("nation", "seg", "t", S.rnd(S.rate_per_1000("filings", "stock")).alias("rate"))


@query("p_outcome_transform", with_(PC) + "SELECT nation, seg, t, " + r("ln(1 + greatest(filings - 1, 0))") + " AS y_log1p, " + r("ln(greatest(1000.0*filings/stock, 0) + 0.01)") + " AS y_log FROM pc")
def _(spark, sf):
    p = D.segment_month(spark, sf)
    return p.select("nation", "seg", "t", S.rnd(S.log_outcome(F.col("filings") - 1)).alias("y_log1p"),
                    S.rnd(S.log_outcome(S.rate_per_1000("filings", "stock"), 0.01)).alias("y_log"))


@query("p_keys", with_(P1) + "SELECT id, t, coalesce(g, 0) AS g, t - g AS e, (dense_rank() OVER (ORDER BY id))::BIGINT AS unit, (g IS NULL OR t < g) AS untreated_obs, coalesce(t >= g, false)::INT AS post_treat FROM p1")
def _(spark, sf):
    p = P.dense_ids(D.nation_month(spark, sf), "id", "unit")
    return p.select("id", "t", F.coalesce("g", F.lit(0)).alias("g"), (F.col("t") - F.col("g")).alias("e"), "unit",
                    (F.col("g").isNull() | (F.col("t") < F.col("g"))).alias("untreated_obs"),
                    F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("int").alias("post_treat"))


@query("p_event_window", with_(P1) + "SELECT id, t, t - g AS e FROM p1 WHERE g IS NULL OR (t - g BETWEEN -12 AND 24)")
def _(spark, sf):
    e = F.col("t") - F.col("g")
    return D.nation_month(spark, sf).where(e.isNull() | e.between(-12, 24)).select("id", "t", e.alias("e"))


@query("p_date_window", "SELECT count(*) AS n, count(*) FILTER (NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-07-01')) AS keep_closed, count(*) FILTER (NOT (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01')) AS keep_half_open FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'")
def _(spark, sf):
    ts = lambda s: F.lit(s).cast("timestamp")
    o = T.table(spark, sf, "orders").where(F.col("o_orderdate").between(ts("1996-01-01"), ts("2000-12-31")))
    d = F.col("o_orderdate").cast("date")
    return o.agg(F.count("*").alias("n"), F.count_if(~S.in_window(d, "1998-01-01", "1998-07-01")).alias("keep_closed"),
                 F.count_if(~S.in_window(d, "1998-01-01", "1998-07-01", closed="left")).alias("keep_half_open"))


@query("p_exclude_units", with_(P1) + "SELECT region, count(*) AS n FROM p1 WHERE id NOT IN (3, 7, 11) GROUP BY 1")
def _(spark, sf):
    return D.nation_month(spark, sf).where(~F.col("id").isin(3, 7, 11)).groupBy("region").agg(F.count("*").alias("n"))


@query("p_event_bin", with_(P1) + "SELECT CASE WHEN g IS NULL THEN 'Never treated' WHEN t - g BETWEEN -12 AND 24 THEN (t - g)::VARCHAR ELSE 'Exclude' END AS bin, count(*) AS n, " + r("avg(y)") + " AS y FROM p1 GROUP BY 1")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumn("bin", S.event_bin(F.col("t") - F.col("g"), -12, 24))
    return p.groupBy("bin").agg(F.count("*").alias("n"), S.rnd(F.avg("y")).alias("y"))


@query("p_period_class", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'pre' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'regime_a' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'transition' ELSE 'regime_b' END AS era, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    d = F.col("o_orderdate")
    before = lambda s: d < F.lit(s).cast("timestamp")
    era = F.when(before("1997-01-01"), "pre").when(before("1999-01-01"), "regime_a").when(before("2000-01-01"), "transition").otherwise("regime_b")
    return T.table(spark, sf, "orders").groupBy(era.alias("era")).agg(F.count("*").alias("n"))


@query("p_pseudo_event_time", with_(P1) + ", m AS (SELECT quantile_cont(g, 0.5) AS med FROM (SELECT DISTINCT id, g FROM p1 WHERE g IS NOT NULL)) SELECT id, t, (t - coalesce(g, floor(med)))::BIGINT AS e FROM p1, m")
def _(spark, sf):
    p = D.nation_month(spark, sf)
    med = exact_quantiles(p.where("g is not null").select("id", "g").distinct(), [], "g", {"med": 0.5})
    return p.select("id", "t", (F.col("t") - F.coalesce("g", F.floor(med.scalar()))).cast("bigint").alias("e"))


@query("p_complete_cases", with_(P1) + "SELECT count(*) AS rows_before, count(*) FILTER (g IS NOT NULL AND n <> 0) AS rows_after FROM p1")
def _(spark, sf):
    p = D.nation_month(spark, sf).withColumn("n", F.nullif("n", F.lit(0)))
    return P.completeness(p, ["g", "n"])


@query("p_normalize_weights", with_(P4) + "SELECT d, post, count(*) AS n, " + r("sum(w / (SELECT avg(w) FROM p4))", 4) + " AS w FROM p4 GROUP BY 1, 2")
def _(spark, sf):
    p = P.normalize_weights(D.cross_section(spark, sf), "w")
    return p.groupBy("d", "post").agg(F.count("*").alias("n"), S.rnd(F.sum("w"), 4).alias("w"))


@query("p_validate", "WITH x AS (SELECT l_orderkey AS id, l_linenumber AS t, l_returnflag AS g FROM lineitem) SELECT 'cohort_not_constant' AS \"check\", count(*) FILTER (c > 1) AS violations FROM (SELECT count(DISTINCT g) AS c FROM x GROUP BY id) UNION ALL SELECT 'duplicate_unit_periods', sum(n - d)::BIGINT FROM (SELECT count(*) AS n, count(DISTINCT t) AS d FROM x GROUP BY id) UNION ALL SELECT 'missing_keys', count(*) FILTER (id IS NULL OR t IS NULL) FROM x UNION ALL SELECT 'negative_weights', count(*) FILTER (l_quantity < 0) FROM lineitem")
def _(spark, sf):
    return P.validate_panel(T.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("p_time_seq", with_(P2) + ", axis AS (SELECT t, row_number() OVER (ORDER BY t) AS s FROM (SELECT DISTINCT t FROM p2)) SELECT p2.id, p2.t, a.s::BIGINT AS t_seq, coalesce((SELECT min(b.s) FROM axis b WHERE b.t >= p2.g), 0)::BIGINT AS g_seq FROM p2 JOIN axis a ON a.t = p2.t")
def _(spark, sf):
    return P.time_sequence(D.customer_quarter(spark, sf), "t", "g").select("id", "t", "t_seq", "g_seq")
