"""Grouped summaries shared by the diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.pvalues import p_t
from panelwright.functions.scalars import AVG_Z, col, rnd


def weighted_mean(x, w) -> Column:
    ok = col(x).isNotNull() & (col(w) > 0)
    return F.sum(F.when(ok, col(x) * col(w))) / F.sum(F.when(ok, col(w)))


def mean_se_ci(df: DataFrame, keys: list[str], y: str, digits: int = 6) -> DataFrame:
    m, se = F.avg(y), F.stddev_samp(y) / F.sqrt(F.count(y))
    return df.groupBy(*keys).agg(F.count(y).alias("n"), rnd(m, digits).alias("mean"), rnd(se, digits).alias("se"),
                                 rnd(m - AVG_Z * se, digits).alias("lo"), rnd(m + AVG_Z * se, digits).alias("hi"))


def ols_slope(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Simple regression per group from one pass of co-moments."""
    s = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_r2(y, x).alias("_r2"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    rss = F.greatest(F.col("_syy") - F.col("_b") * F.col("_sxy"), F.lit(0.0))
    se = F.when(F.col("n") > 2, F.sqrt(rss / (F.col("n") - 2) / F.col("_sxx")))
    s = s.withColumn("_se", se)
    return s.select(*keys, "n", rnd("_b").alias("slope"), rnd("_a", 4).alias("intercept"), rnd("_r2").alias("r2"), rnd("_se").alias("se"), rnd(p_t(F.col("_b") / F.nullif("_se", F.lit(0.0)), F.col("n") - 2)).alias("p"))


def dup_audit(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    c = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return c.agg(F.lit(label).alias("label"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_dup_keys"),
                 F.max("n").alias("max_rows"), F.sum(F.col("n") - 1).alias("extra_rows"))


def rows_of_top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the ``k`` most observed groups (a report feature: the limit is the point)."""
    top = df.groupBy(key).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), key).limit(k).select(key)
    return df.join(top, key, "left_semi")


def with_reference_row(df: DataFrame, **values) -> DataFrame:
    """Append the omitted reference row."""
    one = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(one)
