"""Dose response and regime comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators.panel import breakpoint_bins


def dose_change(df: DataFrame, unit: str, y: str, dose: str, post: Column) -> DataFrame:
    """Change of the mean outcome and the average dose per unit."""
    k = df.groupBy(unit).agg(F.avg(F.when(~post, F.col(y))).alias("pre"), F.avg(F.when(post, F.col(y))).alias("post"), F.avg(dose).alias("dose"))
    return k.where("pre is not null and post is not null").select(unit, (F.col("post") - F.col("pre")).alias("change"), "dose")


def pre_tertiles(df: DataFrame, unit: str, value: str, pre: Column) -> DataFrame:
    """Low, medium, high by the unit's average before treatment."""
    b = df.where(pre).groupBy(unit).agg(F.avg(value).alias("_base"))
    q = exact_quantiles(b, [], "_base", {"a": 1 / 3.0, "b": 2 / 3.0}).select(F.array(F.lit(float("-inf")), "a", "b", F.lit(float("inf"))).alias("c"))
    return b.withColumn("_c", q.scalar()).select(unit, breakpoint_bins("_base", F.col("_c"), ["Low", "Medium", "High"]).alias("bin"))


def event_index(df: DataFrame, unit: str, event: str, value: str, base_lo: int, base_hi: int, lo: int, hi: int) -> DataFrame:
    """Mean by event time of value over the unit's base-window mean, times 100."""
    b = df.where(F.col(event).between(base_lo, base_hi)).groupBy(unit).agg(F.avg(value).alias("_b")).where("_b > 0")
    d = df.where(F.col(event).between(lo, hi)).join(b, unit)
    return d.groupBy(F.col(event).alias("e")).agg(F.count("*").alias("n"), F.avg(100 * F.col(value) / F.col("_b")).alias("idx"))
