"""Exact quantiles of groups of any size.

The built-in exact percentile keeps a group's whole value table in one buffer.
Here a bounded sketch brackets each wanted rank (its rank error is guaranteed),
rows below a bracket are only counted, and the few rows inside it are ranked
exactly after equal values have been collapsed. Rows meet their group's brackets
without being dealt by group, so that a large group is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import durable

ACCURACY = 10_000  # sketch rank error is at most rows / ACCURACY
MARGIN = 2 / ACCURACY
# Up to this size a group is ranked whole; beyond it the margin exceeds the sketch
# error by at least two ranks, so both neighbours of an interpolated rank are inside.
SMALL = 2 * ACCURACY
# Groups whose brackets go to all tasks; beyond them brackets are copied so often that a large group is spread.
SENT_GROUPS, SPREAD = 20_000, 16


def _rank(p: float, n: Column, kind: int) -> Column:
    """Zero-based rank, fractional for interpolated quantiles."""
    if kind == 7:
        return F.lit(p) * (n - 1)
    return F.greatest(F.ceil(F.lit(p) * n - F.lit(1e-9)) - 1, F.lit(0)).cast("double")


def _beside(vals: DataFrame, brackets: DataFrame, gk: list[str]) -> DataFrame:
    if brackets.count() <= SENT_GROUPS:
        return vals.join(F.broadcast(brackets), gk)
    copies = brackets.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return vals.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(SPREAD))).join(copies, [*gk, "_s"]).drop("_s")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], kind: int = 7) -> DataFrame:
    """One row per group with a column per name in ``probs``.

    ``kind`` 7 interpolates linearly, ``kind`` 1 inverts the empirical
    distribution. Nulls and NaN are left out."""
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    gk = keys or ["_all"]
    if not keys:
        vals = vals.withColumn("_all", F.lit(1))
    names, ps = list(probs), list(probs.values())
    ends = [min(max(p + s * MARGIN, 0.0), 1.0) for p in ps for s in (-1, 1)]
    grid = "array(" + ", ".join(f"{e!r}D" for e in ends) + ")"
    cuts = vals.groupBy(*gk).agg(F.expr(f"percentile_approx(_v, {grid}, {ACCURACY})").alias("_cuts"), F.count("*").alias("_n"))
    # A margin that reaches past the first or last row is open ended. The sketch depends
    # on merge order, so its brackets are fixed before two branches read them.
    lows = [F.when((F.col("_n") <= SMALL) | F.lit(p <= MARGIN), F.lit(float("-inf"))).otherwise(F.col("_cuts")[2 * i]) for i, p in enumerate(ps)]
    highs = [F.when((F.col("_n") <= SMALL) | F.lit(1 - p <= MARGIN), F.lit(float("inf"))).otherwise(F.col("_cuts")[2 * i + 1]) for i, p in enumerate(ps)]
    brackets = durable(cuts.select(*gk, "_n", *[c.alias(f"_lo{i}") for i, c in enumerate(lows)], *[c.alias(f"_hi{i}") for i, c in enumerate(highs)]))
    rows = _beside(vals, brackets.drop("_n"), gk)
    below = rows.groupBy(*gk).agg(*[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in range(len(ps))])
    hits = F.array_compact(F.array(*[F.when((F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")), F.lit(i)) for i in range(len(ps))]))
    inside = rows.select(*gk, "_v", F.explode(hits).alias("_i")).groupBy(*gk, "_i", "_v").agg(F.count("*").alias("_c"))
    want = brackets.select(*gk, "_n").join(below, gk).select(*gk, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"_below{i}").alias("below"), _rank(p, F.col("_n"), kind).alias("h")) for i, p in enumerate(ps)])).alias("q")).select(
        *gk, F.col("q.i").alias("_i"), F.col("q.below").alias("_below"), F.col("q.h").alias("_h"))
    w = Window.partitionBy(*gk, "_i").orderBy("_v")
    ranked = inside.withColumn("_top", F.sum("_c").over(w)).join(want, [*gk, "_i"])
    top, bottom = F.col("_below") + F.col("_top"), F.col("_below") + F.col("_top") - F.col("_c")
    at = lambda k: F.max(F.when((k >= bottom) & (k < top), F.col("_v")))
    lo, hi = at(F.floor("_h")), at(F.ceil("_h"))
    per = ranked.groupBy(*gk, "_i").agg(lo.alias("_a"), hi.alias("_b"), F.first("_h").alias("_h"))
    per = per.withColumn("_q", F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a")))
    out = per.groupBy(*gk).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    return out.select(*keys, *names)
