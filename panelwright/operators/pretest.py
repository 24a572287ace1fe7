"""Cramer-von Mises pre-trend test over covariate values.

The outcome change of a cell is kept only for units with x <= u, for every
observed u. As the effect is a difference of weighted means, its path in u is a
running sum of sums per covariate value: units are aggregated by value first,
and no unit is ever paired with a threshold. Bootstrap paths are running sums of
the same shape with signed weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.attgt import Design, cell_list, cell_rows, cells_frame, control_cohorts, on_axis, series_contract, unit_series
from panelwright.operators.bootstrap import multiplier_draws
from panelwright.session import keep


def _paths(sums: DataFrame, by: list[str], value: str, share: DataFrame) -> DataFrame:
    """Running sums over x at every observed x, per key."""
    grid = sums.select(*by).distinct().withColumn("_u", share.agg(F.sort_array(F.collect_list(F.struct("x", "share")))).scalar())
    full = grid.select(*by, F.explode("_u").alias("_p")).select(*by, "_p.x", "_p.share").join(sums, [*by, "x"], "left")
    w = Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("path", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w))


def cvm_pretest(df: DataFrame, d: Design, x: str, draws: int = 199, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """Statistic, critical value and p-value, one row."""
    units = unit_series(df, d, [x])
    units, k = series_contract(units, d)
    periods, cohorts = k.periods, k.controls
    grid = [c for c in cell_list(periods, k.cohorts, d) if c[3] is not None and c[1] > c[2] and c[2] != c[3]]
    members = control_cohorts(cells_frame(df.sparkSession, grid), cohorts, d)
    n = units.count()
    share = units.groupBy(F.col(x).alias("x")).agg((F.count("*") / F.lit(n)).alias("share"))
    rows = cell_rows(on_axis(units, periods), periods, members, [x]).withColumnRenamed(x, "x")
    arm = rows.groupBy("cell", "treated").agg(F.sum("w").alias("_sw"))
    # sign and scale of a unit's part in its cell's difference of means
    rows = keep(rows.join(arm, ["cell", "treated"]).withColumn("part", F.when(F.col("treated") == 1, 1.0).otherwise(-1.0) * F.col("w") / F.col("_sw")).select("unit", "cell", "treated", "x", "part", (F.col("part") * F.col("dy")).alias("m")))
    armsums = rows.groupBy("cell", "treated", "x").agg(F.sum("m").alias("m"))
    armpath = keep(_paths(armsums, ["cell", "treated"], "m", share).select("cell", "treated", "x", "share", F.col("path").alias("j")))
    path = armpath.groupBy("cell", "x", "share").agg(F.sum("j").alias("j"))
    stat = path.agg((n * F.sum(F.col("share") * F.col("j") * F.col("j"))).alias("s")).first().s
    key = keep(rows.select("cell", "treated", "x").distinct().select("*", F.xxhash64("cell", "treated", "x").alias("param")))
    coded = rows.select("unit", F.xxhash64("cell", "treated", "x").alias("param"), "m", F.abs("part").alias("a"))
    signed = multiplier_draws(coded.select("unit", "param", F.col("m").alias("psi")), draws, 1, seed).join(key, "param").select("cell", "treated", "x", "b", F.col("value").alias("m"))
    totals = multiplier_draws(coded.select("unit", "param", F.col("a").alias("psi")), draws, 1, seed).join(key, "param").groupBy("cell", "treated", "b").agg(F.sum("value").alias("tot"))
    bp = _paths(signed, ["cell", "treated", "b"], "m", share).join(totals, ["cell", "treated", "b"]).join(armpath.select("cell", "treated", "x", "j"), ["cell", "treated", "x"])
    jb = bp.groupBy("b", "cell", "x", "share").agg(F.sum(F.col("path") - F.col("j") * F.col("tot")).alias("jb"))
    sims = jb.groupBy("b").agg((n * F.sum(F.col("share") * F.col("jb") * F.col("jb"))).alias("s"))
    return sims.agg(F.lit(float(stat)).alias("statistic"), F.expr(f"percentile_disc({1 - alpha}) within group (order by s)").alias("critical"), F.avg((F.col("s") > float(stat)).cast("double")).alias("p_value"), F.count("*").alias("draws"))
