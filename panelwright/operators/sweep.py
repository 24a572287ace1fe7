"""Power, size and calibration summaries of a table of fits, and residual pools.

The fits come from placebo treatments of the given panel (``placebo``); effects
follow by linearity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import MIX_MODULUS, draw31, long_array
from panelwright.session import durable

# Fixed values.
REJECTION_RANGE = (0.02, 0.10)


def residual_pools(df: DataFrame, time: str, resid: str, order: str, min_units: int = 2) -> tuple[DataFrame, DataFrame]:
    """Residuals of each period, numbered in unit order: rows (pool, i, r), i from 0, so that element i of a pool is a join; and
    per period (time, pool, size). Pool null is the pool of all periods, in period order, for periods with fewer units.

    Numbers come in two levels, without a sort of a whole period in one task: rows lie sorted by (period, unit) over range
    partitions, get their rank inside the partition, and the sizes of the parts before are added."""
    d = df.where(F.col(resid).isNotNull()).select(F.col(time).alias("t"), F.col(order).alias("o"), F.col(resid).alias("r"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = durable(d.repartitionByRange(n, "t", "o").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "t").orderBy("o")
    ranked = d.withColumn("k", F.row_number().over(inside) - 1)
    sizes = d.groupBy("t", "part").agg(F.count("*").alias("c"))  # periods x the few partitions each lies in
    before = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.orderBy("t", "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"b": F.coalesce(F.sum("c").over(before), F.lit(0)), "g": F.coalesce(F.sum("c").over(all_before), F.lit(0))})
    numbered = ranked.join(sizes.select("t", "part", "b", "g"), ["t", "part"])
    keys = d.groupBy("t").agg(F.count("*").alias("own"))
    total = d.agg(F.count("*").alias("total"))
    keys = keys.withColumns({"pool": F.when(F.col("own") >= min_units, F.col("t")), "size": F.when(F.col("own") >= min_units, F.col("own")).otherwise(total.scalar())})
    thin = keys.where("pool is null").limit(1).count() > 0
    rows = numbered.join(keys.where("pool is not null").select("t", "pool"), "t").select("pool", (F.col("b") + F.col("k")).alias("i"), "r")
    if thin:
        rows = rows.unionByName(numbered.select(F.lit(None).cast("bigint").alias("pool"), (F.col("g") + F.col("k")).alias("i"), "r"))
    return rows, keys.select(F.col("t").alias(time), "pool", "size")


def ar1_calibration(df: DataFrame, unit: str, time: str, resid: str, by: str, kind: str = "ols", clip: float = 0.95) -> DataFrame:
    """Standard deviation scale and persistence of residuals.

    Residuals are standardised by ``by`` (period or unit); persistence is the
    lag correlation or the regression through the origin, clipped."""
    sd = df.groupBy(by).agg(F.stddev_samp(resid).alias("_sd"))
    z = df.join(sd.where("_sd > 0"), by).withColumn("_z", F.col(resid) / F.col("_sd"))
    z = z.withColumn("_l", F.lag("_z").over(Window.partitionBy(unit).orderBy(time)))
    rho = F.corr("_z", "_l") if kind == "corr" else F.sum(F.col("_z") * F.col("_l")) / F.sum(F.when(F.col("_z").isNotNull(), F.col("_l") * F.col("_l")))
    r = z.where("_l is not null").agg(rho.alias("rho_raw"), F.count("*").alias("pairs"))
    r = r.withColumn("rho", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("rho_raw"))))
    return r.withColumn("innovation_sd", F.sqrt(1 - F.col("rho") * F.col("rho")))


def replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n)))


def standard_normal(seed: int, *keys) -> Column:
    """Normal draw by the polar form of two uniforms."""
    u = lambda s: (draw31(s, *keys) + F.lit(0.5)) / F.lit(float(MIX_MODULUS))
    return F.sqrt(-2 * F.ln(u(seed))) * F.cos(2 * F.pi() * u(seed + 1))


def draw_ar1(units: DataFrame, seed: int, periods: list[int], rho: float, sd: Column, reps: int) -> DataFrame:
    """Persistent draws per replicate and unit: (rep, unit, t, draw).

    The recursion runs inside one row over the unit's period axis."""
    d = units.withColumn("rep", replicates(reps))
    s = (1 - rho * rho) ** 0.5
    path = F.aggregate(
        long_array(periods), F.expr("cast(array() as array<double>)"),
        lambda acc, t: F.concat(acc, F.array(F.when(F.size(acc) == 0, standard_normal(seed, F.col("rep"), F.col("unit"), t)).otherwise(F.lit(rho) * F.try_element_at(acc, F.lit(-1)) + F.lit(s) * standard_normal(seed, F.col("rep"), F.col("unit"), t)))))
    x = d.select("rep", "unit", sd.alias("_sd"), F.arrays_zip(long_array(periods).alias("t"), path.alias("z")).alias("a"))
    return x.select("rep", "unit", "_sd", F.explode("a").alias("a")).select("rep", "unit", F.col("a.t").alias("t"), (F.col("a.z") * F.col("_sd")).alias("draw"))


def demean_both(df: DataFrame, unit: str, time: str, x: str, out: str) -> DataFrame:
    """Column demeaned over units and periods of a balanced panel."""
    mi, mt = df.groupBy(unit).agg(F.avg(x).alias("_a")), df.groupBy(time).agg(F.avg(x).alias("_b"))
    return df.join(mi, unit).join(mt, time).withColumn(out, F.col(x) - F.col("_a") - F.col("_b") + df.agg(F.avg(x)).scalar()).drop("_a", "_b")


def with_effects(base: DataFrame, effects: list[float]) -> DataFrame:
    """Step effects by linearity: the estimate moves by the effect and the
    residuals, hence the standard error, stay as they are."""
    return base.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects]))).withColumn("att", F.col("att") + F.col("effect"))


def power_table(fits: DataFrame, alpha: float = 0.05, by: str = "effect", p: str = "p") -> DataFrame:
    """Power and its ingredients per effect: rejection, spread, sign and size errors."""
    ok = F.col("att").isNotNull() & F.col("se").isNotNull() & (F.col("se") > 0)
    hit = ok & (F.col(p) < alpha)
    return fits.groupBy(by).agg(
        F.count("*").alias("n_sims"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, (F.col(p) < alpha).cast("double"))).alias("power"),
        F.avg(F.when(ok, F.col("att"))).alias("mean_att"), F.stddev_samp(F.when(ok, F.col("att"))).alias("sd_att"), F.avg(F.when(ok, F.col("se"))).alias("mean_se"),
        F.avg(F.when(hit & (F.col(by) != 0), (F.signum("att") != F.signum(by)).cast("double"))).alias("type_s"),
        F.avg(F.when(hit & (F.col(by) != 0), F.abs("att") / F.abs(by))).alias("exaggeration")).withColumn("se_over_sd", F.col("mean_se") / F.col("sd_att"))


def mde(power: DataFrame, by: list[str], target: float = 0.80, effect: str = "effect", value: str = "power") -> DataFrame:
    """Smallest effect reaching the target, interpolated from the point before it."""
    w = Window.partitionBy(*by).orderBy(effect)
    d = power.where(F.col(effect) > 0).withColumns({"_e0": F.lag(effect).over(w), "_p0": F.lag(value).over(w)})
    flat = F.col("_p0").isNull() | (F.col("_p0") == F.col(value))
    x = F.when(flat, F.col(effect)).otherwise(F.col("_e0") + (target - F.col("_p0")) * (F.col(effect) - F.col("_e0")) / (F.col(value) - F.col("_p0")))
    first = d.where(F.col(value) >= target).groupBy(*by).agg(F.min_by(x, effect).alias("mde"))
    return power.select(*by).distinct().join(first, by, "left")


def size_table(fits: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """Null rejection rate, p quantiles, and the factor standard errors are short by."""
    return fits.agg(F.count("*").alias("n"), F.avg((F.col(p) < alpha).cast("double")).alias("type1"), F.expr(f"percentile({p}, 0.05)").alias("p_q05"), F.expr(f"percentile({p}, 0.5)").alias("p_q50"),
                    F.expr(f"percentile({p}, 0.95)").alias("p_q95"), F.avg("att").alias("mean_att"), F.avg("se").alias("mean_se"), (F.stddev_samp("att") / F.avg("se")).alias("implied_multiplier"))


def pick_threshold(sweep: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Smallest threshold whose null rejection is acceptable, else the closest to nominal."""
    lo, hi = REJECTION_RANGE
    ok = F.col("feasible") & F.col("type1").between(lo, hi)
    a = sweep.agg(F.min(F.when(ok, F.col("threshold"))).alias("first_ok"), F.min_by("threshold", F.when(F.col("feasible"), F.struct(F.abs(F.col("type1") - alpha), F.col("threshold")))).alias("closest"))
    return a.select(F.coalesce("first_ok", "closest").alias("threshold"), F.col("first_ok").isNotNull().alias("in_range"))


def choose_method(type1: Column, alpha: float = 0.05) -> Column:
    """Headline method from the size of its own test."""
    return F.when(type1.isNull(), "not assessed").when(type1 <= alpha + 0.03, "analytic").when(type1 <= alpha + 0.10, "bootstrap").otherwise("report as descriptive")
