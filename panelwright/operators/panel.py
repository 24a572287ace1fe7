"""Panel construction: coercion, roll-ups, source priority, treatment dates, balance.

Whole-group facts (a unit's peak, its first treatment month, its period count)
are aggregates joined back rather than unordered windows: the aggregate combines
map-side, and adaptive execution either broadcasts it or splits a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import col, sum0
from panelwright.session import durable


def coerce(df: DataFrame, types: dict[str, str], pad: dict[str, int] | None = None) -> DataFrame:
    """Force column types; what does not parse becomes null. ``pad`` left-pads codes."""
    out = {c: F.col(c).try_cast(t) for c, t in types.items()}
    for c, width in (pad or {}).items():
        out[c] = F.lpad(F.trim(F.col(c).cast("string")), width, "0")
    return df.withColumns(out)


def normalize_keys(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rename the first present alias of each key to its canonical name and
    split a combined five-digit code when the parts are missing."""
    have = {c.lower(): c for c in df.columns}
    for name, names in aliases.items():
        if name not in df.columns:
            hit = next((have[a] for a in names if a in have), None)
            if hit:
                df = df.withColumnRenamed(hit, name)
    if "fips" in df.columns and "fips_state" not in df.columns:
        code = F.lpad(F.col("fips").cast("string"), 5, "0")
        df = df.withColumns({"fips_state": F.substring(code, 1, 2), "fips_county": F.substring(code, 3, 3)})
    return df


def pick_outcome(df: DataFrame, preferred: list[str]) -> DataFrame:
    """First available preferred column as double ``outcome``."""
    hit = next((c for c in preferred if c in df.columns), None)
    if hit is None:
        raise ValueError(f"none of {preferred} is present")
    return df.withColumn("outcome", F.col(hit).cast("double"))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows before and after dropping incomplete ones, in one pass."""
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0))
    return df.agg(F.count("*").alias("rows_before"), F.count(F.when(bad == 0, 1)).alias("rows_after"))


def normalize_weights(df: DataFrame, w: str) -> DataFrame:
    """Weights divided by their global mean (a scalar subquery, no join)."""
    return df.withColumn(w, F.col(w) / df.agg(F.avg(w)).scalar())


def validate_panel(df: DataFrame, unit: str, time: str, cohort: str, weight: str | None = None) -> DataFrame:
    """Violations of the panel contract, one named count per row."""
    per_unit = df.groupBy(unit).agg(
        (F.count_distinct(cohort) + F.max(F.col(cohort).isNull().cast("int"))).alias("_g"),
        F.count("*").alias("_n"), F.count_distinct(time).alias("_t"))
    checks = per_unit.agg(
        F.count(F.when(F.col("_g") > 1, 1)).alias("cohort_not_constant"),
        F.sum(F.col("_n") - F.col("_t")).alias("duplicate_unit_periods"))
    neg = F.count(F.when(F.col(weight) < 0, 1)) if weight else F.lit(0).cast("bigint")
    rows = df.agg(F.count(F.when(F.col(unit).isNull() | F.col(time).isNull(), 1)).alias("missing_keys"), neg.alias("negative_weights"))
    a = checks.unpivot([], checks.columns, "check", "violations")
    return a.unionByName(rows.unpivot([], rows.columns, "check", "violations"))


def collapse(df: DataFrame, keys: list[str], sums: list[str], keep: list[str], order: Column) -> DataFrame:
    """One row per key: sums (0 when all null) and the first of the others under
    an explicit order."""
    return df.groupBy(*keys).agg(*[sum0(c).alias(c) for c in sums], *[F.min_by(c, order).alias(c) for c in keep])


def rollup_weighted(df: DataFrame, keys: list[str], sums: list[str], means: dict[str, str]) -> DataFrame:
    """Sums plus weighted means over rows whose value and weight are both usable."""
    aggs = [sum0(F.col(c).cast("double")).alias(c) for c in sums]
    for x, w in means.items():
        ok = F.col(x).isNotNull() & (F.col(w) > 0)
        aggs.append((F.sum(F.when(ok, F.col(x) * F.col(w))) / F.sum(F.when(ok, F.col(w)))).alias(x))
    return df.groupBy(*keys).agg(*aggs)


def priority_union(primary: DataFrame, fallback: DataFrame, on: list[str]) -> DataFrame:
    """All primary rows, and fallback rows only for keys the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)


def first_source_wins(frames: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of tagged sources, one row per key from the earliest listed source.

    The winner is a ``min_by`` aggregate, so duplicates combine map-side."""
    parts = [f.withColumns({"source": F.lit(tag), "_rank": F.lit(i)}) for i, (tag, f) in enumerate(frames)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in keys and c != "_rank"]
    row = F.struct(*rest)
    best = u.groupBy(*keys).agg(F.min_by(row, F.struct("_rank", row)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def attach_min(df: DataFrame, unit: str, value: str, out: str) -> DataFrame:
    """Earliest non-null ``value`` of the unit on all its rows."""
    return df.join(df.groupBy(unit).agg(F.min(value).alias(out)), unit, "left")


def attach_schedule(panel: DataFrame, schedule: DataFrame, on: str, cohort: str) -> DataFrame:
    """Cohort month from a dates table; 0 marks the never treated."""
    return panel.join(schedule.select(on, cohort), on, "left").withColumn(cohort, F.coalesce(F.col(cohort), F.lit(0)))


def activity_dates(df: DataFrame, unit: str, time: str, value: str, shares: list[float], totals: list[float]) -> DataFrame:
    """First period at each share of the unit's peak and at each running total.

    Every threshold is taken in the same two passes; the running sum is the only
    ordered window and sees one row per unit and period."""
    peak = df.groupBy(unit).agg(F.max(value).alias("_peak"))
    w = Window.partitionBy(unit).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    x = df.join(peak, unit).withColumn("_cum", F.sum(value).over(w))
    aggs = [F.min(F.when((F.col("_peak") > 0) & (F.col(value) >= F.lit(p) * F.col("_peak")), F.col(time))).alias(f"at_{round(p * 100)}pct") for p in shares]
    aggs += [F.min(F.when(F.col("_cum") >= F.lit(float(s)), F.col(time))).alias(f"at_total_{s:g}") for s in totals]
    return x.groupBy(unit).agg(*aggs)


def balance_common(df: DataFrame, unit: str, time: str) -> DataFrame:
    """Keep the periods every unit is observed in."""
    n = df.agg(F.count_distinct(unit)).scalar()
    full = df.groupBy(time).agg(F.count_distinct(unit).alias("_n")).where(F.col("_n") == n).select(time)
    return df.join(full, time, "left_semi")


def balance_units(df: DataFrame, unit: str, time: str) -> DataFrame:
    """Keep the units observed in every period."""
    n = df.agg(F.count_distinct(time)).scalar()
    full = df.groupBy(unit).agg(F.count_distinct(time).alias("_n")).where(F.col("_n") == n).select(unit)
    return df.join(full, unit, "left_semi")


def coverage_filter(df: DataFrame, unit: str, at_least: int | None = None, share_of_max: float | None = None) -> DataFrame:
    """Keep units with enough rows, by count or by share of the fullest unit."""
    counts = df.groupBy(unit).agg(F.count("*").alias("_n"))
    bar = F.lit(at_least) if at_least is not None else F.lit(share_of_max) * counts.agg(F.max("_n")).scalar()
    return df.join(counts.where(F.col("_n") >= bar).select(unit), unit, "left_semi")


def untreated_rows(df: DataFrame, time: str, cohort: str) -> DataFrame:
    return df.where(F.col(cohort).isNull() | (F.col(time) < F.col(cohort)))


def wide_two_periods(df: DataFrame, unit: str, time: str, y: str, pre: int, post: int) -> DataFrame:
    """y0, y1 and their difference per unit observed in both periods."""
    two = df.where(F.col(time).isin(pre, post)).groupBy(unit).agg(
        F.max(F.when(F.col(time) == pre, F.col(y))).alias("y0"), F.max(F.when(F.col(time) == post, F.col(y))).alias("y1"))
    return two.where("y0 is not null and y1 is not null").withColumn("dy", F.col("y1") - F.col("y0"))


def standardize(df: DataFrame, unit: str, time: str, cohort: str, anticipation: int = 0,
                control_group: str = "nevertreated", balance: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sample rules of the group-time estimator, in their order, and a log of
    the rows each rule removed.

    1. a cohort beyond the last period, or coded 0, never gets treated;
    2. without never-treated units both modes stop before the last cohort minus
       anticipation; ``nevertreated`` turns that cohort into controls, while
       ``notyettreated`` leaves it its name;
    3. units treated by the first period are dropped;
    4. incomplete units are dropped when a balanced panel is asked for.
    """
    steps: list[tuple[str, DataFrame]] = [("input", df)]
    tmax = df.agg(F.max(time)).scalar()
    d = df.withColumn(cohort, F.when((F.col(cohort) > 0) & (F.col(cohort) <= tmax), F.col(cohort)))
    steps.append(("as_if_never_treated", d))
    head = d.agg(F.max(cohort).alias("gmax"), F.max(F.col(cohort).isNull()).alias("has_never")).first()
    if not head.has_never and head.gmax is not None:
        d = d.where(F.col(time) < head.gmax - anticipation)
        if control_group == "nevertreated":
            d = d.withColumn(cohort, F.when(F.col(cohort) < head.gmax, F.col(cohort)))
    steps.append(("truncate_without_never_treated", d))
    tmin = d.agg(F.min(time)).scalar()
    d = d.where(F.col(cohort).isNull() | (F.col(cohort) > tmin + F.lit(anticipation)))
    steps.append(("treated_in_first_period", d))
    if balance:
        d = balance_units(d, unit, time)
        steps.append(("incomplete_units", d))
    log = None
    for name, frame in steps:
        row = frame.agg(F.lit(name).alias("step"), F.count("*").alias("rows_left"), F.count_distinct(unit).alias("units_left"))
        log = row if log is None else log.unionByName(row)
    return d, log


def small_cohorts(df: DataFrame, unit: str, cohort: str, covariates: int) -> DataFrame:
    """Cohorts with fewer units than covariates plus five."""
    sizes = df.groupBy(cohort).agg(F.count_distinct(unit).alias("units"))
    return sizes.withColumn("too_small", F.col("units") < F.lit(covariates + 5))


def time_sequence(df: DataFrame, time: str, cohort: str) -> DataFrame:
    """Observed periods as 1..T and the cohort as the first index at or after it.

    The ordered list of periods is one array scalar (its length is the number of
    calendar periods), so no window runs over the panel."""
    axis = df.agg(F.array_sort(F.collect_set(time)).alias("a"))
    d = df.withColumn("_axis", axis.scalar())
    pos = F.array_position("_axis", F.col(time))
    gpos = F.size(F.filter("_axis", lambda a: a < F.col(cohort))) + 1
    return d.withColumns({"t_seq": pos.cast("bigint"), "g_seq": F.when(F.col(cohort).isNull(), F.lit(0)).when(
        gpos > F.size("_axis"), F.lit(0)).otherwise(gpos).cast("bigint")}).drop("_axis")


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Index of sorted distinct key values, ranked on the key table only.

    Ranks are made in range partitions: each partition numbers its own keys and
    adds the sizes of the partitions before it."""
    keys = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    # Range bounds are sampled, so the tagged keys are fixed before two branches read them.
    tagged = durable(keys.select(key, F.spark_partition_id().alias("_p")))
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("_c"))
    off = sizes.withColumn("_off", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_off")
    ranked = tagged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    table_ = ranked.join(off, "_p").select(key, (F.col("_r") + F.col("_off")).cast("bigint").alias(out))
    return df.join(table_, key)


def breakpoint_bins(value, cuts: Column, labels: list[str]) -> Column:
    """Right-closed bins between the elements of ``cuts``, lowest value included."""
    v = col(value)
    out = F.when(v.isNull(), None)
    for i, name in enumerate(labels):
        out = out.when(v <= cuts[i + 1], name)
    return out
