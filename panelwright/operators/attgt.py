"""Group-time average treatment effects.

Cells (group, period) come from the distinct cohorts and periods. Without
covariates every cell needs only sums per (cohort, period pair), so the units
are read once, their outcome changes are summed map-side, and the comparison
groups are put together on those few rows. With covariates the units are laid
out by cell and handed to the batched two-period estimators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import AVG_Z, long_array, struct_array
from panelwright.operators.design import with_covariates
from panelwright.operators.did2x2 import CELL, estimate_cells
from panelwright.session import keep

TINY_SE = 10 * 1.4901161193847656e-8


@dataclass(frozen=True)
class Design:
    """Which columns play which part, and the comparison rules."""

    unit: str | None = "id"
    time: str = "t"
    cohort: str = "g"
    y: str = "y"
    weight: str | None = None
    cluster: str | None = None
    control_group: str = "nevertreated"
    base_period: str = "varying"
    anticipation: int = 0
    mode: str = "panel"  # panel | unbalanced | rc


def axes(df: DataFrame, d: Design) -> tuple[list[int], list[int], bool]:
    """Sorted periods, sorted cohorts as written, and whether a cohort is null;
    one aggregate whose result has calendar size."""
    g = F.col(d.cohort).try_cast("bigint")  # an infinite cohort becomes null
    r = df.agg(F.array_sort(F.collect_set(F.col(d.time).cast("bigint"))).alias("t"), F.array_sort(F.collect_set(g)).alias("g"), F.max(g.isNull()).alias("null")).first()
    return list(r.t), list(r.g), bool(r["null"])


@dataclass(frozen=True)
class Contract:
    """What the sample rules leave: periods, treated cohorts that get cells, and
    the cohorts that may serve as not-yet-treated controls."""

    periods: list
    cohorts: list
    controls: list
    latest: int | None  # cohorts from here on count as never treated
    first: int | None  # cohorts up to here leave the sample

    def column(self, c: Column) -> Column:
        """A cohort column under the rules: null is never treated."""
        c = c.try_cast("bigint")
        return F.when((c > 0) & (c < F.lit(self.latest)), c) if self.latest is not None else c

    def in_sample(self, c: Column) -> Column:
        """Rows of ``c`` (already under the rules) that stay."""
        return c.isNull() | (c > F.lit(self.first)) if self.first is not None else F.lit(True)


def contract(periods: list[int], cohorts: list[int], has_null: bool, d: Design) -> Contract:
    """The sample rules of the group-time estimator, on calendar-sized lists.

    0, an infinite cohort and one beyond the last period are never treated.
    Without any, periods stop before the last cohort (less the anticipation),
    which then is the comparison: as never treated for ``nevertreated``, under
    its own name and without cells of its own for ``notyettreated``. Cohorts
    treated by the first period leave the sample."""
    if not periods:
        return Contract([], [], [], None, None)
    treated = [g for g in cohorts if 0 < g <= periods[-1]]
    latest, controls = periods[-1] + 1, treated
    if treated and not has_null and len(treated) == len(cohorts):
        last = treated[-1]
        periods = [t for t in periods if t < last - d.anticipation]
        treated = treated[:-1]
        if d.control_group == "nevertreated":
            latest, controls = last, treated
    first = periods[0] if periods else None
    inside = lambda gs: [g for g in gs if first is not None and g > first]
    return Contract(periods, [g for g in inside(treated) if g > first + d.anticipation], inside(controls), latest, first)


def under_contract(df: DataFrame, d: Design) -> tuple[DataFrame, Contract]:
    """Rows of a long panel or cross-section under the sample rules."""
    k = contract(*axes(df, d), d)
    x = df.withColumn(d.cohort, k.column(F.col(d.cohort)))
    x = x.where(k.in_sample(F.col(d.cohort)))
    return (x.where(F.col(d.time) <= F.lit(k.periods[-1])) if k.periods else x.limit(0)), k


def gt_cells(df: DataFrame, d: Design) -> DataFrame:
    """The grid of cells with base period, as rows (cell, g, t, pre, is_post)."""
    k = contract(*axes(df, d), d)
    return cells_frame(df.sparkSession, cell_list(k.periods, k.cohorts, d))


def cell_list(periods: list[int], cohorts: list[int], d: Design) -> list[tuple]:
    """(cell, g, t, pre, is_post) in order; ``pre`` is None without a base period.

    Varying base: the period before for cells before treatment, the last
    untreated period afterwards. Universal base: the last untreated period."""
    rows = []
    for g in cohorts:
        last = max((p for p in periods if p + d.anticipation < g), default=None)
        for before, t in zip([None, *periods], periods):
            if d.base_period == "varying" and before is None:
                continue
            pre = before if d.base_period == "varying" and t < g else last
            rows.append((len(rows), g, t, pre, t >= g))
    return rows


def cells_frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "cell BIGINT, g BIGINT, t BIGINT, pre BIGINT, is_post BOOLEAN")


def base_pairs(rows: list[tuple]) -> list[tuple[int, int]]:
    return sorted({(t, pre) for _, _, t, pre, _ in rows if pre is not None})


def control_cohorts(cells: DataFrame, cohorts: list[int], d: Design) -> DataFrame:
    """Membership (cell, cohort, treated): the cohort itself, and the cohorts that
    serve as its controls. Cohort null is never treated. The candidates are a
    short literal array, so the rule is a filter rather than a join."""
    members = long_array([*cohorts, None])
    c = cells.withColumn("cohort", F.explode(members))
    own = F.col("cohort").eqNullSafe(F.col("g"))
    control = F.col("cohort").isNull()
    if d.control_group == "notyettreated":
        control = control | ((F.col("cohort") > F.greatest("t", "pre") + d.anticipation) & ~own)
    return c.where(own | control).withColumn("treated", own)


def unit_series(df: DataFrame, d: Design, extra: list[str] | None = None) -> DataFrame:
    """One row per unit: cohort, weight, cluster, extra columns and the outcomes as
    a map from period. The one wide shuffle of the estimator, persisted because
    axes, shares, cell sums and influence values all read it. Weight, cluster
    and covariates are those of the unit's first observed period."""
    w = F.lit(1.0) if d.weight is None else F.min_by(F.col(d.weight).cast("double"), d.time)
    cl = F.min(d.unit) if d.cluster is None else F.min_by(d.cluster, d.time)
    g = df.where(F.col(d.y).isNotNull()).groupBy(F.col(d.unit).alias("unit")).agg(
        F.min(d.cohort).try_cast("bigint").alias("cohort"), w.alias("w"), cl.alias("cluster"), *[F.min_by(c, d.time).alias(c) for c in (extra or [])],
        F.map_from_entries(F.collect_list(F.struct(F.col(d.time).cast("bigint"), F.col(d.y).cast("double")))).alias("series"))
    return keep(g)


def series_contract(units: DataFrame, d: Design) -> tuple[DataFrame, Contract]:
    """Persisted units under the sample rules; periods that fall away are left
    out when the outcomes are laid on the axis."""
    k = contract(*axes(units.select(F.explode(F.map_keys("series")).alias("t"), F.col("cohort").alias("g")), Design()), d)
    return units.withColumn("cohort", k.column(F.col("cohort"))).where(k.in_sample(F.col("cohort"))), k


def on_axis(units: DataFrame, periods: list[int]) -> DataFrame:
    """Outcome map laid on the period axis as an array (null where unobserved)."""
    axis = long_array(periods)
    return units.withColumn("ys", F.transform(axis, lambda p: F.col("series")[p])).drop("series")


def _position(periods: list[int], c: Column) -> Column:
    return F.array_position(long_array(periods), c).cast("int")


def pair_moments(units: DataFrame, pairs: list[tuple[int, int]], periods: list[int]) -> DataFrame:
    """Sums of weighted outcome changes per cohort and period pair.

    Each unit row is expanded over the pairs inside the task and summed there;
    what moves is one row per cohort, pair and task."""
    idx = {p: i for i, p in enumerate(periods)}
    lit = struct_array([(t, p, idx[t], idx[p]) for t, p in pairs], ("t", "pre", "i", "j"))
    x = units.select("cohort", "w", "ys", F.explode(lit).alias("p")).select("cohort", "w", "p.t", "p.pre", (F.get("ys", F.col("p.i").cast("int")) - F.get("ys", F.col("p.j").cast("int"))).alias("dy"))
    x = x.where("dy is not null")
    w, dy = F.col("w"), F.col("dy")
    return x.groupBy("cohort", "t", "pre").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * dy).alias("swd"), F.sum(w * w).alias("sww"), F.sum(w * w * dy).alias("swwd"), F.sum(w * w * dy * dy).alias("swwdd"))


def _panel_cells(members: DataFrame, moments: DataFrame) -> DataFrame:
    """ATT and standard error per cell from cohort sums."""
    m = members.join(moments.withColumnRenamed("cohort", "_mc"), ["t", "pre"]).where(F.col("cohort").eqNullSafe(F.col("_mc")))
    arm = m.groupBy("cell", "treated").agg(*[F.sum(c).alias(c) for c in ("n", "sw", "swd", "sww", "swwd", "swwdd")])
    mean = F.col("swd") / F.col("sw")
    # squared influence of an arm: sum w^2 (dy - mean)^2 / (sum w)^2
    var = (F.col("swwdd") - 2 * mean * F.col("swwd") + mean * mean * F.col("sww")) / (F.col("sw") * F.col("sw"))
    arm = arm.select("cell", "treated", "n", "sw", mean.alias("m"), F.greatest(var, F.lit(0.0)).alias("v"))
    pick = lambda c, t: F.max(F.when(F.col("treated") == t, F.col(c)))
    return arm.groupBy("cell").agg(pick("n", True).alias("n_treated"), pick("n", False).alias("n_control"), pick("m", True).alias("mt"), pick("m", False).alias("mc"),
                                   pick("sw", True).alias("wt"), pick("sw", False).alias("wc"), (pick("v", True) + pick("v", False)).alias("v"))


def att_gt(df: DataFrame, d: Design, method: str = "dr", covariates: list[str] | str | None = None, guard: float | None = None) -> DataFrame:
    """ATT, standard error, bands' inputs and reason for every (group, period).

    ``covariates`` are column names or a formula. ``guard`` blanks panel cells with covariates whose largest propensity
    score reaches it or whose control design is singular. A cell that cannot be estimated stays in the grid with null
    values."""
    spark = df.sparkSession
    df, covariates = with_covariates(df, covariates)
    units = unit_series(df, d, covariates) if d.mode in ("panel", "unbalanced") and not (covariates and d.mode == "unbalanced") else None
    if units is not None:
        units, k = series_contract(units, d)
    else:
        df, k = under_contract(df, d)
    periods = k.periods
    grid = cell_list(periods, k.cohorts, d)
    cells = cells_frame(spark, grid)
    members = control_cohorts(cells.where("pre is not null"), k.controls, d)
    if d.mode == "panel" and not covariates:
        est = _panel_cells(members, pair_moments(on_axis(units, periods), base_pairs(grid), periods))
        est = est.select("cell", "n_treated", "n_control", (F.col("mt") - F.col("mc")).alias("att"), F.sqrt("v").alias("se"))
        est = est.withColumn("reason", F.when(F.col("n_treated").isNull(), "no treated units").when(F.col("n_control").isNull(), "no control units"))
    elif d.mode == "panel":
        r = cell_rows(on_axis(units, periods), periods, members, covariates)
        t = estimate_cells(r, method, "dy", "treated", covariates, "w", cell="cell", unit="unit", guard=guard).table
        sizes = r.groupBy("cell").agg(F.count_if(F.col("treated") == 1).alias("n_treated"), F.count_if(F.col("treated") == 0).alias("n_control"))
        est = t.select(F.col(CELL).alias("cell"), "att", "se", "reason").join(sizes, "cell")
    else:
        est = _cross_section_cells(df, d, members, grid, periods, method, covariates, units)
    out = cells.join(est, "cell", "left")
    base = F.col("t") == F.col("pre")
    tiny = F.col("se") <= TINY_SE
    return out.select(
        "cell", "g", "t", "pre", "is_post", "n_treated", "n_control",
        F.when(base, F.lit(0.0)).otherwise(F.col("att")).alias("att"), F.when(~base & ~tiny, F.col("se")).alias("se"),
        F.when(base, "reference period").when(F.col("pre").isNull(), "no base period").when(F.col("att").isNull(), F.coalesce("reason", F.lit("no comparison"))).alias("reason"))


def cell_rows(units: DataFrame, periods: list[int], members: DataFrame, covariates: list[str]) -> DataFrame:
    """Units laid out by the cells they take part in: (cell, unit, treated, dy, w, covariates).

    The membership table has cohorts x cells rows; it is grouped by cohort first
    so the join key is the cohort and each unit meets one row."""
    lists = members.groupBy("cohort").agg(F.collect_list(F.struct("cell", F.col("treated").cast("double").alias("treated"), _position(periods, F.col("t")).alias("i"), _position(periods, F.col("pre")).alias("j"))).alias("cells"))
    x = units.join(lists.withColumnRenamed("cohort", "_mc"), F.col("cohort").eqNullSafe(F.col("_mc")))
    x = x.select("unit", "cluster", "w", "ys", *covariates, F.explode("cells").alias("c"))
    x = x.select("unit", "cluster", "w", *covariates, "c.cell", "c.treated", (F.element_at("ys", F.col("c.i")) - F.element_at("ys", F.col("c.j"))).alias("dy"))
    return x.where("dy is not null")


def _cross_section_cells(df: DataFrame, d: Design, members: DataFrame, grid: list[tuple], periods: list[int], method: str, covariates: list[str] | None, units: DataFrame | None) -> DataFrame:
    """Repeated cross-sections, and unbalanced panels treated as such with the
    influence of a unit's rows added up."""
    w = F.lit(1.0) if d.weight is None else F.col(d.weight).cast("double")
    if covariates:
        lists = members.groupBy("cohort").agg(F.collect_list(F.struct("cell", F.col("treated").cast("double").alias("treated"), F.col("t").alias("ct"), F.col("pre").alias("cp"))).alias("cells"))
        x = df.join(lists.withColumnRenamed("cohort", "_mc"), F.col(d.cohort).eqNullSafe(F.col("_mc")))
        x = x.select(*([F.col(d.unit).alias("unit")] if d.unit else []), F.col(d.time).alias("_t"), F.col(d.y).alias("y"), w.alias("w"), *covariates, F.explode(F.filter("cells", lambda c: (c["ct"] == F.col(d.time)) | (c["cp"] == F.col(d.time)))).alias("c"))
        x = x.select("*", "c.cell", "c.treated", (F.col("_t") == F.col("c.ct")).cast("double").alias("post")).drop("c")
        t = estimate_cells(x, method, "y", "treated", covariates, "w", "post", cell="cell", unit="unit" if d.unit else None)
        sizes = x.groupBy("cell").agg(F.count_if(F.col("treated") == 1).alias("n_treated"), F.count_if(F.col("treated") == 0).alias("n_control"))
        tab = t.table.withColumnRenamed(CELL, "cell")
        if d.mode == "unbalanced":
            psi = t.influence.withColumnRenamed(CELL, "cell").groupBy("cell", "unit").agg(F.sum("psi").alias("psi"))
            se = psi.groupBy("cell").agg(F.sum(F.col("psi") * F.col("psi")).alias("ss"))
            tab = tab.drop("se").join(se, "cell", "left").withColumn("se", F.sqrt("ss") / F.col("n"))
        return tab.select("cell", "att", "se", "reason").join(sizes, "cell")
    if d.mode == "unbalanced":
        return _unbalanced_cells(on_axis(units, periods), members, [p for p in base_pairs(grid) if p[0] != p[1]], periods)
    y = F.col(d.y).cast("double")
    m = df.where(y.isNotNull()).groupBy(F.col(d.cohort).alias("_mc"), F.col(d.time).cast("bigint").alias("tt")).agg(
        F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * w).alias("sww"), F.sum(w * w * y).alias("swwy"), F.sum(w * w * y * y).alias("swwyy"))
    return _quadrants(members, m)


def _quadrants(members: DataFrame, m: DataFrame) -> DataFrame:
    two = members.select("cell", "cohort", "treated", F.explode(F.array(F.struct(F.lit(1).alias("post"), F.col("t").alias("tt")), F.struct(F.lit(0).alias("post"), F.col("pre").alias("tt")))).alias("q")).select("cell", "cohort", "treated", "q.post", "q.tt")
    j = two.join(m, "tt").where(F.col("cohort").eqNullSafe(F.col("_mc")))
    quad = j.groupBy("cell", "treated", "post").agg(*[F.sum(c).alias(c) for c in ("n", "sw", "swy", "sww", "swwy", "swwyy")])
    mean = F.col("swy") / F.col("sw")
    var = (F.col("swwyy") - 2 * mean * F.col("swwy") + mean * mean * F.col("sww")) / (F.col("sw") * F.col("sw"))
    quad = quad.withColumns({"m": mean, "v": F.greatest(var, F.lit(0.0)), "s": F.when(F.col("treated") == (F.col("post") == 1), 1.0).otherwise(-1.0)})
    has = lambda t, p: F.max(F.when((F.col("treated") == t) & (F.col("post") == p), 1)).isNotNull()
    g = quad.groupBy("cell").agg(F.count("*").alias("_q"), F.sum(F.col("s") * F.col("m")).alias("att"), F.sqrt(F.sum("v")).alias("se"),
                                 F.sum(F.when(F.col("treated"), F.col("n"))).alias("n_treated"), F.sum(F.when(~F.col("treated"), F.col("n"))).alias("n_control"),
                                 has(True, 0).alias("h10"), has(True, 1).alias("h11"), has(False, 0).alias("h00"), has(False, 1).alias("h01"))
    full = F.col("_q") == 4
    why = F.concat_ws(", ", *[F.when(~F.col(h), n) for h, n in (("h10", "n_treat_pre=0"), ("h11", "n_treat_post=0"), ("h00", "n_control_pre=0"), ("h01", "n_control_post=0"))])
    return g.select("cell", "n_treated", "n_control", F.when(full, F.col("att")).alias("att"), F.when(full, F.col("se")).alias("se"), F.when(~full, why).alias("reason"))


def _unbalanced_cells(units: DataFrame, members: DataFrame, pairs: list[tuple[int, int]], periods: list[int]) -> DataFrame:
    """Cross-section estimates whose influence is summed within units.

    The variance of a cell needs, per arm, each period's own sums and the cross
    sum over units seen in both; all come from one expansion over the pairs."""
    idx = {p: i for i, p in enumerate(periods)}
    lit = struct_array([(t, p, idx[t], idx[p]) for t, p in pairs], ("t", "pre", "i", "j"))
    x = units.select("cohort", "w", "ys", F.explode(lit).alias("p")).select("cohort", "w", "p.t", "p.pre", F.get("ys", F.col("p.i").cast("int")).alias("a"), F.get("ys", F.col("p.j").cast("int")).alias("b"))
    w, a, b = F.col("w"), F.col("a"), F.col("b")
    ha, hb = a.isNotNull(), b.isNotNull()
    both = ha & hb
    sums = {"na": F.count(a), "nb": F.count(b), "wa": F.sum(F.when(ha, w)), "wb": F.sum(F.when(hb, w)), "ya": F.sum(w * a), "yb": F.sum(w * b),
            "wwa": F.sum(F.when(ha, w * w)), "wwb": F.sum(F.when(hb, w * w)), "wya": F.sum(w * w * a), "wyb": F.sum(w * w * b), "yya": F.sum(w * w * a * a), "yyb": F.sum(w * w * b * b),
            "wwc": F.sum(F.when(both, w * w)), "ca": F.sum(F.when(both, w * w * a)), "cb": F.sum(F.when(both, w * w * b)), "cab": F.sum(w * w * a * b)}
    m = x.where(ha | hb).groupBy(F.col("cohort").alias("_mc"), "t", "pre").agg(*[F.coalesce(e, F.lit(0)).alias(n) for n, e in sums.items()])
    j = members.join(m, ["t", "pre"]).where(F.col("cohort").eqNullSafe(F.col("_mc")))
    arm = j.groupBy("cell", "treated").agg(*[F.sum(n).alias(n) for n in sums])
    A, B = F.col("ya") / F.nullif("wa", F.lit(0.0)), F.col("yb") / F.nullif("wb", F.lit(0.0))
    var = ((F.col("yya") - 2 * A * F.col("wya") + A * A * F.col("wwa")) / (F.col("wa") * F.col("wa")) + (F.col("yyb") - 2 * B * F.col("wyb") + B * B * F.col("wwb")) / (F.col("wb") * F.col("wb"))
           - 2 * (F.col("cab") - B * F.col("ca") - A * F.col("cb") + A * B * F.col("wwc")) / (F.col("wa") * F.col("wb")))
    arm = arm.withColumns({"d": A - B, "v": var})
    pick = lambda c, t: F.max(F.when(F.col("treated") == t, F.col(c)))
    g = arm.groupBy("cell").agg((pick("d", True) - pick("d", False)).alias("att"), F.sqrt(pick("v", True) + pick("v", False)).alias("se"),
                                (pick("na", True) + pick("nb", True)).alias("n_treated"), (pick("na", False) + pick("nb", False)).alias("n_control"),
                                *[F.coalesce(pick(c, t), F.lit(0)).alias(n) for c, t, n in (("nb", True, "q10"), ("na", True, "q11"), ("nb", False, "q00"), ("na", False, "q01"))])
    why = F.concat_ws(", ", *[F.when(F.col(h) == 0, n) for h, n in (("q10", "n_treat_pre=0"), ("q11", "n_treat_post=0"), ("q00", "n_control_pre=0"), ("q01", "n_control_post=0"))])
    return g.select("cell", "n_treated", "n_control", "att", "se", F.when(F.col("att").isNull(), why).alias("reason"))


# ---- support ---------------------------------------------------------------

def support_table(df: DataFrame, d: Design) -> DataFrame:
    """Observation counts behind every (group, period >= group) comparison.

    One aggregate gives observations per cohort and period. Controls at a period
    are the never treated plus, for the not-yet-treated rule, every cohort after
    it; that is a suffix sum over cohorts, taken on the small table."""
    seen = df.groupBy(F.col(d.cohort).alias("c"), F.col(d.time).cast("bigint").alias("t")).agg(F.count(d.y).alias("n"))
    seen = keep(seen)
    periods = seen.agg(F.array_sort(F.collect_set("t")).alias("a")).scalar()
    cells = seen.where("c is not null").select(F.col("c").cast("bigint").alias("g")).distinct().withColumn("t", F.explode(periods)).where(F.col("t") >= F.col("g"))
    cells = cells.withColumn("pre", F.col("g") - 1 - d.anticipation)
    counts = seen.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col("c").cast("bigint"), F.lit(-1)), F.col("n")))).alias("by"))
    here = counts.select("t", F.col("by").alias("now"))
    before = counts.select(F.col("t").alias("pre"), F.col("by").alias("then"))
    j = cells.join(here, "t", "left").join(before, "pre", "left")

    def total(m: str) -> Column:
        keep_ = lambda k, v: (k == -1) | (k > F.col("t")) if d.control_group == "notyettreated" else k == -1
        return F.coalesce(F.aggregate(F.map_values(F.map_filter(m, keep_)), F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0))

    own = lambda m: F.coalesce(F.element_at(m, F.col("g")), F.lit(0))
    out = j.select("g", "t", (F.col("t") - F.col("g")).alias("event_time"), own("then").alias("n_treat_pre"), own("now").alias("n_treat_post"), total("then").alias("n_control_pre"), total("now").alias("n_control_post"))
    quad = ["n_treat_pre", "n_treat_post", "n_control_pre", "n_control_post"]
    missing = F.concat_ws(", ", *[F.when(F.col(c) == 0, F.lit(f"{c}=0")) for c in quad])
    ok = F.least(*quad) > 0
    return out.select("*", sum((F.col(c) for c in quad[1:]), F.col(quad[0])).alias("n_total"), ok.alias("identifiable"), F.when(~ok, missing).alias("reason"))


def panel_balance(df: DataFrame, d: Design) -> DataFrame:
    """Units, periods, observations and balance of the panel, one row."""
    per = df.groupBy(d.unit).agg(F.count(d.y).alias("n"), F.max(F.col(d.cohort).isNotNull().cast("int")).alias("tr"))
    a = per.agg(F.count("*").alias("n_units"), F.sum("tr").alias("n_treated"), F.min("n").alias("min_obs"), F.max("n").alias("max_obs"), F.avg("n").alias("mean_obs"), F.sum("n").alias("n_obs"))
    return a.withColumn("n_periods", df.agg(F.count_distinct(d.time)).scalar()).withColumn("balance_pct", 100.0 * F.col("n_obs") / (F.col("n_units") * F.col("n_periods")))


def support_summary(support: DataFrame, by: list[str]) -> DataFrame:
    return support.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if("identifiable").alias("identifiable_cells"), (100.0 * F.avg(F.col("identifiable").cast("double"))).alias("pct"))


def att_gt_safe(df: DataFrame, d: Design, method: str = "dr", covariates: list[str] | None = None, on_missing: str = "null") -> DataFrame:
    """Group-time effects with the support reason attached to empty cells;
    ``on_missing='fail'`` refuses a panel with unsupported cells."""
    est = att_gt(df, d, method, covariates)
    sup = support_table(df, d).select("g", "t", "identifiable", F.col("reason").alias("support_reason"))
    j = est.join(sup, ["g", "t"], "left")
    j = j.withColumn("reason", F.coalesce("support_reason", "reason")).drop("support_reason")
    if on_missing == "fail":
        bad = j.where("is_post and not identifiable").limit(1).collect()
        if bad:
            raise ValueError(f"cell ({bad[0].g}, {bad[0].t}) is not identified: {bad[0].reason}")
    return j.withColumns({c: F.when(F.coalesce("identifiable", F.lit(True)), F.col(c)) for c in ("att", "se")})


def custom_att(df: DataFrame, d: Design, effect) -> DataFrame:
    """Effect per cell from a user function of the cell's arms.

    ``effect(treated, control)`` gets two dictionaries of column expressions
    (n, mean, sw) and returns a column."""
    units, k = series_contract(unit_series(df, d), d)
    periods = k.periods
    grid = cell_list(periods, k.cohorts, d)
    cells = cells_frame(df.sparkSession, grid)
    members = control_cohorts(cells.where("pre is not null"), k.controls, d)
    e = _panel_cells(members, pair_moments(on_axis(units, periods), base_pairs(grid), periods))
    t = {"n": F.col("n_treated"), "mean": F.col("mt"), "sw": F.col("wt")}
    c = {"n": F.col("n_control"), "mean": F.col("mc"), "sw": F.col("wc")}
    return cells.join(e, "cell").select("g", "t", effect(t, c).alias("att"))


def tidy(est: DataFrame, crit: float = AVG_Z) -> DataFrame:
    return est.select(F.concat(F.lit("ATT("), F.col("g"), F.lit(","), F.col("t"), F.lit(")")).alias("term"), F.col("g").alias("group"), F.col("t").alias("time"), F.col("att").alias("estimate"), F.col("se").alias("std_error"),
                      (F.col("att") - crit * F.col("se")).alias("conf_low"), (F.col("att") + crit * F.col("se")).alias("conf_high"),
                      (F.col("att") - AVG_Z * F.col("se")).alias("point_conf_low"), (F.col("att") + AVG_Z * F.col("se")).alias("point_conf_high"))
