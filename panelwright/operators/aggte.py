"""Summaries of group-time effects and their inference.

Without covariates a unit's influence on any summary is linear in its outcome
vector: weight times (constants + slopes . outcomes), with constants and slopes
that depend on the unit's cohort only. The cell weights are folded into those
slopes first, so units are read once, in Arrow batches, and each task returns
only sums of products between summaries.
"""

from __future__ import annotations

from collections import namedtuple
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import pchisq_upper
from panelwright.functions.scalars import AVG_Z
from panelwright.operators import attgt as A
from panelwright.operators.attgt import Design

CellRow = namedtuple("CellRow", "cell g t pre is_post att se")

CHUNK = 256  # summaries per pass over the units when only variances are wanted


@dataclass
class Param:
    """A weighted sum of cells; ``shares`` marks weights estimated from cohort sizes."""

    kind: str
    key: int | None
    weights: dict  # (g, t) -> weight
    correction: dict = field(default_factory=dict)  # cohort -> coefficient of w_i in the influence
    estimate: float = float("nan")


def cohort_shares(units: DataFrame) -> dict:
    """Weighted share of units in each cohort (None is never treated)."""
    rows = units.groupBy("cohort").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    total_w, total = sum(r.w for r in rows), sum(r.n for r in rows)
    return {"share": {r.cohort: r.w / total_w for r in rows}, "n": total, "wbar": total_w / total}


def _weighted(kind, key, keep_cells, att, pg) -> Param:
    """Average with estimated cohort shares as weights."""
    s = sum(pg[g] for g, _ in keep_cells)
    theta = sum(pg[g] * att[g, t] for g, t in keep_cells) / s
    cor: dict = {}
    for g, t in keep_cells:
        cor[g] = cor.get(g, 0.0) + (att[g, t] - theta) / s
    return Param(kind, key, {c: pg[c[0]] / s for c in keep_cells}, cor, theta)


def _mean(kind, key, parts: list[Param]) -> Param:
    w: dict = {}
    cor: dict = {}
    for p in parts:
        for c, v in p.weights.items():
            w[c] = w.get(c, 0.0) + v / len(parts)
        for g, v in p.correction.items():
            cor[g] = cor.get(g, 0.0) + v / len(parts)
    return Param(kind, key, w, cor, sum(p.estimate for p in parts) / len(parts))


def build_params(kind: str, att: dict, pg: dict, tmax: int, balance_e: int | None = None, min_e: float = -np.inf, max_e: float = np.inf) -> list[Param]:
    """Parameters of one summary type; the overall one has key None and is last."""
    cells = sorted(att)
    post = [c for c in cells if c[0] <= c[1] <= c[0] + max_e]
    if kind == "simple":
        return [_weighted("simple", None, post, att, pg)] if post else []
    if kind == "group":
        parts = []
        for g in sorted({c[0] for c in post}):
            mine = [c for c in post if c[0] == g]
            parts.append(Param("group", g, {c: 1 / len(mine) for c in mine}, {}, sum(att[c] for c in mine) / len(mine)))
        if not parts:
            return []
        s = sum(pg[p.key] for p in parts)
        theta = sum(pg[p.key] * p.estimate for p in parts) / s
        w = {c: v * pg[p.key] / s for p in parts for c, v in p.weights.items()}
        return parts + [Param("group", None, w, {p.key: (p.estimate - theta) / s for p in parts}, theta)]
    if kind == "dynamic":
        use = cells
        if balance_e is not None:
            use = [c for c in cells if tmax - c[0] >= balance_e and c[1] - c[0] <= balance_e]
        parts = []
        for e in sorted({t - g for g, t in use}):
            if min_e <= e <= max_e:
                parts.append(_weighted("dynamic", e, [c for c in use if c[1] - c[0] == e], att, pg))
        after = [p for p in parts if p.key >= 0]
        return parts + ([_mean("dynamic", None, after)] if after else [])
    if kind == "calendar":
        parts = [_weighted("calendar", t, [c for c in post if c[1] == t], att, pg) for t in sorted({c[1] for c in post})]
        return parts + ([_mean("calendar", None, parts)] if parts else [])
    raise ValueError(f"unknown summary {kind}")


@dataclass
class Fit:
    """Estimated cells plus what inference needs: units, shares, cohort sums."""

    design: Design
    table: DataFrame
    rows: list
    units: DataFrame
    periods: list
    cohorts: list
    shares: dict
    arm: dict  # (cell, treated) -> (sum of weights, weighted mean change)
    control: dict  # cell -> set of control cohorts

    @property
    def att(self) -> dict:
        return {(r.g, r.t): r.att for r in self.rows if r.att is not None}


def fit_panel(df: DataFrame, d: Design) -> Fit:
    """Cells without covariates, together with the sums inference reuses."""
    series, k = A.series_contract(A.unit_series(df, d), d)
    periods, cohorts = k.periods, k.controls
    grid = A.cell_list(periods, k.cohorts, d)
    cells = A.cells_frame(df.sparkSession, grid)
    members = A.control_cohorts(cells.where("pre is not null"), cohorts, d)
    units = A.on_axis(series, periods)
    by = {r.cell: r for r in A._panel_cells(members, A.pair_moments(units, A.base_pairs(grid), periods)).collect()}
    rows, arm, control = [], {}, {}
    for cell, g, t, pre, post in grid:
        r = by.get(cell)
        ok = r is not None and r.mt is not None and r.mc is not None
        base = t == pre
        att = 0.0 if base else (r.mt - r.mc if ok else None)
        se = r.v ** 0.5 if ok and not base and r.v ** 0.5 > A.TINY_SE else None
        if ok:
            arm[cell] = (r.wt, r.mt, r.wc, r.mc)
            late = [c for c in cohorts if c > max(t, pre) + d.anticipation and c != g] if d.control_group == "notyettreated" else []
            control[cell] = [None, *late]
        rows.append(CellRow(cell, g, t, pre, post, att, se))
    table = df.sparkSession.createDataFrame([tuple(r) for r in rows], "cell BIGINT, g BIGINT, t BIGINT, pre BIGINT, is_post BOOLEAN, att DOUBLE, se DOUBLE")
    return Fit(d, table, rows, units, periods, cohorts, cohort_shares(series), arm, control)


def influence_coefficients(fit: Fit, params: list[Param]) -> dict:
    """Per cohort: constants a (P) and slopes b (T x P) so that a unit's influence
    on each summary is w x (a + y b)."""
    idx = {p: i for i, p in enumerate(fit.periods)}
    n, wbar = fit.shares["n"], fit.shares["wbar"]
    T, P = len(fit.periods), len(params)
    coef = {c: (np.zeros(P), np.zeros((T, P))) for c in [*fit.cohorts, None]}
    cell_of = {(r.g, r.t): r for r in fit.rows}
    for k, p in enumerate(params):
        for g, v in p.correction.items():
            coef[g][0][k] += v / wbar
        for (g, t), weight in p.weights.items():
            r = cell_of[g, t]
            if r.t == r.pre or r.cell not in fit.arm:
                continue
            wt, mt, wc, mc = fit.arm[r.cell]
            i, j = idx[r.t], idx[r.pre]
            for cohorts, s, m in (((g,), n * weight / wt, mt), (fit.control[r.cell], -n * weight / wc, mc)):
                for c in cohorts:
                    a, b = coef[c]
                    a[k] -= s * m
                    b[i, k] += s
                    b[j, k] -= s
    return coef


def _batches(coef: dict, f: pd.DataFrame) -> np.ndarray:
    """Influence of a batch of units on every summary."""
    first = next(iter(coef.values()))
    out = np.zeros((len(f), len(first[0])))
    cohort = f["cohort"].to_numpy()
    missing = pd.isna(cohort)
    ys = np.array([np.asarray(v, dtype=float) for v in f["ys"]])
    ys = np.nan_to_num(ys, nan=0.0)
    w = f["w"].to_numpy()
    for c, (a, b) in coef.items():
        m = missing if c is None else (~missing & (cohort == c))
        if m.any():
            out[m] = w[m, None] * (a + ys[m] @ b)
    return out


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def influence_products(fit: Fit, params: list[Param], full: bool = False, by_cluster: bool = False) -> np.ndarray:
    """Sum over units (or clusters) of influence products: the diagonal, or all
    pairs of summaries when ``full``."""
    coef = influence_coefficients(fit, params)
    P = len(params)
    units = fit.units

    def part(batches):
        total = np.zeros((P, P)) if full else np.zeros(P)
        for f in batches:
            m = np.vstack(f["v"].to_numpy()) if "v" in f else _batches(coef, f)
            total += m.T @ m if full else (m * m).sum(axis=0)
        yield pd.DataFrame({"p": np.arange(total.size), "v": total.ravel()})

    src = units.select("cohort", "w", "ys")
    if by_cluster:
        def sums(batches):
            for f in batches:
                m = _batches(coef, f)
                g = pd.DataFrame(m).groupby(f["cluster"].to_numpy()).sum()
                yield pd.DataFrame({"cluster": g.index, "v": list(g.to_numpy())})

        v = units.select("cohort", "w", "ys", "cluster").mapInPandas(sums, f"cluster {_type(units, 'cluster')}, v array<double>")
        src = v.groupBy("cluster").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(P)]).alias("v")).select("v")
    rows = src.mapInPandas(part, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(P * P if full else P)
    for r in rows:
        out[r.p] = r.v
    return out.reshape(P, P) if full else out


def aggregate(fit: Fit, kind: str, **window) -> DataFrame:
    """Estimates and analytic standard errors of one summary type, one row each;
    the overall row has a null key."""
    params = build_params(kind, fit.att, fit.shares["share"], fit.periods[-1], **window)
    n = fit.shares["n"]
    ses: list[float] = []
    for lo in range(0, len(params), CHUNK):
        part = params[lo:lo + CHUNK]
        ses += list(np.sqrt(influence_products(fit, part)) / n)
    rows = [(kind, p.key, float(p.estimate), float(s) if s > 1e-12 else None) for p, s in zip(params, ses)]
    t = fit.table.sparkSession.createDataFrame(rows, "kind STRING, key BIGINT, estimate DOUBLE, se DOUBLE")
    return t.withColumns({"lo": F.col("estimate") - AVG_Z * F.col("se"), "hi": F.col("estimate") + AVG_Z * F.col("se")})


def influence_long(fit: Fit, params: list[Param]) -> DataFrame:
    """(unit, cluster, param, psi) with zeros left out: input of the bootstrap."""
    coef = influence_coefficients(fit, params)

    def part(batches):
        for f in batches:
            m = _batches(coef, f)
            i, k = np.nonzero(m)
            yield pd.DataFrame({"unit": f["unit"].to_numpy()[i], "cluster": f["cluster"].to_numpy()[i], "param": k, "psi": m[i, k]})

    return fit.units.select("unit", "cluster", "cohort", "w", "ys").mapInPandas(part, f"unit {_type(fit.units, 'unit')}, cluster {_type(fit.units, 'cluster')}, param bigint, psi double")


def cell_params(fit: Fit) -> list[Param]:
    return [Param("cell", r.cell, {(r.g, r.t): 1.0}, {}, r.att) for r in fit.rows if r.att is not None and r.t != r.pre]


def pretest_wald(fit: Fit) -> dict:
    """Joint test that effects before treatment are zero, over all cells before it."""
    pre = [p for p in cell_params(fit) if all(g > t for g, t in p.weights)]
    if not pre:
        return {"statistic": None, "df": 0, "p_value": None}
    v = influence_products(fit, pre, full=True) / fit.shares["n"]
    b = np.array([p.estimate for p in pre])
    if np.linalg.cond(v) > 1 / np.finfo(float).eps:
        return {"statistic": None, "df": len(pre), "p_value": None}
    stat = float(fit.shares["n"] * b @ np.linalg.solve(v, b))
    return {"statistic": stat, "df": len(pre), "p_value": pchisq_upper(stat, len(pre))}


def joint_chi2(rows: DataFrame, estimate: str = "estimate", se: str = "se") -> DataFrame:
    """Sum of squared t ratios over given rows with its chi-square p-value."""
    s = rows.where(F.col(se).isNotNull()).agg(F.sum(F.pow(F.col(estimate) / F.col(se), 2)).alias("statistic"), F.count("*").alias("df")).first()
    p = None if not s.df else pchisq_upper(s.statistic, s.df)
    return rows.sparkSession.createDataFrame([(s.statistic, s.df, p)], "statistic DOUBLE, df BIGINT, p_value DOUBLE")


def dynamic_wald(fit: Fit, before: int = -1, **window) -> dict:
    """Wald test of the pre-treatment event-study coefficients with their full covariance."""
    params = [p for p in build_params("dynamic", fit.att, fit.shares["share"], fit.periods[-1], **window) if p.key is not None and p.key <= before]
    n = fit.shares["n"]
    v = influence_products(fit, params, full=True) / n / n
    b = np.array([p.estimate for p in params])
    rank = int(np.linalg.matrix_rank(v))
    stat = float(b @ np.linalg.pinv(v, hermitian=True) @ b)
    return {"statistic": stat, "df": rank, "p_value": pchisq_upper(stat, rank)}


def holm(df: DataFrame, p: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values of a result table (a few rows)."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col(p).asc_nulls_last())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    m = df.agg(F.count(p)).scalar()
    adj = (m - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("_adj", adj).withColumn(out, F.least(F.max("_adj").over(run), F.lit(1.0))).drop("_adj")


def event_study_frame(dyn: DataFrame, crit: float = AVG_Z) -> DataFrame:
    """Event-study rows with interval, side and significance flags."""
    lo, hi = F.col("estimate") - crit * F.col("se"), F.col("estimate") + crit * F.col("se")
    return dyn.where("key is not null").select(F.col("key").alias("e"), "estimate", "se", lo.alias("ci_lower"), hi.alias("ci_upper"), (F.col("key") < 0).alias("is_pre"), ((lo > 0) | (hi < 0)).alias("significant"))
