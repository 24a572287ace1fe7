"""Two-way fixed effects on balanced or unbalanced panels.

Unit effects are removed inside each unit's own rows; period effects stay as
columns of the normal equations, so the fit is exact on any panel. Each task
turns its units into one partial cross-product matrix; the driver solves a
system whose size is regressors plus periods. A second pass over the units
gives cluster scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import pf_upper, two_sided_t
from panelwright.functions.scalars import AVG_Z, col
from panelwright.operators.moments import unpack
from panelwright.session import keep

ROWS_TIMES_COLUMNS = 4_000_000  # doubles held by one dense block inside a task


@dataclass
class FeFit:
    names: list
    coef: np.ndarray
    vcov: np.ndarray
    n: int
    n_units: int
    n_clusters: int
    n_coef_full: int
    ssr: float
    period_effects: dict
    kind: str

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0.0))

    @property
    def df_t(self) -> float:
        return self.n_clusters - 1 if self.kind != "iid" else self.n - self.n_coef_full

    def rows(self) -> list[tuple]:
        """(term, estimate, se, t, p, lo, hi): p from t, interval normal."""
        out = []
        for name, b, s in zip(self.names, self.coef, self.se):
            t = b / s if s > 0 else float("nan")
            out.append((name, float(b), float(s), float(t), float(two_sided_t(t, self.df_t)) if s > 0 else None, float(b - AVG_Z * s), float(b + AVG_Z * s)))
        return out

    def frame(self, spark, key_type: str = "STRING") -> DataFrame:
        return spark.createDataFrame(self.rows(), f"term {key_type}, estimate DOUBLE, se DOUBLE, t DOUBLE, p DOUBLE, lo DOUBLE, hi DOUBLE")

    def wald(self, pick) -> dict:
        """Joint F test of the named coefficients."""
        i = [k for k, n in enumerate(self.names) if pick(n)]
        b, v = self.coef[i], self.vcov[np.ix_(i, i)]
        rank = int(np.linalg.matrix_rank(v, tol=1e-12 * max(np.max(np.abs(np.diag(v))), 1e-300))) if i else 0
        if not rank:
            return {"statistic": None, "df1": 0, "df2": None, "p_value": None}
        stat = float(b @ np.linalg.pinv(v, rcond=1e-10, hermitian=True) @ b) / rank
        return {"statistic": stat, "df1": rank, "df2": self.df_t, "p_value": pf_upper(stat, rank, self.df_t)}


def fe_units(df: DataFrame, unit: str, time: str, y, dense: list | None = None, code=None, cluster: str | None = None) -> tuple[DataFrame, list[int]]:
    """Rows of a unit side by side: period position, outcome, regressors and the
    code of the one active dummy (-1 for none). A unit has at most one row per
    period, which bounds its arrays."""
    d = df.select(F.col(unit).alias("unit"), F.col(time).cast("bigint").alias("_t"), col(y).cast("double").alias("_y"), F.array(*[col(x).cast("double") for x in (dense or [])]).cast("array<double>").alias("_d"),
                  (F.lit(-1) if code is None else F.coalesce(col(code).cast("int"), F.lit(-1))).alias("_c"), (F.col(unit) if cluster is None else F.col(cluster)).alias("_cl"))
    d = d.where(F.col("_y").isNotNull() & F.col("_t").isNotNull())
    g = keep(d.groupBy("unit").agg(F.min("_cl").alias("cluster"), F.collect_list(F.struct("_t", "_y", "_c", "_d")).alias("r")))
    periods = g.select(F.explode("r._t").alias("t")).agg(F.array_sort(F.collect_set("t")).alias("a")).first().a
    return g.select("unit", "cluster", F.col("r._t").alias("t"), F.col("r._y").alias("y"), F.col("r._c").alias("c"), F.col("r._d").alias("d")), periods


def _blocks(batches, periods: np.ndarray, n_dense: int, n_code: int):
    """Dense, unit-demeaned blocks (X, y, unit position, frame) of bounded size."""
    width = n_dense + n_code + len(periods) - 1
    for f in batches:
        sizes = f["t"].map(len).to_numpy()
        limit = max(1, ROWS_TIMES_COLUMNS // max(width, 1))
        start = 0
        while start < len(f):
            stop, rows = start, 0
            while stop < len(f) and (rows == 0 or rows + sizes[stop] <= limit):
                rows += sizes[stop]
                stop += 1
            g = f.iloc[start:stop]
            start = stop
            u = np.repeat(np.arange(len(g)), g["t"].map(len).to_numpy())
            t = np.searchsorted(periods, np.concatenate(g["t"].to_numpy()))
            y = np.concatenate(g["y"].to_numpy()).astype(float)
            c = np.concatenate(g["c"].to_numpy())
            x = np.zeros((len(y), width))
            if n_dense:
                x[:, :n_dense] = np.vstack([np.vstack(v) for v in g["d"]])
            hit = np.flatnonzero(c >= 0)
            x[hit, n_dense + c[hit].astype(int)] = 1.0
            late = np.flatnonzero(t > 0)
            x[late, n_dense + n_code + t[late] - 1] = 1.0
            n = np.bincount(u, minlength=len(g)).astype(float)
            s = np.zeros((len(g), width))
            np.add.at(s, u, x)
            sy = np.bincount(u, weights=y, minlength=len(g))
            yield x - (s / n[:, None])[u], y - (sy / n)[u], u, g, t


@dataclass
class Normal:
    """Normal equations of regressors and period effects, unit effects removed."""

    a: np.ndarray
    b: np.ndarray
    inv: np.ndarray
    theta: np.ndarray
    ssr: float
    rank: int
    n: int
    n_units: int


def normal_equations(units: DataFrame, periods: list[int], n_dense: int, n_code: int) -> Normal:
    """One partial cross-product matrix per task, summed and solved on the driver."""
    width = n_dense + n_code + len(periods) - 1
    ax = np.array(periods)

    def gram_part(batches):
        total = np.zeros(width * (width + 1) // 2 + width + 3)
        iu = np.triu_indices(width)
        for x, yy, u, g, _ in _blocks(batches, ax, n_dense, n_code):
            total += np.concatenate([(x.T @ x)[iu], x.T @ yy, [yy @ yy, len(yy), len(g)]])
        i = np.flatnonzero(total)
        yield pd.DataFrame({"p": i, "v": total[i]})

    s = units.mapInPandas(gram_part, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(width * (width + 1) // 2 + width + 3)
    for r in s:
        v[r.p] = r.v
    tri = width * (width + 1) // 2
    a, b, (yy, n, n_units) = unpack(v[:tri], width), v[tri:tri + width], v[tri + width:]
    inv = np.linalg.pinv(a, rcond=1e-11, hermitian=True)
    theta = inv @ b
    rank = int(np.linalg.matrix_rank(a, tol=1e-9 * np.max(np.abs(np.diag(a))))) if width else 0
    return Normal(a, b, inv, theta, float(yy - theta @ b), rank, int(n), int(n_units))


def sum_arrays(parts: DataFrame, key: str) -> DataFrame:
    """Elementwise sums of the array column ``v`` per ``key``, of partial sums of tasks."""
    kind = dict(parts.dtypes)[key]

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(f["v"].iloc[0]))
        for v in f["v"]:
            total += v
        return pd.DataFrame({key: [f[key].iloc[0]], "v": [total]})

    return parts.groupBy(key).applyInPandas(add, f"{key} {kind}, v array<double>")


def fit_fe(df: DataFrame, unit: str, time: str, y, dense: list | None = None, names: list | None = None, code=None, code_names: list | None = None,
           cluster: str | None = None, kind: str = "cluster", transform: np.ndarray | None = None) -> FeFit:
    """Least squares with unit and period effects.

    ``kind``: cluster (one way), iid, hc1, twoway (unit and period).
    ``transform`` maps the coefficients to reported combinations (rows)."""
    units, periods = fe_units(df, unit, time, y, dense, code, cluster)
    nd, nc = len(dense or []), len(code_names or [])
    k = nd + nc
    ax = np.array(periods)
    width = k + len(ax) - 1

    eq = normal_equations(units, periods, nd, nc)
    inv, theta, ssr, rank, n, n_units = eq.inv, eq.theta, eq.ssr, eq.rank, eq.n, eq.n_units
    m = np.eye(k, width) if transform is None else np.hstack([transform, np.zeros((len(transform), width - k))])
    lift = m @ inv  # reported combinations x columns
    reported = list(names or []) + list(code_names or [])
    label = reported if transform is None else None
    full = rank + int(n_units)

    def outer(mode: str) -> tuple[np.ndarray, int]:
        q = len(m)
        if q == 0:
            return np.zeros((0, 0)), int(n_units)

        def scores(batches):
            for x, yv, u, g, t in _blocks(batches, ax, nd, nc):
                e = yv - x @ theta
                inf = (x * e[:, None]) @ lift.T
                if mode == "row":
                    yield pd.DataFrame({"key": [0], "v": [(inf.T @ inf).ravel()], "n": [len(inf)]})
                    continue
                key, size = (u, len(g)) if mode in ("unit", "cluster") else (t, len(ax))
                acc = np.zeros((size, q))
                np.add.at(acc, key, inf)
                if mode == "unit":
                    yield pd.DataFrame({"key": [0], "v": [(acc.T @ acc).ravel()], "n": [len(g)]})
                elif mode == "time":
                    yield pd.DataFrame({"key": np.arange(size), "v": list(acc), "n": 1})
                else:
                    by = pd.DataFrame(acc).groupby(g["cluster"].to_numpy()).sum()
                    yield pd.DataFrame({"key": by.index, "v": list(by.to_numpy()), "n": 1})

        out = units.mapInPandas(scores, "key bigint, v array<double>, n bigint")
        if mode in ("unit", "row"):
            r = out.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).collect()
            flat = np.zeros(q * q)
            for row in r:
                flat[row.p] = row.x
            return flat.reshape(q, q), int(n_units if mode == "unit" else n)

        def square(batches):
            total, count = np.zeros((q, q)), 0
            for f in batches:
                if len(f):
                    w = np.vstack(f["v"].to_numpy())
                    total += w.T @ w
                    count += len(f)
            yield pd.DataFrame({"p": np.arange(q * q + 1), "x": np.append(total.ravel(), count)})

        summed = out.groupBy("key").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(q)]).alias("v")).select("v")
        r = summed.mapInPandas(square, "p int, x double").groupBy("p").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(q * q + 1)
        for row in r:
            flat[row.p] = row.x
        return flat[:-1].reshape(q, q), int(flat[-1])

    # unit effects nested in the clusters do not count against the residual degrees of freedom
    k_nested = rank + 1
    if kind == "iid":
        vcov, g = ssr / (n - full) * m @ inv @ m.T, int(n_units)
    elif kind == "hc1":
        meat, _ = outer("row")
        vcov, g = meat * n / (n - full), int(n_units)
    elif kind == "twoway":
        v1, g1 = outer("unit" if cluster is None else "cluster")
        v2, g2 = outer("time")
        v12, _ = outer("row")
        g = min(g1, g2)
        vcov = (v1 + v2 - v12) * (n - 1) / (n - full) * g / (g - 1)
    else:
        meat, g = outer("unit" if cluster is None else "cluster")
        vcov = meat * (n - 1) / (n - k_nested) * g / max(g - 1, 1)
    effects = {int(p): float(e) for p, e in zip(periods, np.append(0.0, theta[k:]))}
    coef = m @ theta
    units.unpersist()
    return FeFit(label or [f"c{i}" for i in range(len(coef))], coef, vcov, int(n), int(n_units), g, full, ssr, effects, kind)


def period_components(df: DataFrame, unit: str, time: str) -> dict[int, int]:
    """Label of the connected part of the unit-period graph that each period is in.

    A unit ties its periods together, so the distinct pairs (first period, period)
    carry all links; they are at most the square of the calendar."""
    first = df.groupBy(unit).agg(F.min(time).alias("_a"), F.collect_set(time).alias("_b"))
    root: dict[int, int] = {}

    def find(t: int) -> int:
        while root.setdefault(t, t) != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    for a, b in first.select("_a", F.explode("_b").alias("_b")).distinct().collect():
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {int(t): int(find(t)) for t in root}


def predict_all(df: DataFrame, unit: str, time: str, y: str, fit_on: Column, out: str = "yhat") -> DataFrame:
    """Fitted unit + period effects for every row, estimated on chosen rows.

    A row whose unit or period has no chosen row gets null, and so does one whose
    unit and period are in different connected parts: their sum is not identified."""
    base = df.where(fit_on & F.col(y).isNotNull())
    fit = fit_fe(base, unit, time, y)
    part = period_components(base, unit, time)
    lam = df.sparkSession.createDataFrame([(t, v, part[t]) for t, v in fit.period_effects.items()], "_t BIGINT, _lam DOUBLE, _pt BIGINT")
    alpha = base.join(lam, F.col(time) == F.col("_t")).groupBy(unit).agg(F.avg(F.col(y) - F.col("_lam")).alias("_alpha"), F.min("_pt").alias("_pu"))
    j = df.join(lam, F.col(time) == F.col("_t"), "left").join(alpha, unit, "left")
    return j.withColumn(out, F.when(F.col("_pt") == F.col("_pu"), F.col("_alpha") + F.col("_lam"))).drop("_t", "_lam", "_alpha", "_pt", "_pu")


def residualize(df: DataFrame, unit: str, time: str, y: str, fit_on: Column | None = None, recentre: bool = False, out: str = "resid") -> DataFrame:
    """Outcome minus fitted two-way effects, optionally around the overall mean."""
    p = predict_all(df, unit, time, y, F.lit(True) if fit_on is None else fit_on, "_hat")
    e = F.col(y) - F.col("_hat")
    if recentre:
        e = e + df.agg(F.avg(y)).scalar()
    return p.withColumn(out, e).drop("_hat")


def event_codes(df: DataFrame, time: str, cohort: str, ref: int = -1, lo: int | None = None, hi: int | None = None) -> tuple[DataFrame, list[int]]:
    """Event-time dummy code per row; the reference and never-treated rows have none."""
    e = F.col(time) - F.col(cohort)
    d = df.withColumn("e", e.cast("bigint"))
    if lo is not None:
        d = d.where(F.col("e").isNull() | F.col("e").between(lo, hi))
    seen = d.where(F.col("e").isNotNull() & (F.col("e") != ref)).agg(F.array_sort(F.collect_set("e")).alias("a")).first().a
    from panelwright.functions.scalars import long_array

    return d.withColumn("_code", F.array_position(long_array(seen), F.col("e")) - 1), [int(v) for v in seen]


def event_study(df: DataFrame, unit: str, time: str, cohort: str, y: str, lo: int, hi: int, cluster: str | None = None, kind: str = "cluster", drop_reference_rows: bool = False) -> FeFit:
    """Leads and lags around -1. ``drop_reference_rows`` removes the rows at -1
    instead of making them the reference level."""
    d, levels = event_codes(df, time, cohort, -1, lo, hi)
    if drop_reference_rows:
        d = d.where(F.col("e").isNull() | (F.col("e") != -1))
    return fit_fe(d, unit, time, y, code="_code", code_names=levels, cluster=cluster, kind=kind)


def sun_abraham(df: DataFrame, unit: str, time: str, cohort: str, y: str, cluster: str | None = None, agg: str = "event") -> FeFit:
    """Cohort by event-time saturated regression, averaged with the cohorts'
    shares of the rows at each event time (or over all treated rows)."""
    d = df.withColumn("e", (F.col(time) - F.col(cohort)).cast("bigint"))
    seen = d.where("e is not null and e <> -1").groupBy(F.col(cohort).alias("g"), "e").agg(F.count("*").alias("n")).orderBy("g", "e").collect()
    pairs = [(r.g, r.e) for r in seen]
    lookup = df.sparkSession.createDataFrame([(i, g, e) for i, (g, e) in enumerate(pairs)], "_code INT, _g BIGINT, _e BIGINT")
    d = d.join(lookup, (F.col(cohort) == F.col("_g")) & (F.col("e") == F.col("_e")), "left")
    if agg == "att":
        names, groups = ["ATT"], [[i for i, (_, e) in enumerate(pairs) if e >= 0]]
    else:
        names = sorted({e for _, e in pairs})
        groups = [[i for i, (_, e) in enumerate(pairs) if e == x] for x in names]
    t = np.zeros((len(names), len(pairs)))
    for row, members in zip(t, groups):
        total = sum(seen[i].n for i in members)
        for i in members:
            row[i] = seen[i].n / total
    fit = fit_fe(d, unit, time, y, code="_code", code_names=pairs, cluster=cluster, transform=t)
    fit.names = names
    return fit


def static_effect(df: DataFrame, unit: str, time: str, y: str, x, cluster: str | None = None, kind: str = "cluster") -> FeFit:
    return fit_fe(df, unit, time, y, dense=[x], names=["effect"], cluster=cluster, kind=kind)


def unit_slope_difference(df: DataFrame, unit: str, y: str, time: str, group) -> DataFrame:
    """Differential linear trend: y on time and time x group with unit effects only,
    clustered by unit. Within-unit sums are one aggregate; the rest is 2 x 2."""
    g = df.withColumn("_g", col(group).cast("double")).groupBy(unit).agg(
        F.max("_g").alias("d"), F.regr_sxx(F.col(y), F.col(time)).alias("sxx"), F.regr_sxy(F.col(y), F.col(time)).alias("sxy"), F.regr_syy(F.col(y), F.col(time)).alias("syy"), F.count("*").alias("n"))
    s = lambda c, m: F.sum(F.when(F.col("d") == m, F.col(c)).otherwise(0.0))
    t = g.agg(s("sxx", 0).alias("x0"), s("sxy", 0).alias("y0"), s("sxx", 1).alias("x1"), s("sxy", 1).alias("y1"), F.sum("n").alias("n"), F.count("*").alias("units")).first()
    b0, b1 = t.y0 / t.x0, t.y1 / t.x1
    slope = F.when(F.col("d") == 1, b1).otherwise(b0)
    sc = F.col("sxy") - slope * F.col("sxx")
    sx = F.when(F.col("d") == 1, t.x1).otherwise(t.x0)
    v = g.agg(F.sum((sc / sx) * (sc / sx)).alias("v")).first().v
    # two slopes plus one constant not absorbed by the clusters
    adj = (t.n - 1) / (t.n - 3) * t.units / (t.units - 1)
    return df.sparkSession.createDataFrame([(b0, b1 - b0, float(np.sqrt(v * adj)), t.units)], "base_slope DOUBLE, difference DOUBLE, se DOUBLE, units BIGINT")


def imputation_att(df: DataFrame, unit: str, time: str, cohort: str, y: str) -> DataFrame:
    """Mean treated outcome minus the effects fitted on untreated rows, with the
    first stage in the error; ``imputation.imputation_effects`` has event times too."""
    from panelwright.operators.imputation import imputation_effects

    return imputation_effects(df, unit, time, cohort, y).where("e is null").drop("e")
