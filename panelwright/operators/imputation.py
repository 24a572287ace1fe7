"""Imputation effects: treated outcomes minus unit and period effects fitted on
untreated rows, with the first stage in the error.

An effect is linear in the outcomes: treated rows weigh 1/N, and carrying these
weights back through the two-way fit gives every untreated row a weight too. With
unit effects removed inside units the fit is one system in the periods: it is
solved once for the outcomes and once for all effects' weights, and units
back-substitute on their own. Errors sum (weight x residual) over a cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.fe import fe_units, period_components, sum_arrays
from panelwright.session import keep


def _treated(time: str, cohort: str):
    return F.coalesce(F.col(time) >= F.col(cohort), F.lit(False))


class _Stage:
    """What the passes over units share: periods, their connected parts, period effects."""

    def __init__(self, periods: np.ndarray, part: np.ndarray, effects: np.ndarray):
        self.periods, self.part, self.effects = periods, part, effects

    def units(self, batches):
        """Per unit: frame row, untreated periods and residuals, treated periods, event times and effects."""
        for f in batches:
            for row in f.itertuples(index=False):
                t = np.searchsorted(self.periods, row.t)
                y, on = np.asarray(row.y, float), np.asarray(row.c) == 1
                free = t[~on]
                if len(free):
                    level = np.mean(y[~on] - self.effects[free])
                    # a treated row counts if its period is tied to the unit's untreated ones
                    ok = self.part[t[on]] == self.part[free[0]]
                    e = np.array([d[0] for d in np.asarray(row.d, object)[on]], np.int64) if on.any() else np.empty(0, np.int64)
                    yield row, free, y[~on] - level - self.effects[free], t[on][ok], e[ok], (y[on] - level - self.effects[t[on]])[ok]
                else:
                    none = np.empty(0, np.int64)
                    yield row, free, np.empty(0), none, none, np.empty(0)


def _prepare(df: DataFrame, unit: str, time: str, cohort: str, y: str, cluster: str | None):
    on = _treated(time, cohort)
    units, periods = fe_units(df, unit, time, y, [F.coalesce(F.col(time) - F.col(cohort), F.lit(0))], on.cast("int"), cluster)
    ax, n = np.array(periods, np.int64), len(periods)
    found = period_components(df.where(~on & F.col(y).isNotNull()), unit, time)
    part = np.array([found.get(int(t), -1) for t in periods])

    def gram(batches):
        a, b = np.zeros((n, n)), np.zeros(n)
        for f in batches:
            for t, yy, c in zip(f["t"], f["y"], f["c"]):
                free = np.asarray(c) == 0
                at, v = np.searchsorted(ax, np.asarray(t)[free]), np.asarray(yy, float)[free]
                if len(at):
                    a[at, at] += 1
                    a[np.ix_(at, at)] -= 1 / len(at)
                    b[at] += v - v.mean()
        yield pd.DataFrame({"k": np.arange(n), "v": [np.append(r, x) for r, x in zip(a, b)]})

    rows = np.zeros((n, n + 1))
    for r in sum_arrays(units.mapInPandas(gram, "k int, v array<double>"), "k").collect():
        rows[r.k] = r.v
    inv = np.linalg.pinv(rows[:, :n], rcond=1e-11, hermitian=True) if n else np.zeros((0, 0))
    return units, _Stage(ax, part, inv @ rows[:, n]), inv


def _carried(units: DataFrame, stage: _Stage, inv: np.ndarray):
    """Cells (cohort's unit-level sums are not needed): per event time the number of treated rows and the period weights of
    the untreated rows, and the mean effect per (cohort, event time)."""
    n = len(stage.periods)

    def sums(batches):
        back: dict[int, np.ndarray] = {}
        cells: dict[tuple[int, int], list[float]] = {}
        for _row, free, _res, t, e, tau in stage.units(batches):
            for tt, ee, x in zip(t, e, tau):
                v = back.setdefault(int(ee), np.zeros(n + 1))
                v[tt] += 1
                v[free] -= 1 / len(free)
                v[n] += 1
                c = cells.setdefault((int(ee), int(stage.periods[tt] - ee)), [0.0, 0.0])
                c[0] += 1
                c[1] += x
        if back:
            yield pd.DataFrame({"k": [f"e{e}" for e in back] + [f"c{e},{g}" for e, g in cells], "v": [*back.values(), *map(np.array, cells.values())]})

    got = {r.k: np.array(r.v) for r in sum_arrays(units.mapInPandas(sums, "k string, v array<double>"), "k").collect()}
    events = sorted(int(k[1:]) for k in got if k[0] == "e")
    back = np.array([got[f"e{e}"] for e in events]).reshape(len(events), n + 1)
    cells = {tuple(map(int, k[1:].split(","))): v for k, v in got.items() if k[0] == "c"}
    # the last effect is that of all treated rows
    counts = np.append(back[:, n], back[:, n].sum())
    q = np.vstack([back[:, :n], back[:, :n].sum(axis=0)])
    weights = inv @ (q / np.where(counts > 0, counts, 1)[:, None]).T
    return events, counts, weights, cells


def imputation_effects(df: DataFrame, unit: str, time: str, cohort: str, y: str, cluster: str | None = None) -> DataFrame:
    """Per event time e, and for all treated rows (e null): att, se, se_cells, n_treated_rows, units.

    ``se`` takes treated residuals around the effect itself (the two-stage moment error), ``se_cells`` around the mean of their
    cohort and event time. Treated rows whose unit has no untreated row, or whose period is not tied to the unit's untreated
    periods, have no imputed outcome and are left out."""
    spark = df.sparkSession
    units, stage, inv = _prepare(df, unit, time, cohort, y, cluster)
    events, counts, weights, cells = _carried(units, stage, inv)
    place = {e: k for k, e in enumerate(events)}
    m = len(events) + 1
    sums = np.zeros(m)
    for (e, _), (_, s) in cells.items():
        sums[place[e]] += s
        sums[-1] += s
    att = sums / np.where(counts > 0, counts, 1)
    means = {k: s / c for k, (c, s) in cells.items()}

    def scores(batches):
        by: dict = {}
        for row, free, res, t, e, tau in stage.units(batches):
            v = np.zeros((3, m))
            if len(free):
                v[:2] = -(res @ weights[free])
            for tt, ee, x in zip(t, e, tau):
                k = place[int(ee)]
                cell = x - means[int(ee), int(stage.periods[tt] - ee)]
                v[0, k] += (x - att[k]) / counts[k]
                v[0, -1] += (x - att[-1]) / counts[-1]
                v[1, k] += cell / counts[k]
                v[1, -1] += cell / counts[-1]
                v[2, k] = v[2, -1] = 1
            key = row.cluster
            by[key] = by[key] + v if key in by else v
            if cluster is None and len(by) >= 2000:
                yield pd.DataFrame({"key": list(by), "v": [x.ravel() for x in by.values()]})
                by = {}
        if by:
            yield pd.DataFrame({"key": list(by), "v": [x.ravel() for x in by.values()]})

    key_type = dict(units.dtypes)["cluster"]
    parts = units.mapInPandas(scores, f"key {key_type}, v array<double>")
    parts = parts if cluster is None else sum_arrays(parts, "key")

    def squares(batches):
        total = np.zeros(3 * m)
        for f in batches:
            for v in f["v"]:
                total[: 2 * m] += np.square(v[: 2 * m])
                total[2 * m :] += v[2 * m :]
        yield pd.DataFrame({"k": [0], "v": [total]})

    got = sum_arrays(parts.mapInPandas(squares, "k int, v array<double>"), "k").collect()
    total = np.array(got[0].v).reshape(3, m) if got else np.zeros((3, m))
    units.unpersist()
    rows = [(e, float(att[k]), float(np.sqrt(total[0, k])), float(np.sqrt(total[1, k])), int(counts[k]), int(total[2, k])) for k, e in enumerate([*events, None]) if counts[k] > 0]
    return spark.createDataFrame(rows, "e BIGINT, att DOUBLE, se DOUBLE, se_cells DOUBLE, n_treated_rows BIGINT, units BIGINT")


def imputation_weights(df: DataFrame, unit: str, time: str, cohort: str, y: str) -> DataFrame:
    """unit, t, treated, weight: the overall effect is the sum of weight x outcome over all rows."""
    units, stage, inv = _prepare(df, unit, time, cohort, y, None)
    _, counts, weights, _ = _carried(units, stage, inv)
    n, m = counts[-1], weights[:, -1]

    def spread(batches):
        for row, free, _res, t, _e, _tau in stage.units(batches):
            at = np.searchsorted(stage.periods, row.t)
            on = np.asarray(row.c) == 1
            w = np.zeros(len(at))
            w[on] = np.isin(at[on], t) / n if n else 0
            if len(free):
                w[~on] = -((len(t) / n if n else 0) - m[free].sum()) / len(free) - m[at[~on]]
            yield pd.DataFrame({"unit": row.unit, "t": row.t, "treated": on, "weight": w})

    return keep(units).mapInPandas(spread, f"unit {dict(units.dtypes)['unit']}, t bigint, treated boolean, weight double")
