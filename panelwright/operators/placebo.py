"""Placebo treatments of the given panel: units drawn at random, or the true dates
shifted, many replicates in two passes.

A unit offers a few start dates (the cohorts' dates, or its own date shifted). What
one start contributes to the two-way regression is a vector over the periods and two
numbers; a replicate's sums are products of its assignments with these vectors, a
block of units at a time. Only sums per (replicate, period) move. The fits are exact
on unbalanced panels.

Which k of n units a replicate treats is an exact choice without a ranking: the k
smallest hashes are those up to a bound, and the bound is found by counting hashes in
bins and refining the bin that holds the k-th.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import two_sided_t
from panelwright.functions.scalars import MIX_MODULUS, draw31_numpy
from panelwright.operators.fe import fe_units, sum_arrays
from panelwright.session import keep

#: Units handled at once; a bin of the hash that holds more units than BIN is cut into BINS again.
BLOCK, BIN, BINS = 512, 2000, 2048
SHIFTS = tuple(range(-6, 7))


def _keys(units: DataFrame) -> DataFrame:
    """A whole number per unit to draw by: its value, or a hash of it."""
    whole = dict(units.dtypes)["unit"] in ("tinyint", "smallint", "int", "bigint")
    return units.withColumn("key", F.col("unit").cast("bigint") if whole else F.xxhash64("unit"))


def _draws(seed: int, reps: int, keys: np.ndarray) -> np.ndarray:
    """Draws (replicate x unit)."""
    return draw31_numpy(seed, np.arange(1, reps + 1)[:, None], np.mod(keys, MIX_MODULUS)[None, :])


def _key_blocks(batches):
    for f in batches:
        k = f["key"].to_numpy()
        for at in range(0, len(k), BLOCK):
            yield k[at : at + BLOCK]


def smallest_bounds(units: DataFrame, k: int, reps: int, seed: int) -> np.ndarray:
    """Per replicate the (hash, key) of the k-th smallest unit; ``units`` has a column key, distinct per unit."""
    ids = units.select("key")
    low, width, need = np.zeros(reps, np.int64), MIX_MODULUS, np.full(reps, k, np.int64)
    while True:
        step = -(-width // BINS)

        def part(batches, low=low, width=width, step=step):
            total = np.zeros((reps, BINS))
            for keys in _key_blocks(batches):
                h = _draws(seed, reps, keys) - low[:, None]
                r, u = np.nonzero((h >= 0) & (h < width))
                total += np.bincount(r * BINS + h[r, u] // step, minlength=reps * BINS).reshape(reps, BINS)
            yield pd.DataFrame({"r": np.arange(reps), "v": list(total)})

        most = 0
        new_low, new_need = low.copy(), need.copy()
        for row in sum_arrays(ids.mapInPandas(part, "r int, v array<double>"), "r").toLocalIterator():
            c = np.cumsum(row.v)
            b = int(np.searchsorted(c, need[row.r]))
            new_low[row.r] = low[row.r] + b * step
            new_need[row.r] = need[row.r] - (int(c[b - 1]) if b else 0)
            most = max(most, int(row.v[b]))
        low, need, width = new_low, new_need, step
        if most <= BIN or width == 1:
            break

    def inside(batches):
        for keys in _key_blocks(batches):
            h = _draws(seed, reps, keys)
            r, u = np.nonzero((h >= low[:, None]) & (h < low[:, None] + width))
            yield pd.DataFrame({"r": r.astype(np.int32), "h": h[r, u], "key": keys[u]})

    out = np.zeros((reps, 2), np.int64)
    got = ids.mapInPandas(inside, "r int, h bigint, key bigint").toPandas()  # about BIN rows per replicate at most
    got = got.sort_values(["r", "h", "key"])
    for r, g in got.groupby("r"):
        out[r] = g[["h", "key"]].to_numpy()[need[r] - 1]
    return out


def placebo_schedule(units: DataFrame, cohorts: list[int], n_treated: int, reps: int, seed: int, unit: str = "unit") -> DataFrame:
    """Random treated units and cohorts per replicate: (rep, unit, g_placebo), units by the smallest hashes of a replicate, cohorts
    by another hash."""
    d = keep(_keys(units.select(F.col(unit).alias("unit"))))
    bounds = smallest_bounds(d, n_treated, reps, seed)
    starts = np.array(cohorts, np.int64)

    def run(batches):
        for f in batches:
            for at in range(0, len(f), BLOCK):
                g = f.iloc[at : at + BLOCK]
                pick = chosen(g["key"].to_numpy(), bounds, seed, len(starts))
                start = pd.array(starts[np.maximum(pick, 0)].ravel(), dtype="Int64")
                start[(pick < 0).ravel()] = pd.NA
                yield pd.DataFrame({"rep": np.repeat(np.arange(1, reps + 1), len(g)), unit: np.tile(g["unit"].to_numpy(), reps), "g_placebo": start})

    return d.mapInPandas(run, f"rep int, {unit} {dict(d.dtypes)['unit']}, g_placebo bigint")


def chosen(keys: np.ndarray, bounds: np.ndarray, seed: int, options: int) -> np.ndarray:
    """Option of each (replicate, unit), -1 for untreated."""
    h = _draws(seed, len(bounds), keys)
    on = (h < bounds[:, :1]) | ((h == bounds[:, :1]) & (keys[None, :] <= bounds[:, 1:]))
    return np.where(on, _draws(seed + 1, len(bounds), keys) % options, -1)


def placebo_fits(df: DataFrame, unit: str, time: str, cohort: str, y: str, kind: str = "units", reps: int = 200, seed: int = 50, cohorts: list[int] | None = None,
                 n_treated: int | None = None, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """Static two-way effect of a placebo treatment per replicate: rep, att, se (clustered by unit), t, p, rejected (p < 0.05).

    ``kind`` units: ``n_treated`` units (default: as many as are ever treated) get one of ``cohorts`` (default: those of the
    panel). ``kind`` dates: every treated unit's date moves by one of ``shifts``, drawn among those that leave it with periods
    before and after inside the panel's window; a unit without such a shift stays untreated."""
    spark = df.sparkSession
    units, periods = fe_units(df, unit, time, y, cluster=cohort)  # the group is a unit's (smallest) cohort
    units = keep(_keys(units.withColumnRenamed("cluster", "g")))
    ax, n = np.array(periods, np.int64), len(periods)
    seen = units.where(F.col("g").isNotNull()).agg(F.count("*").alias("k"), F.array_sort(F.collect_set("g")).alias("g")).first()
    starts = np.array(cohorts if cohorts is not None else seen.g, np.int64)
    bounds = smallest_bounds(units, n_treated if n_treated is not None else seen.k, reps, seed) if kind == "units" else None
    moves = np.array(shifts, np.int64)

    def gram(batches):
        a = np.zeros((n, n + 3))
        for f in batches:
            for t, yy in zip(f["t"], f["y"]):
                at, v = np.searchsorted(ax, t), np.asarray(yy, float)
                a[at, at] += 1
                a[np.ix_(at, at)] -= 1 / len(at)
                a[at, n] += v - v.mean()
                a[0, n + 1] += len(at)
                a[0, n + 2] += 1
        yield pd.DataFrame({"k": np.arange(n), "v": list(a)})

    a = np.zeros((n, n + 3))
    for r in sum_arrays(units.mapInPandas(gram, "k int, v array<double>"), "k").collect():
        a[r.k] = r.v
    inv = np.linalg.pinv(a[:, :n], rcond=1e-11, hermitian=True)
    lam, rows, n_units = inv @ a[:, n], a[0, n + 1], a[0, n + 2]
    rank = int(np.linalg.matrix_rank(a[:, :n], tol=1e-9 * max(np.max(np.abs(np.diag(a[:, :n]))), 1e-300)))

    def blocks(batches):
        """Per block: presence (unit x period), outcome residuals, per option the demeaned regressor, and the options drawn."""
        for f in batches:
            for at in range(0, len(f), BLOCK):
                g = f.iloc[at : at + BLOCK]
                m = len(g)
                here, out = np.zeros((m, n)), np.zeros((m, n))
                for k, (t, yy) in enumerate(zip(g["t"], g["y"])):
                    j = np.searchsorted(ax, t)
                    here[k, j] = 1
                    v = np.asarray(yy, float) - lam[j]
                    out[k, j] = v - v.mean()
                keys, size = g["key"].to_numpy(), here.sum(axis=1, keepdims=True)
                if kind == "units":
                    begin = np.tile(starts, (m, 1))
                    pick = chosen(keys, bounds, seed, len(starts))
                else:
                    own = g["g"].to_numpy(dtype=float)
                    begin = own[:, None] + moves[None, :]
                    ok = (begin > ax[0]) & (begin <= ax[-1])
                    order = np.argsort(~ok, axis=1, kind="stable")  # valid shifts first, in order
                    valid = ok.sum(axis=1)
                    pick = np.take_along_axis(order, (_draws(seed, reps, keys) % np.maximum(valid, 1)).T, axis=1).T
                    pick[:, valid == 0] = -1
                x = (ax[None, None, :] >= begin[:, :, None]) * here[:, None, :]
                x = (x - x.sum(axis=2, keepdims=True) / size[:, None, :]) * here[:, None, :]
                yield here, out, x, pick, size[:, 0]

    def first(batches):
        """Per replicate: <x, y>, <x, x>, x summed per period."""
        total = np.zeros((reps, 2 + n))
        for _here, out, x, pick, _size in blocks(batches):
            for o in range(x.shape[1]):
                on = (pick == o).astype(float)
                total[:, 0] += on @ (x[:, o] * out).sum(axis=1)
                total[:, 1] += on @ np.square(x[:, o]).sum(axis=1)
                total[:, 2:] += on @ x[:, o]
        yield pd.DataFrame({"r": np.arange(reps), "v": list(total)})

    total = np.zeros((reps, 2 + n))
    for r in sum_arrays(units.mapInPandas(first, "r int, v array<double>"), "r").collect():
        total[r.r] = r.v
    gamma = total[:, 2:] @ inv
    xx = total[:, 1] - (total[:, 2:] * gamma).sum(axis=1)
    with np.errstate(all="ignore"):
        beta = np.where(xx > 1e-9, total[:, 0] / xx, np.nan)

    def second(batches):
        """Sum of squared unit scores per replicate."""
        out_ = np.zeros(reps)
        for here, out, x, pick, size in blocks(batches):
            xy = -gamma @ out.T
            sq = np.square(gamma) @ here.T - np.square(gamma @ here.T) / size
            for o in range(x.shape[1]):
                on = pick == o
                xy += on * (x[:, o] * out).sum(axis=1)
                sq += on * (np.square(x[:, o]).sum(axis=1) - 2 * gamma @ x[:, o].T)
            out_ += np.square(xy - beta[:, None] * sq).sum(axis=1)
        yield pd.DataFrame({"k": [0], "v": [out_]})

    squares = np.array(sum_arrays(units.mapInPandas(second, "k int, v array<double>"), "k").first().v)
    units.unpersist()
    factor = (rows - 1) / (rows - rank - 2) * n_units / (n_units - 1)
    out = []
    for r in range(reps):
        if not np.isfinite(beta[r]):
            out.append((r + 1, None, None, None, None, None))
            continue
        se = float(np.sqrt(squares[r] * factor) / xx[r])
        t = float(beta[r]) / se if se > 0 else None
        p = float(two_sided_t(t, n_units - 1)) if t is not None else None
        out.append((r + 1, float(beta[r]), se, t, p, None if p is None else p < 0.05))
    return spark.createDataFrame(out, "rep BIGINT, att DOUBLE, se DOUBLE, t DOUBLE, p DOUBLE, rejected BOOLEAN")


def rejection_share(fits: DataFrame) -> DataFrame:
    """Replicates with an estimate, and the share of them that reject."""
    return fits.agg(F.count("*").alias("replicates"), F.count("p").alias("estimated"), F.avg(F.col("rejected").cast("double")).alias("rejected"))


def threshold_ladder(df: DataFrame, unit: str, time: str, y: str, x: str, level: str, thresholds: list[float]) -> DataFrame:
    """Static effect and cluster error on the units whose ``level`` reaches each threshold, all nested samples in two passes:
    threshold, att, se, units, n.

    A unit adds its products to the highest threshold it passes; cumulated from the top they are the normal equations of every
    sample. A second pass adds each unit's squared score under every threshold it passes."""
    from panelwright.operators.fe import _blocks

    ladder = np.array(sorted(thresholds), float)
    units, periods = fe_units(df, unit, time, y, dense=[x, level])
    units = units.withColumns({"level": F.element_at("d", 1)[1], "d": F.transform("d", lambda v: F.slice(v, 1, 1))})
    units = keep(units.where(F.col("level") >= float(ladder[0])))
    ax, m = np.array(periods), len(ladder)
    width = len(ax)

    def rung(g: pd.DataFrame) -> np.ndarray:
        return np.searchsorted(ladder, g["level"].to_numpy(float), side="right") - 1

    def sums(batches):
        total = np.zeros((m, width * (width + 1) + 2))
        for z, yy, u, g, _ in _blocks(batches, ax, 1, 0):
            of = rung(g)
            for j in np.unique(of):
                hit = of[u] == j
                zz, v = z[hit], yy[hit]
                total[j] += np.concatenate([(zz.T @ zz).ravel(), zz.T @ v, [len(v), (of == j).sum()]])
        yield pd.DataFrame({"j": np.arange(m), "v": list(total)})

    total = np.zeros((m, width * (width + 1) + 2))
    for r in sum_arrays(units.mapInPandas(sums, "j int, v array<double>"), "j").collect():
        total[r.j] = r.v
    total = np.cumsum(total[::-1], axis=0)[::-1]
    theta, lift, rank, known = np.zeros((m, width)), np.zeros((m, width)), np.zeros(m), np.zeros(m, bool)
    for j in range(m):
        a = total[j, : width * width].reshape(width, width)
        inv = np.linalg.pinv(a, rcond=1e-11, hermitian=True)
        theta[j], lift[j] = inv @ total[j, width * width : -2], inv[0]
        known[j] = a[0, 0] > 0 and abs(inv[0] @ a[:, 0] - 1) < 1e-6
        rank[j] = np.linalg.matrix_rank(a, tol=1e-9 * np.max(np.abs(np.diag(a)))) if a.any() else 0

    def scores(batches):
        out = np.zeros(m)
        for z, yy, u, g, _ in _blocks(batches, ax, 1, 0):
            s = np.zeros((len(g), m))
            np.add.at(s, u, (z @ lift.T) * (yy[:, None] - z @ theta.T))
            out += (np.square(s) * (np.arange(m)[None, :] <= rung(g)[:, None])).sum(axis=0)
        yield pd.DataFrame({"k": [0], "v": [out]})

    got = sum_arrays(units.mapInPandas(scores, "k int, v array<double>"), "k").collect()
    squares = np.array(got[0].v) if got else np.zeros(m)
    units.unpersist()
    rows = []
    for j in range(m):
        n, k = total[j, -2:]
        fits = known[j] and n > rank[j] + 1 and k > 1
        se = float(np.sqrt(squares[j] * (n - 1) / (n - rank[j] - 1) * k / (k - 1))) if fits else None
        rows.append((float(ladder[j]), float(theta[j, 0]) if known[j] else None, se, int(k), int(n)))
    return df.sparkSession.createDataFrame(rows, "threshold DOUBLE, att DOUBLE, se DOUBLE, units BIGINT, n BIGINT")
