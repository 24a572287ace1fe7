"""Leave-one-out influence of units on two-way effects, on balanced or unbalanced panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import pf_upper
from panelwright.operators.fe import Normal, _blocks, event_codes, fe_units, normal_equations, sum_arrays
from panelwright.session import keep


# Dropping unit i takes its own products out of the normal equations A theta = b. With its demeaned rows Z and residuals e,
#     theta(-i) = theta - A^-1 Z' (I - H)^-1 e,   A(-i)^-1 = A^-1 + A^-1 Z' (I - H)^-1 Z A^-1,   H = Z A^-1 Z',
# so a unit needs its own rows and the inverse of the totals; no fit is repeated. Where I - H is singular, the unit alone
# identifies something, and the smaller system is solved by its pseudo-inverse.


class _Without:
    """Solutions of the normal equations without some rows."""

    def __init__(self, eq: Normal):
        self.a, self.b, self.inv, self.theta, self.rank = eq.a, eq.b, eq.inv, eq.theta, eq.rank

    def solve(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """theta, inverse, rank and which coefficients are identified, without the demeaned rows (z, y)."""
        half = z @ self.inv
        gap = np.eye(len(z)) - half @ z.T
        if not len(z) or (len(z) <= len(self.b) and np.linalg.eigvalsh(gap)[0] > 1e-8):
            back = np.linalg.solve(gap, half)
            theta = self.theta - back.T @ (y - z @ self.theta)
            return theta, self.inv + half.T @ back, self.rank, np.ones(len(self.b), bool)
        a = self.a - z.T @ z
        inv = np.linalg.pinv(a, rcond=1e-10, hermitian=True)
        known = np.abs(np.einsum("ij,ji->i", inv, a) - 1) < 1e-6
        rank = int(np.linalg.matrix_rank(a, tol=1e-9 * np.max(np.abs(np.diag(a))))) if a.any() else 0
        return inv @ (self.b - z.T @ y), inv, rank, known


    def each(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For units with as many rows each: theta, first row of the inverse, rank, and whether the first coefficient is
        identified, without the rows of each."""
        units, size, width = z.shape
        half = z @ self.inv
        gap = np.eye(size) - half @ z.transpose(0, 2, 1)
        fine = np.linalg.eigvalsh(gap)[:, 0] > 1e-8 if size <= width else np.zeros(units, bool)
        theta, first, rank, known = np.zeros((units, width)), np.zeros((units, width)), np.full(units, self.rank), np.ones(units, bool)
        right = np.stack([y - z @ self.theta, half[:, :, 0]], axis=2)[fine]
        back = half[fine].transpose(0, 2, 1) @ np.linalg.solve(gap[fine], right)
        theta[fine], first[fine] = self.theta - back[:, :, 0], self.inv[0] + back[:, :, 1]
        for k in np.flatnonzero(~fine):
            theta[k], inv, rank[k], ok = self.solve(z[k], y[k])
            first[k], known[k] = inv[0], ok[0]
        return theta, first, rank, known


class _Features:
    """A unit's cluster score without others, c'Z'(y - Z theta), is a product of what depends on the unit alone (its products
    <x, y>, <x, x>, x and y per period, and its pattern of periods) with what depends on (c, theta) alone. One Gram matrix of
    the units' features therefore gives the sum of squared scores for any dropped unit.

    The pattern enters as the matrix diag(p) - pp'/n: as one feature per pattern while these are fewer than its entries, else as
    the entries."""

    def __init__(self, units: DataFrame, periods: np.ndarray):
        n = len(periods)
        self.periods, self.n = periods, n
        self.most = n * (n + 1) // 2
        seen = units.select(F.sort_array("t").alias("t")).distinct().limit(self.most + 1).collect()
        self.patterns = {tuple(r.t): k for k, r in enumerate(seen)} if len(seen) <= self.most else None
        self.seen = np.array([np.isin(periods, t) for t in self.patterns], float).reshape(-1, n) if self.patterns is not None else None
        self.upper = np.triu_indices(n)
        self.width = 2 + 2 * n + (len(self.patterns) if self.patterns is not None else self.most)

    def of(self, at: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Features of units with as many rows each: positions of their periods, demeaned rows."""
        units, size = at.shape
        v, u, x = np.zeros((units, self.width)), np.arange(units)[:, None], z[:, :, 0]
        v[:, 0], v[:, 1] = (x * y).sum(axis=1), (x * x).sum(axis=1)
        v[u, 2 + at], v[u, 2 + self.n + at] = x, y
        if self.patterns is not None:
            v[u[:, 0], [2 + 2 * self.n + self.patterns[tuple(t)] for t in self.periods[np.sort(at, axis=1)].tolist()]] = 1
        else:
            p = np.zeros((units, self.n))
            p[u, at] = 1
            i, j = self.upper
            v[:, 2 + 2 * self.n :] = p[:, i] * ((i == j) - p[:, j] / size)
        return v

    def weights(self, c: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """What units' features are multiplied with; rows of c and theta: the regressor, then the periods but the first."""
        cd, lam = c.copy(), theta.copy()
        cd[:, 0] = lam[:, 0] = 0.0  # of the first period
        v = np.zeros((len(c), self.width))
        v[:, 0], v[:, 1] = c[:, 0], -c[:, 0] * theta[:, 0]
        v[:, 2 : 2 + self.n] = -c[:, :1] * lam - theta[:, :1] * cd
        v[:, 2 + self.n : 2 + 2 * self.n] = cd
        if self.patterns is not None:
            v[:, 2 + 2 * self.n :] = (cd @ self.seen.T) * (lam @ self.seen.T) / self.seen.sum(axis=1) - (cd * lam) @ self.seen.T
        else:
            i, j = self.upper
            v[:, 2 + 2 * self.n :] = -(cd[:, i] * lam[:, j] + (i != j) * cd[:, j] * lam[:, i])
        return v

    def gram(self, units: DataFrame) -> np.ndarray:
        def part(batches):
            total = np.zeros((self.width, self.width))
            for _g, _k, at, z, y in like_units(batches, self.periods, self.width):
                v = self.of(at, z, y)
                total += v.T @ v
            yield pd.DataFrame({"k": np.arange(self.width), "v": list(total)})

        out = np.zeros((self.width, self.width))
        for r in sum_arrays(units.mapInPandas(part, "k int, v array<double>"), "k").toLocalIterator():
            out[r.k] = r.v
        return out


#: Numbers in one array of a block of units with as many rows each.
LIKE_NUMBERS = 1_000_000


def like_units(frames, periods: np.ndarray, width: int):
    """Units with as many rows each, side by side: frame, positions in it, positions of the periods, demeaned regressors (x, then
    the periods but the first) and outcomes. A block has at most LIKE_NUMBERS numbers in these and in ``width`` numbers a unit."""
    for z, y, u, g, t in _blocks(frames, periods, 1, 0):
        n = np.bincount(u, minlength=len(g))
        first = np.cumsum(n) - n
        for size in np.unique(n):
            same = np.flatnonzero(n == size)
            step = max(1, LIKE_NUMBERS // max(width, size * z.shape[1]))
            for lo in range(0, len(same), step):
                k = same[lo : lo + step]
                rows = first[k][:, None] + np.arange(size)
                yield g, k, t[rows], z[rows], y[rows]


def _share(n: float, rank: int, units: int) -> float:
    """Small-sample factor of a cluster error; unit effects nested in the clusters do not count."""
    return (n - 1) / (n - rank - 1) * units / (units - 1) if n > rank + 1 and units > 1 else float("nan")


def leave_one_out(df: DataFrame, unit: str, time: str, y: str, x: str) -> DataFrame:
    """Static effect without each unit, on any panel: unit, n_obs, n_remaining, att_loo, se_loo (clustered by unit), att_full,
    influence, pct_change (influence in percent of the full effect). Null where the rest does not identify the effect."""
    units, periods = fe_units(df, unit, time, y, dense=[x])
    ax = np.array(periods)
    eq = normal_equations(units, periods, 1, 0)
    without, features = _Without(eq), _Features(units, ax)
    total = features.gram(units)
    full, n, n_units = float(eq.theta[0]), eq.n, eq.n_units

    def run(batches):
        for g, k, at, z, yy in like_units(batches, ax, features.width):
            theta, first, rank, known = without.each(z, yy)
            w = features.weights(first, theta)
            meat = np.maximum(((w @ total) * w).sum(axis=1) - np.square((features.of(at, z, yy) * w).sum(axis=1)), 0.0)
            size = z.shape[1]
            share = {r: _share(n - size, r, n_units - 1) for r in set(rank.tolist())}
            se = np.sqrt(meat * [share[r] for r in rank.tolist()])
            found = lambda v: pd.Series(v).astype(object).where(known, None)
            yield pd.DataFrame({"unit": g["unit"].iloc[k].to_numpy(), "n_obs": size, "att_loo": found(theta[:, 0]), "se_loo": found(se)})

    r = units.mapInPandas(run, f"unit {dict(units.dtypes)['unit']}, n_obs bigint, att_loo double, se_loo double")
    r = r.withColumns({"n_remaining": F.lit(n_units - 1).cast("bigint"), "att_full": F.lit(full)})
    return r.withColumns({"influence": F.col("att_full") - F.col("att_loo"), "pct_change": 100 * (F.col("att_full") - F.col("att_loo")) / F.abs("att_full")})


def leave_one_out_saturated(df: DataFrame, unit: str, time: str, cohort: str, y: str, average: str = "events") -> DataFrame:
    """Average treated effect of the cohort-by-event saturated regression without each unit, on any panel: unit, treated,
    att_loo, att_full, influence.

    ``average``: events (mean of the event-time coefficients from 0 on, each averaged over cohorts by row shares) or rows (mean
    over treated rows). Shares are those of the rows left."""
    d = df.withColumn("e", (F.col(time) - F.col(cohort)).cast("bigint"))
    seen = d.where(F.col("e").isNotNull() & (F.col("e") != -1) & F.col(y).isNotNull()).groupBy(F.col(cohort).alias("g"), "e").agg(F.count("*").alias("n")).orderBy("g", "e").collect()
    pairs = df.sparkSession.createDataFrame([(i, r.g, r.e) for i, r in enumerate(seen)], "_code INT, _g BIGINT, _e BIGINT")
    d = d.join(F.broadcast(pairs), (F.col(cohort) == F.col("_g")) & (F.col("e") == F.col("_e")), "left")
    units, periods = fe_units(d.withColumn("_tr", F.col(cohort).isNotNull().cast("double")), unit, time, y, ["_tr"], "_code")
    units = units.withColumns({"treated": F.exists("d", lambda v: v[0] > 0), "d": F.transform("d", lambda v: F.array().cast("array<double>"))})
    ax, cells = np.array(periods), len(seen)
    without = _Without(normal_equations(units, periods, 0, cells))
    events = np.array([r.e for r in seen])
    rows = np.array([r.n for r in seen], float)

    def mean(theta: np.ndarray, n: np.ndarray, known: np.ndarray) -> float | None:
        post = (events >= 0) & (n > 0) & known[:cells]
        if not post.any():
            return None
        if average == "rows":
            return float(n[post] @ theta[:cells][post] / n[post].sum())
        return float(np.mean([n[post & (events == e)] @ theta[:cells][post & (events == e)] / n[post & (events == e)].sum() for e in np.unique(events[post])]))

    full = mean(without.theta, rows, np.ones(len(without.b), bool))

    def run(batches):
        for f in batches:
            out = []
            for k in range(len(f)):
                for z, yy, _u, g, _t in _blocks([f.iloc[k : k + 1]], ax, 0, cells):
                    theta, _inv, _rank, known = without.solve(z, yy)
                    own = np.asarray(g["c"].iloc[0])
                    out.append(mean(theta, rows - np.bincount(own[own >= 0], minlength=cells), known))
            yield pd.DataFrame({"unit": f["unit"], "treated": f["treated"], "att_loo": out})

    r = units.mapInPandas(run, f"unit {dict(units.dtypes)['unit']}, treated boolean, att_loo double")
    return r.withColumn("att_full", F.lit(full)).withColumn("influence", F.col("att_full") - F.col("att_loo"))


def cumulative_drop(df: DataFrame, unit: str, time: str, y: str, x: str, loo: DataFrame, cohort: str = "g", most: int = 10, min_treated: int = 2, min_units: int = 5) -> list[tuple]:
    """(n_dropped, dropped, att, se, units, n) after dropping the ``most`` most influential units of ``loo`` one after another,
    until fewer than ``min_treated`` treated or ``min_units`` units are left.

    Only these units' rows reach the driver; each step takes one more block out of the totals."""
    ranked = [r.unit for r in loo.where("influence is not null").orderBy(F.desc(F.abs("influence")), "unit").limit(most).collect()]
    units, periods = fe_units(df.withColumn("_tr", F.col(cohort).isNotNull().cast("double")), unit, time, y, dense=[x, "_tr"])
    units = units.withColumns({"treated": F.exists("d", lambda v: v[1] > 0), "d": F.transform("d", lambda v: F.slice(v, 1, 1))})
    ax = np.array(periods)
    eq = normal_equations(units, periods, 1, 0)
    without, features = _Without(eq), _Features(units, ax)
    total = features.gram(units)
    treated = units.where("treated").count()
    own = {f["unit"].iloc[0]: (f, bool(f["treated"].iloc[0])) for r in units.where(F.col("unit").isin(ranked)).collect() for f in [pd.DataFrame([r.asDict(recursive=True)])]}
    out, gone, n = [], [], eq.n
    for k in range(len(ranked) + 1):
        if k:
            f, was_treated = own[ranked[k - 1]]
            gone += [b[2:] for b in like_units([f], ax, features.width)]
            treated -= was_treated
            n -= len(f["t"].iloc[0])
            if treated < min_treated or eq.n_units - k < min_units:
                break
        z = np.vstack([g[1][0] for g in gone]) if gone else np.zeros((0, len(eq.b)))
        theta, inv, rank, known = without.solve(z, np.concatenate([g[2][0] for g in gone]) if gone else np.zeros(0))
        if known[0]:
            w = features.weights(inv[:1], theta[None])[0]
            meat = max(w @ total @ w - sum((features.of(*g)[0] @ w) ** 2 for g in gone), 0.0)
            out.append((k, ",".join(map(str, ranked[:k])), float(theta[0]), float(np.sqrt(meat * _share(n, rank, eq.n_units - k))), int(eq.n_units - k), int(n)))
    units.unpersist()
    return out


#: Bytes of solutions without a unit that go to all tasks at once.
BROADCAST_BYTES = 16_000_000


def loo_lead_test(df: DataFrame, unit: str, time: str, cohort: str, y: str, lo: int, hi: int) -> DataFrame:
    """Joint F test of the leads (before -1) of the event study without each treated unit, clustered by unit: dropped, f, df1,
    p, att (mean of the coefficients from 0 on).

    One pass gives the coefficients and weights without every treated unit. Their errors need the residuals of all other
    units, so these solutions go to the units in blocks of at most BROADCAST_BYTES, one pass a block."""
    spark = df.sparkSession
    coded, levels = event_codes(df, time, cohort, -1, lo, hi)
    units, periods = fe_units(coded.withColumn("_tr", F.col(cohort).isNotNull().cast("double")), unit, time, y, ["_tr"], "_code")
    units = keep(units.withColumns({"treated": F.exists("d", lambda v: v[0] > 0), "d": F.transform("d", lambda v: F.array().cast("array<double>"))}))
    ax, nc = np.array(periods), len(levels)
    eq = normal_equations(units, periods, 0, nc)
    without, width = _Without(eq), len(eq.b)
    leads = np.flatnonzero(np.array(levels) < -1)
    after = np.flatnonzero(np.array(levels) >= 0)
    q = len(leads)
    kind = dict(units.dtypes)["unit"]

    def solutions(batches):
        for f in batches:
            out = []
            for k in range(len(f)):
                for z, yy, *_ in _blocks([f.iloc[k : k + 1]], ax, 0, nc):
                    theta, inv, rank, known = without.solve(z, yy)
                    theta[:nc][~known[:nc]] = 0.0
                    lift = inv[leads] * known[leads][:, None]
                    ok = after[known[after]]
                    out.append((len(yy), rank, theta, lift.ravel(), float(theta[ok].mean()) if len(ok) else None))
            yield pd.DataFrame({"unit": f["unit"], "n": [o[0] for o in out], "rank": [o[1] for o in out], "theta": [o[2] for o in out], "lift": [o[3] for o in out], "att": [o[4] for o in out]})

    gone = units.where("treated").mapInPandas(solutions, f"unit {kind}, n bigint, rank int, theta array<double>, lift array<double>, att double")
    gone = keep(gone)
    n_gone = gone.count()
    blocks = max(1, -(-n_gone * 8 * width * (q + 1) // BROADCAST_BYTES))
    n, n_units = eq.n, eq.n_units
    results = None
    for k in range(blocks):
        part = gone.where(F.pmod(F.xxhash64("unit"), F.lit(blocks)) == k).select("unit", "n", "rank", "theta", "lift", "att").toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part["unit"].to_numpy(), np.vstack(part["theta"].to_numpy()), [np.asarray(v).reshape(q, width) for v in part["lift"]]))

        def meats(batches, sent=sent):
            names, thetas, lifts = sent.value
            total = np.zeros((len(names), q, q))
            for z, yy, u, g, _t in _blocks(batches, ax, 0, nc):
                residual = yy[:, None] - z @ thetas.T
                starts = np.flatnonzero(np.diff(u, prepend=-1))
                for r, name in enumerate(names):
                    s = np.add.reduceat((z * residual[:, r : r + 1]) @ lifts[r].T, starts, axis=0)
                    s[g["unit"].to_numpy()[u[starts]] == name] = 0.0
                    total[r] += s.T @ s
            yield pd.DataFrame({"k": np.arange(len(names)), "v": [m.ravel() for m in total]})

        found = {r.k: np.array(r.v).reshape(q, q) for r in sum_arrays(units.mapInPandas(meats, "k int, v array<double>"), "k").collect()}
        rows = []
        for r in range(len(part)):
            v = found[r] * _share(n - part["n"][r], part["rank"][r], n_units - 1)
            b = np.asarray(part["theta"][r])[leads]
            rank = int(np.linalg.matrix_rank(v, tol=1e-12 * max(np.max(np.abs(np.diag(v))), 1e-300))) if q else 0
            f = float(b @ np.linalg.pinv(v, rcond=1e-10, hermitian=True) @ b) / rank if rank else None
            rows.append((part["unit"][r].item() if hasattr(part["unit"][r], "item") else part["unit"][r], f, rank, float(pf_upper(f, rank, n_units - 2)) if rank else None, None if pd.isna(part["att"][r]) else float(part["att"][r])))
        frame = spark.createDataFrame(rows, f"dropped {kind}, f DOUBLE, df1 INT, p DOUBLE, att DOUBLE")
        results = frame if results is None else results.unionByName(frame)
    return results if results is not None else spark.createDataFrame([], f"dropped {kind}, f DOUBLE, df1 INT, p DOUBLE, att DOUBLE")


def unit_raw_difference(df: DataFrame, unit: str, time: str, cohort: str, y: str) -> DataFrame:
    post = F.col(time) >= F.col(cohort)
    return df.where(F.col(cohort).isNotNull()).groupBy(unit).agg(
        F.avg(F.when(~post, F.col(y))).alias("mean_pre"), F.avg(F.when(post, F.col(y))).alias("mean_post"), F.count_if(~post).alias("n_pre"), F.count_if(post).alias("n_post")).withColumn("raw_diff", F.col("mean_post") - F.col("mean_pre"))


def influence_summary(loo: DataFrame) -> DataFrame:
    """Largest influence and whose, spread, range, and concentration of influence."""
    a = F.abs("influence")
    return loo.agg(F.max_by("unit", a).alias("top_unit"), F.max(a).alias("max_influence"), F.stddev_samp("influence").alias("sd_influence"), F.min("att_loo").alias("lowest"), F.max("att_loo").alias("highest"),
                   (F.sum(a * a) / (F.sum(a) * F.sum(a))).alias("hhi"))
