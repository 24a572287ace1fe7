"""Two-group, two-period difference in differences, for many cells at once.

A cell is one comparison: the only one of a plain two-period study, one (group,
period) pair, or one bootstrap draw. Each stage is a single grouped aggregate
over all cells; the driver sees k-sized sums per cell, solves them, and joins
the solutions back as a small table. The influence value of every row is a
column expression over the row and its cell's constants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import AVG_Z, col, linear, logistic
from panelwright.operators.design import with_covariates
from panelwright.operators.moments import solve_spd, unpack
from panelwright.session import keep

# Fixed values.
PSCORE_CAP = 1.0 - 1e-6
TRIM_LEVEL = 0.995

PANEL_METHODS = ("reg", "ipw", "sipw", "dr", "dr_imp")
RC_METHODS = ("reg", "ipw", "sipw", "dr", "dr1", "dr_imp", "dr_imp1")
BROADCAST_NUMBERS = 2_000_000  # numbers in a cell table still sent to every task

CELL, Y, D, POST, W = "_cell", "_y", "_d", "_post", "_w"


@dataclass
class CellResult:
    """Per-cell estimates and the frame of influence values behind them."""

    table: DataFrame
    influence: DataFrame
    point: DataFrame

    def rows(self) -> list:
        return self.table.collect()


class _Job:
    def __init__(self, df: DataFrame, k: int, single: bool):
        self.df, self.k, self.single = df, k, single
        self.x = [F.col(f"_x{i}") for i in range(k)]

    def attach(self, df: DataFrame, table: dict) -> DataFrame:
        """Give every row the constants of its cell; rows of cells without any are left out."""
        names = list(next(iter(table.values()))) if table else []
        if self.single:
            row = next(iter(table.values()))
            return df.withColumns({n: F.array(*[F.lit(float(u)) for u in v]) if isinstance(v, np.ndarray) else F.lit(float(v)) for n, v in row.items()})
        vec = {n: isinstance(v, np.ndarray) for n, v in next(iter(table.values())).items()}
        schema = f"{CELL} BIGINT, " + ", ".join(f"{n} {'ARRAY<DOUBLE>' if vec[n] else 'DOUBLE'}" for n in names)
        rows = [(int(c), *[[float(u) for u in v[n]] if vec[n] else float(v[n]) for n in names]) for c, v in table.items()]
        small = self.df.sparkSession.createDataFrame(rows, schema)
        numbers = len(rows) * sum(self.k if vec[n] else 1 for n in names)
        return df.join(F.broadcast(small) if numbers <= BROADCAST_NUMBERS else small, CELL)

    def dot(self, name: str) -> Column:
        out = F.lit(0.0)
        for i, x in enumerate(self.x):
            out = out + x * F.col(name)[i]
        return out

    def grams(self, df: DataFrame, keys: list[str], y: Column, w: Column, extra: dict[str, Column] | None = None) -> list:
        xtx = F.array(*[F.sum(w * self.x[i] * self.x[j]) for i in range(self.k) for j in range(i, self.k)])
        xty = F.array(*[F.sum(w * x * y) for x in self.x])
        return df.groupBy(*keys).agg(xtx.alias("a"), xty.alias("b"), F.count("*").alias("n"), F.sum(w).alias("sw"), *[e.alias(n) for n, e in (extra or {}).items()]).collect()


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Solution of small normal equations, or None when singular."""
    if not (np.all(np.isfinite(a)) and np.all(np.isfinite(b))):
        return None
    try:
        if np.linalg.cond(a) > 1.0 / np.finfo(float).eps:
            return None
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None


def batched_logit(job: _Job, df: DataFrame, cells: list[int], tol: float = 1e-10, maxit: int = 40, last: dict | None = None) -> tuple[dict, dict, dict]:
    """Newton logit of every cell together: one grouped aggregate per step, over
    the cells still moving. Returns coefficients, information matrices, failures;
    ``last`` receives the last coefficients of every cell, failed ones included."""
    gamma = {c: np.zeros(job.k) for c in cells}
    info: dict[int, np.ndarray] = {}
    failed: dict[int, str] = {}
    active = set(cells)
    for _ in range(maxit):
        if not active:
            break
        d = job.attach(df, {c: {"_g": gamma[c]} for c in sorted(active)})
        d = d.withColumn("_p", logistic(job.dot("_g")))
        score = {"sc": F.array(*[F.sum(F.col(W) * (F.col(D) - F.col("_p")) * x) for x in job.x])}
        for r in job.grams(d, [CELL], F.lit(0.0), F.col(W) * F.col("_p") * (1 - F.col("_p")), score):
            c = r[CELL]
            h = unpack(r.a, job.k)
            s = _solve(h, np.array(r.sc))
            if s is None or np.max(np.abs(gamma[c] + s)) > 1e3:
                failed[c] = "propensity score could not be estimated"
                active.discard(c)
                continue
            info[c] = h
            size = np.max(np.abs(s))
            gamma[c] = gamma[c] + (s if size < 5 else s * 5 / size)
            if size < tol:
                active.discard(c)
    for c in active:
        failed[c] = "propensity score did not converge"
    if last is not None:
        last.update(gamma)
    return {c: g for c, g in gamma.items() if c not in failed}, info, failed


def batched_calibrated(job: _Job, df: DataFrame, cells: list[int], tol: float = 1e-10, maxit: int = 60, last: dict | None = None) -> tuple[dict, dict]:
    """Calibrated propensity: maximise the mean of w(D xg - (1-D) exp(xg)).

    Concave, so damped Newton steps suffice; each is one grouped aggregate.
    A cell that does not settle falls back to the logit and is flagged 2."""
    gamma: dict[int, np.ndarray] = {}
    base, _, bad = batched_logit(job, df, cells, last=last)
    gamma.update(base)
    flag = {c: 0 for c in base}
    active = set(base)
    value: dict[int, float] = {}
    trial = dict(gamma)
    step: dict[int, np.ndarray] = {}
    for _ in range(maxit):
        if not active:
            break
        d = job.attach(df, {c: {"_g": trial[c]} for c in sorted(active)})
        eta = job.dot("_g")
        d = d.withColumn("_e", F.exp(eta))
        wt = F.col(W) * (1 - F.col(D)) * F.col("_e")
        # Score and curvature in one Gram: weight w(1-D)e, response (wD - w(1-D)e)/(w(1-D)e) split in two sums.
        extra = {"obj": F.sum(F.col(W) * (F.col(D) * eta - (1 - F.col(D)) * F.col("_e"))), "sd": F.array(*[F.sum(F.col(W) * F.col(D) * x) for x in job.x])}
        for r in job.grams(d, [CELL], F.lit(1.0), wt, extra):
            c = r[CELL]
            if c in value and not (np.isfinite(r.obj) and r.obj >= value[c] - 1e-12 * abs(value[c])):
                step[c] = step[c] / 2
                trial[c] = gamma[c] + step[c]
                if np.max(np.abs(step[c])) < 1e-14:
                    active.discard(c)
                continue
            gamma[c], value[c] = trial[c], r.obj
            s = _solve(unpack(r.a, job.k), np.array(r.sd) - np.array(r.b))
            if s is None:
                flag[c] = 2
                gamma[c] = base[c]
                active.discard(c)
                continue
            if np.max(np.abs(s)) < tol:
                active.discard(c)
            step[c], trial[c] = s, gamma[c] + s
    for c in active:
        flag[c], gamma[c] = 2, base[c]
    return gamma, flag


def estimate_cells(df: DataFrame, method: str, y, d, xs: list | None = None, w=None, post=None, cell=None, unit: str | None = None,
                   trim: float = TRIM_LEVEL, cache: bool = True, guard: float | None = None) -> CellResult:
    """ATT, standard error and reason per cell.

    ``xs`` are columns or a formula. With ``guard``, a cell whose largest propensity score reaches it, or whose control
    design is singular to machine precision, gets no estimate but the reason.

    Panel data give the outcome change as ``y`` and no ``post``; repeated
    cross-sections give ``post``. A cell that cannot be estimated keeps a null
    ATT and says why; the others are not affected."""
    rc = post is not None
    if method not in (RC_METHODS if rc else PANEL_METHODS):
        raise ValueError(f"unknown method {method}")
    df, xs = with_covariates(df, xs)
    covs = [F.lit(1.0)] + [col(x).cast("double") for x in (xs or [])]
    k = len(covs)
    base = df.select(*([F.col(unit)] if unit else []), (F.lit(0) if cell is None else col(cell)).cast("bigint").alias(CELL), col(y).cast("double").alias(Y),
                     col(d).cast("double").alias(D), *([col(post).cast("double").alias(POST)] if rc else []),
                     (F.lit(1.0) if w is None else col(w).cast("double")).alias(W), *[c.alias(f"_x{i}") for i, c in enumerate(covs)])
    job = _Job(base, k, cell is None)
    if cache:
        base = keep(base)
    spark = df.sparkSession
    quad = [D, POST] if rc else [D]
    sizes: dict[int, dict] = {}
    grams: dict[tuple, tuple] = {}
    for r in job.grams(base, [CELL, *quad], F.col(Y), F.col(W)):
        c = r[CELL]
        s = sizes.setdefault(c, {"n": 0, "sw": 0.0, "seen": set()})
        s["n"] += r.n
        s["sw"] += r.sw
        s["seen"].add(tuple(int(r[q]) for q in quad))
        grams[(c, *[int(r[q]) for q in quad])] = (unpack(r.a, k), np.array(r.b))
    need = {(a, b) for a in (0, 1) for b in (0, 1)} if rc else {(0,), (1,)}
    label = {(0,): "no control observations", (1,): "no treated observations", (0, 0): "n_control_pre=0", (0, 1): "n_control_post=0", (1, 0): "n_treat_pre=0", (1, 1): "n_treat_post=0"}
    reason: dict[int, str] = {}
    for c, s in sizes.items():
        gone = sorted(need - s["seen"], reverse=True)
        if gone:
            reason[c] = ", ".join(label[g] for g in gone)
    live = [c for c in sizes if c not in reason]
    const: dict[int, dict] = {c: {"_wbar": sizes[c]["sw"] / sizes[c]["n"]} for c in live}

    # propensity score
    gamma, hess, last = {}, {}, {}
    checked = list(live)
    if method != "reg" and live:
        if method.startswith("dr_imp"):
            gamma, flags = batched_calibrated(job, base, live, last=last)
            lost = [c for c in live if c not in gamma]
            for c in lost:
                reason[c] = "propensity score could not be estimated"
        else:
            gamma, hess, bad = batched_logit(job, base, live, last=last)
            reason.update(bad)
    if guard is not None:
        reason.update(guarded(job, base, checked, last, guard, method))
    live = [c for c in live if c not in reason]
    if method != "reg":
        for c in live:
            const[c]["_g"] = gamma[c]

    # outcome regressions
    fits: dict[tuple, np.ndarray] = {}
    if method in ("dr_imp", "dr_imp1") and live:
        t = job.attach(base, {c: {"_g": gamma[c]} for c in live})
        odds = F.exp(F.least(job.dot("_g"), F.lit(float(np.log(PSCORE_CAP / (1 - PSCORE_CAP))))))
        for r in job.grams(t.where(F.col(D) == 0), [CELL, *quad], F.col(Y), F.col(W) * odds):
            grams[(r[CELL], "c", *[int(r[q]) for q in quad[1:]])] = (unpack(r.a, k), np.array(r.b))
    regs: dict[str, tuple] = {}
    imp = method.startswith("dr_imp")
    if method in ("reg", "dr", "dr1", "dr_imp", "dr_imp1"):
        control = ("c",) if imp else (0,)
        regs = {"_bc1": control + (1,), "_bc0": control + (0,)} if rc else {"_bc": control}
        if rc and method in ("dr", "dr_imp"):
            regs.update({"_bt1": (1, 1), "_bt0": (1, 0)})
    for c in list(live):
        for name, key in regs.items():
            a, b = grams[(c, *key)]
            s = _solve(a, b)
            if s is None:
                reason[c] = "singular outcome regression design"
                break
            const[c][name] = s
        if c in reason:
            live.remove(c)
    if not live:
        empty = spark.createDataFrame([(int(c), sizes[c]["n"], None, None, reason[c]) for c in sizes], f"{CELL} BIGINT, n BIGINT, att DOUBLE, se DOUBLE, reason STRING")
        return CellResult(empty, base.limit(0).select(CELL, *([unit] if unit else []), F.lit(0.0).alias("psi")), empty)

    rows = job.attach(base, {c: const[c] for c in live})
    ww, yy, dd = F.col(W) / F.col("_wbar"), F.col(Y), F.col(D)
    cols: dict[str, Column] = {"_wn": ww}
    if method != "reg":
        cols["_ps"] = F.least(logistic(job.dot("_g")), F.lit(PSCORE_CAP))
    for name in regs:
        cols[name.replace("_b", "_m")] = job.dot(name)
    rows = rows.withColumns(cols)
    wn = F.col("_wn")
    if method != "reg":
        ps = F.col("_ps")
        tr = F.when((dd == 0) & (ps >= trim), 0.0).otherwise(1.0)
        odds = ps / (1 - ps)
    make = _rc_plan if rc else _panel_plan
    means, psi = make(method, job, wn, yy, dd, F.col(POST) if rc else None, None if method == "reg" else (ps, tr, odds))
    agg = rows.groupBy(CELL).agg(*[F.avg(e).alias(n) for n, e in means.items()]).collect()
    final: dict[int, dict] = {}
    att: dict[int, float] = {}
    for r in agg:
        c = r[CELL]
        m = {n: r[n] for n in means}
        n = sizes[c]["n"]
        inv = {}
        for key in [kk for kk in grams if kk[0] == c and len(kk) == 1 + len(quad) and "c" not in kk]:
            inv[key[1:]] = _inverse(grams[key][0] / const[c]["_wbar"] / n)
        inv["ps"] = _inverse(hess[c] / const[c]["_wbar"] / n) if c in hess else None
        value, consts = psi(m, inv)
        if not np.isfinite(value):
            reason[c] = "estimate is not finite"
            continue
        att[c] = value
        final[c] = consts
    rows = job.attach(rows, final) if final else rows.limit(0)
    expr = psi.expression if hasattr(psi, "expression") else None
    inf = rows.select(CELL, *([unit] if unit else []), expr().alias("psi")) if final else rows.select(CELL, F.lit(0.0).alias("psi"))
    point = spark.createDataFrame([(int(c), int(sizes[c]["n"]), att.get(c), reason.get(c)) for c in sizes], f"{CELL} BIGINT, n BIGINT, att DOUBLE, reason STRING")
    sds = inf.groupBy(CELL).agg((F.stddev_samp("psi") * F.sqrt(F.count("*") - 1) / F.count("*")).alias("se"))
    return CellResult(point.join(sds, CELL, "left").select(CELL, "n", "att", "se", "reason"), inf, point)


def guarded(job: _Job, df: DataFrame, cells: list[int], scores: dict, limit: float, method: str) -> dict[int, str]:
    """Reasons of cells without overlap or with a singular control design: the largest score and the controls' cross
    products of all cells come out of one grouped aggregate. Scores of a fit that failed are those of its last step."""
    if not cells:
        return {}
    scored = method != "reg"
    d = job.attach(df, {c: {"_g": scores[c]} for c in cells}) if scored else df
    top = F.max(logistic(job.dot("_g"))) if scored else F.lit(None).cast("double")
    control = F.col(D) == 0
    gram = F.array(*[F.sum(F.when(control, job.x[i] * job.x[j])) for i in range(job.k) for j in range(i, job.k)])
    out = {}
    for r in d.groupBy(CELL).agg(top.alias("top"), gram.alias("a")).collect():
        if scored and r.top is not None and r.top >= limit:
            out[r[CELL]] = "overlap condition violated"
        elif not method.startswith(("ipw", "sipw")) and reciprocal_condition(unpack(r.a, job.k)) < np.finfo(float).eps:
            out[r[CELL]] = "singular control design"
    return out


def reciprocal_condition(a: np.ndarray) -> float:
    if not np.all(np.isfinite(a)):
        return 0.0
    try:
        return 1.0 / (np.linalg.norm(a, 1) * np.linalg.norm(np.linalg.inv(a), 1))
    except np.linalg.LinAlgError:
        return 0.0


def overlap_trim(df: DataFrame, d, xs: list | str, w=None, limit: float = 0.999) -> DataFrame:
    """The rows with their propensity score ``ps``, without the treated ones whose score lies above ``limit``."""
    df, xs = with_covariates(df, xs)
    covs = [F.lit(1.0)] + [col(x).cast("double") for x in xs]
    base = df.select(F.lit(0).cast("bigint").alias(CELL), col(d).cast("double").alias(D), (F.lit(1.0) if w is None else col(w).cast("double")).alias(W),
                     *[c.alias(f"_x{i}") for i, c in enumerate(covs)])
    last: dict = {}
    batched_logit(_Job(keep(base), len(covs), True), base, [0], last=last)
    ps = logistic(linear(last[0], covs))
    out = df.withColumn("ps", ps).where((col(d) != 1) | (F.col("ps") <= limit) | F.col("ps").isNull())
    return out.drop(*[x for x in xs if isinstance(x, str) and x.startswith("_f")])


def _inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a, hermitian=True)


class _Psi:
    """Turns cell means into the ATT and the constants of the influence column."""

    def __init__(self, solve, expression):
        self._solve, self.expression = solve, expression

    def __call__(self, m, inv):
        return self._solve(m, inv)


def _vec(means: dict, name: str, x: list[Column], e: Column) -> None:
    for i, c in enumerate(x):
        means[f"{name}__{i}"] = e * c


def _get(m: dict, name: str, k: int) -> np.ndarray:
    return np.array([m[f"{name}__{i}"] for i in range(k)])


def _panel_plan(method, job, w, y, d, _post, score):
    x, k = job.x, job.k
    c = F.col
    means: dict[str, Column] = {"wd": w * d}
    if method == "reg":
        means.update(ty=w * d * y, tm=w * d * c("_mc"))
        _vec(means, "M", x, w * d)

        def solve(m, inv):
            et, ec = m["ty"] / m["wd"], m["tm"] / m["wd"]
            return et - ec, {"_et": et, "_ec": ec, "_wd": m["wd"], "_v": inv[(0,)] @ _get(m, "M", k)}

        def expr():
            treat = w * d * (y - c("_et"))
            cont = w * d * (c("_mc") - c("_ec")) + w * (1 - d) * (y - c("_mc")) * job.dot("_v")
            return (treat - cont) / c("_wd")

        return means, _Psi(solve, expr)
    ps, tr, odds = score
    wt, wc = tr * w * d, tr * w * odds * (1 - d)
    if method == "ipw":
        means.update(ty=wt * y, cy=wc * y)
        _vec(means, "M", x, wc * y)

        def solve(m, inv):
            a = (m["ty"] - m["cy"]) / m["wd"]
            return a, {"_att": a, "_wd": m["wd"], "_v": inv["ps"] @ _get(m, "M", k)}

        def expr():
            return (wt * y - wc * y - w * (d - ps) * job.dot("_v") - w * d * c("_att")) / c("_wd")

        return means, _Psi(solve, expr)
    if method == "dr_imp":
        part = tr * (1 - (1 - d) / (1 - ps)) * (y - c("_mc"))
        means.update(num=w * part)

        def solve(m, inv):
            a = m["num"] / m["wd"]
            return a, {"_att": a, "_wd": m["wd"]}

        return means, _Psi(solve, lambda: w * tr * (part - d * c("_att")) / c("_wd"))
    u = y - c("_mc") if method == "dr" else y
    means.update(swt=wt, swc=wc, ty=wt * u, cy=wc * u)
    _vec(means, "X1", x, wc * u)
    _vec(means, "X0", x, wc)
    _vec(means, "T", x, wt)

    def solve(m, inv):
        et, ec = m["ty"] / m["swt"], m["cy"] / m["swc"]
        m2 = (_get(m, "X1", k) - ec * _get(m, "X0", k)) / m["swc"]
        out = {"_et": et, "_ec": ec, "_swt": m["swt"], "_swc": m["swc"], "_v": inv["ps"] @ m2}
        if method == "dr":
            out["_v1"] = inv[(0,)] @ (_get(m, "T", k) / m["swt"])
            out["_v3"] = inv[(0,)] @ (_get(m, "X0", k) / m["swc"])
        return et - ec, out

    def expr():
        treat = wt * (u - c("_et")) / c("_swt")
        cont = wc * (u - c("_ec")) / c("_swc") + w * (d - ps) * job.dot("_v")
        if method == "dr":
            ols = w * (1 - d) * (y - c("_mc"))
            treat = treat - ols * job.dot("_v1")
            cont = cont - ols * job.dot("_v3")
        return treat - cont

    return means, _Psi(solve, expr)


def _rc_plan(method, job, w, y, d, p, score):
    x, k = job.x, job.k
    c = F.col
    q = 1 - p
    means: dict[str, Column] = {}
    if method == "reg":
        means.update(t1=w * d * p, t0=w * d * q, wd=w * d, y1=w * d * p * y, y0=w * d * q * y, m=w * d * (c("_mc1") - c("_mc0")))
        _vec(means, "M", x, w * d)

        def solve(m, inv):
            e1, e0, ec = m["y1"] / m["t1"], m["y0"] / m["t0"], m["m"] / m["wd"]
            M = _get(m, "M", k)
            return e1 - e0 - ec, {"_e1": e1, "_e0": e0, "_ec": ec, "_t1": m["t1"], "_t0": m["t0"], "_wd": m["wd"], "_v1": inv[(0, 1)] @ M, "_v0": inv[(0, 0)] @ M}

        def expr():
            treat = w * d * p * (y - c("_e1")) / c("_t1") - w * d * q * (y - c("_e0")) / c("_t0")
            cont = w * d * (c("_mc1") - c("_mc0") - c("_ec")) + w * (1 - d) * p * (y - c("_mc1")) * job.dot("_v1") - w * (1 - d) * q * (y - c("_mc0")) * job.dot("_v0")
            return treat - cont / c("_wd")

        return means, _Psi(solve, expr)
    ps, tr, odds = score
    wc1, wc0 = tr * w * odds * (1 - d) * p, tr * w * odds * (1 - d) * q
    if method == "ipw":
        wt1, wt0 = w * d * p, w * d * q
        means.update(Pi=w * d, lam=w * p, lam0=w * q, a=wt1 * y, b=wt0 * y, e=wc1 * y, f=wc0 * y)
        _vec(means, "M1", x, wc1 * y)
        _vec(means, "M0", x, wc0 * y)

        def solve(m, inv):
            s1, s0 = m["Pi"] * m["lam"], m["Pi"] * m["lam0"]
            t1, t0, u1, u0 = m["a"] / s1, m["b"] / s0, m["e"] / s1, m["f"] / s0
            mom = -_get(m, "M1", k) / s1 + _get(m, "M0", k) / s0
            return (t1 - t0) - (u1 - u0), {"_s1": s1, "_s0": s0, "_k1": t1 - u1, "_k0": t0 - u0, "_Pi": m["Pi"], "_l": m["lam"], "_l0": m["lam0"], "_v": inv["ps"] @ mom}

        def expr():
            one = (wt1 - wc1) * y / c("_s1") - c("_k1") - (w * d - c("_Pi")) * c("_k1") / c("_Pi") - (w * p - c("_l")) * c("_k1") / c("_l")
            zero = (wt0 - wc0) * y / c("_s0") - c("_k0") - (w * d - c("_Pi")) * c("_k0") / c("_Pi") - (w * q - c("_l0")) * c("_k0") / c("_l0")
            return one - zero + w * (d - ps) * job.dot("_v")

        return means, _Psi(solve, expr)
    # Trimming only removes controls, so treated weights need none.
    wt1, wt0, wd = w * d * p, w * d * q, w * d
    u = y if method == "sipw" else y - (p * c("_mc1") + q * c("_mc0"))
    full = method in ("dr", "dr_imp")
    means.update(t1=wt1, t0=wt0, c1=wc1, c0=wc0, a=wt1 * u, b=wt0 * u, e=wc1 * u, f=wc0 * u)
    if full:
        g1, g0 = c("_mt1") - c("_mc1"), c("_mt0") - c("_mc0")
        means.update(wd=wd, d1=wd * g1, k1=wt1 * g1, d0=wd * g0, k0=wt0 * g0)
    if method in ("sipw", "dr", "dr1"):
        for n, e in (("C1u", wc1 * u), ("C0u", wc0 * u), ("C1", wc1), ("C0", wc0), ("T1", wt1), ("T0", wt0), ("Td", wd)):
            _vec(means, n, x, e)

    def solve(m, inv):
        t1, t0, u1, u0 = m["a"] / m["t1"], m["b"] / m["t0"], m["e"] / m["c1"], m["f"] / m["c0"]
        value = (t1 - t0) - (u1 - u0)
        out = {"_e1": t1, "_e0": t0, "_u1": u1, "_u0": u0, "_t1": m["t1"], "_t0": m["t0"], "_c1": m["c1"], "_c0": m["c0"]}
        if full:
            q1, r1, q0, r0 = m["d1"] / m["wd"], m["k1"] / m["t1"], m["d0"] / m["wd"], m["k0"] / m["t0"]
            value += (q1 - r1) - (q0 - r0)
            out.update(_q1=q1, _r1=r1, _q0=q0, _r0=r0, _wdm=m["wd"])
        if method in ("sipw", "dr", "dr1"):
            g = lambda n: _get(m, n, k)
            out["_v"] = inv["ps"] @ ((g("C1u") - u1 * g("C1")) / m["c1"] - (g("C0u") - u0 * g("C0")) / m["c0"])
        if method in ("dr", "dr1"):
            # Both arms share the control regressions, so their moments are netted first.
            net1 = -g("T1") / m["t1"] + g("C1") / m["c1"]
            net0 = -g("T0") / m["t0"] + g("C0") / m["c0"]
            if method == "dr":
                mom1, mom0 = g("Td") / m["wd"] - g("T1") / m["t1"], g("Td") / m["wd"] - g("T0") / m["t0"]
                out["_h1"], out["_h0"] = inv[(0, 1)] @ (net1 - mom1), inv[(0, 0)] @ (net0 + mom0)
                out["_j1"], out["_j0"] = inv[(1, 1)] @ mom1, inv[(1, 0)] @ (-mom0)
            else:
                out["_h1"], out["_h0"] = inv[(0, 1)] @ net1, inv[(0, 0)] @ net0
        return value, out

    def expr():
        psi = (wt1 * (u - c("_e1")) / c("_t1") - wt0 * (u - c("_e0")) / c("_t0")) - (wc1 * (u - c("_u1")) / c("_c1") - wc0 * (u - c("_u0")) / c("_c0"))
        if full:
            psi = psi + (wd * (g1 - c("_q1")) / c("_wdm") - wt1 * (g1 - c("_r1")) / c("_t1")) - (wd * (g0 - c("_q0")) / c("_wdm") - wt0 * (g0 - c("_r0")) / c("_t0"))
        if method in ("sipw", "dr", "dr1"):
            psi = psi - w * (d - ps) * job.dot("_v")
        if method in ("dr", "dr1"):
            psi = psi + w * (1 - d) * (p * (y - c("_mc1")) * job.dot("_h1") + q * (y - c("_mc0")) * job.dot("_h0"))
        if method == "dr":
            psi = psi + w * d * (p * (y - c("_mt1")) * job.dot("_j1") + q * (y - c("_mt0")) * job.dot("_j0"))
        return psi

    return means, _Psi(solve, expr)


def did_2x2(df: DataFrame, method: str, y=None, y1=None, y0=None, d="d", post=None, xs: list | None = None, w=None, trim: float = TRIM_LEVEL) -> DataFrame:
    """One-row result: att, se, lci, uci, n. Panel data by ``y1``/``y0``, repeated
    cross-sections by ``y``/``post``."""
    outcome = col(y1) - col(y0) if y1 is not None else col(y)
    r = estimate_cells(df, method, outcome, d, xs, w, post, trim=trim)
    return with_ci(r.table).select("n", "att", "se", "lci", "uci")


def with_ci(df: DataFrame) -> DataFrame:
    return df.withColumns({"lci": F.col("att") - AVG_Z * F.col("se"), "uci": F.col("att") + AVG_Z * F.col("se")})


def twfe_2x2(df: DataFrame, y, d, post, xs: list | None = None, w=None) -> DataFrame:
    """Regression of the outcome on treatment, period, their product and
    covariates, rows taken as independent."""
    from panelwright.operators.moments import gram

    df, xs = with_covariates(df, xs)
    xs = [col(x) for x in (xs or [])]
    dd, pp = col(d).cast("double"), col(post).cast("double")
    ww = F.lit(1.0) if w is None else col(w)
    f = df.select(col(y).alias("_y"), (ww / df.agg(F.avg(ww)).scalar()).alias("_w"), F.lit(1.0).alias("_x0"), (dd * pp).alias("_x1"), pp.alias("_x2"), dd.alias("_x3"),
                  *[x.alias(f"_x{4 + i}") for i, x in enumerate(xs)])
    k = 4 + len(xs)
    x = [F.col(f"_x{i}") for i in range(k)]
    g = gram(f, [], x, F.col("_y"), F.col("_w")).first()
    a = unpack(g.xtx, k) / g.n
    beta = solve_spd(a, np.array(g.xty) / g.n, "regression")
    psi = F.col("_w") * (F.col("_y") - linear(beta, x)) * linear(np.linalg.inv(a)[1], x)
    out = f.agg((F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return with_ci(out.withColumn("att", F.lit(float(beta[1])))).select("n", "att", "se", "lci", "uci")


def did_long(df: DataFrame, method: str, y: str, time: str, d: str, unit: str | None = None, xs: list | None = None, w: str | None = None) -> DataFrame:
    """Two-period estimate from long data: panel when a unit is named, else
    repeated cross-sections. Covariates and weights of a panel are read in the
    first period."""
    df, xs = with_covariates(df, xs)
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    if unit is None:
        post = (F.col(time) == span.select("b").scalar()).cast("double")
        return did_2x2(df.withColumn("_late", post), method, y=y, d=d, post="_late", xs=xs, w=w)
    lo, hi = span.first()
    first = F.col(time) == lo
    keepers = [c for c in dict.fromkeys([d, *(xs or []), *([w] if w else [])])]
    wide = df.groupBy(unit).agg(F.max(F.when(first, F.col(y))).alias("_y0"), F.max(F.when(F.col(time) == hi, F.col(y))).alias("_y1"),
                                *[F.max(F.when(first, F.col(c))).alias(c) for c in keepers])
    return did_2x2(wide.where("_y0 is not null and _y1 is not null"), method, y1="_y1", y0="_y0", d=d, xs=xs, w=w)


def preprocess_report(df: DataFrame, y: str, time: str, d: str, unit: str, xs: list[str], w: str | None = None) -> DataFrame:
    """Checks a two-period panel must pass, as (check, found, wanted, ok)."""
    fixed = [d, *xs, *([w] if w else [])]
    u = df.groupBy(unit).agg(F.count_distinct(time).alias("_p"), F.max(d).alias("_d"), *[(F.count_distinct(c) > 1).cast("bigint").alias(f"_v{i}") for i, c in enumerate(fixed)])
    a = df.agg(F.count_distinct(time).alias("periods"), F.count_distinct(d).alias("groups"), F.count(F.when(F.col(y).isNull(), 1)).alias("missing_outcomes"))
    varying = F.sum(F.greatest(*[F.col(f"_v{i}") for i in range(len(fixed))], F.lit(0)))
    b = u.agg(F.count_if(F.col("_p") != 2).alias("unbalanced_units"), varying.alias("time_varying_units"),
              F.least(F.count_if((F.col("_d") == 1) & (F.col("_p") == 2)), F.count_if((F.col("_d") == 0) & (F.col("_p") == 2))).alias("smallest_group"))
    long = a.unpivot([], a.columns, "check", "found").unionByName(b.unpivot([], b.columns, "check", "found"))
    wanted = F.when(F.col("check").isin("periods", "groups"), 2).when(F.col("check") == "smallest_group", len(xs) + 5).otherwise(0)
    ok = F.when(F.col("check") == "smallest_group", F.col("found") >= F.col("wanted")).otherwise(F.col("found") == F.col("wanted"))
    return long.withColumn("wanted", wanted.cast("bigint")).withColumn("ok", ok)


def wls_odds(df: DataFrame, y, xs: list, ps, w, mask: Column) -> DataFrame:
    """Regression coefficients on a subset, weighted by the odds of treatment."""
    from panelwright.operators.moments import gram

    x = [F.lit(1.0)] + [col(c) for c in xs]
    g = gram(df.where(mask), [], x, y, col(w) * col(ps) / (1 - col(ps))).first()
    beta = solve_spd(unpack(g.xtx, len(x)), np.array(g.xty), "outcome regression")
    return df.sparkSession.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "position INT, coef DOUBLE")


def aipw_panel(dy, d, ps, reg, w) -> Column:
    """Aggregate: plug-in ATT for given propensity and outcome regression."""
    dy, d, ps, reg, w = (col(c) for c in (dy, d, ps, reg, w))
    return F.sum(w * (d - ps * (1 - d) / (1 - ps)) * (dy - reg)) / F.sum(w * d)


def aipw_rc(y, post, d, ps, w, reg_control_post, reg_control_pre, reg_treat_post=None, reg_treat_pre=None) -> Column:
    """Aggregate: plug-in ATT for repeated cross-sections, locally efficient when
    treated regressions are given."""
    y, p, d, ps, w = (col(c) for c in (y, post, d, ps, w))
    c1, c0 = col(reg_control_post), col(reg_control_pre)
    u = y - (p * c1 + (1 - p) * c0)
    odds = ps / (1 - ps)
    part = lambda wt: F.sum(wt * u) / F.sum(wt)
    value = part(w * d * p) - part(w * d * (1 - p)) - part(w * (1 - d) * p * odds) + part(w * (1 - d) * (1 - p) * odds)
    if reg_treat_post is not None:
        gap = lambda wt, e: F.sum(wt * e) / F.sum(wt)
        e1, e0 = col(reg_treat_post) - c1, col(reg_treat_pre) - c0
        value = value + gap(w * d, e1) - gap(w * d * p, e1) - gap(w * d, e0) + gap(w * d * (1 - p), e0)
    return value
