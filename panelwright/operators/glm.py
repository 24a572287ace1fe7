"""Generalised linear models by reweighted least squares.

Every iteration is one Spark aggregate of the current working weights and
response; only k-sized sums come back. Link, variance and deviance are column
expressions, so a user family is a triple of such expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import two_sided_normal, two_sided_t
from panelwright.functions.scalars import col, linear
from panelwright.operators.design import model_matrix
from panelwright.operators.factors import reduced, solved, stack
from panelwright.operators.moments import unpack
from panelwright.session import keep, small_batches

WIDE = 24  # beyond this many columns, cross products are summed in Arrow batches


@dataclass(frozen=True)
class Arrays:
    """A family on arrays."""

    link: Callable
    mean: Callable
    slope: Callable
    variance: Callable
    deviance: Callable
    start: Callable


@dataclass(frozen=True)
class Family:
    """Column-expression family: inverse link, its slope, variance, deviance."""

    name: str
    link: Callable[[Column], Column]
    mean: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    variance: Callable[[Column], Column]
    deviance: Callable[[Column, Column], Column]
    start: Callable[[Column], Column]
    fixed_dispersion: bool = False
    #: The same functions on arrays; with them wide fits keep the design as blocks of numbers.
    arrays: Arrays | None = None


def _xlogy(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.ln(b)).otherwise(0.0)


# link name -> (link, inverse, slope of the inverse)
LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "log": (F.ln, F.exp, F.exp),
    "logit": (lambda m: F.ln(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(-F.abs(e)) / ((1 + F.exp(-F.abs(e))) * (1 + F.exp(-F.abs(e))))),
    "cloglog": (lambda m: F.ln(-F.log1p(-m)), lambda e: -F.expm1(-F.exp(e)), lambda e: F.exp(e - F.exp(e))),
    "sqrt": (F.sqrt, lambda e: e * e, lambda e: 2 * e),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e)),
    "1/mu^2": (lambda m: 1 / (m * m), lambda e: 1 / F.sqrt(e), lambda e: -0.5 / (e * F.sqrt(e))),
}


# The same on arrays.
ARRAY_LINKS = {
    "identity": (lambda m: m, lambda e: e, np.ones_like),
    "log": (np.log, np.exp, np.exp),
    "logit": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-np.abs(e)) / np.square(1 + np.exp(-np.abs(e)))),
    "cloglog": (lambda m: np.log(-np.log1p(-m)), lambda e: -np.expm1(-np.exp(e)), lambda e: np.exp(e - np.exp(e))),
    "sqrt": (np.sqrt, np.square, lambda e: 2 * e),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / np.square(e)),
    "1/mu^2": (lambda m: 1 / np.square(m), lambda e: 1 / np.sqrt(e), lambda e: -0.5 / (e * np.sqrt(e))),
}


def _array_xlogy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a > 0, a * np.log(np.where(a > 0, b, 1.0)), 0.0)


# name -> (variance, deviance, start)
ARRAY_FAMILIES = {
    "gaussian": (np.ones_like, lambda y, m: np.square(y - m), lambda y: y),
    "binomial": (lambda m: m * (1 - m), lambda y, m: 2 * (_array_xlogy(y, y / m) + _array_xlogy(1 - y, (1 - y) / (1 - m))), lambda y: (y + 0.5) / 2),
    "poisson": (lambda m: m, lambda y, m: 2 * (_array_xlogy(y, y / m) - (y - m)), lambda y: y + 0.1),
    "gamma": (np.square, lambda y, m: -2 * (np.log(y / m) - (y - m) / m), lambda y: y),
    "inverse_gaussian": (lambda m: m**3, lambda y, m: np.square(y - m) / (y * m * m), lambda y: y),
}


def family(name: str, link: str | None = None) -> Family:
    """Standard family with its usual or a chosen link."""
    found = _family(name, link)
    variance, deviance, start = ARRAY_FAMILIES[name]
    default = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "inverse_gaussian": "1/mu^2"}
    return replace(found, arrays=Arrays(*ARRAY_LINKS[link or default[name]], variance, deviance, start))


def _family(name: str, link: str | None = None) -> Family:
    default = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "inverse_gaussian": "1/mu^2"}
    lk, inv, slope = LINKS[link or default[name]]
    if name == "gaussian":
        return Family(name, lk, inv, slope, lambda m: F.lit(1.0), lambda y, m: (y - m) * (y - m), lambda y: y)
    if name == "binomial":
        return Family(name, lk, inv, slope, lambda m: m * (1 - m), lambda y, m: 2 * (_xlogy(y, y / m) + _xlogy(1 - y, (1 - y) / (1 - m))), lambda y: (y + 0.5) / 2, True)
    if name == "poisson":
        return Family(name, lk, inv, slope, lambda m: m, lambda y, m: 2 * (_xlogy(y, y / m) - (y - m)), lambda y: y + 0.1, True)
    if name == "gamma":
        return Family(name, lk, inv, slope, lambda m: m * m, lambda y, m: -2 * (F.ln(y / m) - (y - m) / m), lambda y: y)
    if name == "inverse_gaussian":
        return Family(name, lk, inv, slope, lambda m: m * m * m, lambda y, m: (y - m) * (y - m) / (y * m * m), lambda y: y)
    raise ValueError(f"unknown family {name}")


@dataclass
class GlmFit:
    family: Family
    coef: np.ndarray
    cov_unscaled: np.ndarray
    deviance: float
    null_deviance: float
    n: int
    rank: int
    iterations: int
    converged: bool
    dispersion: float
    names: list[str] = field(default_factory=list)
    #: Which coefficients the design identifies; pivoted fits leave the others at 0.
    estimated: np.ndarray | None = None
    loglik: float = float("nan")

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov_unscaled) * self.dispersion)

    def eta(self, xs: list, offset=None) -> Column:
        e = linear(self.coef, xs)
        return e if offset is None else e + col(offset)

    def predict(self, xs: list, kind: str = "response", offset=None) -> Column:
        e = self.eta(xs, offset)
        return e if kind == "link" else self.family.mean(e)

    def residual(self, y, xs: list, kind: str = "deviance", offset=None) -> Column:
        y = col(y)
        eta = self.eta(xs, offset)
        mu = self.family.mean(eta)
        if kind == "response":
            return y - mu
        if kind == "working":
            return (y - mu) / self.family.slope(eta)
        if kind == "pearson":
            return (y - mu) / F.sqrt(self.family.variance(mu))
        return F.signum(y - mu) * F.sqrt(F.greatest(self.family.deviance(y, mu), F.lit(0.0)))

    def summary(self) -> list[tuple]:
        """(term, estimate, se, statistic, p); normal when dispersion is known, else t."""
        out = []
        known = np.ones(len(self.coef), bool) if self.estimated is None else self.estimated
        for name, b, s, ok in zip(self.names, self.coef, self.se, known):
            if not ok:
                out.append((name, None, None, None, None))
                continue
            stat = b / s if s > 0 else float("nan")
            p = two_sided_normal(stat) if self.family.fixed_dispersion else two_sided_t(stat, self.df_residual)
            out.append((name, float(b), float(s), float(stat), float(p)))
        return out


def wide_gram(df: DataFrame, xs: list, z: Column, w: Column, extras: dict[str, Column]) -> tuple[np.ndarray, np.ndarray, dict]:
    """X'WX and X'Wz for many columns: each task multiplies Arrow batches and
    emits one packed row per partition; the packed rows are summed by position."""
    k = len(xs)
    iu = np.triu_indices(k)
    names = list(extras)

    def part(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            m, zz, wt = np.column_stack(cols[:k]), cols[k], cols[k + 1]
            row = np.concatenate([(m.T @ (m * wt[:, None]))[iu], m.T @ (wt * zz), [c.sum() for c in cols[k + 2:]]])
            total = row if total is None else total + row
        if total is not None:
            yield pa.record_batch({"p": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    rows = df.select(*[col(x).cast("double").alias(f"c{i}") for i, x in enumerate(xs)], z.alias("z"), w.alias("w"), *[e.alias(n) for n, e in extras.items()])
    summed = rows.mapInArrow(part, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(len(summed))
    for r in summed:
        v[r.p] = r.v
    t = len(iu[0])
    return unpack(v[:t], k), v[t:t + k], dict(zip(names, v[t + k:]))


def glm_fit(df: DataFrame, y, xs: list | str, fam: Family, w=None, offset=None, start: np.ndarray | None = None,
            tol: float = 1e-8, maxit: int = 100, names: list[str] | None = None, cache: bool = True, method: str = "gram") -> GlmFit:
    """Fit by reweighted least squares with step halving; ``xs`` are columns or a formula.

    ``method``: gram (cross products, minimum norm if deficient), or the triangular factor of the weighted rows: qr (a singular
    design is an error), pivoted_qr (columns beyond the rank get no coefficient), svd (minimum norm). The narrow modelling frame
    is persisted because every iteration reads it; families with array functions and more than WIDE columns, or a factor
    method, keep it as blocks of numbers, which are dealt over the cores once if they lie in fewer partitions."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    if isinstance(xs, str):
        m = model_matrix(df, xs)
        xs, names = m.columns, names or m.names
    k = len(xs)
    if method != "gram" and fam.arrays is None:
        raise ValueError("factor methods need a family with array functions")
    d = df.select(col(y).cast("double").alias("_y"), (F.lit(1.0) if w is None else col(w)).alias("_w"),
                  (F.lit(0.0) if offset is None else col(offset)).alias("_o"), *[col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    if fam.arrays is not None and (k > WIDE or method != "gram"):
        return _fit_blocks(d, k, fam, offset is not None, start, tol, maxit, names or [f"x{i}" for i in range(k)], method)
    if cache:
        d = keep(d)
    yy, ww, oo, xc = F.col("_y"), F.col("_w"), F.col("_o"), [F.col(f"_x{i}") for i in range(k)]

    def step(eta: Column) -> tuple[np.ndarray, np.ndarray, float, float, float]:
        # Staged projections keep the long linear predictor evaluated once per row.
        x = d.withColumn("_eta", eta)
        x = x.withColumns({"_mu": fam.mean(F.col("_eta")), "_slope": fam.slope(F.col("_eta"))})
        mu, slope = F.col("_mu"), F.col("_slope")
        x = x.withColumns({"_var": fam.variance(mu), "_dev": ww * fam.deviance(yy, mu)})
        x = x.withColumns({"_wt": ww * slope * slope / F.col("_var"), "_z": F.col("_eta") - oo + (yy - mu) / slope, "_pe": ww * (yy - mu) * (yy - mu) / F.col("_var")})
        if k > WIDE:
            a, b, e = wide_gram(x, xc, F.col("_z"), F.col("_wt"), {"dev": F.col("_dev"), "pearson": F.col("_pe"), "n": F.lit(1.0)})
            return a, b, e["dev"], e["pearson"], e["n"]
        up = ", ".join(f"sum(_wt * _x{i} * _x{j})" for i in range(k) for j in range(i, k))
        r = x.agg(F.expr(f"array({up})").alias("a"), F.expr("array(" + ", ".join(f"sum(_wt * _x{i} * _z)" for i in range(k)) + ")").alias("b"), F.sum("_dev").alias("dev"), F.sum("_pe").alias("pearson"), F.count("*").cast("double").alias("n")).first()
        return unpack(r.a, k), np.array(r.b), r.dev, r.pearson, r.n

    def line(beta: np.ndarray) -> Column:
        return F.expr(" + ".join(f"{float(b)!r}D * _x{i}" for i, b in enumerate(beta))) + oo

    solve = lambda a, b: np.linalg.lstsq(a, b, rcond=1e-13)[0]
    if start is None:
        a, b, _, _, _ = step(fam.link(fam.start(yy)))
        beta = solve(a, b)
    else:
        beta = np.asarray(start, dtype=float)
    dev_old, it, converged = math.inf, 0, False
    a, b, dev, pearson, n = step(line(beta))
    prev = None
    while it < maxit:
        it += 1
        halvings = 0
        while prev is not None and (not math.isfinite(dev) or dev > dev_old + 1e-7 * (abs(dev_old) + 0.1)) and halvings < 25:
            beta = 0.5 * (beta + prev)
            a, b, dev, pearson, n = step(line(beta))
            halvings += 1
        if abs(dev - dev_old) / (abs(dev) + 0.1) < tol:
            converged = True
            break
        prev, dev_old = beta, dev
        beta = solve(a, b)
        a, b, dev, pearson, n = step(line(beta))
    rank = int(np.linalg.matrix_rank(a, tol=1e-9 * max(np.max(np.abs(np.diag(a))), 1e-300)))
    m = d.agg((F.sum(ww * yy) / F.sum(ww)).alias("m")).first().m
    null = d.agg(F.sum(ww * fam.deviance(yy, F.lit(m)))).first()[0] if offset is None else float("nan")
    disp = 1.0 if fam.fixed_dispersion else pearson / max(n - rank, 1)
    mu = fam.mean(line(beta))
    parts = d.agg(*[e.alias(n) for n, e in likelihood_sums(fam.name, yy, ww, mu).items()]).first().asDict()
    if cache:
        d.unpersist()
    return GlmFit(fam, beta, np.linalg.pinv(a), float(dev), float(null) if null is not None else float("nan"), int(n), rank, it, converged, float(disp),
                  names or [f"x{i}" for i in range(k)], loglik=log_likelihood(fam.name, parts, float(dev)))


METHODS = ("gram", "qr", "pivoted_qr", "svd")
#: Rows in a block of numbers.
BLOCK_ROWS = 2048


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function of positive numbers: Stirling's series eight places up."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.ln(x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def likelihood_sums(name: str, y: Column, w: Column, mu: Column) -> dict[str, Column]:
    """The sums over rows that a family's log-likelihood needs beside the deviance."""
    out = {"n": F.count("*").cast("double"), "sw": F.sum(w)}
    if name == "gaussian":
        return out | {"lw": F.sum(F.ln(w))}
    if name == "gamma":
        return out | {"ly": F.sum(w * F.ln(y)), "lm": F.sum(w * F.ln(mu)), "r": F.sum(w * y / mu)}
    if name == "inverse_gaussian":
        return out | {"ly": F.sum(w * F.ln(y))}
    if name == "poisson":
        return out | {"l": F.sum(w * (_xlogy(y, mu) - mu - ln_gamma(y + 1)))}
    if name == "binomial":
        # a row of weight w and share y stands for w trials with w y successes
        trials, hits = F.round(w), F.round(w * y)
        return out | {"l": F.sum(w * (_xlogy(y, mu) + _xlogy(1 - y, 1 - mu)) + F.when((y > 0) & (y < 1), ln_gamma(trials + 1) - ln_gamma(hits + 1) - ln_gamma(trials - hits + 1)).otherwise(0.0))}
    return out


def array_likelihood(name: str, y: np.ndarray, w: np.ndarray, mu: np.ndarray) -> list[float]:
    """The same sums on arrays: lw, ly, lm, r, l."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    out = [0.0] * 5
    if name == "gaussian":
        out[0] = np.log(w).sum()
    elif name == "gamma":
        out[1:4] = w @ np.log(y), w @ np.log(mu), w @ (y / mu)
    elif name == "inverse_gaussian":
        out[1] = w @ np.log(y)
    elif name == "poisson":
        out[4] = w @ (_array_xlogy(y, mu) - mu - lgamma(y + 1))
    elif name == "binomial":
        trials, hits, part = np.round(w), np.round(w * y), (y > 0) & (y < 1)
        out[4] = w @ (_array_xlogy(y, mu) + _array_xlogy(1 - y, 1 - mu))
        if part.any():
            out[4] += (lgamma(trials[part] + 1) - lgamma(hits[part] + 1) - lgamma((trials - hits)[part] + 1)).sum()
    return out


def log_likelihood(name: str, s: dict, deviance: float) -> float:
    """The maximised log-likelihood; dispersion, where there is one, at deviance over (weighted) rows."""
    if name in ("poisson", "binomial"):
        return float(s["l"])
    if name == "gaussian":
        return -(s["n"] * (math.log(2 * math.pi * deviance / s["n"]) + 1) - s["lw"]) / 2 if deviance > 0 else float("inf")
    if name == "gamma":
        shape = s["sw"] / deviance if deviance > 0 else float("inf")
        return shape * s["sw"] * math.log(shape) - s["sw"] * math.lgamma(shape) + (shape - 1) * s["ly"] - shape * s["lm"] - shape * s["r"] if math.isfinite(shape) else float("inf")
    if name == "inverse_gaussian":
        return -(s["sw"] * (math.log(deviance / s["sw"] * 2 * math.pi) + 1) + 3 * s["ly"]) / 2 if deviance > 0 else float("inf")
    return float("nan")


def _blocks(d: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The modelling frame as blocks of BLOCK_ROWS rows (columns x.., y, w, o side by side as doubles), and the number of
    partitions that hold some. Tasks get few blocks at a time, however many a partition holds."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            for at in range(0, len(m), BLOCK_ROWS):
                part = m[at : at + BLOCK_ROWS]
                yield pa.record_batch({"n": pa.array([len(part)], pa.int32()), "m": pa.array([part.tobytes()], pa.binary())})

    packed = keep(small_batches(d).select(*[f"_x{i}" for i in range(k)], "_y", "_w", "_o").mapInArrow(pack, "n int, m binary"))
    filled = packed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("b")).agg(F.count("*").alias("p"), F.sum("b").alias("b")).first()
    cores = d.sparkSession.sparkContext.defaultParallelism
    if filled.p and filled.p < min(cores, filled.b):
        return keep(packed.repartition(min(cores, filled.b))), min(cores, filled.b)
    return packed, filled.p


def _fit_blocks(d: DataFrame, k: int, fam: Family, has_offset: bool, start, tol: float, maxit: int, names: list[str], method: str) -> GlmFit:
    (blocks, filled), f = _blocks(d, k), fam.arrays
    iu = np.triu_indices(k)

    def step(beta: np.ndarray | None, mean: float | None = None, last: bool = False):
        """Cross products or factor at ``beta`` (None: at the starting means), deviance, pearson, n, weight, weighted sum of y, and
        the deviance around ``mean``."""

        def part(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            r, gram, sums = np.zeros((0, k + 1)), np.zeros(len(iu[0]) + k), np.zeros(12)
            with np.errstate(all="ignore"):
                for b in batches:
                    for n, raw in zip(b.column(0).to_pylist(), b.column(1)):
                        m = np.frombuffer(raw.as_buffer(), float).reshape(n, k + 3)
                        x, y, w, o = m[:, :k], m[:, k], m[:, k + 1], m[:, k + 2]
                        eta = f.link(f.start(y)) if beta is None else x @ beta + o
                        mu, slope = f.mean(eta), f.slope(eta)
                        var = f.variance(mu)
                        root = np.sqrt(w * slope * slope / var)
                        z = eta - o + (y - mu) / slope
                        lost = f.deviance(y, np.full(n, mean)) if mean is not None else np.zeros(n)
                        sums[:6] += [w @ f.deviance(y, mu), w @ (np.square(y - mu) / var), n, w.sum(), w @ y, w @ lost]
                        if last:
                            sums[7:] += array_likelihood(fam.name, y, w, mu)
                            continue
                        xr, zr = x * root[:, None], z * root
                        if method == "gram":
                            gram += np.concatenate([(xr.T @ xr)[iu], xr.T @ zr])
                        elif np.all(np.isfinite(xr)) and np.all(np.isfinite(zr)):
                            r = stack([r, np.column_stack([xr, zr])])
                        else:
                            sums[6] += 1
            yield pa.record_batch({"b": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64())), "s": pa.array([np.concatenate([sums, gram])], pa.list_(pa.float64()))})

        r, s = reduced(blocks.mapInArrow(part, "b bigint, r array<double>, s array<double>"), k + 1, filled)
        return r, s[12:], s[:12]

    def solve(r: np.ndarray, gram: np.ndarray, bad: float):
        if method == "gram":
            a = unpack(gram[: len(iu[0])], k)
            rank = int(np.linalg.matrix_rank(a, tol=1e-9 * max(np.max(np.abs(np.diag(a))), 1e-300)))
            return np.linalg.lstsq(a, gram[len(iu[0]) :], rcond=1e-13)[0], np.linalg.pinv(a), rank, np.ones(k, bool)
        if bad:
            raise FloatingPointError("weights or working responses are not finite")
        return solved(r[:k, :k], r[:k, k], method)

    r, gram, sums = step(None)
    mean = sums[4] / sums[3]
    beta = solve(r, gram, sums[6])[0] if start is None else np.asarray(start, float)
    dev_old, it, converged, prev = math.inf, 0, False, None
    r, gram, sums = step(beta, mean)
    null = sums[5]
    while it < maxit:
        it += 1
        halvings = 0
        while prev is not None and (not math.isfinite(sums[0]) or sums[0] > dev_old + 1e-7 * (abs(dev_old) + 0.1)) and halvings < 25:
            beta = 0.5 * (beta + prev)
            r, gram, sums = step(beta)
            halvings += 1
        if abs(sums[0] - dev_old) / (abs(sums[0]) + 0.1) < tol:
            converged = True
            break
        prev, dev_old = beta, sums[0]
        beta = solve(r, gram, sums[6])[0]
        r, gram, sums = step(beta)
    _, cov, rank, known = solve(r, gram, sums[6])
    dev, pearson, n = sums[:3]
    lw, ly, lm, ratio, own = step(beta, last=True)[2][7:]
    loglik = log_likelihood(fam.name, {"n": sums[2], "sw": sums[3], "lw": lw, "ly": ly, "lm": lm, "r": ratio, "l": own}, float(dev)) if fam.name in ARRAY_FAMILIES else float("nan")
    blocks.unpersist()
    disp = 1.0 if fam.fixed_dispersion else pearson / max(n - rank, 1)
    return GlmFit(fam, beta, cov, float(dev), float("nan") if has_offset else float(null), int(n), rank, it, converged, float(disp), names, known, loglik)


def column_bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sum, maximum and minimum of each column, long."""
    wide = df.agg(*[f(c).alias(f"{n}__{c}") for c in cols for n, f in (("sum", F.sum), ("max", F.max), ("min", F.min))])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"sum__{c}").alias("total"), F.col(f"max__{c}").alias("hi"), F.col(f"min__{c}").alias("lo")) for c in cols])
    return wide.select(F.explode(arr).alias("s")).select("s.*")
