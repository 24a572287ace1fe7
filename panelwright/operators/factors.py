"""Triangular factors of tall matrices: one per task, stacked and factored again,
and what small factors are solved with.

A factor keeps the singular values of the rows it stands for, where their cross
products square them: designs of condition 1e9 keep their coefficients and rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import col
from panelwright.session import keep

#: What counts as nothing beside the largest column or singular value: rounding of stacked factors with a margin.
TINY = 1e-12
#: Factors that the driver stacks itself; more are first stacked in groups by tasks.
STACKED = 64


def stack(factors: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of matrices on top of one another."""
    return np.linalg.qr(np.vstack(factors), mode="r")


def reduced(parts: DataFrame, width: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and sums of the rows of ``tasks`` tasks (r: factor of ``width`` columns, row by row; s: sums, b: number of the task).

    Beyond STACKED rows, groups of about the square root of their number are stacked by tasks first: neither a task nor the
    driver holds more than so many small factors."""

    def join(f: pd.DataFrame) -> pd.DataFrame:
        r = stack([np.asarray(v).reshape(-1, width) for v in f["r"]])
        return pd.DataFrame({"b": [f["b"].iloc[0]], "r": [r.ravel()], "s": [np.sum(np.vstack(f["s"].to_numpy()), axis=0)]})

    if tasks > STACKED:
        groups = int(np.ceil(np.sqrt(tasks)))
        parts = parts.groupBy(F.pmod("b", F.lit(groups)).alias("g")).applyInPandas(join, "b bigint, r array<double>, s array<double>")
    rows = parts.collect()
    if not rows:
        return np.zeros((0, width)), np.zeros(0)
    return stack([np.asarray(x.r).reshape(-1, width) for x in rows]), np.sum([x.s for x in rows], axis=0)


def pivoted(r: np.ndarray, tol: float = TINY) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Householder factor with column pivoting: triangle, orthogonal factor, order of the columns, rank.

    The next column is that with the largest rest; a rest of at most ``tol`` times the first ends the rank."""
    a, m = np.array(r, float), min(r.shape)
    q, order = np.eye(len(a)), np.arange(a.shape[1])
    first, rank = 0.0, 0
    for j in range(m):
        norms = np.sqrt(np.square(a[j:, j:]).sum(axis=0))
        p = j + int(np.argmax(norms))
        if j == 0:
            first = norms.max(initial=0.0)
        if norms[p - j] <= first * tol:
            break
        a[:, [j, p]], order[[j, p]] = a[:, [p, j]], order[[p, j]]
        v = a[j:, j].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[j:, j:] -= 2 * np.outer(v, v @ a[j:, j:])
        q[:, j:] -= 2 * np.outer(q[:, j:] @ v, v)
        rank += 1
    return np.triu(a), q, order, rank


def independent(r: np.ndarray, tol: float = 1e-7) -> list[int]:
    """Columns, in order, that those before them do not explain: a rest of at most ``tol`` times the column counts as none."""
    kept: list[int] = []
    basis = np.zeros((r.shape[0], 0))
    for j in range(r.shape[1]):
        size = np.linalg.norm(r[:, j])
        v = r[:, j] / size if size > 0 else r[:, j]
        for _ in range(2):  # twice, so that rounding leaves nothing of the basis
            v = v - basis @ (basis.T @ v)
        rest = np.linalg.norm(v)
        if size > 0 and rest > tol:
            kept.append(j)
            basis = np.column_stack([basis, v / rest])
    return kept


def solved(r: np.ndarray, c: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Coefficients, inverse of r'r, rank and which coefficients are estimated, from a triangle and the rotated response.

    qr: no pivoting, a singular triangle is an error; pivoted_qr: columns beyond the rank get no coefficient (0, not estimated);
    svd: minimum norm."""
    k = r.shape[1]
    if method == "qr":
        d = np.abs(np.diag(r))
        if len(r) < k or d.min(initial=np.inf) <= TINY * d.max(initial=0.0):
            raise np.linalg.LinAlgError("the design is singular; use pivoted_qr or svd")
        inv = np.linalg.solve(r, np.eye(k))
        return inv @ c, inv @ inv.T, k, np.ones(k, bool)
    if method == "pivoted_qr":
        t, q, order, rank = pivoted(r)
        inv = np.linalg.solve(t[:rank, :rank], np.eye(rank))
        beta, cov, known = np.zeros(k), np.zeros((k, k)), np.zeros(k, bool)
        used = order[:rank]
        beta[used], known[used] = inv @ (q.T @ c)[:rank], True
        cov[np.ix_(used, used)] = inv @ inv.T
        return beta, cov, rank, known
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    ok = s > TINY * s.max(initial=0.0)
    v = vt[ok].T / s[ok]
    return v @ (u[:, ok].T @ c), v @ v.T, int(ok.sum()), np.ones(k, bool)


def column_factor(df: DataFrame, xs: list) -> np.ndarray:
    """Triangular factor of columns over all rows."""
    k = len(xs)

    def part(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        r = np.zeros((0, k))
        for b in batches:
            r = stack([r, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])])
        yield pa.record_batch({"b": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64())), "s": pa.array([[0.0]], pa.list_(pa.float64()))})

    cols = df.select(*[col(x).cast("double").alias(f"c{i}") for i, x in enumerate(xs)])
    parts = keep(cols.mapInArrow(part, "b bigint, r array<double>, s array<double>"))
    return reduced(parts, k, parts.count())[0]
