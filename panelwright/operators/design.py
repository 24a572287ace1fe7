"""One-sided formulas as column expressions.

``~ a + b:c + a*b + factor(f) - 1``: variables are columns, ``:`` multiplies, ``*`` stands for both variables and their
product, ``factor()`` turns numbers into categories; text and boolean columns are categories anyway. Categories become
treatment contrasts (the first level in sorted order is the base) or, where the term without the category is not in the
model, one indicator a level. Products are made row by row, so nothing is shuffled but the distinct levels."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
MAX_LEVELS = 10_000  # levels of a category that are sent to the driver; more is an error


@dataclass
class ModelMatrix:
    """Names and column expressions of a design, with ``intercept`` telling whether the first one is constant."""

    names: list[str]
    columns: list[Column]
    intercept: bool

    def covariates(self) -> list[Column]:
        """Without the constant, for estimators that add their own."""
        return self.columns[1:] if self.intercept else self.columns


def parse(formula: str) -> tuple[list[tuple[str, ...]], set[str], bool]:
    """Terms in order (lower orders first, repeats left out), variables wrapped in factor(), whether there is an intercept."""
    text = formula.split("~", 1)[1] if formula.strip().startswith("~") else formula
    text = re.sub(r"\s+", "", text)
    found, factors, intercept = [], set(), True
    for sign, part in re.findall(r"([+-]?)([^+-]+)", text):
        if part in ("0", "1"):
            intercept = (part == "1") == (sign != "-")
            continue
        if sign == "-":
            raise ValueError(f"only the intercept can be left out: -{part}")
        groups = []
        for crossed in part.split("*"):
            names = []
            for v in crossed.split(":"):
                m = re.fullmatch(rf"factor\(({NAME})\)|({NAME})", v)
                if not m:
                    raise ValueError(f"not a term: {v!r} in {formula!r}")
                if m[1]:
                    factors.add(m[1])
                names.append(m[1] or m[2])
            groups.append(names)
        for size in range(1, len(groups) + 1):
            for chosen in combinations(groups, size):
                found.append(tuple(dict.fromkeys(v for names in chosen for v in names)))
    if text and "".join(a + b for a, b in re.findall(r"([+-]?)([^+-]+)", text)) != text:
        raise ValueError(f"not a formula: {formula!r}")
    terms, seen = [], set()
    for t in sorted(found, key=len):
        if frozenset(t) not in seen:
            seen.add(frozenset(t))
            terms.append(t)
    return terms, factors, intercept


def levels(df: DataFrame, name: str) -> list:
    """Sorted distinct values, nulls left out; at most MAX_LEVELS."""
    got = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(got) > MAX_LEVELS:
        raise ValueError(f"{name} has more than {MAX_LEVELS} levels")
    return sorted(got)


def model_matrix(df: DataFrame, formula: str) -> ModelMatrix:
    """A row with a null in a variable gets null in that variable's columns."""
    terms, wrapped, intercept = parse(formula)
    types = {f.name: f.dataType for f in df.schema.fields}
    used = list(dict.fromkeys(v for t in terms for v in t))
    missing = [v for v in used if v not in types]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    categories = {v: levels(df, v) for v in used if v in wrapped or isinstance(types[v], (T.StringType, T.BooleanType))}
    present = {frozenset(t) for t in terms} | ({frozenset()} if intercept else set())
    names, columns = (["(Intercept)"], [F.lit(1.0)]) if intercept else ([], [])
    for t in terms:
        sides = []
        for v in t:
            if v not in categories:
                sides.append([(v, F.col(v).cast("double"))])
                continue
            # Without the intercept the first category of all is coded by indicators, as is one whose lower term is absent.
            base = 1 if frozenset(t) - {v} in present else 0
            sides.append([(f"{v}{x}", (F.col(v) == F.lit(x)).cast("double")) for x in categories[v][base:]])
            present |= {frozenset()} if len(t) == 1 and not base else set()
        for cell in product(*reversed(sides)):
            cell = cell[::-1]
            names.append(":".join(n for n, _ in cell))
            value = cell[0][1]
            for _, c in cell[1:]:
                value = value * c
            columns.append(value)
    return ModelMatrix(names, columns, intercept)


def with_covariates(df: DataFrame, xs: list | str | None) -> tuple[DataFrame, list | None]:
    """Covariates as column names; a formula's columns are added to the frame."""
    if not isinstance(xs, str):
        return df, xs
    m = model_matrix(df, xs)
    if not m.intercept:
        raise ValueError("covariate formulas keep their intercept")
    added = {f"_f{i}": c for i, c in enumerate(m.covariates())}
    return df.withColumns(added) if added else df, list(added)
