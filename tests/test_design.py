"""Formulas, guards and trimming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import attgt as A
from panelwright.operators import did2x2 as E
from panelwright.operators.design import model_matrix, parse


def test_terms_are_crossed_and_ordered():
    terms, factors, intercept = parse("~ b:c + a*b + factor(k) - 1")
    assert terms == [("a",), ("b",), ("k",), ("b", "c"), ("a", "b")] and factors == {"k"} and not intercept
    assert parse("~ 1") == ([], set(), True)
    assert parse("~ a*b*c")[0] == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]
    for bad in ("~ a + ", "~ a ++ b", "~ log(a)", "~ a - b"):
        with pytest.raises(ValueError):
            parse(bad)


def matrix(df, formula):
    m = model_matrix(df, formula)
    return m.names, [tuple(r) for r in df.orderBy("id").select(*[c.alias(f"c{i}") for i, c in enumerate(m.columns)]).collect()]


def test_factors_get_contrasts_or_indicators(spark):
    df = spark.createDataFrame([(1, 2.0, "u", 5), (2, 3.0, "v", 7), (3, None, "w", 5), (4, 1.0, None, 7)], "id int, a double, f string, k int")
    assert matrix(df, "~ a*f") == (["(Intercept)", "a", "fv", "fw", "a:fv", "a:fw"],
                                   [(1.0, 2.0, 0.0, 0.0, 0.0, 0.0), (1.0, 3.0, 1.0, 0.0, 3.0, 0.0), (1.0, None, 0.0, 1.0, None, None), (1.0, 1.0, None, None, None, None)])
    assert matrix(df, "~ f - 1")[0] == ["fu", "fv", "fw"]
    assert matrix(df, "~ a:f")[0] == ["(Intercept)", "a:fu", "a:fv", "a:fw"]
    assert matrix(df, "~ factor(k) + a:factor(k)")[0] == ["(Intercept)", "k7", "a:k5", "a:k7"]
    assert matrix(df, "~ f + factor(k) - 1")[0] == ["fu", "fv", "fw", "k7"]
    with pytest.raises(ValueError):
        model_matrix(df, "~ z")


def panel(spark, extra):
    r = random.Random(3)
    rows = []
    for i in range(60):
        g = [None, 3, 4][i % 3]
        x = extra(i, g)
        for t in range(1, 6):
            rows.append((i, t, g, r.gauss(0, 1) + x * t + (2.0 if g and t >= g else 0.0), float(x)))
    return spark.createDataFrame(rows, "id long, t long, g long, y double, x double")


def cells(df, *args, **kw):
    return {(c.g, c.t): c for c in A.att_gt(df, A.Design(), *args, **kw).where("pre is not null").collect()}


def test_formula_equals_columns_and_guard_leaves_good_cells(spark):
    df = panel(spark, lambda i, g: i // 3 % 2)
    a, b = cells(df, "dr", ["x"]), cells(df, "dr", "~ x", guard=0.999)
    assert len(a) == 8 and all(a[k].att == pytest.approx(b[k].att) and a[k].se == pytest.approx(b[k].se) and b[k].reason is None for k in a)


def test_guard_finds_scores_near_one_and_singular_controls(spark):
    beyond = cells(panel(spark, lambda i, g: 2 if g == 4 else i // 3 % 2), "dr", ["x"], guard=0.999)
    assert {k[0] for k, c in beyond.items() if c.reason == "overlap condition violated"} == {4}
    assert all(c.att is None for k, c in beyond.items() if k[0] == 4) and all(c.att is not None for k, c in beyond.items() if k[0] == 3)
    flat = cells(panel(spark, lambda i, g: i // 3 % 2 if g else 1), "reg", ["x"], guard=0.999)
    assert {c.reason for c in flat.values()} == {"singular control design"}


def test_guard_reads_the_largest_score(spark):
    """One treated unit in 30 has a score between the limits."""
    r = random.Random(9)
    rows = [(k, float(r.random() < 1 / (1 + np.exp(-x))), x, r.gauss(0, 1)) for k, x in enumerate(np.linspace(-6, 6, 300).tolist())]
    df = spark.createDataFrame(rows, "id long, d double, x double, dy double")
    top = E.overlap_trim(df, "d", ["x"], limit=2.0).agg(F.max("ps")).first()[0]
    assert E.estimate_cells(df, "dr", "dy", "d", ["x"], guard=top + 1e-9).rows()[0].reason is None
    assert E.estimate_cells(df, "dr", "dy", "d", ["x"], guard=top - 1e-9).rows()[0].reason == "overlap condition violated"
    kept = E.overlap_trim(df, "d", ["x"], limit=0.9)
    assert kept.where("d = 1 and ps > 0.9").count() == 0 and kept.where("d = 0").count() == df.where("d = 0").count() < kept.count() < 300
