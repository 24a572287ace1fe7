"""Registered queries against their SQL counterparts."""

import math
import os

import duckdb
import pytest

from panelwright.plans import load_all
from panelwright.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
load_all()

SAMPLE = ["panel_collapse", "panel_priority_union", "panel_did_standardize", "treat_activity_pct", "diff_cells", "a_quantile", "j_control_range", "gt_support", "att_gt", "gt_2x2_unbalanced",
          "agg_dynamic", "did_dr_panel", "did_dr_rc", "twfe_static", "sunab", "glm_fit", "loo_att", "placebo_schedule", "coverage_unit", "dose_change",
          "att_gt_zero_coded", "att_gt_no_never", "fe_predict_components", "f_distribution", "joint_holm", "src_wide", "a_slope",
          "imputation_att", "imputation_weights", "loo_cumulative", "loo_sunab", "boot_wild_cluster_region", "placebo_permute", "placebo_date_shift", "coverage_sweep_effects", "glm_fit_qr", "glm_aliased", "glm_loglik", "p_collinear_drop", "resid_pool",
          "p_covariate_matrix", "did_formula_factor", "udf_formula", "panel_overlap_trim", "gt_v1_guards", "sink_partial"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.execute(SQL[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(v, str) for v in a) else a == b


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 250


@pytest.mark.parametrize("name", ["did_aipw", "did_aipw_rc"])
def test_rows_are_not_dealt_by_stratum(spark, name):
    """Rows meet the two strata's means where they lie, whatever Spark takes the strata's size for."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert any("Join Inner" in line and "x1" in line and "strategy=broadcast" in line for line in plan.splitlines()), plan
