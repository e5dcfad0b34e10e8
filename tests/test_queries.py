"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from tessera import plans
from tessera.plans.base import QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["ts_mean", "ts_corr", "ewm_mean", "ts_rank_pct", "cs_rank", "cs_neutralize_both", "dsl_formula_5", "factor_liquidity", "factor_value", "asof_merge", "fin_lag_report", "interval_attach",
        "daily_rankic", "ic_newey_west", "jaccard_turnover", "decile_monotonicity", "ic_retention", "tradability_diagnostics", "signal_diagnosis", "limit_flags_official", "neutralize_controls", "portfolio_metrics", "industry_intervals", "trial_memory", "greedy_prune", "ic_p_values", "factor_quality", "factor_growth", "week_schedule", "limit_flags", "topk_industry_cap", "perf_metrics", "doc_identity_dedup", "html_strip", "stream_daily_counts"]


def test_every_sql_has_a_query():
    q, s = plans.queries(), plans.oracles()
    assert set(s) <= set(q) and len(q) > 90 and q is QUERIES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = plans.queries()[name](spark, SF)
    rel = c.execute(plans.oracles()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, rel.fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
