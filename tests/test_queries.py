"""Entry contract, and a selection of registered queries against their SQL twins at the smallest scale.
`tools/check.py` runs every query at sf0.01."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
from check import TABLES, rows  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
PICKED = ["t0_bars_daily", "l6_bars_with_identity", "l8_panel", "l10_liquidity_metrics", "d7_index_problems", "d10_adjusted_jumps", "i3_symbol_history_from_changes", "i5_inherit_class",
          "i12_trading_days_between", "c1_parse_subjects", "c2_ratio_factors", "c9_factor_timeline", "c12_reparse", "f3_rsi", "f7_prior_extremes", "p6_ttm", "r2_comparators", "r7_score", "r14_swing_pullback_ema",
          "t2_charges", "t7_next_open_entry_symbol", "t7_next_open_entry_market", "t8_first_exit_market_clock", "t13_touch_fills", "t14_oco_first", "w1_windows", "w3_best_params", "v1_picks_view",
          "v10_run_summary", "b1_positions", "b2_running_cash", "b9_daily_snapshots", "s1_full_daily", "s2_legacy_daily", "s3_scripcode_daily", "s4_udiff", "s5_index_close", "s6_security_list", "s7_symbol_changes", "s8_price_bands", "s9_holidays", "s10_actions_json",
          "s11_filing_index", "s12_candles_json", "s13_union_sources", "s14_replace_dates", "s15_partition_manifest", "s16_dedupe_artifacts", "x1_candles"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


def test_contract_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert {n for n in set(q) - set(o) if not n.startswith("op") and n != "pipeline"} == set()


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"rule", "symbol", "date", "rank", "score"} <= set(df.columns)


@needs_data
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())
