"""Inputs that the given tables never hold: nothing may vanish, loosen or turn into a number without a word."""

import datetime as dt

import pytest

from barloom.functions import rules as rl
from barloom.operators import identity as idn
from barloom.operators import ledger
from barloom.operators import outcomes as oc
from barloom.rules import seed_rules
from barloom.sources import daily_files as df
from barloom.sources import store

D = dt.date


def test_rename_chain_of_forty(spark):
    changes = spark.createDataFrame([(f"S{k}", f"S{k + 1}", D(2000, 1, 1) + dt.timedelta(k)) for k in range(40)], "old_symbol string, new_symbol string, changed_on date")
    listings = spark.createDataFrame([("NSE", "S40", 7)], "exchange string, symbol string, security_id long")
    got = idn.symbol_history_from_changes(changes, listings, "NSE").collect()
    assert len(got) == 40 and {(r.status, r.final_symbol, r.security_id) for r in got} == {("resolved", "S40", 7)}
    classes = spark.createDataFrame([("S40", "equity")], "symbol string, instrument_class string")
    assert idn.inherit_class(changes, classes).count() == 40


def test_rename_circle_ends(spark):
    day = D(2000, 1, 1)
    changes = spark.createDataFrame([("A", "B", day), ("B", "A", day)], "old_symbol string, new_symbol string, changed_on date")
    assert {r.complete for r in idn.rename_targets(changes).collect()} == {False}


def test_rate_above_a_thousand(spark):
    flows = spark.createDataFrame([("P", D(2024, 1, 1), -1.0), ("P", D(2024, 2, 1), 2.0)], "portfolio string, date date, amount double")
    assert ledger.xirr(flows).first().xirr == pytest.approx(2 ** (365 / 31) - 1)


@pytest.mark.parametrize("change", [lambda s: s.update(surprise=1), lambda s: s["universe"].update(min_median_turnover=1), lambda s: s["entry"].update(extra=1)])
def test_unknown_keys_raise(spark, change):
    spec = {"slug": "x", "universe": {"min_median_turnover_inr": 5}, "entry": {"left": {"ind": "close"}, "op": ">", "right": 1}}
    rl.entry_column(spec, ["close"])
    change(spec)
    with pytest.raises(KeyError):
        rl.entry_column(spec, ["close"])


def test_liquidity_floor_of_a_shipped_rule_holds(spark):
    bars = spark.createDataFrame([(100.0, 1.0, 500), (100.0, 3e7, 500)], "close_raw double, turnover_med20 double, bar_count int")
    for spec in seed_rules().values():
        assert [r.ok for r in bars.select(rl.universe_column(spec["universe"], bars.columns).alias("ok")).collect()] == [False, True]


def _panel(spark, days):
    return spark.createDataFrame([("A", D(2024, 1, d), 10.0, 11.0, 9.0, 10.0) for d in days], "symbol string, date date, open double, high double, low double, close double")


def test_picks_without_a_bar_stay(spark):
    picks = spark.createDataFrame([("A", D(2024, 1, 3)), ("A", D(2024, 1, 1)), ("Z", D(2024, 1, 1)), ("Z", D(2024, 1, 19))], "symbol string, date date").selectExpr(
        "*", "0.5 AS stop_pct", "CAST(NULL AS DOUBLE) AS target_pct", "2 AS hold_days")
    got = {(r.symbol, r.date.day): (r.status, r.entry_date) for r in oc.track_picks(picks, _panel(spark, [2, 4, 5, 8, 9]), ["date"], "2024-01-20").select("symbol", "date", "status", "entry_date").collect()}
    assert got == {("A", 3): ("closed", D(2024, 1, 4)), ("A", 1): ("closed", D(2024, 1, 2)), ("Z", 1): ("void", None), ("Z", 19): ("pending_entry", None)}


def test_order_without_expiry_fills(spark):
    orders = spark.createDataFrame([(1, "A", "limit", "buy", 5, None, 9.5, None, "open", dt.datetime(2024, 1, 2, 10), None)],
                                   "order_id int, symbol string, type string, side string, qty int, oco_group long, limit_price double, trigger_price double, status string, created_at timestamp, valid_until timestamp")
    candles = spark.createDataFrame([("A", dt.datetime(2024, 3, d, 10), dt.datetime(2024, 3, d, 11), 10.0, 11.0, low, 10.0) for d, low in ((4, 9.8), (5, 9.0), (6, 8.0))],
                                    "symbol string, candle_start timestamp, candle_end timestamp, open double, high double, low double, close double")
    got = oc.touch_fills(orders, candles).collect()
    assert [(r.order_id, r.candle_start.day, r.fill_price) for r in got] == [(1, 5, 9.5)]


def test_bad_number_fails_the_read(spark):
    row = {"SYMBOL": "A", "SERIES": "EQ", "DATE1": "17-Sep-2026", "PREV_CLOSE": "1", "OPEN_PRICE": "1", "HIGH_PRICE": "1", "LOW_PRICE": "1", "LAST_PRICE": "-", "CLOSE_PRICE": "1,000.5", "AVG_PRICE": "1",
           "TTL_TRD_QNTY": "1", "TURNOVER_LACS": "1", "NO_OF_TRADES": "1", "DELIV_QTY": "-", "DELIV_PER": " "}
    good = df.normalise_full_daily(spark.createDataFrame([row])).first()
    assert (good.close, good["last"], good.delivery_qty) == (1000.5, None, None)
    with pytest.raises(Exception, match="not a number in CLOSE_PRICE"):
        df.normalise_full_daily(spark.createDataFrame([{**row, "CLOSE_PRICE": "12x"}])).collect()


def test_lake_reader_prunes_folders_and_knows_an_absent_lake(spark, tmp_path):
    bars = spark.createDataFrame([(ex, f"S{k}", D(2020 + y, 1, 2), float(k), 5) for ex in ("NSE", "BSE") for y in range(4) for k in range(3)], "exchange string, symbol string, date date, close double, volume long")
    path = str(tmp_path / "lake")
    assert store.read_bars(spark, path, bars.schema, "NSE").schema.names == bars.columns and store.read_bars(spark, path, bars.schema).count() == 0
    store.write_bars(bars, path)
    assert sorted(map(tuple, store.read_bars(spark, path, bars.schema).collect())) == sorted(map(tuple, bars.collect()))
    got = store.read_bars(spark, path, bars.schema, "NSE", "2021-06-01", "2022-12-31")
    assert {(r.exchange, r.date.year) for r in got.collect()} == {("NSE", 2022)} and len(got.inputFiles()) >= 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "exchange" in folders and "year" in folders and got.count() == 3


def test_manifest_sees_pairs_of_equal_rows(spark):
    row = ("NSE", "A", D(2020, 1, 2), 1.0)
    schema = "exchange string, symbol string, date date, close double"
    old, new = (store.partition_manifest(spark.createDataFrame([row, row, *[("NSE", "B", D(2020, 1, 2), v)] * 2], schema)) for v in (1.0, 2.0))
    assert [r.problem for r in store.verify_manifest(old, new).collect()] == ["content"]
