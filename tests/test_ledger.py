"""Ledgers against a walk trade by trade, with one hot day; holdings as intervals; dated splits."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.intervals import intervals, on_days
from barloom.operators import ledger

D = dt.date
COLUMNS = "portfolio string, exchange string, symbol string, date date, orderkey long, linenumber int, partkey long, suppkey long, amount double, qty long, price double, side string"


def trade(k, portfolio, exchange, symbol, day, qty, price, side):
    return (portfolio, exchange, symbol, day, k, 1, 1, 1, 0.0, qty, price, side)


def hot_day(n=3000, seed=2):
    """All trades of one portfolio in one symbol on one day, and a few of others."""
    rng, held, rows = random.Random(seed), 0, []
    for k in range(n):
        sell = held and rng.random() < 0.5
        qty = held if sell and rng.random() < 0.1 else rng.randint(1, held) if sell else rng.randint(1, 50)
        held += -qty if sell else qty
        rows.append(trade(k, "hot", "NSE", "A", D(2020, 1, 6), qty, round(rng.uniform(50, 150), 2), "sell" if sell else "buy"))
    rows += [trade(k, "cold", x, "A", D(2020, 1, 6 + k), 10 + k, 100.0, "buy") for k, x in enumerate(["NSE", "BSE", "NSE"])]
    return rows


def walk(rows):
    state, sales = defaultdict(lambda: [0, 0.0, 0.0]), {}
    for r in sorted(rows, key=lambda r: r[3:9]):
        qty, cost, gain = state[r[:3]]
        if r[-1] == "buy":
            state[r[:3]] = [qty + r[9], cost + r[9] * r[10], gain]
        else:
            profit = r[9] * r[10] - cost * r[9] / qty
            state[r[:3]] = [qty - r[9], cost * (qty - r[9]) / qty, gain + profit]
            sales[r[4]] = profit
    return state, sales


@pytest.mark.parametrize("block", [8, 256])
def test_scan_of_a_hot_day(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    monkeypatch.setattr(scan.prefix_scan, "__defaults__", (None, block))
    rows = hot_day()
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    state, sales = walk(rows)
    ordered = ledger.trades_in_order(df)
    got = {(r.portfolio, r.exchange, r.symbol): r for r in ledger.positions(ordered).collect()}
    assert set(got) == set(state)
    for key, (qty, cost, gain) in state.items():
        r = got[key]
        assert r.qty == qty and r.realised == pytest.approx(gain, abs=1e-6) and r.avg_cost == pytest.approx(cost / qty if qty else 0, abs=1e-9)
    assert {r.orderkey: r.realised for r in ledger.sale_results(ordered).collect()} == pytest.approx(sales, abs=1e-7)
    cash, money = {r.orderkey: r.cash for r in ledger.running_cash(df.filter("portfolio = 'hot'"), 500.0).collect()}, 500.0
    for r in sorted(rows[:3000], key=lambda r: r[3:9]):
        money += r[9] * r[10] * (1 if r[-1] == "sell" else -1)
        assert cash[r[4]] == pytest.approx(money, abs=1e-6)
    # no group of the scan holds more than a block
    groups = ordered.groupBy(F.shiftright("_n", block.bit_length() - 1).alias("b"), *ledger.KEYS).count()
    assert groups.agg(F.max("count")).first()[0] <= block


def test_no_lists_in_scans(spark):
    ordered = ledger.trades_in_order(spark.createDataFrame(hot_day(40), COLUMNS))
    plan = ledger.positions(ordered)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan and "Join Cross" not in plan


def test_oversold_and_empty_ledgers(spark):
    rows = [trade(1, "p", "NSE", "A", D(2020, 1, 1), 5, 10.0, "buy"), trade(2, "p", "NSE", "A", D(2020, 1, 2), 6, 10.0, "sell"), trade(3, "p", "BSE", "A", D(2020, 1, 2), 1, 10.0, "sell")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r.orderkey for r in ledger.oversold(ledger.trades_in_order(df)).collect()) == [2, 3]
    assert ledger.positions(ledger.trades_in_order(df.limit(0))).count() == 0


def test_days_in_intervals_grow_with_days_held(spark):
    states = spark.createDataFrame([("a", D(2020, 1, 10), 1), ("a", D(2020, 3, 5), 0), ("a", D(2020, 5, 1), 2), ("b", D(2020, 4, 2), 7)], "k string, date date, held int")
    days = spark.createDataFrame([(D(2020, m, d),) for m in range(1, 7) for d in (1, 10, 28)], "day date")
    held = intervals(states, ["k"]).filter("held > 0")
    got = {(r.k, r.day): r.held for r in on_days(held, days).collect()}
    at = lambda k, day: next((h for x, d, h in sorted([("a", D(2020, 1, 10), 1), ("a", D(2020, 3, 5), 0), ("a", D(2020, 5, 1), 2), ("b", D(2020, 4, 2), 7)], reverse=True) if x == k and d <= day), 0)
    want = {(k, r.day): at(k, r.day) for k in "ab" for r in days.collect() if at(k, r.day)}
    assert got == want
    before = {(r.k, r.day) for r in on_days(held, days, after=True).collect()}
    assert ("a", D(2020, 1, 10)) not in before and ("a", D(2020, 1, 28)) in before and ("a", D(2020, 5, 1)) not in before


def test_split_meets_the_position_before_its_ex_date(spark):
    rows = [trade(1, "p", "NSE", "A", D(2020, 1, 1), 5, 10.0, "buy"), trade(2, "p", "NSE", "A", D(2020, 2, 1), 3, 20.0, "buy"), trade(3, "q", "NSE", "A", D(2020, 3, 1), 9, 10.0, "buy"), trade(4, "p", "BSE", "A", D(2020, 1, 1), 7, 10.0, "buy")]
    ordered = ledger.trades_in_order(spark.createDataFrame(rows, COLUMNS))
    actions = spark.createDataFrame([("NSE", "A", D(2020, 2, 1), 1.5), ("NSE", "A", D(2020, 3, 1), 0.1), ("NSE", "A", D(2019, 1, 1), 2.0)], "exchange string, symbol string, ex_date date, volume_factor double")
    got = {r.ex_date: r for r in ledger.apply_split(ordered, actions).collect()}
    assert set(got) == {D(2020, 2, 1), D(2020, 3, 1)}  # nothing was held in 2019, q bought on the ex-date, BSE has no action
    first, second = got[D(2020, 2, 1)], got[D(2020, 3, 1)]
    assert (first.qty, first.new_qty, first.dropped_shares) == (5, 7, 0.5) and first.new_avg_cost * 7 + first.dropped_cost == pytest.approx(50)
    assert (second.qty, second.new_qty, second.new_avg_cost) == (8, 0, 0.0) and second.dropped_cost == pytest.approx(110)


def test_every_owner_of_a_symbol_meets_every_action(spark):
    rows = [trade(1, "p", "NSE", "A", D(2020, 1, 1), 5, 10.0, "buy"), trade(2, "p", "NSE", "A", D(2020, 2, 1), 5, 20.0, "sell"), trade(3, "q", "NSE", "A", D(2020, 3, 1), 4, 10.0, "sell"), trade(4, "p", "BSE", "A", D(2020, 1, 1), 7, 10.0, "buy")]
    actions = spark.createDataFrame([(1, "NSE", "A", D(2020, 1, 1)), (2, "NSE", "A", D(2020, 2, 1)), (3, "NSE", "A", D(2020, 2, 1)), (4, "NSE", "A", D(2020, 4, 1)), (5, "NSE", "B", D(2020, 4, 1))], "action_id long, exchange string, symbol string, ex_date date")
    got = {(r.portfolio, r.exchange, r.action_id): r.held for r in ledger.held_before(spark.createDataFrame(rows, COLUMNS), actions).collect()}
    assert got == {("p", "NSE", 1): 0, ("p", "NSE", 2): 5, ("p", "NSE", 3): 5, ("p", "NSE", 4): 0, ("q", "NSE", 1): 0, ("q", "NSE", 2): 0, ("q", "NSE", 3): 0, ("q", "NSE", 4): -4}


def test_cost_scan_joins_four_stretches_a_pass(spark):
    from barloom.functions.scan import in_order, prefix_scan
    rows = [("p", i, float(i % 7), 0.0 if i % 50 == 49 else (0.5 if i % 3 == 0 else 1.0)) for i in range(700)]
    ordered = in_order(spark.createDataFrame(rows, "k string, i int, v double, keep double"), ["k"], ["i"])
    out = prefix_scan(ordered, ["k"], F.col("v"), "before", "after", F.col("keep"), block=64, numbered=ordered)
    state, want = 0.0, {}
    for _, i, v, keep in rows:
        state = keep * state + v
        want[i] = state
    assert {r["i"]: r["after"] for r in out.collect()} == pytest.approx(want)
    passes = out._jdf.queryExecution().optimizedPlan().toString().count("Window [lag(_a")
    assert passes <= 12, passes  # three passes and a step over 64 rows, not seven; before: 2 a doubling


def test_value_on_the_last_day_is_the_last_snapshot(spark):
    """Sums up to a day say what snapshots say of it, of portfolios that hold nothing, too; no window over portfolios' days is needed."""
    from barloom.operators import lake
    rng, series = random.Random(7), ["EQ", "BE", "BZ"]
    rows = [trade(k, f"P{rng.randrange(4)}", rng.choice(["NSE", "BSE"]), rng.choice("ABC"), D(2020, 1, 1) + dt.timedelta(rng.randrange(120)), rng.randint(1, 9), float(k), rng.choice(["buy", "buy", "sell"])) for k in range(150)]
    rows.append(trade(200, "late", "NSE", "A", D(2020, 4, 20), 5, 10.0, "buy"))
    trades = spark.createDataFrame(rows, COLUMNS).withColumn("series", F.element_at(F.array(*[F.lit(s) for s in series]), (F.col("orderkey") % 3 + 1).cast("int"))).withColumn("discount", F.lit(0.0))
    days = spark.createDataFrame([(D(2020, m, 1),) for m in range(1, 5)], "date date")
    bench = spark.createDataFrame([(D(2020, 1, 1), 1.0)], "date date, close double")
    closes = lake.one_series_per_day(lake.bars_from_trades(trades, F.col("orderkey")), series, ("exchange", "symbol", "date"))
    want = {r.portfolio: r.market_value for r in ledger.daily_snapshots(trades, closes, days, bench, 1e6).filter("date = '2020-04-01'").collect()}
    day = F.lit("2020-04-01").cast("date")
    out = ledger.value_on(trades, lake.last_trade_closes(trades, day, ["orderkey"], series), day)
    got = {r.portfolio: r.market_value for r in out.collect()}
    assert set(got) == set(want) and len(want) == 5 and want["late"] == 0
    assert all(got[p] == pytest.approx(want[p]) for p in want) and sum(v > 0 for v in got.values()) > 1
