import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import rules as rl
from barloom.operators import actions as act
from barloom.operators import costs as cs
from barloom.operators import evaluation as ev
from barloom.operators import fundamentals as fd
from barloom.operators import identity as idn
from barloom.operators import lake
from barloom.operators import ledger as lg
from barloom.operators import outcomes as oc
from barloom.operators import screening as sc
from barloom.rules import seed_rules

D = dt.date


@pytest.mark.parametrize("subject,status,types,factors", [
    ("Bonus 1:1", "parsed", ["bonus"], [0.5]),
    ("Bonus- 1:2", "parsed", ["bonus"], [2 / 3]),
    ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share", "parsed", ["split"], [0.1]),
    ("Interim Dividend - Rs 5 Per Share And Bonus 1:1", "parsed", ["dividend", "bonus"], [None, 0.5]),
    ("Rights 1:5 @ Premium Rs 74/-", "parsed", ["rights"], [None]),
    ("Rights 3:19", "ambiguous", ["rights"], [None]),
    ("Sub-Division Of Something", "unparsed", [None], [None]),
    ("Interimdividend Re 1", "parsed", ["dividend"], [None]),
    ("Nterest Amount- Rs 3.0556/Return On Capital", "ambiguous", ["distribution"], [None]),
    ("Scheme Of Arangement", "parsed", ["demerger"], [None]),
])
def test_subjects(spark, subject, status, types, factors):
    got = act.parse_subjects(spark.createDataFrame([(1, subject)], "action_id int, subject string")).orderBy("clause").collect()
    assert [r.action_type for r in got] == types
    assert [r.parse_status for r in got] == [status] * len(types)
    assert [r.price_factor for r in got] == [pytest.approx(f) if f else None for f in factors]
    assert all(r.price_factor * r.volume_factor == pytest.approx(1) for r in got if r.price_factor)


def test_ex_date_bar_is_not_adjusted_and_same_day_factors_multiply(spark):
    bars = spark.createDataFrame([("NSE", "A", D(2024, 1, d), 100.0, 5) for d in (1, 2, 3)], "exchange string, symbol string, date date, close double, volume long")
    acts = spark.createDataFrame([("NSE", "A", D(2024, 1, 2), 0.2, 5.0), ("NSE", "A", D(2024, 1, 2), 0.5, 2.0)], "exchange string, symbol string, ex_date date, price_factor double, volume_factor double")
    tl = act.factor_timeline(acts)
    assert [round(r.cumulative_price_factor, 12) for r in tl.collect()] == [0.1]
    got = {r.date.day: (round(r.close, 9), r.volume) for r in act.adjust_bars(bars, tl).collect()}
    assert got == {1: (10.0, 50), 2: (100.0, 5), 3: (100.0, 5)}


def test_rights_factor(spark):
    f = lambda n, d, issue, cum: spark.range(1).select(act.rights_factor(*[F.lit(float(x)) for x in (n, d, issue, cum)]).alias("f")).first().f
    assert f(1, 1, 50, 100) == pytest.approx(0.75)
    assert f(1, 1, 100, 100) == 1.0
    assert f(20, 1, 1, 100) is None


def test_golden_charges(spark):
    t = spark.createDataFrame([("P", "A", D(2026, 9, 18), "NSE", "delivery", "sell", 50, 100.0)], "portfolio string, symbol string, date date, exchange string, product string, side string, qty long, price double")
    assert cs.charges(t).first().total == Decimal("5.19")
    assert cs.dp_charges(t.union(t)).collect()[0].dp_charge == Decimal("15.34")


def test_slippage_unknown_is_worst(spark):
    df = spark.createDataFrame([(None,), (6e8,), (2e7,), (1.0,)], "a double").select(cs.slippage_bps(F.col("a")).alias("b"))
    assert [r.b for r in df.collect()] == [40, 5, 20, 40]


def path(spark, bars):
    p = spark.createDataFrame([("A", D(2024, 1, 1) + dt.timedelta(i), *map(float, b)) for i, b in enumerate(bars)], "symbol string, date date, open double, high double, low double, close double")
    return oc.numbered_bars(p).withColumn("lock", F.lit("none"))


def outcome(spark, bars, stop, target, hold):
    b = path(spark, bars)
    s = spark.createDataFrame([("A", D(2024, 1, 1), stop, target, hold)], "symbol string, date date, stop_pct double, target_pct double, hold_days int")
    return oc.first_exit(oc.next_open_entry(s, b), b, ["date"]).first()


def test_exit_order(spark):
    flat = (100, 100, 100, 100)
    o = outcome(spark, [flat, (100, 120, 80, 100), (100, 120, 80, 100)], 0.1, 0.1, 5)
    assert (o.exit_reason, o.exit_price, o.holding_days) == ("stop", 90.0, 1)  # no exit on the entry bar; the stop wins a tie
    o = outcome(spark, [flat, flat, (85, 85, 80, 82)], 0.1, None, 5)
    assert (o.exit_reason, o.exit_price) == ("stop_gap", 85.0)
    o = outcome(spark, [flat, flat, (115, 116, 114, 115)], 0.1, 0.1, 5)
    assert (o.exit_reason, o.exit_price) == ("target_gap", 115.0)
    o = outcome(spark, [flat] * 6, 0.1, 0.1, 3)
    assert (o.exit_reason, o.holding_days, o.status) == ("time", 3, "closed")
    o = outcome(spark, [flat, flat, (100, 105, 99, 104)], 0.1, 0.1, 9)
    assert (o.status, o.exit_reason, round(o.net_return, 9), round(o.mfe, 9), round(o.mae, 9)) == ("open", None, 0.04, 0.05, -0.01)


def test_locked_bar_defers_the_exit(spark):
    flat = (100, 100, 100, 100)
    b = path(spark, [flat, flat, (80, 80, 80, 80), (80, 80, 80, 80), (70, 75, 65, 72)]).withColumn("lock", F.when(F.col("open") == 80, "lower").otherwise("none"))
    s = spark.createDataFrame([("A", D(2024, 1, 1), 0.1, None, 2)], "symbol string, date date, stop_pct double, target_pct double, hold_days int")
    o = oc.first_exit(oc.next_open_entry(s, b), b, ["date"], defer_locks=True).first()
    assert (o.exit_price, o.holding_days, o.exit_reason) == (70.0, 3, "stop_gap")


def scores(spark, values, direction):
    c = spark.createDataFrame([("r", "", D(2024, 1, 1), f"S{i}", v) for i, v in enumerate(values)], "rule string, variant string, date date, symbol string, r0 double")
    c = c.withColumn("w0", F.lit(1.0)).withColumn("asc0", F.lit(direction == "asc"))
    return [round(r.score, 4) for r in sc.score(c).orderBy("symbol").collect()]


def test_best_value_scores_highest_either_way_and_missing_scores_zero(spark):
    assert scores(spark, [10.0, 20.0, 30.0, None], "desc") == [33.3333, 66.6667, 100.0, 0.0]
    assert scores(spark, [10.0, 20.0, 30.0, None], "asc") == [100.0, 66.6667, 33.3333, 0.0]
    assert scores(spark, [1.0, 1.0], "desc") == [75.0, 75.0]


def test_rank_keys_are_added_in_their_order(spark):
    """Symbols whose keys were ranked in other orders, with sums that differ in the last digit by the order of adding."""
    n = 11
    rows = [("r", "", D(2020, 1, 1), f"s{i:02}", float(i), float(-i), float(i * 7 % n), 0.1, 0.7, 0.2, False, False, False) for i in range(n)]
    cols = "rule string, variant string, date date, symbol string, r0 double, r1 double, r2 double, w0 double, w1 double, w2 double, asc0 boolean, asc1 boolean, asc2 boolean"
    rank = lambda k: {r[3]: sum(x[4 + k] <= r[4 + k] for x in rows) / n for r in rows}
    a, b, c = (rank(k) for k in range(3))
    want = {s: ((0.1 * a[s] + 0.7 * b[s]) + 0.2 * c[s]) / ((0.1 + 0.7) + 0.2) * 100 for s in a}
    assert {r.symbol: r.score for r in sc.score(spark.createDataFrame(rows, cols)).collect()} == want


def test_missing_is_false_before_not(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    node = {"not": {"left": {"ind": "x"}, "op": ">", "right": 10}}
    assert df.filter(rl.rule_column(node, {}, df.columns)).count() == 2
    with pytest.raises(KeyError):
        rl.rule_column({"left": {"ind": "nope"}, "op": ">", "right": 1}, {}, df.columns)
    with pytest.raises(KeyError):
        rl.resolve_params({"params": {}}, {"a": 1})


def test_seed_rules_compile(spark):
    rules = seed_rules()
    assert len(rules) == 10
    names = set()

    def collect(n):
        if isinstance(n, dict):
            if "ind" in n:
                names.add(rl.feature_name(n["ind"], n.get("period")))
            for v in n.values():
                collect(v)
        elif isinstance(n, list):
            for v in n:
                collect(v)
    collect(list(rules.values()))
    cols = sorted(names | {"close_raw", "turnover_med20", "bar_count", "series", "prev_rsi14"})
    for r in rules.values():
        rl.entry_column(r, cols)
    assert len(rl.param_grid(rules["swing_pullback_ema"])) == 3


def test_positions_average_cost(spark):
    rows = [("P", "A", D(2024, 1, 1), 0, 1, "buy", 10, 100.0), ("P", "A", D(2024, 1, 1), 0, 2, "buy", 10, 200.0), ("P", "A", D(2024, 1, 2), 0, 3, "sell", 20, 300.0),
            ("P", "A", D(2024, 1, 3), 0, 4, "buy", 4, 50.0), ("P", "A", D(2024, 1, 3), 1, 5, "sell", 1, 60.0)]
    t = spark.createDataFrame(rows, "portfolio string, symbol string, date date, block long, orderkey long, side string, qty long, price double")
    for c in ("linenumber", "partkey", "suppkey", "amount"):
        t = t.withColumn(c, F.lit(1))
    t = t.withColumn("exchange", F.lit("NSE"))
    p = lg.positions(t).first()
    assert (p.qty, p.avg_cost, p.realised) == (3, 50.0, 20 * 150.0 + 10.0)
    assert sorted(r.realised for r in lg.sale_results(t).collect()) == [10.0, 3000.0]
    over = t.union(t.limit(1).withColumn("side", F.lit("sell")).withColumn("qty", F.lit(99)).withColumn("orderkey", F.lit(9)).withColumn("date", F.lit("2024-01-09").cast("date")))
    assert lg.oversold(over).count() == 1


def test_xirr(spark):
    f = spark.createDataFrame([("a", D(2023, 1, 1), -100.0), ("a", D(2024, 1, 1), 112.0), ("b", D(2023, 1, 1), -100.0), ("c", D(2023, 1, 1), -5.0), ("c", D(2023, 1, 1), 5.0)], "portfolio string, date date, amount double")
    got = {r.portfolio: r.xirr for r in lg.xirr(f).collect()}
    assert got["a"] == pytest.approx(0.12, abs=1e-9) and got["b"] is None and got["c"] is None


def test_restatement_replaces_a_quarter_from_its_own_date(spark):
    q = [(D(2023, 3, 31), D(2023, 5, 1), 1.0), (D(2023, 6, 30), D(2023, 8, 1), 1.0), (D(2023, 9, 30), D(2023, 11, 1), 1.0), (D(2023, 12, 31), D(2024, 2, 1), 1.0), (D(2023, 6, 30), D(2024, 3, 1), 5.0)]
    f = spark.createDataFrame([("A", *r) for r in q], "symbol string, period_end date, available_on date, q_eps double")
    got = {r.available_on: r.q_eps_ttm for r in fd.ttm(f, ["q_eps"]).collect()}
    assert got == {D(2024, 2, 1): 4.0, D(2024, 3, 1): 8.0}


def test_gate_matrix(spark):
    def verdict(outcomes, trades, dd):
        rows = [("r", "swing", o, trades, dd) for o in outcomes]
        return ev.gate(spark.createDataFrame(rows, "rule string, horizon string, outcome string, trade_count int, max_drawdown double")).first().verdict
    assert verdict(["pass"] * 6, 10, -0.1) == "pass"
    assert verdict(["pass"] * 5 + ["no_trades"], 10, -0.1) == "insufficient_evidence"
    assert verdict(["pass"] * 3 + ["fail"] * 3, 10, -0.1) == "fail"
    assert verdict(["pass"] * 6, 10, -0.3) == "fail"
    assert verdict(["pass"] * 6, 1, -0.1) == "insufficient_evidence"


def test_identity_join_does_not_multiply_bars(spark):
    bars = spark.createDataFrame([("NSE", "A", D(2024, 1, 1), None)], "exchange string, symbol string, date date, security_id long")
    hist = spark.createDataFrame([(7, "NSE", "A", D(2020, 1, 1), D(2024, 1, 1))], "security_id long, exchange string, symbol string, valid_from date, valid_to date")
    lst = spark.createDataFrame([("NSE", "A", "EQ", 9), ("NSE", "A", "BE", 9)], "exchange string, symbol string, series string, security_id long")
    sec = spark.createDataFrame([(7, "I7", "Seven"), (9, "I9", "Nine")], "security_id long, isin string, company_name string")
    got = lake.bars_with_identity(bars, hist, lst, sec).collect()
    assert [(r.resolved_id, r.isin) for r in got] == [(9, "I9")]  # valid_to is exclusive


def test_filing_facts_ignore_dimensions_and_comments(spark):
    xml = """<xbrl><xbrli:context id="OneD"><xbrli:entity/></xbrli:context><xbrli:context id="OneI"><xbrli:scenario/></xbrli:context>
    <in:ProfitBeforeTax unitRef="INR" contextRef="OneD"> 12.5 </in:ProfitBeforeTax><in:Equity contextRef="OneI" unitRef="INR">9</in:Equity>
    <in:BasicEarningsLossPerShareFromContinuingOperations contextRef="OneD" unitRef="x">2</in:BasicEarningsLossPerShareFromContinuingOperations>
    <!-- <in:TaxExpense contextRef="OneD" unitRef="INR">1</in:TaxExpense> --><in:Income contextRef="OneD">5</in:Income></xbrl>"""
    got = {(r.kind, r.item): r.value for r in fd.extract_filing_facts(spark.createDataFrame([("f", xml)], "filing_id string, xml string")).collect()}
    assert got == {("quarter", "pbt"): 12.5, ("quarter", "eps"): 2.0}


def test_stitch_chains_windows(spark):
    e = spark.createDataFrame([("r", "W1", D(2024, 1, 1), 10.0), ("r", "W1", D(2024, 1, 2), 11.0), ("r", "W2", D(2024, 2, 1), 50.0), ("r", "W2", D(2024, 2, 2), 100.0)], "rule string, label string, date date, equity double")
    assert [round(r.curve, 6) for r in ev.stitch_curves(e, ["rule"]).orderBy("date").collect()] == [100.0, 110.0, 110.0, 220.0]
    assert pd.notna(ev.sharpe(e, ["rule"]).first().sharpe)


def test_skip_index_equals_a_walk_bar_by_bar(spark):
    """Long holds, gaps in the calendar, locked bars, entries near the end of the data."""
    import random
    rng = random.Random(4)
    rows, price = [], {"A": 100.0, "B": 100.0}
    for k in range(420):
        for s in price:
            if s == "B" and k % 7 == 3:
                continue  # no bar that day
            o = price[s] * (1 + rng.gauss(0, 0.004))
            c = o * (1 + rng.gauss(0, 0.004))
            hi, lo = max(o, c) * (1 + abs(rng.gauss(0, 0.003))), min(o, c) * (1 - abs(rng.gauss(0, 0.003)))
            rows.append((s, D(2020, 1, 1) + dt.timedelta(days=k), o, hi, lo, c))
            price[s] = c
    bars = oc.numbered_bars(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double"), "market")
    bars = bars.withColumn("lock", F.when(F.col("r") % 5 == 0, "lower").otherwise("none"))
    signals = [(k, s, D(2020, 1, 1) + dt.timedelta(days=rng.randrange(415)), rng.choice([0.02, 0.1, 0.5, None]), rng.choice([0.02, 0.1, None]), rng.choice([1, 5, 40, 250])) for k in range(150) for s in price]
    df = spark.createDataFrame(signals, "k int, symbol string, date date, stop_pct double, target_pct double, hold_days int").dropDuplicates(["k", "symbol"])
    entries = oc.next_open_entry(df, bars, "market").cache()
    listed = {}
    for b in bars.orderBy("r").collect():
        listed.setdefault(b.symbol, []).append(b)
    for defer in (False, True):
        got = {(r.k, r.symbol): r for r in oc.first_exit(entries, bars, ["k"], 0.001, defer).collect()}
        want, closed = 0, 0
        for e in entries.filter("entry_status = 'entered'").collect():
            r, stop, target = got[e.k, e.symbol], e.entry_price * (1 - e.stop_pct) if e.stop_pct else -1, e.entry_price * (1 + e.target_pct) if e.target_pct else 1e9
            path, out = [], None
            for b in listed[e.symbol][e.entry_r - 1:]:
                path.append(b)
                why = ("stop_gap", b.open) if b.r > e.entry_r and b.open <= stop else ("stop", stop) if b.r > e.entry_r and b.low <= stop else ("target_gap", b.open) if b.r > e.entry_r and b.open >= target else \
                    ("target", target) if b.r > e.entry_r and b.high >= target else ("time", b.close) if b.n - e.entry_n >= e.hold_days else None
                if why and not (defer and b.lock == "lower"):
                    out = why
                    break
            assert (r.exit_reason, r.exit_date) == ((out[0], path[-1].date) if out else (None, None)), (e, r)
            assert r.net_return == pytest.approx((out[1] if out else path[-1].close) / e.entry_price - 1 - 0.001) and r.holding_days == len(path) - 1 and r.last_date == path[-1].date
            assert r.mfe == pytest.approx(max(0, max(b.high for b in path) / e.entry_price - 1)) and r.mae == pytest.approx(min(0, min(b.low for b in path) / e.entry_price - 1))
            want, closed = want + 1, closed + bool(out)
        assert want == len(got) and 50 < closed < want
    spans = oc.first_exit(entries.filter("hold_days = 250"), bars, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert spans.count("explode") == 2 and oc.BLOCK * 5 < 250


def test_order_key_sorts_like_the_tuple_and_refuses_long_values(spark):
    from barloom.functions.windows import order_key
    rows = [(12, 3, 10**10, 5.0), (12, 3, 7, 999.0), (2, 99, 1, 1.0), (10**12, 0, 0, 0.0), (12, 4, 0, 0.0)]
    df = spark.createDataFrame(rows, "a long, b int, c long, d double")
    key = order_key([(F.col("a"), 13), (F.col("b"), 2), (F.col("c"), 11), (F.col("d"), 3)])
    assert [tuple(r) for r in df.orderBy(key).collect()] == sorted(rows)
    plan = df.select(key.alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as decimal(") <= 4, plan  # few decimals; before: one a part and a sum
    with pytest.raises(Exception, match="exceeds 2 digits"):
        df.select(order_key([(F.col("a"), 13), (F.col("d"), 2)]).alias("k")).collect()
