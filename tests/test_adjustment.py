"""Back-adjustment keyed on the security, and subjects that are not understood as a whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import actions as act

D = dt.date
SERIES = ["EQ", "BE", "BZ"]


def actions(spark, rows):
    return spark.createDataFrame(rows, "action_id long, exchange string, symbol string, ex_date date, captured_on date, subject string")


def bars(spark, rows):
    return spark.createDataFrame([(*r, "EQ", r[3], r[3], r[3], 100, None) for r in rows], "exchange string, symbol string, date date, close double, series string, open double, high double, low double, volume long, delivery_qty long")


def test_each_subject_is_parsed_once_and_met_by_all_actions(spark):
    df = actions(spark, [(k, "NSE", "A", D(2020, 1, k % 27 + 1), D(2020, 1, 1), s) for k, s in enumerate(["Bonus 1:1"] * 5 + [None, "", "Bonus 1:1 & Rights 3:19", "Dividend - Rs 2 Per Share And Bonus 1:2", "Name Change"])])
    got = {}
    for r in act.parse_subjects(df).collect():
        got.setdefault(r.action_id, []).append((r.clause, r.action_type, r.price_factor, r.parse_status))
    assert set(got) == set(range(10)) and all(got[k] == [(1, "bonus", 0.5, "parsed")] for k in range(5))
    assert got[5] == got[6] == got[9] == [(1, None, None, "unparsed")]
    assert sorted(got[7]) == [(1, "bonus", 0.5, "ambiguous"), (2, "rights", None, "ambiguous")]
    assert sorted(x[1] for x in got[8]) == ["bonus", "dividend"]
    assert act.parsed_clauses(df).count() == 5


def test_ambiguous_subjects_feed_no_factor(spark):
    df = actions(spark, [(1, "NSE", "A", D(2020, 1, 10), D(2020, 1, 1), "Bonus 1:1 & Rights 3:19"), (2, "NSE", "A", D(2020, 2, 10), D(2020, 1, 1), "Bonus 1:1")])
    parsed = act.parse_subjects(df)
    assert [(r.effective_date, r.cumulative_price_factor) for r in act.factor_timeline(act.dedupe_actions(parsed)).collect()] == [(D(2020, 2, 10), 0.5)]
    holes = {(r.action_type, r.reason): r.n_actions for r in act.excluded_actions(parsed).collect()}
    assert holes == {("bonus", "closeable_hole"): 1, ("rights", "closeable_hole"): 1}


def test_ratio_is_part_of_an_event(spark):
    df = actions(spark, [(1, "NSE", "A", D(2020, 1, 10), D(2020, 1, 1), "Bonus 1:1"), (2, "NSE", "A", D(2020, 1, 10), D(2020, 1, 2), "Bonus 1:1"), (3, "NSE", "A", D(2020, 1, 10), D(2020, 1, 1), "Bonus 2:2")])
    assert sorted(r.action_id for r in act.dedupe_actions(act.parse_subjects(df)).collect()) == [2, 3]


def test_adjustment_reaches_bars_printed_under_a_former_symbol(spark):
    history = spark.createDataFrame([(7, "NSE", "OLDCO", D(1900, 1, 1), D(2020, 1, 1)), (7, "NSE", "NEWCO", D(2020, 1, 1), None), (8, "NSE", "OLDCO", D(2021, 1, 1), None)], "security_id long, exchange string, symbol string, valid_from date, valid_to date")
    listings = spark.createDataFrame([("NSE", "NEWCO", "EQ", 7), ("NSE", "OLDCO", "EQ", 8)], "exchange string, symbol string, series string, security_id long")
    securities = spark.createDataFrame([(7, "NEWCO", 10.0), (8, "OLDCO", 10.0)], "security_id long, canonical_symbol string, face_value double")
    b = bars(spark, [("NSE", "OLDCO", D(2019, 6, 3), 100.0), ("NSE", "NEWCO", D(2020, 6, 1), 100.0), ("NSE", "OLDCO", D(2021, 2, 1), 100.0), ("NSE", "OTHER", D(2019, 6, 3), 100.0)])
    df = actions(spark, [(1, "NSE", "NEWCO", D(2021, 6, 1), D(2021, 5, 1), "Bonus 1:1"), (2, "NSE", "OTHER", D(2021, 6, 1), D(2021, 5, 1), "Bonus 1:3"), (3, "NSE", "NEWCO", D(2020, 3, 2), D(2020, 2, 1), "Rights 1:4 @ Premium Rs 40")])
    got = {(r.symbol, r.date.year): (r.close, r.volume) for r in act.rebuild_adjusted(b, df, securities, SERIES, history, listings).collect()}
    rights = (4 * 100 + 50) / 5 / 100  # the cum-rights close stands under the former symbol
    assert got["OLDCO", 2019] == (pytest.approx(100 * 0.5 * rights), round(100 * 2 / rights))
    assert got["NEWCO", 2020] == (50.0, 200) and got["OLDCO", 2021] == (100.0, 100)  # the symbol's next owner is another security
    assert got["OTHER", 2019] == (75.0, 133)
    plain = act.rebuild_adjusted(b, df, securities, SERIES).filter(F.col("symbol") == "OLDCO")
    assert {r.close for r in plain.collect()} == {100.0}


def test_figures_as_known_then(spark):
    """Trailing sums and growth against a search over all filings known by each one's date."""
    import random

    from barloom.operators import fundamentals as fd
    rng, rows = random.Random(1), []
    for symbol in "abc":
        for k in range(24):
            period = (dt.date(2015, 1, 1) + dt.timedelta(days=91 * (k + 1) + (40 if k == 9 and symbol == "b" else 0)))
            for version in range(rng.choice([1, 1, 2, 3])):
                rows.append((symbol, period, period + dt.timedelta(days=rng.choice([30, 45, 300]) * (version + 1) + version), k % 4 == 3, rng.choice([None, *range(1, 50)]), float(rng.randint(-5, 90)), float(rng.randint(-5, 90))))
    rng.shuffle(rows)
    df = spark.createDataFrame([(s, p, a, an, None if x is None else float(x), y, z) for s, p, a, an, x, y, z in rows], "symbol string, period_end date, available_on date, is_annual boolean, x double, y_revenue double, y_pat double")
    sums, growth = {}, {}
    for s, p, a, *_ in rows:
        known = sorted((r for r in rows if r[0] == s and (r[2], r[1]) <= (a, p)), key=lambda r: r[2])
        latest = {r[1]: r for r in known}
        four = sorted(latest, reverse=True)[:4]
        if len(four) == 4:
            ok = all(70 <= (u - v).days <= 110 for u, v in zip(four, four[1:], strict=False)) and all(latest[q][4] is not None for q in four)
            sums[s, a, p] = float(sum(latest[q][4] for q in four)) if ok else None
        years = [r for r in known if r[3]]
        if years:
            new = max(years, key=lambda r: (r[1], r[2]))
            base = [r for r in years if abs((new[1] - r[1]).days - 1095) <= 20]
            if base:
                old = min(base, key=lambda r: (r[1], r[2]))
                growth[s, a, p] = [(new[c] / old[c]) ** (1 / 3) - 1 if old[c] > 0 and new[c] > 0 else None for c in (5, 6)]
    assert {(r.symbol, r.available_on, r.period_end): r.x_ttm for r in fd.ttm(df, ["x"]).collect()} == sums and any(v for v in sums.values())
    got = {(r.symbol, r.available_on, r.period_end): [r.sales_cagr3, r.profit_cagr3] for r in fd.growth3(df).collect()}
    assert set(got) == set(growth) and len(got) > 10
    for key, pair in growth.items():
        assert got[key] == [None if v is None else pytest.approx(v) for v in pair]
