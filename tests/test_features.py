import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ewm import ewm
from barloom.functions.joins import asof_join, average_rank
from barloom.functions.rolling import rolling
from barloom.functions.windows import add_weekdays, symbol_window
from barloom.operators import features as ft
from barloom.operators import lake


def walk(symbols=2, n=700, seed=7):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        dates = pd.bdate_range("2019-01-01", periods=n)
        out.append(pd.DataFrame({
            "symbol": f"S{s}", "date": dates.date, "open": close * 0.999, "high": close * 1.01, "low": close * 0.99, "close": close,
            "volume": rng.integers(100, 1000, n), "turnover": close * 500, "delivery_pct": np.where(rng.random(n) < 0.2, np.nan, 50.0)}))
    pdf = pd.concat(out)
    return pdf.astype(object).where(pdf.notna(), None)


@pytest.fixture(scope="module")
def panel(spark):
    pdf = walk()
    return spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)],
                                 "symbol string, date date, open double, high double, low double, close double, volume long, turnover double, delivery_pct double").cache()


def test_sma_and_prior_high_by_hand(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), float(i + 1)) for i in range(40)]
    p = spark.createDataFrame(rows, "symbol string, date date, close double").withColumn("high", F.col("close"))
    got = {r.date: r for r in ft.sma(p, (20,)).collect()}
    d0 = dt.date(2020, 1, 1)
    assert got[d0 + dt.timedelta(18)].sma20 is None
    assert got[d0 + dt.timedelta(19)].sma20 == 10.5
    assert got[d0 + dt.timedelta(39)].sma20 == 30.5
    flat = spark.createDataFrame([("A", d0 + dt.timedelta(i), 100.0 if i < 25 else 120.0) for i in range(26)], "symbol string, date date, high double")
    assert ft.prior_extremes(flat, (20,), ()).orderBy(F.desc("date")).first().high_prior20 == 100.0


def test_block_means_match_pandas_over_several_blocks(panel):
    got = ft.ema(panel, (10, 200)).orderBy("symbol", "date").toPandas()
    for _, g in got.groupby("symbol"):
        for n in (10, 200):
            want = g.close.ewm(span=n, adjust=False).mean()
            want[: n - 1] = np.nan
            np.testing.assert_allclose(g[f"ema{n}"].astype(float), want, rtol=1e-12)
    r = ft.rsi(panel, (2, 14)).orderBy("symbol", "date").toPandas()
    for _, g in r.groupby("symbol"):
        d = g.close.diff()
        for n in (2, 14):
            up, down = d.clip(lower=0).ewm(alpha=1 / n, adjust=False).mean(), (-d).clip(lower=0).ewm(alpha=1 / n, adjust=False).mean()
            want = 100 - 100 / (1 + up / down)
            want[:n] = np.nan
            np.testing.assert_allclose(g[f"rsi{n}"].astype(float), want, rtol=1e-9)


def test_no_losses_is_100(spark):
    p = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(i), 1.0 + i) for i in range(20)], "symbol string, date date, close double")
    assert ft.rsi(p, (14,)).orderBy(F.desc("date")).first().rsi14 == 100.0


def test_tiles_match_plain_frames(panel):
    w = symbol_window("symbol")
    t = rolling(panel, w, {"a": ("avg", "close", 200, False), "h": ("max", "high", 252, True), "l": ("min", "low", 55, False), "d": ("avg", "delivery_pct", 20, True, 10)}, nullable=("delivery_pct",))
    fr = w.rowsBetween(-20, -1)
    t = t.withColumn("a2", F.when(F.row_number().over(w) >= 200, F.avg("close").over(w.rowsBetween(-199, 0)))).withColumn(
        "h2", F.when(F.row_number().over(w) > 252, F.max("high").over(w.rowsBetween(-252, -1)))).withColumn(
        "l2", F.when(F.row_number().over(w) >= 55, F.min("low").over(w.rowsBetween(-54, 0)))).withColumn(
        "d2", F.when(F.count("delivery_pct").over(fr) >= 10, F.avg("delivery_pct").over(fr)))
    bad = t.filter("abs(a - a2) > 1e-9 OR h <> h2 OR l <> l2 OR abs(d - d2) > 1e-9 OR (a IS NULL) <> (a2 IS NULL) OR (h IS NULL) <> (h2 IS NULL) OR (l IS NULL) <> (l2 IS NULL) OR (d IS NULL) <> (d2 IS NULL)")
    assert bad.count() == 0


def test_features_do_not_look_ahead(panel):
    cols = ["sma50", "ema20", "rsi14", "atr_pct14", "ret20", "high_prior20", "low_prior60", "vol_ratio20", "turnover_med20", "adv_turnover", "delivery_pct_sma20", "mom_12_1", "high_252_prox"]
    assert ft.look_ahead_diff(ft.features, panel, "2020-06-30", cols).count() == 0


def test_look_ahead_is_caught(panel):
    cheat = lambda p: p.withColumn("x", F.lead("close").over(symbol_window("symbol")))
    assert ft.look_ahead_diff(cheat, panel, "2020-06-30", ["x"]).count() > 0
    counts = {(str(r.cut), r.feature): r for r in ft.look_ahead_counts(lambda p: cheat(p).withColumn("y", F.col("close") * 2), panel, ["2019-06-28", "2020-06-30"]).collect()}
    assert len(counts) == 4 and all((r.n_changed > 0) == (feature == "x") and r.n_rows > 0 for (_, feature), r in counts.items())


def test_asof_directions(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("a", 12, "z")], "k string, u int, v string")
    pick = lambda **kw: sorted((r.k, r.t, r.v) for r in asof_join(left, right, ["k"], "t", "u", ["v"], **kw).collect())
    assert pick() == [("a", 5, "x"), ("a", 10, "y"), ("b", 1, None)]
    assert pick(strict=True) == [("a", 5, None), ("a", 10, "y"), ("b", 1, None)]
    assert pick(direction="forward") == [("a", 5, "x"), ("a", 10, "z"), ("b", 1, None)]
    assert pick(direction="forward", strict=True) == [("a", 5, "y"), ("a", 10, "z"), ("b", 1, None)]


def test_average_rank_with_hot_group_and_hot_value(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.7, "hot", "cold"), "i": range(3000), "v": np.where(rng.random(3000) < 0.4, 1.0, rng.normal(0, 5, 3000))})
    got = average_rank(spark.createDataFrame(pdf), ["k"], "v", "r", "n").toPandas().sort_values("i")
    np.testing.assert_allclose(got.r.values, pdf.groupby("k").v.rank().values)
    assert (got.n.values == pdf.groupby("k").v.transform("count").values).all()


def test_means_and_panels_sort_and_shuffle_once(spark):
    """All passes of a mean share the sort on the symbol, without arrays; bars are dealt by symbol for every window on it."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    bars = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "symbol string, date date, close double")
    mean = plan(ewm(bars, {"e": (F.col("close"), 2.0 / 201, 200, 0), "f": (F.col("close"), 0.5, 2, 1)}))
    assert mean.count("Sort [") == 1 and "collect_list" not in mean
    trades = spark.createDataFrame([], "exchange string, symbol string, series string, date date, price double, qty double, amount double, discount double, k long")
    assert plan(lake.panel(lake.bars_from_trades(trades, F.col("k")))).count("Exchange hashpartitioning") == 2


def test_average_rank_when_the_sketch_comes_out_otherwise_each_time(spark, monkeypatch):
    """Parts of a sketch arrive in any order, so two evaluations of one plan need not give the same ranges."""
    import random
    edges = F.udf(lambda lo, hi: sorted(random.SystemRandom().uniform(lo, hi) for _ in range(31)), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda c, probs, accuracy: edges(F.min(c), F.max(c)))
    pdf = pd.DataFrame({"k": ["a", "b"] * 200, "i": range(400), "v": np.random.default_rng(5).integers(0, 150, 400).astype(float)})
    got = average_rank(spark.createDataFrame(pdf), ["k"], "v", "r", "n").toPandas().sort_values("i")
    np.testing.assert_allclose(got.r.values, pdf.groupby("k").v.rank().values)
    assert (got.n.values == pdf.groupby("k").v.transform("count").values).all()


def test_add_weekdays_matches_business_days(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), h) for i in range(14) for h in (1, 4, 5, 6, 23)]
    got = spark.createDataFrame(rows, "d date, n int").withColumn("e", add_weekdays(F.col("d"), F.col("n"))).collect()
    assert all(r.e == pd.bdate_range(r.d, periods=r.n + 1)[-1].date() for r in got)


def _moves(plan):
    """Exchanges and sorts of a plan."""
    own = [plan] if plan.getClass().getSimpleName() in ("ShuffleExchangeExec", "SortExec") else []
    children = plan.children()
    return own + [x for i in range(children.size()) for x in _moves(children.apply(i))]


def test_fundamentals_are_attached_without_moving_features(spark):
    """Rows equal those of fundamentals attached to the features, and no exchange or sort carries a feature."""
    from barloom.operators import fundamentals as fd
    from barloom.plans.workbench import Workbench
    wb = Workbench(spark, "/root/testdata/sf0.001")
    late = fd.attach_fundamentals(wb.feat, wb.metrics).select(*wb.fpanel.columns)
    assert late.count() == wb.fpanel.count() > 0
    assert late.exceptAll(wb.fpanel).count() == 0 and wb.fpanel.filter("eps_ttm IS NOT NULL AND pe_ttm IS NOT NULL").count() > 0
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        moved = [x.output().mkString(",") for x in _moves(wb.fpanel._jdf.queryExecution().executedPlan())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert moved and not any("rsi14" in s or "sma200" in s for s in moved)


def test_look_ahead_counts_computes_the_whole_features_once(panel):
    """Cut days read a table of the whole features; only the shortened panels have plans of features of their own."""
    runs = []

    def fn(p):
        runs.append(p)
        return ft.sma(p, (20,))
    out = ft.look_ahead_counts(fn, panel, ["2019-06-28", "2020-06-30"])
    assert len(runs) == 3 and {(r.feature, r.n_changed) for r in out.collect()} == {("sma20", 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 2  # the written features, read by both cut days
