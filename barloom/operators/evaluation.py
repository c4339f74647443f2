"""Walk-forward evaluation: windows, equity, metrics, the promotion gate, live statistics.

Equity tables hold one row per (run, day), so a window over (run) or (run, window label) is bounded by
the calendar; trades are only ever aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.joins import asof_join
from barloom.functions.windows import latest_per, safe_div

# Promotion thresholds and decay rule.
GATE = {"default": (6, 0.6, -0.25, 30), "long_term": (3, 0.6, -0.35, 10)}
AUTO_LIVE = ["seed"]
DECAY_MIN_CLOSED, DECAY_DROP = 15, 15.0
YEAR = 252.0
UNB = Window.unboundedPreceding


def walk_windows(span: DataFrame, train: int = 24, test: int = 6, step: int = 6) -> DataFrame:
    """Rolling month-aligned windows over one (start, end) row; a test span is never cut short."""
    s = span.select("end", F.posexplode(F.sequence(F.trunc("start", "month"), F.col("end"), F.expr(f"INTERVAL {step} MONTHS"))).alias("_i", "train_start"))
    out = s.select("end", F.concat(F.lit("W"), (F.col("_i") + 1).cast("string")).alias("label"), "train_start",
                   F.date_sub(F.add_months("train_start", train), 1).alias("train_end"), F.add_months("train_start", train).alias("test_start"),
                   F.date_sub(F.add_months("train_start", train + test), 1).alias("test_end"))
    return out.filter(F.col("test_end") <= F.col("end")).drop("end")


def window_months(windows: DataFrame, part: str = "test") -> DataFrame:
    """(label, month): the windows are whole months, so membership is an equality, not a range join."""
    months = F.sequence(F.col(f"{part}_start"), F.trunc(f"{part}_end", "month"), F.expr("INTERVAL 1 MONTH"))
    return windows.select("label", F.explode(months).alias("_month"))


def assign_windows(rows: DataFrame, windows: DataFrame, part: str = "test", date: str = "date") -> DataFrame:
    """Rows with the label of every window whose ``part`` span holds their date. A window list has a
    few dozen entries per decade of calendar, hence the broadcast."""
    return rows.withColumn("_month", F.trunc(date, "month")).join(F.broadcast(window_months(windows, part)), "_month").drop("_month")


def daily_returns(marks: DataFrame, run: list[str], trade: list[str], cost_pct: float = 0.0) -> DataFrame:
    """Equal-weight daily return of a run's open positions, from gross marks (gain since entry); the
    cost is taken on the first day of each position."""
    w = Window.partitionBy(*run, *trade).orderBy("date")
    prev = F.lag(F.col("gross") + 1).over(w)
    ratio = (F.col("gross") + 1) / F.coalesce(prev, F.lit(1.0)) * F.when(prev.isNull(), 1 - cost_pct).otherwise(1.0)
    return (marks.withColumn("_r", ratio - 1).groupBy(*run, "date").agg(F.avg("_r").alias("ret"), F.count("*").alias("n_open")))


def equity_from_returns(daily: DataFrame, run: list[str], slots: int = 10, start: float = 100.0, weight: float = 1.0) -> DataFrame:
    """Compounded equity when ``weight`` of it is in the open positions each day and the rest is cash."""
    w = Window.partitionBy(*run).orderBy("date").rowsBetween(UNB, 0)
    return daily.select(*run, "date", (F.product(F.col("ret") * weight + 1).over(w) * start).alias("equity"),
                        F.least(F.lit(1.0), F.col("n_open") / float(slots)).alias("exposure"))


def best_params(daily: DataFrame, windows: DataFrame, weight: float = 1.0) -> DataFrame:
    """Per rule and window the variant with the best total return in training, first variant on ties
    (returns whose logarithms are equal to nine decimals tie, whatever their size: the last digits of a sum depend on
    its order)."""
    t = assign_windows(daily, windows, "train").groupBy("rule", "variant", "label").agg(F.sum(F.log(F.col("ret") * weight + 1)).alias("_log"))
    best = latest_per(t, ["rule", "label"], [F.round("_log", 9).desc(), F.col("variant")])
    return best.select("rule", "variant", "label", (F.exp("_log") - 1).alias("train_return"))


def drawdown(equity: DataFrame, keys: list[str]) -> DataFrame:
    peak = F.max("equity").over(Window.partitionBy(*keys).orderBy("date").rowsBetween(UNB, 0))
    return (equity.withColumn("_dd", F.when(peak > 0, F.col("equity") / peak - 1)).groupBy(*keys)
            .agg(F.least(F.lit(0.0), F.min("_dd")).alias("max_drawdown")))


def growth(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Total return and yearly growth (365.25 days; 0 when it cannot be computed)."""
    g = equity.groupBy(*keys).agg(F.min_by("equity", "date").alias("_e0"), F.max_by("equity", "date").alias("_e1"),
                                  F.datediff(F.max("date"), F.min("date")).alias("_days"))
    ok = (F.col("_days") > 0) & (F.col("_e0") > 0) & (F.col("_e1") > 0)
    return g.select(*keys, (F.col("_e1") / F.col("_e0") - 1).alias("total_return"),
                    F.when(ok, F.pow(F.col("_e1") / F.col("_e0"), 365.25 / F.when(F.col("_days") > 0, F.col("_days"))) - 1).otherwise(0.0).alias("cagr"))


def sharpe(equity: DataFrame, keys: list[str], risk_free: float = 0.0) -> DataFrame:
    """Yearly Sharpe ratio of daily returns; 0 below three points or without variance."""
    prev = F.lag("equity").over(Window.partitionBy(*keys).orderBy("date"))
    rf = (1.0 + risk_free) ** (1.0 / YEAR) - 1.0
    r = equity.withColumn("_r", F.when(prev > 0, F.col("equity") / prev - 1 - rf))
    a = r.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"))
    return a.select(*keys, F.when((F.col("_n") >= 3) & (F.col("_s") > 0), F.col("_m") / F.when(F.col("_s") > 0, F.col("_s")) * YEAR ** 0.5).otherwise(0.0).alias("sharpe"))


def trade_stats(trades: DataFrame, keys: list[str], pnl: str = "net_return") -> DataFrame:
    """Win rate, mean win and loss, profit factor (NULL when there are wins and no losses), counts."""
    v = F.col(pnl)
    win, loss = F.when(v > 0, v), F.when(v < 0, v)
    a = trades.groupBy(*keys).agg(F.count("*").alias("trade_count"), F.count(win).alias("_nw"), F.sum(win).alias("_sw"), F.count(loss).alias("_nl"),
                                  F.sum(loss).alias("_sl"), F.avg("holding_days").alias("avg_hold"))
    zero = F.lit(0.0)
    return a.select(*keys, "trade_count", (F.col("_nw") / F.col("trade_count")).alias("win_rate"), F.coalesce(safe_div(F.col("_sw"), F.col("_nw")), zero).alias("avg_win"),
                    F.coalesce(safe_div(F.col("_sl"), F.col("_nl")), zero).alias("avg_loss"),
                    F.when(F.col("_nl") > 0, F.coalesce("_sw", zero) / -F.col("_sl")).when(F.col("_nw") == 0, zero).alias("profit_factor"), "avg_hold")


def exposure(equity: DataFrame, keys: list[str]) -> DataFrame:
    return equity.groupBy(*keys).agg(F.avg("exposure").alias("exposure"))


def align_benchmark(equity: DataFrame, bench: DataFrame, keys: list[str]) -> DataFrame:
    """Benchmark return per run window, carried forward onto its dates; NULL for the whole window when
    the benchmark starts after its first day."""
    b = bench.groupBy("date").agg(F.max("close").alias("bench")).select(F.lit(0).alias("k"), F.col("date").alias("bench_date"), "bench")
    days = equity.select("date").distinct().withColumn("k", F.lit(0))
    on_day = asof_join(days, b, ["k"], "date", "bench_date", ["bench"]).select("date", "bench")
    # one row per calendar day
    j = equity.select(*keys, "date").join(F.broadcast(on_day), "date", "left")
    a = j.groupBy(*keys).agg(F.min_by("bench", "date").alias("_b0"), F.max_by("bench", "date").alias("_b1"), F.max(F.col("bench").isNull()).alias("_gap"))
    return a.select(*keys, F.when(~F.col("_gap") & (F.col("_b0") > 0), F.col("_b1") / F.col("_b0") - 1).alias("benchmark_return"))


def window_metrics(equity: DataFrame, trades: DataFrame, bench: DataFrame, keys: list[str]) -> DataFrame:
    """All figures of every (run, window), trades and equity already labelled."""
    out = growth(equity, keys)
    for part in (drawdown(equity, keys), sharpe(equity, keys), exposure(equity, keys), align_benchmark(equity, bench, keys)):
        out = out.join(part, keys, "left")
    out = out.join(trade_stats(trades, keys), keys, "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))
    return out.withColumn("alpha", F.col("total_return") - F.col("benchmark_return"))


def window_outcome(metrics: DataFrame) -> DataFrame:
    beat = F.col("total_return") > F.col("benchmark_return")
    return metrics.withColumn("outcome", F.when(F.col("trade_count") == 0, "no_trades").when(F.col("benchmark_return").isNull(), "no_benchmark")
                              .when(beat, "pass").otherwise("fail"))


def _threshold(i: int) -> Column:
    return F.when(F.col("horizon") == "long_term", GATE["long_term"][i]).otherwise(GATE["default"][i])


def gate(windows: DataFrame) -> DataFrame:
    """Four checks per (rule, horizon) and the verdict pass / fail / insufficient_evidence."""
    scored = F.col("outcome").isin("pass", "fail")
    a = windows.groupBy("rule", "horizon").agg(
        F.count(F.when(scored, 1)).alias("n_scored"), F.count(F.when(F.col("outcome") == "pass", 1)).alias("n_pass"),
        F.sum("trade_count").alias("n_trades"), F.coalesce(F.min("max_drawdown"), F.lit(0.0)).alias("worst_drawdown"))
    ratio = F.coalesce(safe_div(F.col("n_pass"), F.col("n_scored")), F.lit(0.0))
    a = a.select("*", ratio.alias("pass_ratio"), (F.col("n_scored") >= _threshold(0)).alias("ok_windows"), (ratio >= _threshold(1)).alias("ok_benchmark"),
                 (F.col("worst_drawdown") >= _threshold(2)).alias("ok_drawdown"), (F.col("n_trades") >= _threshold(3)).alias("ok_trades"))
    enough = F.col("ok_windows") & F.col("ok_trades")
    return a.withColumn("verdict", F.when(~enough, "insufficient_evidence").when(F.col("ok_benchmark") & F.col("ok_drawdown"), "pass").otherwise("fail"))


CHECKS = {"scored_windows": "ok_windows", "beats_benchmark_after_costs": "ok_benchmark", "max_drawdown": "ok_drawdown", "enough_trades": "ok_trades"}


def status_for(gated: DataFrame) -> DataFrame:
    """live / candidate / rejected by verdict and origin, with the failing checks named. A gate that
    could not decide leaves a candidate."""
    failing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c), F.lit(n)) for n, c in CHECKS.items()])), ", ")
    status = F.when(F.col("verdict") == "fail", "rejected").when((F.col("verdict") == "pass") & F.col("origin").isin(AUTO_LIVE), "live").otherwise("candidate")
    return gated.withColumn("status", status).withColumn("failing", failing)


def metrics_long(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    wide = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(keys, names, "metric", "value").filter(F.col("value").isNotNull())


def stitch_curves(equity: DataFrame, run: list[str], value: str = "equity") -> DataFrame:
    """Window curves (run, label, date, value) rebased and chained from 100. Rows without a value are
    left out. Windows per run are few, so the chain is a product over them."""
    e = equity.filter(F.col(value).isNotNull())
    ends = e.groupBy(*run, "label").agg(F.min("date").alias("_d0"), F.min_by(value, "date").alias("_v0"), F.max_by(value, "date").alias("_v1"))
    before = Window.partitionBy(*run).orderBy("_d0").rowsBetween(UNB, -1)
    ends = ends.withColumn("_level", F.coalesce(F.product(F.col("_v1") / F.col("_v0")).over(before), F.lit(1.0)) * 100)
    return e.join(ends, [*run, "label"]).select(*run, "label", "date", (F.col("_level") * F.col(value) / F.col("_v0")).alias("curve"))


def stitched_with_benchmark(equity: DataFrame, run: list[str]) -> DataFrame:
    """Both chained curves; the benchmark is dropped for a run where it does not cover every day."""
    a = stitch_curves(equity, run)
    covered = equity.groupBy(*run).agg((F.count("bench") == F.count("equity")).alias("_ok"))
    b = stitch_curves(equity, run, "bench").withColumnRenamed("curve", "bench_curve")
    j = a.join(b, [*run, "label", "date"], "left").join(covered, run)
    return j.withColumn("bench_curve", F.when(F.col("_ok"), F.col("bench_curve"))).drop("_ok")


def oos_summary(window_rows: DataFrame, trades: DataFrame) -> DataFrame:
    """Per rule: chained growth over its test windows, worst drawdown, mean window Sharpe, win rate."""
    a = window_rows.groupBy("rule").agg(
        F.product(1 + F.coalesce("total_return", F.lit(0.0))).alias("_g"), F.datediff(F.max("test_end"), F.min("test_start")).alias("_days"),
        F.min("max_drawdown").alias("max_drawdown"), F.avg("sharpe").alias("sharpe"), F.count("*").alias("n_windows"))
    t = trades.groupBy("rule").agg(F.count("*").alias("trades"), F.avg(F.when(F.col("net_return") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("holding_days").alias("avg_hold"))
    cagr = F.when((F.col("_days") > 0) & (F.col("_g") > 0), F.pow(F.col("_g"), 365.25 / F.col("_days")) - 1)
    return a.join(t, "rule", "left").withColumn("cagr", cagr).drop("_g", "_days")


def live_stats(picks: DataFrame) -> DataFrame:
    """Closed picks that were not void: count, hit rate, mean net return and hold; open count."""
    closed = F.col("status") == "closed"
    return picks.groupBy("rule").agg(
        F.count(F.when(closed, 1)).alias("closed"), F.count(F.when(F.col("status").isin("pending_entry", "open"), 1)).alias("open"),
        F.avg(F.when(closed, (F.col("net_return") > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(closed, F.col("net_return"))).alias("live_return"),
        F.avg(F.when(closed, F.col("holding_days"))).alias("avg_hold_days"))


def decay_flags(live: DataFrame, oos: DataFrame, min_closed: int = DECAY_MIN_CLOSED, drop: float = DECAY_DROP) -> DataFrame:
    """Rules whose live hit rate fell ``drop`` points below their backtest win rate."""
    j = live.join(oos.select("rule", "win_rate"), "rule").withColumn("drop_pts", (F.col("win_rate") - F.col("hit_rate")) * 100)
    return j.filter((F.col("closed") >= min_closed) & (F.col("drop_pts") >= drop)).select("rule", "closed", "hit_rate", "win_rate", "drop_pts")
