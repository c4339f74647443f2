"""Walk-forward evaluation and promotion (survey 2.10)."""

from pyspark.sql import functions as F

from barloom.operators import evaluation as ev
from barloom.operators import outcomes as oc
from barloom.operators import screening as sc
from barloom.plans.derived import outcome_sql
from barloom.plans.registry import query
from barloom.plans.screen_queries import SWEEP, swept_rule

K = ["rule", "label"]
query("w1_windows", "SELECT * FROM wins")(lambda wb: wb.windows)
query("w2_assign_windows", """SELECT 'test' AS part, label, rule, count(*) AS n FROM trades JOIN wins ON entry_date BETWEEN test_start AND test_end GROUP BY ALL
UNION ALL SELECT 'train', label, rule, count(*) FROM trades JOIN wins ON entry_date BETWEEN train_start AND train_end GROUP BY ALL""")(
    lambda wb: ev.assign_windows(wb.trades, wb.windows, "test", "entry_date").groupBy("label", "rule").agg(F.count("*").alias("n")).withColumn("part", F.lit("test"))
    .unionByName(ev.assign_windows(wb.trades, wb.windows, "train", "entry_date").groupBy("label", "rule").agg(F.count("*").alias("n")).withColumn("part", F.lit("train"))))
def _swept_daily(wb):
    bars = wb.numbered_market
    sig = sc.sweep(wb.fpanel, [swept_rule()]).select("rule", "variant", "symbol", "date", "stop_pct", "target_pct", "hold_days")
    o = oc.first_exit(oc.next_open_entry(sig, bars, "market"), bars, ["rule", "variant", "date"]).withColumnRenamed("date", "signal_date")
    m = oc.daily_marks(o, bars, ["rule", "variant", "signal_date"]).withColumnRenamed("net", "gross")
    return ev.daily_returns(m, ["rule", "variant"], ["symbol", "signal_date"], 0.0026)


query("w3_best_params", f"""
WITH o AS ({outcome_sql(SWEEP, 'market', keys='rule, variant, date')}),
mk AS (SELECT rule, variant, o.symbol, o.date AS sd, b.date, CASE WHEN b.date = o.exit_date THEN o.exit_price ELSE b.close END / o.entry_price AS g FROM o JOIN numbered b ON b.symbol = o.symbol AND b.date BETWEEN o.entry_date AND o.last_date),
dr AS (SELECT rule, variant, date, avg(r) AS ret FROM (SELECT *, g / coalesce(lag(g) OVER w, 1) * CASE WHEN lag(g) OVER w IS NULL THEN 1 - 0.0026::DOUBLE ELSE 1 END - 1 AS r FROM mk WINDOW w AS (PARTITION BY rule, variant, symbol, sd ORDER BY date)) GROUP BY ALL),
tr AS (SELECT rule, variant, label, sum(ln(ret * 0.01::DOUBLE + 1)) AS lg FROM dr JOIN wins ON date BETWEEN train_start AND train_end GROUP BY ALL)
SELECT rule, variant, label, exp(lg) - 1 AS train_return FROM (SELECT *, row_number() OVER (PARTITION BY rule, label ORDER BY round(lg, 9) DESC, variant) AS rn FROM tr) WHERE rn = 1""", "train_return:5")(
    lambda wb: ev.best_params(_swept_daily(wb), wb.windows, 0.01))
query("w4_equity_from_trades", "SELECT rule, date, ln(equity) AS log_equity, exposure FROM equity", "log_equity:7 exposure")(
    lambda wb: wb.equity.select("rule", "date", F.log("equity").alias("log_equity"), "exposure"))
query("w5_max_drawdown", "SELECT rule, label, max_drawdown FROM wmetrics", "max_drawdown")(lambda wb: ev.drawdown(wb.eqw, K))
query("w6_growth", "SELECT rule, label, total_return, cagr FROM wmetrics", "total_return:5 cagr:2")(lambda wb: ev.growth(wb.eqw, K))
query("w7_sharpe", "SELECT rule, label, sharpe FROM wmetrics", "sharpe")(lambda wb: ev.sharpe(wb.eqw, K))
TS = "trade_count, win_rate, avg_win, avg_loss, profit_factor, avg_hold"
query("w8_trade_stats", f"SELECT rule, label, {TS} FROM wmetrics WHERE trade_count > 0", "win_rate avg_win avg_loss profit_factor avg_hold")(
    lambda wb: ev.trade_stats(ev.assign_windows(wb.trades, wb.windows, date="entry_date"), K))
query("w9_exposure", "SELECT rule, label, exposure FROM wmetrics", "exposure")(lambda wb: ev.exposure(wb.eqw, K))
query("w10_align_benchmark", "SELECT rule, label, benchmark_return FROM wmetrics", "benchmark_return")(lambda wb: ev.align_benchmark(wb.eqw, wb.bench, K))
query("w11_window_outcome", "SELECT rule, label, outcome, total_return, benchmark_return, alpha, trade_count FROM wmetrics", "total_return:5 benchmark_return alpha:5")(
    lambda wb: wb.wmetrics.select("rule", "label", "outcome", "total_return", "benchmark_return", "alpha", "trade_count"))
query("w12_gate", "SELECT * EXCLUDE (lt) FROM gated", "worst_drawdown pass_ratio")(lambda wb: wb.gated)
query("w13_status_for", """
SELECT rule, verdict, CASE WHEN verdict = 'fail' THEN 'rejected' WHEN verdict = 'pass' AND rule LIKE 's%' THEN 'live' ELSE 'candidate' END AS status,
 array_to_string(list_filter([CASE WHEN NOT ok_windows THEN 'scored_windows' END, CASE WHEN NOT ok_benchmark THEN 'beats_benchmark_after_costs' END, CASE WHEN NOT ok_drawdown THEN 'max_drawdown' END, CASE WHEN NOT ok_trades THEN 'enough_trades' END], lambda x: x IS NOT NULL), ', ') AS failing
FROM gated""")(lambda wb: ev.status_for(wb.gated.withColumn("origin", F.when(F.col("rule").startswith("s"), "seed").otherwise("proposed"))).select("rule", "verdict", "status", "failing"))
NAMES = ["total_return", "max_drawdown", "sharpe", "exposure", "benchmark_return", "win_rate", "trade_count"]
query("w14_metrics_long", "\nUNION ALL ".join(f"SELECT rule, label, '{n}' AS metric, {n}::DOUBLE AS value FROM wmetrics WHERE {n} IS NOT NULL" for n in NAMES), "value:5")(
    lambda wb: ev.metrics_long(wb.wmetrics, K, NAMES))
query("w15_stitch_curves", """
WITH e AS (SELECT rule, label, min(date) AS d0, arg_min(equity, date) AS e0, arg_max(equity, date) AS e1, arg_min(bench, date) FILTER (WHERE bench IS NOT NULL) AS b0, arg_max(bench, date) FILTER (WHERE bench IS NOT NULL) AS b1 FROM eqw GROUP BY ALL),
l AS (SELECT *, coalesce(product(e1 / e0) OVER w, 1) * 100 AS le, coalesce(product(b1 / b0) OVER w, 1) * 100 AS lb FROM e WINDOW w AS (PARTITION BY rule ORDER BY d0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT rule, count(bench) = count(*) AS ok FROM eqw GROUP BY rule)
SELECT rule, label, date, ln(le * equity / e0) AS log_curve, CASE WHEN ok THEN ln(lb * bench / b0) END AS log_bench FROM eqw JOIN l USING (rule, label) JOIN k USING (rule)""", "log_curve:7 log_bench:7")(
    lambda wb: ev.stitched_with_benchmark(wb.eqw.join(F.broadcast(_bench_on_days(wb)), "date", "left"), ["rule"])
    .select("rule", "label", "date", F.log("curve").alias("log_curve"), F.log("bench_curve").alias("log_bench")))


def _bench_on_days(wb):
    from barloom.functions.joins import asof_join
    days = wb.panel.select("date").distinct().withColumn("k", F.lit(0))
    b = wb.bench.select(F.lit(0).alias("k"), F.col("date").alias("bench_date"), F.col("close").alias("bench"))
    return asof_join(days, b, ["k"], "date", "bench_date", ["bench"]).select("date", "bench")


query("w16_oos_summary", "SELECT * FROM oos", "max_drawdown sharpe win_rate avg_hold cagr:4")(lambda wb: wb.oos)


def _tracked(wb):
    return oc.track_picks(wb.picks.select("rule", "symbol", "date", "stop_pct", "target_pct", "hold_days"), wb.panel, ["rule", "date"], "2001-06-30", 0.0026)


TRACK = outcome_sql("SELECT * FROM picks WHERE date <= DATE '2001-06-30'", "symbol", "0.0026").replace("numbered", "numbered_asof")
LIVE = f"""
numbered_asof AS (SELECT * FROM numbered WHERE date <= DATE '2001-06-30'), o AS ({TRACK}),
live AS (SELECT rule, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE status IN ('open', 'pending_entry')) AS open,
 avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE status = 'closed') AS hit_rate, avg(net_return) FILTER (WHERE status = 'closed') AS live_return, avg(holding_days) FILTER (WHERE status = 'closed') AS avg_hold_days
 FROM (SELECT rule, status, net_return, holding_days FROM o UNION ALL
  SELECT rule, CASE WHEN DATE '2001-06-30' - p.date > 10 THEN 'void' ELSE 'pending_entry' END, NULL, NULL FROM picks p JOIN numbered_asof b ON b.symbol = p.symbol AND b.date = p.date WHERE NOT EXISTS (SELECT 1 FROM numbered_asof x WHERE x.symbol = p.symbol AND x.r = b.r + 1)) GROUP BY rule)"""
query("w17_live_stats", f"WITH {LIVE} SELECT * FROM live", "hit_rate live_return avg_hold_days")(lambda wb: ev.live_stats(_tracked(wb)))
query("w18_decay_flags", f"WITH {LIVE} SELECT rule, closed, hit_rate, win_rate, (win_rate - hit_rate) * 100 AS drop_pts FROM live JOIN oos USING (rule) WHERE closed >= 15 AND (win_rate - hit_rate) * 100 >= 0.05", "hit_rate win_rate drop_pts:5")(
    lambda wb: ev.decay_flags(ev.live_stats(_tracked(wb)), wb.oos, drop=0.05))
