"""Read models: the tables a dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import latest_per


def picks_view(picks: DataFrame, tracked: DataFrame, securities: DataFrame, stats: DataFrame, day=None, horizon: str | None = None) -> DataFrame:
    """Picks of one day (default: the newest signal day) with latest standing, company and rule stats."""
    p = picks if horizon is None else picks.filter(F.col("horizon") == horizon)
    at = F.lit(day).cast("date") if day is not None else p.agg(F.max("date")).scalar()
    t = tracked.select("rule", "symbol", "date", "status", "net_return", "last_date")
    s = securities.select(F.col("canonical_symbol").alias("symbol"), "company_name")
    return (p.filter(F.col("date") == at).join(t, ["rule", "symbol", "date"], "left").join(s, "symbol", "left")
            .join(stats.select("rule", "hit_rate", "closed"), "rule", "left"))


def strategy_board(oos: DataFrame, live: DataFrame, status: DataFrame) -> DataFrame:
    o = oos.select("rule", F.col("cagr").alias("backtest_cagr"), F.col("win_rate").alias("backtest_win_rate"), F.col("max_drawdown").alias("backtest_drawdown"), "trades")
    return status.select("rule", "status").join(o, "rule", "left").join(live, "rule", "left")


def recent_trades(live: DataFrame, backtest: DataFrame, k: int = 12) -> DataFrame:
    """Newest k closed trades per rule: live ones when the rule has any, else backtest ones."""
    cols = ["rule", "symbol", "entry_date", "exit_date", "net_return"]
    mine = live.filter("status = 'closed'").select(*cols).withColumn("origin", F.lit("live"))
    rest = backtest.select(*cols).withColumn("origin", F.lit("backtest")).join(mine.select("rule").distinct(), "rule", "left_anti")
    return latest_per(mine.unionByName(rest.select(*mine.columns)), ["rule"], [F.col("exit_date").desc(), F.col("symbol"), F.col("entry_date").desc()], k)


def flagged_by(picks: DataFrame, k: int = 10) -> DataFrame:
    """The newest k picks naming each symbol."""
    return latest_per(picks.select("symbol", "date", "rule", "rank", "score"), ["symbol"], [F.col("date").desc(), F.col("rule")], k)


def capped_per_horizon(picks: DataFrame, cap: int) -> DataFrame:
    return latest_per(picks, ["date", "horizon"], [F.col("score").desc(), F.col("symbol"), F.col("rule")], cap)


def round_robin(picks: DataFrame, each: int, total: int) -> DataFrame:
    """Per day the best pick of every rule first, then every rule's second best, up to ``total``."""
    top = latest_per(picks, ["date", "rule"], [F.col("score").desc(), F.col("symbol")], each)
    w = Window.partitionBy("date", "rule").orderBy(F.col("score").desc(), F.col("symbol"))
    turn = top.withColumn("turn", F.row_number().over(w))
    place = F.row_number().over(Window.partitionBy("date").orderBy("turn", F.col("score").desc(), "rule"))
    return turn.withColumn("place", place).filter(F.col("place") <= total)


def brief_payload(picks: DataFrame, moves: DataFrame, positions: DataFrame) -> DataFrame:
    """One JSON text per day: that day's picks (a few per rule), index moves and held position count."""
    p = picks.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("rule", "rank", "symbol", "score"))).alias("picks"))
    m = moves.groupBy(F.col("day").alias("date")).agg(F.sort_array(F.collect_list(F.struct("index_code", "close", "move_pct", "is_stale"))).alias("indices"))
    n = positions.filter("qty > 0").agg(F.count("*")).scalar()
    return p.join(m, "date", "left").select("date", F.to_json(F.struct("date", "picks", "indices", n.alias("open_positions"))).alias("payload"))


def expected_data(calendar: DataFrame, spans: DataFrame, now, close_hour: int = 18) -> DataFrame:
    """Per exchange: the day whose data should be there at ``now`` (today from ``close_hour`` on, else
    the last trading day before), and whether the lake is behind it."""
    ts = F.lit(now).cast("timestamp")
    limit = F.when(F.hour(ts) >= close_hour, F.to_date(ts)).otherwise(F.date_sub(F.to_date(ts), 1))
    want = calendar.filter(F.col("is_trading") & (F.col("date") <= limit)).groupBy("exchange").agg(F.max("date").alias("expected_date"))
    return spans.join(want, "exchange", "left").withColumn("is_stale", F.coalesce(F.col("latest_date") < F.col("expected_date"), F.lit(False)))


def approximation_reasons(rule_features: DataFrame, availability: DataFrame) -> DataFrame:
    """Rules that use a feature only available after the run starts, with the reasons joined."""
    j = rule_features.join(availability, "feature").filter(F.col("available_from") > F.col("run_start"))
    return j.groupBy("rule").agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"), F.count("*").alias("n_features"))


def run_summary(metrics_long: DataFrame, trades: DataFrame, windows: DataFrame, runs: DataFrame, k: int = 20) -> DataFrame:
    """Newest k runs with their metrics as one map and counts of windows and trades."""
    m = metrics_long.groupBy("rule").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws("/", "label", "metric"), "value")))).alias("metrics"))
    t = trades.groupBy("rule").agg(F.count("*").alias("n_trades"))
    w = windows.groupBy("rule").agg(F.countDistinct("label").alias("n_windows"))
    return runs.orderBy(F.col("run_id").desc(), "rule").limit(k).join(m, "rule", "left").join(t, "rule", "left").join(w, "rule", "left")


def order_activity(orders: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Working orders plus those closed in the last days."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return orders.filter(F.col("status").isin("open", "pending_eod") | (F.col("closed_at") >= since))


def newest_trades(trades: DataFrame, order: list[str], k: int = 100) -> DataFrame:
    return latest_per(trades, ["portfolio"], [F.col("date").desc(), *[F.col(c).desc() for c in order]], k)


def rebased_curve(snapshots: DataFrame, start_capital: float) -> DataFrame:
    """Portfolio value and benchmark as index from the first day with a benchmark close."""
    w = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first("bench_close", ignorenulls=True).over(w)
    return snapshots.select("portfolio", "date", "value", (F.col("bench_close") / base * start_capital).alias("benchmark_value"))


def usage_totals(runs: DataFrame, days: int) -> DataFrame:
    """Known cost and number of runs with unknown cost over the last days of the table."""
    last = runs.agg(F.max("day")).scalar()
    return (runs.filter(F.col("day") > F.date_sub(last, days)).groupBy("kind")
            .agg(F.sum("cost").alias("known_cost"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unknown"), F.count("*").alias("n_runs")))


def review_calendar(outputs: DataFrame, days: DataFrame, n: int = 14) -> DataFrame:
    """Every trading day of the last ``n`` calendar days, ready or pending."""
    last = days.agg(F.max("date")).scalar()
    done = outputs.select("date").distinct().withColumn("_ready", F.lit(True))
    recent = days.filter("is_trading").filter(F.col("date") > F.date_sub(last, n)).select("date")
    return recent.join(done, "date", "left").select("date", F.when(F.col("_ready"), "ready").otherwise("pending").alias("state"))
