"""Trade ledgers: average-cost positions, cash, corporate actions on holdings, valuation, returns.

A portfolio may hold a third of all trades, all of one symbol on one day. Everything that needs trades one after the other
is a prefix scan over ranges of bounded size (``barloom.functions.scan``); the rest is summed with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.intervals import intervals, on_days
from barloom.functions.scan import in_order, prefix_scan
from barloom.functions.windows import latest_per, safe_div

KEYS = ["portfolio", "exchange", "symbol"]
ORDER = ["date", "orderkey", "linenumber", "partkey", "suppkey", "amount", "side"]
UNB = Window.unboundedPreceding


def signed_qty() -> Column:
    return F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))


def trades_in_order(trades: DataFrame) -> DataFrame:
    """The trades of each (portfolio, exchange, symbol) in their order, ready for the scans below, which all read it."""
    return trades if "_n" in trades.columns else in_order(trades, KEYS, ORDER)


def running_quantity(ordered: DataFrame) -> DataFrame:
    """Adds ``qty_before`` and ``qty_after``: shares held around each trade. Several results of the same trades best share
    one ``trades_in_order``."""
    return prefix_scan(trades_in_order(ordered), KEYS, signed_qty(), "qty_before", "qty_after")


def oversold(ordered: DataFrame) -> DataFrame:
    """Trades that sell more than is held; a ledger with any is not valid (no shorting)."""
    return running_quantity(ordered).filter("side = 'sell' AND qty_after < 0")


def running_cost(ordered: DataFrame) -> DataFrame:
    """Adds ``cost_before`` and ``cost_after`` of the shares held, and ``realised`` (before charges; null for buys).

    A buy adds its value to the cost. A sell leaves the average: it keeps the share qty_after / qty_before of the cost, and
    nothing once the position is closed. So the cost after a trade is an affine map of the cost before it."""
    ordered = trades_in_order(ordered)
    held = running_quantity(ordered)
    sell, value = F.col("side") == "sell", (F.col("qty") * F.col("price")).cast("double")
    some = F.when(F.col("qty_before") > 0, F.col("qty_before")).cast("double")
    keep = F.when(~sell, 1.0).when(F.col("qty_after") <= 0, 0.0).otherwise(F.coalesce(F.col("qty_after") / some, F.lit(0.0)))
    out = prefix_scan(held, KEYS, F.when(sell, 0.0).otherwise(value), "cost_before", "cost_after", keep, numbered=ordered)
    return out.withColumn("realised", F.when(sell, value - F.coalesce(F.col("qty") / some, F.lit(0.0)) * F.col("cost_before")))


def positions(ordered: DataFrame) -> DataFrame:
    """Quantity, average cost and realised profit (before charges) per (portfolio, exchange, symbol), buys averaging in and sells
    leaving the average; a closed position carries no cost."""
    out = running_cost(ordered).groupBy(*KEYS).agg(
        F.sum(signed_qty()).alias("qty"), F.max_by("cost_after", "_n").alias("_cost"), F.sum(F.coalesce("realised", F.lit(0.0))).alias("realised"),
        F.min("date").alias("opened_on"), F.max("date").alias("last_trade"))
    held = F.when(F.col("qty") > 0, F.col("qty"))
    return out.select(*KEYS, "qty", F.coalesce(F.col("_cost") / held, F.lit(0.0)).alias("avg_cost"), "realised", "opened_on", "last_trade")


def cash_flow() -> Column:
    return F.when(F.col("side") == "buy", -F.col("qty") * F.col("price")).otherwise(F.col("qty") * F.col("price"))


def cash_by_day(trades: DataFrame, start_capital: float) -> DataFrame:
    """Cash at the close of every day with a trade. Days are few, so the running sum is over day totals."""
    day = trades.groupBy("portfolio", "date").agg(F.sum(cash_flow()).alias("flow"), F.count("*").alias("n_trades"))
    w = Window.partitionBy("portfolio").orderBy("date").rowsBetween(UNB, 0)
    return day.withColumn("cash", F.sum("flow").over(w) + start_capital)


def running_cash(trades: DataFrame, start_capital: float) -> DataFrame:
    """Cash after every single trade."""
    out = prefix_scan(in_order(trades, ["portfolio"], ORDER), ["portfolio"], cash_flow(), "_before", "_after")
    return out.withColumn("cash", F.col("_after") + start_capital).select(*trades.columns, "cash")


def positions_before(ordered: DataFrame, actions: DataFrame) -> DataFrame:
    """Every action with quantity and cost of each holder's position before its ex-date."""
    day = running_cost(ordered).groupBy(*KEYS, "date").agg(F.max_by("qty_after", "_n").alias("qty"), F.max_by("cost_after", "_n").alias("cost"))
    return on_days(intervals(day, KEYS).filter("qty > 0"), actions, "ex_date", on=["exchange", "symbol"], after=True).drop("date", "until")


def apply_split(ordered: DataFrame, actions: DataFrame) -> DataFrame:
    """What a split or bonus makes of each position held before its ex-date: quantity floored, total cost kept, the fraction
    and its cost reported and written off. Positions opened on the ex-date or later are not touched."""
    j = positions_before(ordered, actions.select("exchange", "symbol", "ex_date", "volume_factor").filter("volume_factor > 0"))
    exact = F.col("qty") * F.col("volume_factor")
    kept = F.col("cost") * F.col("new_qty") / F.col("exact")
    left = F.when(F.col("new_qty") > 0, F.col("new_qty"))
    return (j.withColumn("exact", exact).withColumn("new_qty", F.floor(exact + 1e-9).cast("long"))
            .select(*KEYS, "ex_date", "qty", "new_qty", F.coalesce(kept / left, F.lit(0.0)).alias("new_avg_cost"),
                    (F.col("exact") - F.col("new_qty")).alias("dropped_shares"), (F.col("cost") - F.when(F.col("new_qty") > 0, kept).otherwise(0.0)).alias("dropped_cost")))


def daily_holdings(trades: DataFrame) -> DataFrame:
    """Shares held at the close of each day with a trade, from day totals."""
    day = trades.groupBy(*KEYS, "date").agg(F.sum(signed_qty()).alias("_q"))
    w = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(UNB, 0)
    return day.select(*KEYS, "date", F.sum("_q").over(w).alias("held"))


def holding_intervals(trades: DataFrame) -> DataFrame:
    """Holdings from the day of a trade to the next one, where anything is held."""
    return intervals(daily_holdings(trades), KEYS).filter("held > 0")


def holders_before(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """Every action with the shares of those who held any before its ex-date. Holdings are intervals, so rows grow with the
    months held, not with all pairs of holdings and actions."""
    return on_days(holding_intervals(trades), actions, "ex_date", on=["exchange", "symbol"], after=True).drop("date", "until")


def held_before(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """Every action with the shares that each portfolio which ever traded its symbol had before its ex-date: 0 before the
    first trade and after the last sale, below 0 where more was sold than held."""
    dates = actions.select("exchange", "symbol", "ex_date").distinct()
    states = intervals(daily_holdings(trades), KEYS).filter("held <> 0")
    held = on_days(states, dates, "ex_date", on=["exchange", "symbol"], after=True).select(*KEYS, "ex_date", "held")
    every = trades.select(*KEYS).distinct().join(actions, ["exchange", "symbol"])
    return every.join(held, [*KEYS, "ex_date"], "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))


def dividends(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """Cash credited per (portfolio, action), to paise."""
    h = holders_before(trades, actions.filter(F.col("action_type").isin("dividend", "distribution") & F.col("amount").isNotNull()))
    return h.withColumn("credit", F.round(F.col("held") * F.col("amount").cast("decimal(18,4)"), 2).cast("double"))


def rescale_orders(orders: DataFrame, actions: DataFrame) -> DataFrame:
    """Working orders after the splits and bonuses with an ex-date while they were open (after ``date``, and not after
    ``valid_until`` where that is set): limit, trigger and bracket prices times the factor to paise, quantity floored, one
    action after the other; cancelled when nothing is left. Orders that met no action are left out. A symbol's few
    actions travel as one list, so an order stays one row."""
    own = actions.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ex_date", "price_factor", "volume_factor"))).alias("_a"))
    met = F.filter("_a", lambda a: (a["ex_date"] > F.col("date")) & F.coalesce(a["ex_date"] <= F.col("valid_until"), F.lit(True)))
    out = orders.filter(F.col("status").isin("open", "pending_eod")).join(own, "symbol").withColumn("_a", met).filter(F.size("_a") > 0)
    out = out.withColumn("new_qty", F.aggregate("_a", F.col("qty").cast("long"), lambda q, a: F.floor(q * a["volume_factor"] + 1e-9).cast("long")))
    for c in ("limit_price", "trigger_price", "bracket_stop", "bracket_target"):
        if c in orders.columns:
            out = out.withColumn(c, F.aggregate("_a", F.col(c).cast("double"), lambda p, a: F.floor(p * a["price_factor"] * 100 + 0.5) / 100))
    return (out.withColumn("status", F.when(F.col("new_qty") < 1, "cancelled").otherwise(F.col("status")))
            .withColumn("n_actions", F.size("_a")).withColumn("ex_date", F.element_at("_a", -1)["ex_date"]).drop("_a"))


def apply_once(actions: DataFrame, applied: DataFrame, key: list[str]) -> DataFrame:
    """Actions not applied before, one per economic identity (a republished row is the same event)."""
    k = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key])
    return actions.withColumn("action_key", k).dropDuplicates(["action_key"]).join(applied.select("action_key"), "action_key", "left_anti")


def value_portfolio(pos: DataFrame, cash: DataFrame, closes: DataFrame, day) -> DataFrame:
    """Portfolio value on a day: cash plus holdings at the last raw close of their exchange, at cost where there is none."""
    d = F.lit(day).cast("date")
    j = pos.filter("qty > 0").join(closes.select("exchange", "symbol", F.col("close").alias("mark")), ["exchange", "symbol"], "left")
    a = j.groupBy("portfolio").agg(
        F.count("*").alias("n_positions"), F.sum(F.col("avg_cost") * F.col("qty")).alias("invested"), F.sum(F.coalesce("mark", "avg_cost") * F.col("qty")).alias("market_value"),
        F.sum((F.col("mark") - F.col("avg_cost")) * F.col("qty")).alias("unrealised"), F.max(F.datediff(d, "opened_on")).alias("longest_held_days"))
    return cash.join(a, "portfolio", "left").withColumn("value", F.col("cash") + F.coalesce("market_value", F.lit(0.0)))


def daily_snapshots(trades: DataFrame, closes: DataFrame, dates: DataFrame, bench: DataFrame, start_capital: float) -> DataFrame:
    """Value, cash and market value per (portfolio, date), holdings at the last close of their exchange (one row per
    exchange, symbol and date). Holdings, closes and cash are intervals dealt to the days wanted."""
    days = dates.select("date").distinct().withColumnRenamed("date", "day")
    held = on_days(holding_intervals(trades), days).select(*KEYS, "day", "held")
    marks = on_days(intervals(closes.select("exchange", "symbol", "date", "close"), ["exchange", "symbol"]), days).select("exchange", "symbol", "day", "close")
    value = held.join(marks, ["exchange", "symbol", "day"]).groupBy("portfolio", "day").agg(F.sum(F.col("held") * F.col("close")).alias("market_value"))
    cash = on_days(intervals(cash_by_day(trades, start_capital), ["portfolio"]), days).select("portfolio", "day", "cash")
    early = trades.groupBy("portfolio").agg(F.min("date").alias("until")).withColumn("date", F.lit("0001-01-01").cast("date"))
    first = days.agg(F.min("day")).scalar()
    early = on_days(early.withColumn("date", F.greatest("date", first)), days).select("portfolio", "day", F.lit(start_capital).alias("cash"))
    out = cash.unionByName(early).join(value, ["portfolio", "day"], "left")
    b = on_days(intervals(bench.select(F.lit(0).alias("k"), "date", F.col("close").alias("bench_close")), ["k"]), days)  # one row per calendar day
    out = out.withColumn("market_value", F.coalesce("market_value", F.lit(0.0))).withColumn("value", F.col("cash") + F.col("market_value"))
    return out.join(F.broadcast(b.select("day", "bench_close")), "day", "left").withColumnRenamed("day", "date").select("portfolio", "date", "cash", "market_value", "value", "bench_close")


def value_on(trades: DataFrame, closes: DataFrame, day: Column) -> DataFrame:
    """Market value of every portfolio on one day, the row that ``daily_snapshots`` has for it, from sums instead of intervals.
    ``closes``: the last close up to the day, one row per exchange and symbol."""
    held = trades.groupBy(*KEYS).agg(F.sum(F.when(F.col("date") <= day, signed_qty()).otherwise(0)).alias("held"))
    value = F.sum(F.when(F.col("held") > 0, F.col("held") * F.col("close")))
    out = held.join(closes.select("exchange", "symbol", "close"), ["exchange", "symbol"], "left").groupBy("portfolio").agg(value.alias("market_value"))
    return out.select("portfolio", day.alias("date"), F.coalesce("market_value", F.lit(0.0)).alias("market_value"))


def sale_results(ordered: DataFrame) -> DataFrame:
    """Realised profit of every sale against the average cost before it."""
    return running_cost(ordered).filter("side = 'sell'")


def portfolio_summary(ordered: DataFrame, charges: DataFrame, snapshots: DataFrame, start_capital: float) -> DataFrame:
    """Realised profit, charges, share of winning sales (a sale at cost, to a hundredth of a paisa, is none), return, benchmark return and drawdown."""
    s = sale_results(ordered).groupBy("portfolio").agg(F.sum("realised").alias("realised"), F.count("*").alias("n_sales"), F.avg((F.round("realised", 4) > 0).cast("double")).alias("win_rate"))
    c = charges.groupBy("portfolio").agg(F.sum("total").cast("double").alias("charges"))
    peak = F.max("value").over(Window.partitionBy("portfolio").orderBy("date").rowsBetween(UNB, 0))
    v = (snapshots.withColumn("_dd", F.when(peak > 0, F.col("value") / peak - 1)).groupBy("portfolio").agg(
        (F.max_by("value", "date") / start_capital - 1).alias("total_return"),
        (safe_div(F.max_by("bench_close", F.when(F.col("bench_close").isNotNull(), F.col("date"))), F.min_by("bench_close", F.when(F.col("bench_close").isNotNull(), F.col("date")))) - 1).alias("benchmark_return"),
        F.least(F.lit(0.0), F.min("_dd")).alias("max_drawdown")))
    return s.join(c, "portfolio", "left").join(v, "portfolio", "left")


def xirr(flows: DataFrame, lo: float = -0.999999, hi: float = 1e6, steps: int = 90) -> DataFrame:
    """Yearly rate (act/365) that makes each portfolio's flows worth zero, by bisection inside one
    plan. Flows are netted to days first, so a portfolio is a calendar-bounded list. NULL below two
    flows, with one sign only, all on one day, or without a sign change in [lo, hi]."""
    day = flows.groupBy("portfolio", "date").agg(F.sum("amount").alias("amount"))
    g = day.groupBy("portfolio").agg(F.min("date").alias("_d0"), F.max("date").alias("_d1"), F.max("amount").alias("_mx"), F.min("amount").alias("_mn"),
                                     F.sort_array(F.collect_list(F.struct("date", "amount"))).alias("_f"))
    g = g.withColumn("_f", F.transform("_f", lambda x: F.struct((F.datediff(x["date"], F.col("_d0")) / 365.0).alias("t"), x["amount"].alias("v"))))

    def npv(rate):
        return F.aggregate("_f", F.lit(0.0), lambda s, x: s + x["v"] / F.pow(1 + rate, x["t"]))
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), npv(F.lit(lo)).alias("f"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        v = npv(mid)
        same = F.signum(v) == F.signum(s["f"])
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid).alias("hi"), s["f"].alias("f"))
    ok = (F.size("_f") >= 2) & (F.col("_mx") > 0) & (F.col("_mn") < 0) & (F.col("_d1") > F.col("_d0")) & (F.signum(npv(F.lit(lo))) != F.signum(npv(F.lit(hi))))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)
    out = g.withColumn("xirr", F.when(ok, root))
    return out.select("portfolio", F.size("_f").alias("n_days"), "xirr", npv(F.col("xirr")).alias("npv"), F.aggregate("_f", F.lit(0.0), lambda s, x: s + F.abs(x["v"])).alias("gross"))


def net_flows(trades: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Investor's view of a portfolio: money in at each purchase, out at each sale, final holdings last."""
    f = trades.select("portfolio", "date", cash_flow().alias("amount"))
    end = latest_per(snapshots, ["portfolio"], [F.col("date").desc()]).select("portfolio", "date", F.col("market_value").alias("amount"))
    return f.unionByName(end)
