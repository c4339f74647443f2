"""What became of each signal: entry at the next open, first exit, excursions, daily marks; and
order matching against candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.joins import asof_join
from barloom.operators.costs import circuit_lock
from barloom.operators.quality import session_numbers

BAR = ["r", "n", "date", "open", "high", "low", "close", "lock"]


def numbered_bars(panel: DataFrame, clock: str = "symbol") -> DataFrame:
    """Adds ``r`` (the symbol's own bar number), ``n`` (the clock's session number) and ``lock``.

    ``clock`` = "symbol": sessions are the symbol's own bars; "market": days on which anything
    traded. The market calendar has one row per day, hence the broadcast."""
    w = Window.partitionBy("symbol").orderBy("date")
    out = panel.withColumn("r", F.row_number().over(w)).withColumn("_pc", F.lag("close").over(w)).withColumn(
        "lock", circuit_lock(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("_pc"))).drop("_pc")
    if clock == "symbol":
        return out.withColumn("n", F.col("r"))
    days = session_numbers(panel.withColumn("_m", F.lit(0)), ["_m"]).select("date", F.col("session").alias("n"))
    return out.join(F.broadcast(days), "date")


def next_open_entry(signals: DataFrame, bars: DataFrame, clock: str = "symbol") -> DataFrame:
    """Signal (key, symbol, date, ...) -> entry on the next session: status entered, cancelled (opened
    locked at the upper band) or no_bar. No signal is lost: one on a day without a bar of its symbol enters
    on the first bar after it ("symbol") or on the next market session ("market")."""
    if clock == "market":
        days = bars.select("date", F.col("n").alias("_n")).distinct()
        sig = signals.join(days, "date", "left")
    else:
        own = bars.select("symbol", F.col("date").alias("_bar"), F.col("n").alias("_n"))
        sig = asof_join(signals, own, ["symbol"], "date", "_bar", ["_n"]).drop("_bar_asof").withColumn("_n", F.coalesce("_n", F.lit(0)))
    nxt = bars.select("symbol", (F.col("n") - 1).alias("_n"), F.col("n").alias("entry_n"), F.col("r").alias("entry_r"),
                      F.col("date").alias("entry_date"), F.col("open").alias("entry_price"), F.col("lock").alias("_lock"))
    status = F.when(F.col("entry_date").isNull(), "no_bar").when(F.col("_lock") == "upper", "cancelled").otherwise("entered")
    return sig.join(nxt, ["symbol", "_n"], "left").withColumn("entry_status", status).drop("_n", "_lock")


#: Bars of a block of the skip index.
BLOCK = 16
ENTRY = ["symbol", "entry_n", "entry_r", "entry_date", "entry_price", "stop_pct", "target_pct", "hold_days"]


def _exit(bar: Column, i: Column, stop: Column, target: Column, hold: Column, entry_n: Column, defer: bool) -> Column:
    """Exit of one bar: gap through the stop, stop, gap to the target, target, time; NULL reason = none."""
    later = i > 0
    reason = (F.when(later & (bar["open"] <= stop), "stop_gap").when(later & (bar["low"] <= stop), "stop")
              .when(later & (bar["open"] >= target), "target_gap").when(later & (bar["high"] >= target), "target")
              .when(bar["n"] - entry_n >= hold, "time"))
    if defer:
        reason = F.when(bar["lock"] != "lower", reason)
    price = (F.when(reason.isin("stop_gap", "target_gap"), bar["open"]).when(reason == "stop", stop)
             .when(reason == "target", target).when(reason == "time", bar["close"]))
    return F.struct(bar["r"].alias("r"), bar["date"].alias("date"), price.alias("price"), reason.alias("reason"))


def _last_bar_number(entries: DataFrame, bars: DataFrame, defer: bool) -> DataFrame:
    """Adds ``_end``, the last bar number an entry can need. Each bar is at least one session, so hold
    bars after the entry reach the time exit; when locked bars cannot be sold, as many sellable bars."""
    if not defer:
        return entries.withColumn("_end", F.col("entry_r") + F.col("hold_days"))
    w = Window.partitionBy("symbol").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    sellable = F.col("lock") != "lower"
    runs = bars.select("symbol", "r", sellable.alias("_ok"), F.sum(sellable.cast("int")).over(w).alias("_s"),
                       F.max("r").over(Window.partitionBy("symbol")).alias("_max"))
    at = runs.select("symbol", F.col("r").alias("entry_r"), "_s", "_max")
    ends = runs.filter("_ok").select("symbol", F.col("_s").alias("_want"), F.col("r").alias("_r"))
    e = entries.join(at, ["symbol", "entry_r"]).withColumn("_want", F.col("_s") + F.col("hold_days")).join(ends, ["symbol", "_want"], "left")
    return e.withColumn("_end", F.coalesce("_r", "_max")).drop("_s", "_want", "_r", "_max")


def skip_index(bars: DataFrame, defer: bool = False) -> DataFrame:
    """One row per (symbol, block of BLOCK bar numbers): lowest low, highest high, and the lowest, highest and last session
    (``_lo``, ``_hi``, ``_n``) among the bars on which something can be sold."""
    can = F.lit(True) if not defer else F.col("lock") != "lower"
    return bars.groupBy("symbol", F.floor(F.col("r") / BLOCK).alias("_block")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(can, F.col("low"))).alias("_lo"), F.max(F.when(can, F.col("high"))).alias("_hi"), F.max(F.when(can, F.col("n"))).alias("_n"))


def first_exit(entries: DataFrame, bars: DataFrame, keys: list[str], cost_pct: Column | float = 0.0, defer_locks: bool = False) -> DataFrame:
    """Exit and excursions of every entry; daily marks are had from ``daily_marks``.

    An entry meets the blocks of the skip index that its hold spans. The first block after its own whose extremes or last
    session allow an exit is certain to have one, so only the bars of the entry's own block and of that one are looked at,
    and the extremes of the blocks between are those of the index: 2 * BLOCK bars at most, whatever the hold. Everything
    is found by equality on (symbol, number). With ``defer_locks`` a bar locked at the lower band cannot be sold and the
    next one is tried."""
    e = _last_bar_number(entries.filter("entry_status = 'entered'"), bars, defer_locks)
    e = e.withColumn("_stop", F.col("entry_price") * (1 - F.col("stop_pct"))).withColumn("_target", F.col("entry_price") * (1 + F.col("target_pct"))).withColumn("_own", F.floor(F.col("entry_r") / BLOCK))
    ids = [*keys, *ENTRY, "_end", "_stop", "_target", "_own"]
    met = e.select(*ids, F.explode(F.sequence("_own", F.floor(F.col("_end") / BLOCK))).alias("_block")).join(skip_index(bars, defer_locks), ["symbol", "_block"])
    hit = (F.col("_block") > F.col("_own")) & ((F.col("_lo") <= F.col("_stop")) | (F.col("_hi") >= F.col("_target")) | (F.col("_n") - F.col("entry_n") >= F.col("hold_days")))
    blocks = met.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("_block", "high", "low", F.coalesce(hit, F.lit(False)).alias("hit")))).alias("_b"))  # hold / BLOCK entries
    far = F.coalesce(F.get(F.filter("_b", lambda x: x["hit"]), 0)["_block"], F.element_at("_b", -1)["_block"])
    blocks = blocks.withColumn("_far", far)
    between = F.filter("_b", lambda x: (x["_block"] > F.col("_own")) & (x["_block"] < F.col("_far")))
    blocks = blocks.withColumn("_mh", F.array_max(F.transform(between, lambda x: x["high"]))).withColumn("_ml", F.array_min(F.transform(between, lambda x: x["low"]))).drop("_b")
    own = F.sequence(F.col("entry_r").cast("long"), F.least(F.col("_end").cast("long"), F.col("_own") * BLOCK + BLOCK - 1))
    last = F.sequence(F.col("_far") * BLOCK, F.least(F.col("_end").cast("long"), F.col("_far") * BLOCK + BLOCK - 1))
    some = F.when(F.col("_far") > F.col("_own"), F.concat(own, last)).otherwise(own)
    looked = blocks.withColumn("r", F.explode(some)).join(bars.select("symbol", "r", F.struct(*BAR).alias("_bar")), ["symbol", "r"])
    p = looked.groupBy(*ids, "_far", "_mh", "_ml").agg(F.sort_array(F.collect_list("_bar")).alias("path"))  # 2 * BLOCK bars
    exits = F.filter(F.transform("path", lambda b: _exit(b, b["r"] - F.col("entry_r"), F.col("_stop"), F.col("_target"), F.col("hold_days"), F.col("entry_n"), defer_locks)),
                     lambda x: x["reason"].isNotNull())
    p = p.withColumn("_x", F.try_element_at(exits, F.lit(1)))
    p = p.withColumn("_held", F.filter("path", lambda b: b["r"] <= F.coalesce(F.col("_x.r"), b["r"])))
    cost = F.lit(cost_pct) if isinstance(cost_pct, float) else cost_pct
    zero, end = F.lit(0.0), F.element_at("_held", -1)
    passed = end["r"] >= F.col("_far") * BLOCK  # the blocks between were held through
    high = F.greatest(F.array_max(F.transform("_held", lambda b: b["high"])), F.when(passed, F.col("_mh")))
    low = F.least(F.array_min(F.transform("_held", lambda b: b["low"])), F.when(passed, F.col("_ml")))
    return p.select(
        *keys, "symbol", "entry_date", "entry_price", "hold_days", F.when(F.col("_x").isNull(), "open").otherwise("closed").alias("status"),
        F.col("_x.date").alias("exit_date"), F.col("_x.price").alias("exit_price"), F.col("_x.reason").alias("exit_reason"),
        end["date"].alias("last_date"), (F.coalesce(F.col("_x.price"), end["close"]) / F.col("entry_price") - 1 - cost).alias("net_return"), (end["r"] - F.col("entry_r")).cast("int").alias("holding_days"),
        F.greatest(zero, high / F.col("entry_price") - 1).alias("mfe"), F.least(zero, low / F.col("entry_price") - 1).alias("mae"), "entry_r")


def daily_marks(outcomes: DataFrame, bars: DataFrame, keys: list[str], cost_pct: float = 0.0) -> DataFrame:
    """One row for every day held: the net gain at the close, on the exit day at the exit price."""
    days = outcomes.withColumn("r", F.explode(F.sequence(F.col("entry_r").cast("long"), F.col("entry_r").cast("long") + F.col("holding_days"))))
    at = days.join(bars.select("symbol", "r", "date" if "date" not in keys else F.col("date").alias("_day"), F.col("close").alias("_close")), ["symbol", "r"])
    day = "_day" if "date" in keys else "date"
    price = F.when(F.col(day) == F.col("exit_date"), F.col("exit_price")).otherwise(F.col("_close"))
    return at.select(*keys, "symbol", "entry_date", F.col(day).alias("mark_date" if "date" in keys else "date"), (price / F.col("entry_price") - 1 - cost_pct).alias("net"))


def track_picks(picks: DataFrame, panel: DataFrame, keys: list[str], as_of, cost_pct: Column | float = 0.0, void_after: int = 10) -> DataFrame:
    """Standing of every pick on ``as_of``: pending_entry, open, closed, or void when no bar followed
    within ``void_after`` days. The symbol's own bars are the clock. All marks are derived anew."""
    day = F.lit(as_of).cast("date")
    bars = numbered_bars(panel.filter(F.col("date") <= day), "symbol").withColumn("lock", F.lit("none"))
    entries = next_open_entry(picks.filter(F.col("date") <= day), bars)
    done = first_exit(entries, bars, keys, cost_pct)
    waiting = entries.filter("entry_status = 'no_bar'").select(
        *keys, "symbol", F.when(F.datediff(day, "date") > void_after, "void").otherwise("pending_entry").alias("status"))
    return done.unionByName(waiting, allowMissingColumns=True)


def touch_fills(orders: DataFrame, candles: DataFrame, on_day=None) -> DataFrame:
    """First candle that fills each order, and at what price. ``on_day`` tries every working order on
    that one day, whatever its validity.

    Orders meet the candles of the days they are valid on (equality on symbol and day, a bounded
    number of candles a day); an order without expiry meets those of its symbol from its day on. A market order fills at the open, or at the close of the candle it was
    placed in; a limit at the better of limit and open, a stop at the worse, a target at the better."""
    c = candles.withColumn("day", F.to_date("candle_start"))
    days = F.sequence(F.to_date("created_at"), F.to_date(F.col("valid_until") - F.expr("INTERVAL 1 MICROSECOND")))
    o = orders.filter(F.col("status").isin("open", "pending_eod"))
    c = c.select("symbol", "day", "candle_start", "candle_end", "open", "high", "low", "close", *(["lock"] if "lock" in c.columns else []))
    if on_day is None:
        dated = o.filter("valid_until IS NOT NULL").withColumn("day", F.explode(days)).join(c, ["symbol", "day"])
        lasting = o.filter("valid_until IS NULL").withColumnRenamed("symbol", "_s").join(c, (F.col("_s") == F.col("symbol")) & (F.col("day") >= F.to_date("created_at"))).drop("_s")
        j = dated.unionByName(lasting)
    else:
        o = o.withColumn("day", F.lit(on_day).cast("date")).withColumn("valid_until", F.date_add("day", 1).cast("timestamp"))
        j = o.join(c, ["symbol", "day"])
    start, made = F.col("candle_start"), F.col("created_at")
    market = F.col("type") == "market"
    during = market & (start < made) & (made < F.col("candle_end"))
    j = j.filter(((start >= made) | during) & F.coalesce(start < F.col("valid_until"), F.lit(True)))
    if "lock" in c.columns:
        j = j.filter(F.when(F.col("side") == "buy", F.col("lock") != "upper").otherwise(F.col("lock") != "lower"))
    lim, trig, op = F.col("limit_price"), F.col("trigger_price"), F.col("open")
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    limit_buy = (F.col("type") == "limit") & buy & (F.col("low") <= lim)
    limit_sell = (F.col("type") == "limit") & sell & (F.col("high") >= lim)
    stop = (F.col("type") == "stop_loss") & (F.col("low") <= trig)
    goal = (F.col("type") == "target") & (F.col("high") >= trig)
    price = (F.when(market & during, F.col("close")).when(market, op).when(limit_buy, F.least(lim, op)).when(limit_sell, F.greatest(lim, op))
             .when(stop, F.least(trig, op)).when(goal, F.greatest(trig, op)))
    reason = (F.when(market & during, "market_close").when(market, "market_open")
              .when(limit_buy, F.when(op <= lim, "limit_gap").otherwise("limit_touch")).when(limit_sell, F.when(op >= lim, "limit_gap").otherwise("limit_touch"))
              .when(stop, F.when(op <= trig, "stop_gap").otherwise("stop_touch")).when(goal, F.when(op >= trig, "target_gap").otherwise("target_touch")))
    hits = j.withColumn("fill_price", price).withColumn("fill_reason", reason).filter(F.col("fill_price").isNotNull())
    first = F.struct("candle_start", "fill_price", "fill_reason")
    return (hits.groupBy("order_id", "symbol", "type", "side", "qty", "oco_group").agg(F.min_by(first, "candle_start").alias("f"))
            .select("order_id", "symbol", "type", "side", "qty", "oco_group", "f.*"))


def oco_first(fills: DataFrame) -> DataFrame:
    """One fill per exclusive group: the earliest candle, and the stop when both touch in it."""
    rank = F.struct("candle_start", (F.col("type") != "stop_loss").alias("s"), "order_id")
    cols = [c for c in fills.columns]
    group = F.coalesce(F.concat(F.lit("g"), F.col("oco_group").cast("string")), F.concat(F.lit("o"), F.col("order_id").cast("string")))
    return (fills.withColumn("_g", group).groupBy("_g").agg(F.min_by(F.struct(*cols), rank).alias("f")).select("f.*"))


def expire_market_orders(orders: DataFrame, fills: DataFrame, session_close: Column, covered: DataFrame | None = None) -> DataFrame:
    """Market orders still open at the close of their session: cancelled, not carried over."""
    left = orders.filter((F.col("type") == "market") & F.col("status").isin("open", "pending_eod") & (F.col("created_at") <= session_close))
    if covered is not None:
        left = left.join(covered.select("symbol").distinct(), "symbol", "left_semi")
    return left.join(fills.select("order_id"), "order_id", "left_anti").withColumn("status", F.lit("cancelled"))
