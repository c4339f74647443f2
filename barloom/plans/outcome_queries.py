"""Costs, slippage, fills and per-signal outcomes (survey 2.9)."""

from pyspark.sql import functions as F

from barloom.operators import costs as cs
from barloom.operators import features as ft
from barloom.operators import outcomes as oc
from barloom.plans.derived import outcome_sql
from barloom.plans.registry import query

TID = ["portfolio", "symbol", "date", "orderkey", "linenumber", "partkey", "suppkey", "amount", "side"]


def modern(wb):
    """The ledger moved 25 years on, so that every dated rate change is met; every third line is intraday."""
    return wb.ledger.withColumn("date", F.add_months("date", 300)).withColumn("product", F.when(F.col("linenumber") % 3 == 0, "intraday").otherwise("delivery"))


MODERN = "m AS (SELECT * REPLACE (CAST(date + INTERVAL 300 MONTH AS DATE) AS date, CASE WHEN linenumber % 3 = 0 THEN 'intraday' ELSE 'delivery' END AS product) FROM ledger)"
RATES = """rates AS (SELECT *, CASE WHEN exchange = 'BSE' THEN 0.0000375 WHEN date >= DATE '2026-03-01' THEN 0.000030699 ELSE 0.0000297 END::DECIMAL(12,10) AS exchange_rate,
 CASE WHEN exchange = 'BSE' THEN 0 WHEN date >= DATE '2026-03-01' THEN 0.000000001 ELSE 0.000001 END::DECIMAL(12,10) AS ipft_rate,
 CASE WHEN product = 'delivery' THEN 0.001 WHEN side = 'sell' THEN 0.00025 ELSE 0 END::DECIMAL(12,10) AS stt_rate,
 CASE WHEN side = 'sell' THEN 0 WHEN product = 'delivery' THEN 0.00015 ELSE 0.00003 END::DECIMAL(12,10) AS stamp_rate FROM m)"""
query("t1_rates_asof", f"WITH {MODERN}, {RATES} SELECT exchange, product, side, date, exchange_rate, ipft_rate, stt_rate, stamp_rate, count(*) AS n FROM rates GROUP BY ALL",
      "exchange_rate:10 ipft_rate:10 stt_rate:10 stamp_rate:10")(
    lambda wb: cs.rates_asof(modern(wb)).groupBy("exchange", "product", "side", "date", "exchange_rate", "ipft_rate", "stt_rate", "stamp_rate").agg(F.count("*").alias("n")))
CH = ["brokerage", "stt", "stamp_duty", "exchange_txn", "ipft", "sebi_fee", "gst", "total"]
query("t2_charges", f"""
WITH {MODERN}, {RATES}, v AS (SELECT *, CAST(round(qty * price, 2) AS DECIMAL(18,2)) AS turnover FROM rates),
c AS (SELECT *, round(CASE WHEN product = 'intraday' THEN least(turnover * 0.0003, 20) ELSE 0 END, 2) AS brokerage, round(turnover * stt_rate, 2) AS stt, round(turnover * stamp_rate, 2) AS stamp_duty,
 round(turnover * exchange_rate, 2) AS exchange_txn, round(turnover * ipft_rate, 2) AS ipft, round(turnover * 0.000001, 2) AS sebi_fee FROM v),
g AS (SELECT *, round((brokerage + exchange_txn + sebi_fee + ipft) * 0.18, 2) AS gst FROM c)
SELECT {', '.join(TID)}, turnover, brokerage, stt, stamp_duty, exchange_txn, ipft, sebi_fee, gst, brokerage + stt + stamp_duty + exchange_txn + ipft + sebi_fee + gst AS total FROM g""",
      "amount:2 turnover:2 " + " ".join(f"{c}:2" for c in CH))(lambda wb: cs.charges(modern(wb)).select(*TID, "turnover", *CH))
query("t3_dp_charge", f"WITH {MODERN} SELECT portfolio, symbol, date, count(*) AS n_sells, 15.34 AS dp_charge FROM m WHERE side = 'sell' AND product = 'delivery' GROUP BY ALL", "dp_charge:2")(
    lambda wb: cs.dp_charges(modern(wb)))
query("t4_slippage", """
SELECT symbol, date, bps, open * (1 + bps / 10000.0::DOUBLE) AS buy_price, open * (1 - bps / 10000.0::DOUBLE) AS sell_price FROM (
 SELECT symbol, date, open, CASE WHEN a IS NULL THEN 40 WHEN a >= 500000000 THEN 5 WHEN a >= 100000000 THEN 10 WHEN a >= 20000000 THEN 20 ELSE 40 END AS bps FROM (SELECT symbol, date, open, turnover_med20 * 2000 AS a FROM feat))""", "buy_price sell_price")(
    lambda wb: ft.turnover_history(wb.panel).withColumn("bps", cs.slippage_bps(F.col("turnover_med20") * 2000)).select(
        "symbol", "date", "bps", cs.slipped(F.col("open"), F.lit("buy"), F.col("bps")).alias("buy_price"), cs.slipped(F.col("open"), F.lit("sell"), F.col("bps")).alias("sell_price")))
query("t5_cap_qty", "SELECT symbol, date, CAST(least(trades * 2, floor(volume * 0.05::DOUBLE)) AS BIGINT) AS qty FROM panel")(
    lambda wb: wb.panel.select("symbol", "date", cs.cap_qty(F.col("trades") * 2, F.col("volume")).cast("long").alias("qty")))
query("t6_circuit_lock", "SELECT symbol, date, lock FROM numbered")(lambda wb: oc.numbered_bars(wb.panel).select("symbol", "date", "lock"))


def signals(wb):
    """A 20-bar breakout on every bar of the panel."""
    f = ft.prior_extremes(wb.panel, (20,), ()).filter("close > high_prior20")
    return f.select(F.lit("breakout").alias("rule"), "symbol", "date", F.lit(0.1).alias("stop_pct"), F.when(F.col("volume") % 2 == 0, 0.3).alias("target_pct"), (5 + F.col("volume") % 8).cast("int").alias("hold_days"))


SIG = "SELECT 'breakout' AS rule, symbol, date, 0.1::DOUBLE AS stop_pct, CASE WHEN volume % 2 = 0 THEN 0.3::DOUBLE END AS target_pct, CAST(5 + volume % 8 AS INTEGER) AS hold_days FROM feat WHERE close > high_prior20"
for clock in ("market", "symbol"):
    n = "n" if clock == "market" else "r"
    query(f"t7_next_open_entry_{clock}", f"""
SELECT s.symbol, s.date, x.date AS entry_date, x.open AS entry_price, CASE WHEN x.date IS NULL THEN 'no_bar' WHEN x.lock = 'upper' THEN 'cancelled' ELSE 'entered' END AS entry_status
FROM ({SIG}) s JOIN numbered b USING (symbol, date) LEFT JOIN numbered x ON x.symbol = s.symbol AND x.{n} = b.{n} + 1""", "entry_price")(
        lambda wb, c=clock: oc.next_open_entry(signals(wb), oc.numbered_bars(wb.panel, c), c).select("symbol", "date", "entry_date", "entry_price", "entry_status"))
XCOLS = ["rule", "date", "symbol", "entry_date", "entry_price", "hold_days", "status", "exit_date", "exit_price", "exit_reason", "last_date", "net_return", "holding_days"]


def exits(wb, clock, **kw):
    b = wb.numbered_market if clock == "market" else wb.numbered_symbol
    if clock == "symbol":
        b = b.withColumn("lock", F.lit("none"))
    return oc.first_exit(oc.next_open_entry(signals(wb), b, clock), b, ["rule", "date"], **kw)


query("t8_first_exit_symbol_clock", f"SELECT {', '.join(XCOLS)} FROM ({outcome_sql(SIG, 'symbol')})", "entry_price exit_price net_return")(lambda wb: exits(wb, "symbol").select(*XCOLS))
query("t8_first_exit_market_clock", f"SELECT {', '.join(XCOLS)} FROM ({outcome_sql(SIG, 'market')})", "entry_price exit_price net_return")(lambda wb: exits(wb, "market").select(*XCOLS))
query("t9_excursions", f"SELECT symbol, date, mfe, mae, holding_days, net_return FROM ({outcome_sql(SIG, 'symbol', '0.005')})", "mfe mae net_return")(
    lambda wb: exits(wb, "symbol", cost_pct=0.005).select("symbol", "date", "mfe", "mae", "holding_days", "net_return"))
query("t9_daily_marks", f"""
WITH o AS ({outcome_sql(SIG, 'symbol', '0.005')})
SELECT o.symbol, o.date AS signal_date, o.entry_date, b.date, CASE WHEN b.date = o.exit_date THEN o.net_return ELSE b.close / o.entry_price - 1 - 0.005 END AS net
FROM o JOIN numbered b ON b.symbol = o.symbol AND b.date BETWEEN o.entry_date AND o.last_date""", "net")(
    lambda wb: oc.daily_marks(exits(wb, "symbol", cost_pct=0.005).withColumnRenamed("date", "signal_date"), wb.numbered_symbol, ["signal_date"], 0.005))
query("t10_round_trip_cost", """
WITH d AS (SELECT exchange, CAST(date + INTERVAL 300 MONTH AS DATE) AS date, count(*) AS n_bars FROM bars GROUP BY ALL),
r AS (SELECT *, CASE WHEN exchange = 'BSE' THEN 3.75 WHEN date >= DATE '2026-03-01' THEN 3.07 ELSE 2.97 END AS ex, CASE WHEN exchange = 'BSE' THEN 0 WHEN date >= DATE '2026-03-01' THEN 0 ELSE 0.10 END AS ip FROM d)
SELECT exchange, date, n_bars, (100 + 100 + 15 + 2 * (ex + ip + 0.10) + 2 * round((ex + ip + 0.10) * 0.18, 2) + 15.34) / 100000 AS cost_pct FROM r""", "cost_pct:8")(
    lambda wb: wb.bars.groupBy("exchange", F.add_months("date", 300).alias("date")).agg(F.count("*").alias("n_bars")).withColumn("cost_pct", cs.round_trip_cost_pct(F.col("exchange"), F.col("date"))))
TRACK = outcome_sql("SELECT * FROM picks WHERE date <= DATE '2000-06-30'", "symbol", "0.0026").replace("numbered", "numbered_asof")
query("t11_track_picks", f"""
WITH numbered_asof AS (SELECT * FROM numbered WHERE date <= DATE '2000-06-30'), o AS ({TRACK})
SELECT rule, date, symbol, entry_date, exit_date, exit_reason, status, net_return, holding_days FROM o
UNION ALL SELECT rule, p.date, p.symbol, NULL, NULL, NULL, CASE WHEN DATE '2000-06-30' - p.date > 10 THEN 'void' ELSE 'pending_entry' END, NULL, NULL
FROM picks p JOIN numbered_asof b ON b.symbol = p.symbol AND b.date = p.date WHERE NOT EXISTS (SELECT 1 FROM numbered_asof x WHERE x.symbol = p.symbol AND x.r = b.r + 1)""", "net_return")(
    lambda wb: oc.track_picks(wb.picks.select("rule", "symbol", "date", "stop_pct", "target_pct", "hold_days"), wb.panel, ["rule", "date"], "2000-06-30", 0.0026)
    .select("rule", "date", "symbol", "entry_date", "exit_date", "exit_reason", "status", "net_return", "holding_days"))
query("t12_exit_lock_defer", f"SELECT {', '.join(XCOLS)} FROM ({outcome_sql(SIG, 'market', defer=True)})", "entry_price exit_price net_return")(
    lambda wb: exits(wb, "market", defer_locks=True).select(*XCOLS))
FILLS = """
SELECT order_id, symbol, type, side, qty, oco_group, candle_start, fill_price, fill_reason FROM (
 SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY candle_start) AS rn FROM (
  SELECT b.*, c.candle_start, CASE
    WHEN type = 'market' AND c.candle_start < created_at THEN close WHEN type = 'market' THEN open
    WHEN type = 'limit' AND side = 'buy' AND low <= limit_price THEN least(limit_price, open) WHEN type = 'limit' AND side = 'sell' AND high >= limit_price THEN greatest(limit_price, open)
    WHEN type = 'stop_loss' AND low <= trigger_price THEN least(trigger_price, open) WHEN type = 'target' AND high >= trigger_price THEN greatest(trigger_price, open) END AS fill_price,
   CASE WHEN type = 'market' AND c.candle_start < created_at THEN 'market_close' WHEN type = 'market' THEN 'market_open'
    WHEN type = 'limit' AND ((side = 'buy' AND open <= limit_price) OR (side = 'sell' AND open >= limit_price)) THEN 'limit_gap' WHEN type = 'limit' THEN 'limit_touch'
    WHEN type = 'stop_loss' THEN CASE WHEN open <= trigger_price THEN 'stop_gap' ELSE 'stop_touch' END ELSE CASE WHEN open >= trigger_price THEN 'target_gap' ELSE 'target_touch' END END AS fill_reason
  FROM book b JOIN candles c ON c.symbol = b.symbol AND c.candle_start < b.valid_until
   AND (c.candle_start >= b.created_at OR (b.type = 'market' AND b.created_at > c.candle_start AND b.created_at < c.candle_start + INTERVAL 30 MINUTE)))
 WHERE fill_price IS NOT NULL) WHERE rn = 1"""


def fills(wb):
    return oc.touch_fills(wb.book, wb.candles.withColumn("candle_end", F.col("candle_start") + F.expr("INTERVAL 30 MINUTES")))


query("t13_touch_fills", FILLS, "fill_price")(fills)
query("t14_oco_first", f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('g' || oco_group, 'o' || order_id) ORDER BY candle_start, type <> 'stop_loss', order_id) AS k FROM ({FILLS})) WHERE k = 1""", "fill_price")(
    lambda wb: oc.oco_first(fills(wb)))
query("t15_expire_market_orders", f"SELECT order_id, symbol, created_at, 'cancelled' AS status FROM book WHERE type = 'market' AND created_at <= TIMESTAMP '2024-01-25 10:00:00' AND order_id NOT IN (SELECT order_id FROM ({FILLS}))")(
    lambda wb: oc.expire_market_orders(wb.book, fills(wb), F.lit("2024-01-25 10:00:00").cast("timestamp")).select("order_id", "symbol", "created_at", "status"))
