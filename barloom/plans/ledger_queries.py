"""Ledgers and portfolios (survey 2.11)."""

from pyspark.sql import functions as F

from barloom.operators import costs as cs
from barloom.operators import lake
from barloom.operators import ledger as lg
from barloom.plans.derived import TABLE_SQL
from barloom.plans.outcome_queries import MODERN, RATES
from barloom.plans.registry import query
from barloom.plans.workbench import SERIES

CAP = 100_000_000.0
ORD = "date, block, orderkey, linenumber, partkey, suppkey, amount, side"
TABLE_SQL["walk"] = f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY portfolio, exchange, symbol ORDER BY {ORD}) AS n FROM ledger),
f AS (
 SELECT portfolio, exchange, symbol, n, date, orderkey, linenumber, partkey, suppkey, amount, side, l.qty AS tq, price, l.qty AS held, price AS avg_cost, 0.0::DOUBLE AS gain FROM l WHERE n = 1
 UNION ALL
 SELECT l.portfolio, l.exchange, l.symbol, l.n, l.date, l.orderkey, l.linenumber, l.partkey, l.suppkey, l.amount, l.side, l.qty, l.price, CASE WHEN l.side = 'buy' THEN held + l.qty ELSE held - l.qty END,
  CASE WHEN l.side = 'buy' THEN (avg_cost * held + l.price * l.qty) / (held + l.qty) WHEN held = l.qty THEN 0 ELSE avg_cost END,
  CASE WHEN l.side = 'sell' THEN (l.price - avg_cost) * l.qty ELSE 0 END
 FROM f JOIN l ON l.portfolio = f.portfolio AND l.exchange = f.exchange AND l.symbol = f.symbol AND l.n = f.n + 1)
SELECT * FROM f"""
TABLE_SQL["pos"] = """SELECT portfolio, exchange, symbol, arg_max(held, n) AS qty, arg_max(avg_cost, n) AS avg_cost, sum(gain) AS realised, min(date) AS opened_on, max(date) AS last_trade FROM walk GROUP BY ALL"""
FLOW = "CASE WHEN side = 'buy' THEN -qty * price ELSE qty * price END"
TID = ["portfolio", "symbol", "date", "orderkey", "linenumber", "partkey", "suppkey", "amount", "side"]
query("b1_positions", "SELECT * FROM pos", "avg_cost:4 realised:3")(lambda wb: lg.positions(wb.trades_in_order))
query("b1_oversold", "SELECT portfolio, symbol, date, orderkey FROM walk WHERE held < 0")(lambda wb: lg.oversold(wb.trades_in_order).select("portfolio", "symbol", "date", "orderkey"))
query("b2_cash_by_day", f"""SELECT portfolio, date, n_trades, sum(flow) OVER (PARTITION BY portfolio ORDER BY date) + {CAP} AS cash FROM (SELECT portfolio, date, count(*) AS n_trades, sum({FLOW}) AS flow FROM ledger GROUP BY ALL)""", "cash:3")(
    lambda wb: lg.cash_by_day(wb.ledger, CAP).select("portfolio", "date", "n_trades", "cash"))
query("b2_running_cash", f"SELECT {', '.join(TID)}, sum({FLOW}) OVER (PARTITION BY portfolio ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) + {CAP} AS cash FROM ledger", "cash:3 amount:2")(
    lambda wb: lg.running_cash(wb.ledger, CAP).select(*TID, "cash"))
SPLITS = "SELECT DISTINCT exchange, symbol, ex_date, price_factor, volume_factor FROM parsed WHERE price_factor IS NOT NULL"


def _splits(wb):
    return wb.parsed.filter("price_factor IS NOT NULL").select("exchange", "symbol", "ex_date", "price_factor", "volume_factor")


query("b3_apply_split", f"""
WITH a AS ({SPLITS}), h AS (SELECT w.portfolio, w.exchange, w.symbol, a.ex_date, a.price_factor, a.volume_factor, arg_max(held, n) AS qty, arg_max(avg_cost, n) AS avg_cost FROM walk w JOIN a ON w.exchange = a.exchange AND w.symbol = a.symbol AND w.date < a.ex_date GROUP BY ALL)
SELECT portfolio, exchange, symbol, ex_date, qty, nq AS new_qty, CASE WHEN nq > 0 THEN qty * avg_cost * nq / ex / nq ELSE 0 END AS new_avg_cost, ex - nq AS dropped_shares, qty * avg_cost - CASE WHEN nq > 0 THEN qty * avg_cost * nq / ex ELSE 0 END AS dropped_cost
FROM (SELECT *, qty * volume_factor AS ex, CAST(floor(qty * volume_factor + 1e-9) AS BIGINT) AS nq FROM h WHERE qty > 0)""", "new_avg_cost:3 dropped_shares dropped_cost:2")(
    lambda wb: lg.apply_split(wb.trades_in_order, _splits(wb).distinct()))
TABLE_SQL["hold"] = """SELECT portfolio, exchange, symbol, date, CAST(sum(q) OVER (PARTITION BY portfolio, exchange, symbol ORDER BY date) AS BIGINT) AS held FROM (
 SELECT portfolio, exchange, symbol, date, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS q FROM ledger GROUP BY ALL)"""
HELD = """SELECT p.portfolio, p.exchange, p.symbol, a.*, (SELECT arg_max(h.held, h.date) FROM hold h WHERE h.portfolio = p.portfolio AND h.exchange = p.exchange AND h.symbol = p.symbol AND h.date < a.ex_date) AS held
 FROM (SELECT DISTINCT portfolio, exchange, symbol FROM ledger) p JOIN {0} a USING (exchange, symbol)"""
query("b4_held_before", f"SELECT portfolio, exchange, symbol, action_id, ex_date, coalesce(held, 0) AS held FROM ({HELD.format('actions')})")(
    lambda wb: lg.held_before(wb.ledger, wb.actions.select("action_id", "exchange", "symbol", "ex_date")).select("portfolio", "exchange", "symbol", "action_id", "ex_date", "held"))
query("b5_dividends", f"""SELECT portfolio, exchange, symbol, action_id, clause, ex_date, held, round(held * CAST(amount AS DECIMAL(18,4)), 2) AS credit FROM ({HELD.format('parsed')})
WHERE held > 0 AND action_type IN ('dividend', 'distribution') AND amount IS NOT NULL""", "credit:2")(
    lambda wb: lg.dividends(wb.ledger, wb.parsed.select("action_id", "clause", "exchange", "symbol", "ex_date", "action_type", "amount")).select("portfolio", "exchange", "symbol", "action_id", "clause", "ex_date", "held", "credit"))


def _book(wb):
    """Working orders on market symbols: one limit, stop or bracket order per purchase, open for a year."""
    odd = F.when(F.col("linenumber") % 2 == 0, F.col("price"))
    return wb.ledger.filter("side = 'buy'").select("portfolio", "symbol", "date", "orderkey", "linenumber", "partkey", "suppkey", "amount", "qty", F.col("price").alias("limit_price"), odd.alias("trigger_price"),
                                                   (odd * 0.9).alias("bracket_stop"), (odd * 1.1).alias("bracket_target"), F.lit("open").alias("status"), F.date_add("date", 365).alias("valid_until"))


RC = "portfolio, symbol, date, orderkey, linenumber, partkey, suppkey, amount"
SCALED = "list_reduce(list_prepend(CASE WHEN linenumber % 2 = 0 THEN price * {0} END, pf), lambda x, y: floor(x * y * 100 + 0.5) / 100)"
query("b6_rescale_orders", f"""
WITH o AS (SELECT {', '.join('l.' + c for c in RC.split(', '))}, l.qty, l.price, max(a.ex_date) AS ex_date, CAST(count(*) AS INTEGER) AS n_actions, list(CAST(volume_factor AS DOUBLE) ORDER BY a.ex_date, price_factor) AS vf, list(CAST(price_factor AS DOUBLE) ORDER BY a.ex_date, price_factor) AS pf
 FROM ledger l JOIN ({SPLITS}) a ON a.symbol = l.symbol AND a.ex_date > l.date AND a.ex_date <= l.date + 365 WHERE side = 'buy' GROUP BY ALL)
SELECT {RC}, ex_date, n_actions, CAST(list_reduce(list_prepend(CAST(qty AS DOUBLE), vf), lambda x, y: floor(x * y + 1e-9)) AS BIGINT) AS new_qty, CASE WHEN list_reduce(list_prepend(CAST(qty AS DOUBLE), vf), lambda x, y: floor(x * y + 1e-9)) < 1 THEN 'cancelled' ELSE 'open' END AS status,
 list_reduce(list_prepend(CAST(price AS DOUBLE), pf), lambda x, y: floor(x * y * 100 + 0.5) / 100) AS limit_price, {SCALED.format('1')} AS trigger_price, {SCALED.format('0.9::DOUBLE')} AS bracket_stop, {SCALED.format('1.1::DOUBLE')} AS bracket_target FROM o""", "amount:2 limit_price:2 trigger_price:2 bracket_stop:2 bracket_target:2")(
    lambda wb: lg.rescale_orders(_book(wb), _splits(wb)).select(*RC.split(", "), "ex_date", "n_actions", "new_qty", "status", "limit_price", "trigger_price", "bracket_stop", "bracket_target"))
AK = ["symbol", "ex_date", "action_type", "num", "den", "amount"]
query("b7_apply_once", """WITH k AS (SELECT DISTINCT symbol, ex_date, action_type, num, den, amount, price_factor FROM parsed WHERE parse_status = 'parsed')
SELECT symbol, ex_date, action_type, num, den, amount FROM k WHERE symbol || ex_date NOT IN (SELECT symbol || ex_date FROM parsed WHERE action_type = 'dividend' AND parse_status = 'parsed')""", "amount")(
    lambda wb: (lambda p: lg.apply_once(
        p.unionByName(p.withColumn("action_id", -F.col("action_id"))),
        p.join(p.filter("action_type = 'dividend'").select("symbol", "ex_date").distinct(), ["symbol", "ex_date"], "left_semi")
        .select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in [*AK, "price_factor"]]).alias("action_key")), [*AK, "price_factor"]).select(*AK))(
        wb.parsed.filter("parse_status = 'parsed'")))
query("b8_value_portfolio", f"""
WITH c AS (SELECT exchange, symbol, arg_max(close, date) AS mark FROM closes GROUP BY 1, 2), k AS (SELECT portfolio, sum({FLOW}) + {CAP} AS cash FROM ledger GROUP BY 1),
a AS (SELECT portfolio, count(*) AS n_positions, sum(avg_cost * qty) AS invested, sum(coalesce(mark, avg_cost) * qty) AS market_value, sum((mark - avg_cost) * qty) AS unrealised, max(DATE '2002-01-31' - opened_on) AS longest_held_days
      FROM pos LEFT JOIN c USING (exchange, symbol) WHERE qty > 0 GROUP BY 1)
SELECT *, cash + coalesce(market_value, 0) AS value FROM k LEFT JOIN a USING (portfolio)""", "cash:2 invested:2 market_value:2 unrealised:2 value:2")(
    lambda wb: lg.value_portfolio(lg.positions(wb.trades_in_order), wb.ledger.groupBy("portfolio").agg((F.sum(lg.cash_flow()) + CAP).alias("cash")),
                                  lake.last_closes(wb.bars, "2002-01-31"), "2002-01-31"))
TABLE_SQL["closes"] = """SELECT exchange, symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY exchange, symbol, date ORDER BY CASE series WHEN 'EQ' THEN 1 WHEN 'BE' THEN 2 ELSE 3 END) = 1"""
TABLE_SQL["snaps"] = f"""
WITH d AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM tape),
v AS (SELECT portfolio, date, sum(held * close) AS market_value FROM (
  SELECT p.portfolio, p.date, p.held, x.close FROM (SELECT q.portfolio, q.exchange, q.symbol, q.date, h.held FROM (SELECT * FROM (SELECT DISTINCT portfolio, exchange, symbol FROM ledger), d) q
   ASOF JOIN hold h ON h.portfolio = q.portfolio AND h.exchange = q.exchange AND h.symbol = q.symbol AND q.date >= h.date) p ASOF LEFT JOIN closes x ON x.exchange = p.exchange AND x.symbol = p.symbol AND p.date >= x.date) GROUP BY ALL),
c AS (SELECT portfolio, date, sum(flow) OVER (PARTITION BY portfolio ORDER BY date) + {CAP} AS cash FROM (SELECT portfolio, date, sum({FLOW}) AS flow FROM ledger GROUP BY ALL)),
g AS (SELECT * FROM (SELECT DISTINCT portfolio FROM ledger), d),
k AS (SELECT g.portfolio, g.date, coalesce(c.cash, {CAP}) AS cash FROM g ASOF LEFT JOIN c ON c.portfolio = g.portfolio AND g.date >= c.date),
b AS (SELECT d.date, i.close AS bench_close FROM d ASOF LEFT JOIN (SELECT * FROM idx WHERE index_code = 'BROAD_500') i ON d.date >= i.date)
SELECT k.portfolio, k.date, cash, coalesce(market_value, 0) AS market_value, cash + coalesce(market_value, 0) AS value, bench_close FROM k LEFT JOIN v USING (portfolio, date) JOIN b USING (date)"""


def snaps(wb):
    return lg.daily_snapshots(wb.ledger, lake.one_series_per_day(wb.bars, SERIES, ("exchange", "symbol", "date")), wb.tape.select(F.trunc("date", "month").alias("date")).distinct(), wb.bench, CAP)


query("b9_daily_snapshots", "SELECT * FROM snaps", "cash:2 market_value:2 value:2 bench_close")(snaps)
query("b10_portfolio_summary", f"""
WITH {MODERN}, {RATES}, v AS (SELECT *, CAST(round(qty * price, 2) AS DECIMAL(18,2)) AS turnover FROM rates),
c AS (SELECT *, round(CASE WHEN product = 'intraday' THEN least(turnover * 0.0003, 20) ELSE 0 END, 2) AS br, round(turnover * stt_rate, 2) + round(turnover * stamp_rate, 2) AS tax, round(turnover * exchange_rate, 2) + round(turnover * ipft_rate, 2) + round(turnover * 0.000001, 2) AS fee FROM v),
ch AS (SELECT portfolio, CAST(sum(br + tax + fee + round((br + fee) * 0.18, 2)) AS DOUBLE) AS charges FROM c GROUP BY 1),
s AS (SELECT portfolio, sum(gain) AS realised, count(*) AS n_sales, avg(CASE WHEN round(gain, 4) > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM walk WHERE side = 'sell' GROUP BY 1),
x AS (SELECT *, value / max(value) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS dd FROM snaps),
r AS (SELECT portfolio, arg_max(value, date) / {CAP} - 1 AS total_return, arg_max(bench_close, date) FILTER (WHERE bench_close IS NOT NULL) / arg_min(bench_close, date) FILTER (WHERE bench_close IS NOT NULL) - 1 AS benchmark_return, least(0, min(dd)) AS max_drawdown FROM x GROUP BY 1)
SELECT * FROM s LEFT JOIN ch USING (portfolio) LEFT JOIN r USING (portfolio)""", "realised:2 win_rate charges:2 total_return benchmark_return max_drawdown")(
    lambda wb: lg.portfolio_summary(wb.trades_in_order, cs.charges(wb.trades_in_order.withColumn("date", F.add_months("date", 300)).withColumn("product", F.when(F.col("linenumber") % 3 == 0, "intraday").otherwise("delivery"))), snaps(wb), CAP))


def _last_values(wb):
    """The last snapshot of each portfolio, which is all that a yearly rate needs of them."""
    day = wb.tape.agg(F.trunc(F.max("date"), "month")).scalar()
    closes = lake.last_trade_closes(wb.tape, day, ["orderkey", "linenumber", "partkey", F.round(F.col("amount") * 100), "qty"], SERIES)
    return lg.value_on(wb.ledger, closes, day)


# The same bisection as one recursion over all portfolios; a rate is compared to six decimals of 1 + rate.
query("b11_xirr", f"""
WITH RECURSIVE fl AS (SELECT portfolio, date, sum(amount) AS amount FROM (SELECT portfolio, date, {FLOW} AS amount FROM ledger UNION ALL
  SELECT portfolio, date, market_value FROM snaps QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) = 1) GROUP BY ALL),
t AS (SELECT portfolio, (date - min(date) OVER (PARTITION BY portfolio)) / 365.0::DOUBLE AS y, amount FROM fl),
a AS (SELECT portfolio, list(y) AS ys, list(amount) AS vs, count(*) AS n_days FROM t GROUP BY portfolio),
b(portfolio, k, lo, hi, ys, vs, at_lo) AS (SELECT portfolio, 0, -0.999999::DOUBLE, 1e6::DOUBLE, ys, vs, sign(list_sum(list_transform(list_zip(vs, ys), lambda p: p[1] / pow(1 - 0.999999::DOUBLE, p[2])))) FROM a
 UNION ALL SELECT portfolio, k + 1, CASE WHEN s = at_lo THEN m ELSE lo END, CASE WHEN s = at_lo THEN hi ELSE m END, ys, vs, at_lo FROM (
  SELECT *, (lo + hi) / 2 AS m, sign(list_sum(list_transform(list_zip(vs, ys), lambda p: p[1] / pow(1 + (lo + hi) / 2, p[2])))) AS s FROM b WHERE k < 90))
SELECT portfolio, n_days, 1 + (lo + hi) / 2 AS growth, TRUE AS npv_is_zero FROM b JOIN a USING (portfolio) WHERE k = 90""", "growth:6")(
    lambda wb: lg.xirr(lg.net_flows(wb.ledger, _last_values(wb))).select("portfolio", F.col("n_days").cast("long").alias("n_days"), (1 + F.col("xirr")).alias("growth"), (F.abs("npv") < F.col("gross") * 1e-9).alias("npv_is_zero")))
