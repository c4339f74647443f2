"""Lake reads (survey 2.3) and the shared tables."""

import uuid

from pyspark.sql import functions as F

from barloom.functions.lineage import shared_folder
from barloom.operators import lake
from barloom.plans.registry import query
from barloom.plans.workbench import SERIES
from barloom.sources import store

PREC = "CASE series WHEN 'EQ' THEN 1 WHEN 'BE' THEN 2 ELSE 3 END"


def _lake(wb):
    """The bars written as a lake of exchange and year folders, once per workbench, in the shared folder."""
    if not hasattr(wb, "_lake_path"):
        wb._lake_path = f"{shared_folder(wb.spark)}/lake-{uuid.uuid4().hex}"
        store.write_bars(wb.bars, wb._lake_path)
    return wb._lake_path


query("t0_bars_daily", "SELECT * FROM bars", "vwap delivery_pct open high low close prev_close turnover")(lambda wb: wb.bars)
query("t0_filings", "SELECT * FROM filings",
      "q_revenue q_pbt q_finance q_pat q_eps y_revenue y_pat i_equity i_borrow_nc i_borrow_c")(lambda wb: wb.filings)
query("t0_ledger_totals", """SELECT portfolio, symbol, side, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, round(sum(price), 2) AS price_sum
FROM ledger GROUP BY ALL""", "price_sum", 2)(
    lambda wb: wb.ledger.groupBy("portfolio", "symbol", "side").agg(
        F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum("price").alias("price_sum")))

query("l1_dates_present", "SELECT DISTINCT date FROM bars WHERE exchange = 'NSE'")(
    lambda wb: lake.dates_present(wb.bars, "NSE"))
query("l1_dates_present_in_range",
      "SELECT DISTINCT date FROM bars WHERE exchange = 'BSE' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")(
    lambda wb: lake.dates_present(wb.bars, "BSE", "1996-01-01", "1998-12-31"))
query("l2_lake_span", "SELECT exchange, min(date) AS first_date, max(date) AS latest_date FROM bars GROUP BY exchange")(
    lambda wb: lake.lake_span(wb.bars))
query("l3_partition_row_counts", "SELECT exchange, year(date) AS year, count(*) AS n_rows FROM bars GROUP BY ALL")(
    lambda wb: lake.partition_row_counts(wb.bars))
query("l4_bars_for_symbol_raw", """SELECT * FROM bars WHERE exchange = 'NSE' AND symbol = 'Brand#7-0'
 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", "open high low close prev_close vwap delivery_pct turnover")(
    lambda wb: lake.bars_for_symbol(wb.bars, "NSE", "Brand#7-0", "1996-01-01", "1999-12-31"))
query("l4_bars_for_symbol_lake", """SELECT exchange, symbol, series, date, open, close, volume FROM bars WHERE exchange = 'NSE' AND symbol = 'Brand#7-0'
 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", "open close")(
    lambda wb: lake.bars_for_symbol(store.read_bars(wb.spark, _lake(wb), wb.bars.schema, "NSE", "1996-01-01", "1999-12-31"), "NSE", "Brand#7-0")
    .select("exchange", "symbol", "series", "date", "open", "close", "volume"))
query("l3_partition_row_counts_lake", "SELECT exchange, year(date) AS year, count(*) AS n_rows FROM bars GROUP BY ALL")(
    lambda wb: lake.partition_row_counts(store.read_bars(wb.spark, _lake(wb), wb.bars.schema)))
query("l4_bars_for_symbol_adjusted", """SELECT * FROM adj WHERE exchange = 'NSE' AND symbol = 'Brand#7-0'
 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
      "open high low close prev_close vwap delivery_pct turnover cumulative_price_factor cumulative_volume_factor")(
    lambda wb: lake.bars_for_symbol(wb.adj, "NSE", "Brand#7-0", "1996-01-01", "1999-12-31").drop("source"))
query("l5_latest_bar_per_symbol", "SELECT exchange, symbol, max(date) AS last_date FROM bars GROUP BY ALL")(
    lambda wb: lake.latest_bar_per_symbol(wb.bars))


def _bars_unresolved(wb):
    """Bars as captured: the old symbol before the rename, an id reported only on BZ rows."""
    sid = F.regexp_extract("symbol", r"#(\d+)-", 1).cast("long") + 100 * F.regexp_extract("symbol", r"-(\d+)$", 1).cast("long")
    return wb.bars.select("exchange", F.when((F.col("date") < "1998-01-01") & (F.col("exchange") == "NSE"), F.concat(F.lit("OLD"), "symbol"))
                          .otherwise(F.col("symbol")).alias("symbol"), "series", "date", "close",
                          F.when(F.col("series") == "BZ", sid).alias("security_id"))


query("l6_bars_with_identity", """
WITH b AS (SELECT exchange, CASE WHEN date < DATE '1998-01-01' AND exchange = 'NSE' THEN 'OLD' || symbol ELSE symbol END AS symbol, series, date, close,
   CASE WHEN series = 'BZ' THEN CAST(regexp_extract(symbol, '#(\\d+)-', 1) AS BIGINT) + 100 * CAST(regexp_extract(symbol, '-(\\d+)$', 1) AS BIGINT) END AS security_id
 FROM bars),
cur AS (SELECT exchange, symbol, min(security_id) AS list_id FROM listings GROUP BY ALL)
SELECT b.*, coalesce(b.security_id, h.security_id, list_id) AS resolved_id, s.isin, s.company_name
FROM b LEFT JOIN symhist h ON h.exchange = b.exchange AND h.symbol = b.symbol AND b.date >= h.valid_from AND (h.valid_to IS NULL OR b.date < h.valid_to)
LEFT JOIN cur ON cur.exchange = b.exchange AND cur.symbol = b.symbol
LEFT JOIN securities s ON s.security_id = coalesce(b.security_id, h.security_id, list_id)""", "close")(
    lambda wb: lake.bars_with_identity(_bars_unresolved(wb), wb.symhist, wb.listings, wb.securities))
query("l7_benchmark_series", "SELECT date, close FROM idx WHERE index_code = 'BROAD_500' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", "close")(
    lambda wb: lake.benchmark_series(wb.idx, "BROAD_500", "1996-01-01", "2000-12-31"))
query("l8_panel", f"""
SELECT symbol, date, series, open, high, low, close, volume, turnover FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY {PREC}) AS rn
  FROM adj WHERE exchange = 'NSE' AND symbol IN (SELECT symbol FROM adj WHERE exchange = 'NSE' GROUP BY symbol HAVING max(turnover) >= 150000))
WHERE rn = 1""", "open high low close turnover")(
    lambda wb: lake.panel(wb.adj.filter("exchange = 'NSE'"), SERIES, 150000.0)
    .select("symbol", "date", "series", "open", "high", "low", "close", "volume", "turnover"))
query("l9_panel_for_symbols", """SELECT symbol, date, series, close, volume FROM panel
WHERE symbol IN ('Brand#1-0', 'Brand#9-0', 'Brand#25-0') AND date >= DATE '1997-01-01'""", "close")(
    lambda wb: lake.panel_for_symbols(wb.bars.filter("exchange = 'NSE'"), ["Brand#1-0", "Brand#9-0", "Brand#25-0"], SERIES, "1997-01-01")
    .select("symbol", "date", "series", "close", "volume"))

LIQ = """
SELECT symbol, median(turnover) AS median_turnover, median(volume) AS median_volume, median(trades) AS median_trades,
       median(delivery_pct) AS median_delivery_pct, avg(close) AS avg_price, any_value(n) AS listed_days
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, {prec}) AS rn FROM {src} WHERE exchange = 'NSE' AND date <= DATE '2000-06-30')
JOIN (SELECT symbol, count(DISTINCT date) AS n FROM bars WHERE exchange = 'NSE' AND date <= DATE '2000-06-30' GROUP BY symbol) USING (symbol)
WHERE rn <= 20 GROUP BY symbol"""
M = "median_turnover median_volume median_trades median_delivery_pct avg_price"
query("l10_liquidity_metrics", LIQ.format(prec=PREC, src="bars"), M)(
    lambda wb: lake.liquidity_metrics(wb.bars, "NSE", "2000-06-30"))
query("l10_liquidity_metrics_deduped", LIQ.format(prec=PREC, src="panel"), M)(
    lambda wb: lake.liquidity_metrics(wb.bars, "NSE", "2000-06-30", dedupe=True))
query("l11_liquid_universe", """
SELECT s.security_id, s.isin, s.canonical_symbol, s.primary_exchange, f.exchange, f.symbol, f.median_turnover, f.listed_days, f.is_liquid
FROM (SELECT 'NSE' AS exchange, symbol, median(turnover) AS median_turnover, any_value(n) AS listed_days, median(turnover) >= 40000 AS is_liquid
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, """ + PREC + """) AS rn FROM bars WHERE exchange = 'NSE' AND date <= DATE '2000-06-30')
  JOIN (SELECT symbol, count(DISTINCT date) AS n FROM bars WHERE exchange = 'NSE' AND date <= DATE '2000-06-30' GROUP BY symbol) USING (symbol)
  WHERE rn <= 20 GROUP BY symbol) f
JOIN (SELECT DISTINCT exchange, symbol, security_id FROM listings) l ON l.exchange = f.exchange AND l.symbol = f.symbol
JOIN securities s ON s.security_id = l.security_id WHERE f.is_liquid AND s.primary_exchange = f.exchange""", "median_turnover")(
    lambda wb: lake.liquid_universe(
        lake.liquidity_metrics(wb.bars, "NSE", "2000-06-30").select(
            F.lit("NSE").alias("exchange"), "symbol", "median_turnover", "listed_days", (F.col("median_turnover") >= 40000).alias("is_liquid")),
        wb.listings, wb.securities))
query("l12_adv", """SELECT symbol, median(turnover) AS adv_turnover FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM panel WHERE date <= DATE '2000-06-30') WHERE rn <= 20 GROUP BY symbol""", "adv_turnover")(
    lambda wb: lake.adv(wb.bars, "NSE", "2000-06-30"))
query("l13_bars_on_day", "SELECT * FROM panel WHERE date = DATE '1999-03-15'", "open high low close prev_close vwap delivery_pct turnover")(
    lambda wb: lake.bars_on_day(wb.bars, "NSE", "1999-03-15"))
query("l14_last_close_on_or_before", """SELECT symbol, date AS close_date, close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM panel WHERE date <= DATE '1999-03-14') WHERE rn = 1""", "close")(
    lambda wb: lake.last_close_on_or_before(wb.bars, "NSE", "1999-03-14"))
query("l15_last_change", """
SELECT symbol, max(date) AS last_date, arg_max(close, date) AS last_close, CASE WHEN count(*) = 2 THEN arg_min(close, date) END AS previous_close,
       CASE WHEN count(*) = 2 THEN (arg_max(close, date) / arg_min(close, date) - 1) * 100 END AS change_pct
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM panel) WHERE rn <= 2 GROUP BY symbol""",
      "last_close previous_close change_pct")(lambda wb: lake.last_change(wb.panel))
query("l16_index_moves", """
WITH r AS (SELECT index_code, date, close, lag(close) OVER (PARTITION BY index_code ORDER BY date) AS prev FROM idx),
g AS (SELECT d.day, c.index_code FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d, (VALUES ('BROAD_500'), ('WIDE_200')) c(index_code))
SELECT g.index_code, g.day, r.close, r.date AS close_date, (r.close / r.prev - 1) * 100 AS move_pct, r.date <> g.day AS is_stale
FROM g ASOF JOIN r ON g.index_code = r.index_code AND g.day >= r.date WHERE g.day - r.date <= 10""", "close move_pct")(
    lambda wb: lake.index_moves(wb.idx, wb.read("orders").select(F.to_date("o_orderdate").alias("day")).distinct(), ["BROAD_500", "WIDE_200"]))
query("l17_search_securities", """
SELECT *, CASE WHEN upper(canonical_symbol) = 'BRAND#1' THEN 0 WHEN upper(canonical_symbol) LIKE 'BRAND#1%' THEN 1 ELSE 2 END AS match_rank
FROM securities WHERE status = 'ACTIVE' AND (upper(canonical_symbol) LIKE 'BRAND#1%' OR upper(company_name) LIKE '%BRAND#1%')
ORDER BY match_rank, canonical_symbol LIMIT 15""")(lambda wb: lake.search_securities(wb.securities, "brand#1"))
