"""Identity, calendar and lifecycle (survey 2.4)."""

from pyspark.sql import functions as F

from barloom.operators import identity as idn
from barloom.operators import lake
from barloom.plans.registry import query
from barloom.plans.workbench import SERIES


def _records(wb):
    return wb.listings.join(wb.securities.select("security_id", "isin", "company_name", "face_value"), "security_id")


RECORDS = "SELECT l.*, s.isin, s.company_name, s.face_value FROM listings l JOIN securities s USING (security_id) WHERE isin IS NOT NULL"
query("i1_merge_master_securities", f"""
SELECT isin, arg_min(symbol, k) AS canonical_symbol, arg_min(company_name, k) AS company_name, arg_min(face_value, k) AS face_value,
       arg_min(exchange, k) AS primary_exchange, count(*) AS n_records
FROM (SELECT *, row(exchange <> 'NSE', symbol, series) AS k FROM ({RECORDS})) GROUP BY isin""")(lambda wb: idn.merge_master(_records(wb))[0])
query("i1_merge_master_listings", f"SELECT DISTINCT exchange, symbol, series, isin FROM ({RECORDS})")(lambda wb: idn.merge_master(_records(wb))[1])
query("i2_detect_renames", """
WITH p AS (SELECT DISTINCT security_id, exchange, CASE WHEN security_id % 3 = 0 THEN symbol ELSE 'OLD' || symbol END AS o FROM listings),
m AS (SELECT p.*, n.symbol AS n FROM p JOIN (SELECT DISTINCT security_id, exchange, symbol FROM listings) n USING (security_id, exchange)
      WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.security_id = p.security_id AND l.exchange = p.exchange AND l.symbol = p.o))
SELECT security_id, exchange, o AS symbol, DATE '1900-01-01' AS valid_from, DATE '1998-01-01' AS valid_to FROM m
UNION SELECT security_id, exchange, n, DATE '1998-01-01', NULL FROM m""")(
    lambda wb: idn.detect_renames(
        wb.listings.withColumn("symbol", F.when(F.col("security_id") % 3 == 0, F.col("symbol")).otherwise(F.concat(F.lit("OLD"), "symbol"))),
        wb.listings, "1998-01-01"))
TARGETS = """
chain AS (
  SELECT old_symbol, new_symbol, changed_on, new_symbol AS final_symbol, changed_on AS last_on FROM changes
  UNION ALL
  SELECT c.old_symbol, c.new_symbol, c.changed_on, n.new_symbol, n.changed_on FROM chain c JOIN changes n ON n.old_symbol = c.final_symbol AND n.changed_on >= c.last_on),
target AS (SELECT old_symbol, new_symbol, changed_on, arg_max(final_symbol, last_on) AS final_symbol FROM chain GROUP BY ALL)"""
query("i3_symbol_history_from_changes", f"""
WITH RECURSIVE {TARGETS},
ls AS (SELECT symbol, min(security_id) AS security_id FROM listings WHERE exchange = 'NSE' GROUP BY symbol)
SELECT t.old_symbol AS symbol, t.final_symbol, f.security_id,
  coalesce((SELECT max(p.changed_on) FROM changes p WHERE p.new_symbol = t.old_symbol AND p.changed_on <= t.changed_on), DATE '1900-01-01') AS valid_from, t.changed_on AS valid_to,
  CASE WHEN r.symbol IS NOT NULL THEN 'conflict' WHEN f.security_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM target t LEFT JOIN ls f ON f.symbol = t.final_symbol LEFT JOIN ls r ON r.symbol = t.old_symbol""")(
    lambda wb: idn.symbol_history_from_changes(wb.changes, wb.listings, "NSE"))
CLASS = "CASE WHEN isin LIKE 'INF%' THEN 'fund' WHEN isin LIKE 'INE%' THEN 'equity' WHEN isin IS NOT NULL THEN 'other' END"
query("i4_classify_isin", f"SELECT security_id, isin, {CLASS} AS instrument_class FROM securities")(
    lambda wb: idn.classify_isin(wb.securities).select("security_id", "isin", "instrument_class"))


def _classes(wb):
    return idn.classify_isin(wb.securities).select(F.col("canonical_symbol").alias("symbol"), "instrument_class")


query("i5_inherit_class", f"""
WITH RECURSIVE {TARGETS}, k AS (SELECT canonical_symbol AS symbol, {CLASS} AS instrument_class FROM securities WHERE isin IS NOT NULL)
SELECT t.old_symbol AS symbol, arg_max(k.instrument_class, t.changed_on) AS instrument_class FROM target t JOIN k ON k.symbol = t.final_symbol
WHERE t.old_symbol NOT IN (SELECT symbol FROM k) GROUP BY 1""")(lambda wb: idn.inherit_class(wb.changes, _classes(wb)))
query("i6_exclude_funds", "SELECT symbol, date, close FROM panel WHERE symbol NOT IN (SELECT canonical_symbol FROM securities WHERE isin LIKE 'INF%')", "close")(
    lambda wb: idn.exclude_funds(wb.panel, _classes(wb)).select("symbol", "date", "close"))


def _lifecycle(wb):
    # Snapshot = symbols that traded on the last 10 days; state from a previous run is carried per listing.
    listed = wb.listings.withColumn("missed", (F.col("security_id") * 3 % 22).cast("int")).withColumn(
        "last_missed_on", F.when(F.col("security_id") % 2 == 0, F.lit("2001-11-04").cast("date")))
    snap = wb.bars.filter(F.col("date") >= "2001-11-03").select("exchange", "symbol")
    return idn.lifecycle(listed, snap, "2001-11-04", max_absent=0.6)


query("i7_lifecycle", """
WITH l AS (SELECT *, CAST(security_id * 3 % 22 AS INTEGER) AS missed, CASE WHEN security_id % 2 = 0 THEN DATE '2001-11-04' END AS lm FROM listings),
s AS (SELECT DISTINCT exchange, symbol, TRUE AS seen FROM bars WHERE date >= DATE '2001-11-03'),
j AS (SELECT l.*, seen, avg(CASE WHEN seen IS NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY l.exchange) AS r FROM l LEFT JOIN s USING (exchange, symbol)),
c AS (SELECT security_id, CASE WHEN r > 0.6 THEN missed WHEN seen THEN 0 WHEN lm = DATE '2001-11-04' THEN missed ELSE missed + 1 END AS m FROM j)
SELECT security_id, min(m) AS missed, count(*) AS n_listings, CASE WHEN min(m) >= 20 THEN 'DELISTED' WHEN min(m) >= 1 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status
FROM c GROUP BY 1""")(_lifecycle)


def _half_known(wb):
    sid = F.regexp_extract("symbol", r"#(\d+)-", 1).cast("long")
    return wb.bars.select("exchange", "symbol", "series", "date", F.when(F.col("series") == "BZ", sid + 1000).alias("security_id"),
                          F.when(F.col("series") == "BE", F.lit("REPORTED")).alias("isin"))


query("i8_enrich_identity", """
WITH d AS (SELECT exchange, symbol, any_value(security_id) AS sid, any_value(isin) AS isin FROM listings JOIN securities USING (security_id) GROUP BY ALL)
SELECT b.exchange, b.symbol, series, date, CASE WHEN series = 'BZ' THEN CAST(regexp_extract(b.symbol, '#(\\d+)-', 1) AS BIGINT) + 1000 ELSE sid END AS security_id,
       CASE WHEN series = 'BE' THEN 'REPORTED' ELSE isin END AS isin
FROM bars b LEFT JOIN d USING (exchange, symbol)""")(
    lambda wb: idn.enrich_identity(_half_known(wb), wb.listings.join(wb.securities.select("security_id", "isin"), "security_id")))


def _holidays(wb):
    return (idn.day_span(wb.tape, "date", ["exchange"]).filter(F.date_format("date", "MM-dd").isin("01-26", "08-15", "10-02")))


HOL = "(month(date), day(date)) IN ((1, 26), (8, 15), (10, 2))"
SPAN = "SELECT exchange, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM tape GROUP BY exchange"
query("i9_trading_days", f"SELECT exchange, date FROM ({SPAN}) WHERE isodow(date) < 6 AND NOT ({HOL})")(
    lambda wb: idn.trading_days(wb.tape.groupBy("exchange").agg(F.min("date").alias("start"), F.max("date").alias("end")), _holidays(wb)))
query("i10_calendar_from_bars", """
SELECT s.exchange, s.series, s.date, EXISTS (SELECT 1 FROM bars b WHERE b.exchange = s.exchange AND b.series = s.series AND b.date = s.date) AS is_trading
FROM (SELECT exchange, series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars GROUP BY exchange, series) s WHERE isodow(s.date) < 6""")(
    lambda wb: idn.calendar_from_bars(wb.bars, ["exchange", "series"]))


def _sources(wb):
    auth = wb.calendar.filter(F.year("date") >= 1999).withColumn("source", F.lit("authoritative"))
    obs = idn.calendar_from_bars(wb.bars.filter("series = 'BZ'"), ["exchange"]).withColumn("source", F.lit("observed"))
    proxy = (wb.idx.filter("index_code = 'BROAD_500'").select("date").distinct()
             .select(F.explode(F.array(F.lit("NSE"), F.lit("BSE"))).alias("exchange"), "date", F.lit(True).alias("is_trading"), F.lit("proxy").alias("source")))
    return auth.unionByName(obs).unionByName(proxy)


query("i11_merge_calendar", """
WITH s AS (
 SELECT exchange, date, is_trading, 1 AS r, 'authoritative' AS source FROM calendar WHERE year(date) >= 1999
 UNION ALL SELECT e, date, TRUE, 2, 'proxy' FROM idx, (VALUES ('NSE'), ('BSE')) v(e) WHERE index_code = 'BROAD_500'
 UNION ALL SELECT exchange, date, EXISTS (SELECT 1 FROM bars b WHERE b.series = 'BZ' AND b.exchange = d.exchange AND b.date = d.date), 3, 'observed'
  FROM (SELECT exchange, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars WHERE series = 'BZ' GROUP BY exchange) d WHERE isodow(date) < 6)
SELECT exchange, date, arg_min(is_trading, r) AS is_trading, arg_min(source, r) AS source FROM s GROUP BY ALL""")(
    lambda wb: idn.merge_calendar(_sources(wb), ["authoritative", "proxy", "observed"]))


def _order_days(wb):
    return (wb.read("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
            .select(F.explode(F.array(F.lit("NSE"), F.lit("BSE"))).alias("exchange"), "date"))


ODAYS = "SELECT DISTINCT e AS exchange, CAST(o_orderdate AS DATE) AS date FROM orders, (VALUES ('NSE'), ('BSE')) v(e)"
query("i12_is_trading_day", f"SELECT d.*, c.is_trading FROM ({ODAYS}) d LEFT JOIN calendar c USING (exchange, date)")(
    lambda wb: idn.is_trading_day(_order_days(wb), wb.calendar))
query("i12_previous_trading_day", f"""SELECT d.*, (SELECT max(c.date) FROM calendar c WHERE c.is_trading AND c.exchange = d.exchange AND c.date < d.date AND d.date - c.date <= 14) AS previous_day
FROM ({ODAYS}) d""")(lambda wb: idn.previous_trading_day(_order_days(wb), wb.calendar))


def _spans(wb):
    return wb.actions.select(F.col("action_id").alias("span_id"), "exchange", F.col("captured_on").alias("start"), F.col("ex_date").alias("end"))


query("i12_trading_days_between", """SELECT action_id AS span_id, exchange, captured_on AS start, ex_date AS "end",
 (SELECT CASE WHEN count(*) = a.ex_date - a.captured_on + 1 THEN count(*) FILTER (WHERE is_trading) END FROM calendar c
  WHERE c.exchange = a.exchange AND c.date BETWEEN a.captured_on AND a.ex_date) AS n_days FROM actions a""")(
    lambda wb: idn.trading_days_between(_spans(wb), wb.calendar))
LIM = {"min_median_turnover": 40000.0, "min_median_trades": 1, "min_price": 900.0, "min_listed_days": 800}
REASON = """CASE WHEN listed_days < 800 THEN 'listed_days' WHEN coalesce(median_turnover < 40000, TRUE) THEN 'median_turnover'
 WHEN median_trades < 1 THEN 'median_trades' WHEN coalesce(avg_price < 900, TRUE) THEN 'price' ELSE '' END"""
query("i13_is_liquid", f"""
SELECT *, {REASON} AS reason, {REASON} = '' AS is_liquid FROM (
 SELECT symbol, median(turnover) AS median_turnover, median(volume) AS median_volume, median(trades) AS median_trades, median(delivery_pct) AS median_delivery_pct,
        avg(close) AS avg_price, any_value(n) AS listed_days
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM panel) WHERE rn <= 20 GROUP BY symbol)""",
      "median_turnover median_volume median_trades median_delivery_pct avg_price")(
    lambda wb: idn.is_liquid(lake.liquidity_metrics(wb.panel, "NSE", "2001-12-31"), LIM))
LDAILY = f"""
SELECT *, {REASON} AS reason, {REASON} = '' AS is_liquid FROM (
 SELECT exchange, symbol, date, median(turnover) OVER w AS median_turnover, median(volume) OVER w AS median_volume, median(trades) OVER w AS median_trades,
        avg(close) OVER w AS avg_price, dense_rank() OVER (PARTITION BY exchange, symbol ORDER BY date) AS listed_days,
        lead(date) OVER (PARTITION BY exchange, symbol ORDER BY date, p) IS DISTINCT FROM date AS is_last
 FROM (SELECT *, CASE series WHEN 'EQ' THEN 3 WHEN 'BE' THEN 2 ELSE 1 END AS p FROM bars)
 WINDOW w AS (PARTITION BY exchange, symbol ORDER BY date, p ROWS 19 PRECEDING)) WHERE is_last"""
query("i14_liquidity_daily", f"SELECT * EXCLUDE (is_last) FROM ({LDAILY})", "median_turnover median_volume median_trades avg_price")(
    lambda wb: idn.liquidity_daily(wb.bars, 20, LIM))
query("i15_intraday_tradeable", """
WITH l AS (SELECT exchange, symbol, CASE WHEN exchange = 'NSE' THEN (CASE WHEN security_id % 5 = 0 THEN 'SM' ELSE series END) ELSE (CASE WHEN security_id % 7 = 0 THEN 'Z' WHEN security_id % 7 = 1 THEN 'XT' ELSE 'A' END) END AS series, security_id FROM listings)
SELECT *, series IN ('SM', 'Z') AS is_excluded, series NOT IN ('SM', 'Z', 'BE', 'XT') AS is_tradeable_intraday FROM l""")(
    lambda wb: idn.intraday_tradeable(wb.listings.withColumn("series", F.when(F.col("exchange") == "NSE", F.when(F.col("security_id") % 5 == 0, "SM").otherwise(F.col("series")))
                                                            .when(F.col("security_id") % 7 == 0, "Z").when(F.col("security_id") % 7 == 1, "XT").otherwise("A"))))
query("i16_universe_current", f"""
SELECT * EXCLUDE (rn, is_last) FROM (SELECT d.*, o.security_id, row_number() OVER (PARTITION BY o.security_id ORDER BY date DESC, d.exchange DESC, d.symbol) AS rn
 FROM ({LDAILY}) d JOIN (SELECT exchange, symbol, min(security_id) AS security_id FROM listings GROUP BY ALL) o USING (exchange, symbol)) WHERE rn = 1""",
      "median_turnover median_volume median_trades avg_price")(lambda wb: idn.universe_current(idn.liquidity_daily(wb.bars, 20, LIM), wb.listings))
