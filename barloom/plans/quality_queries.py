"""Data-quality jobs (survey 2.2)."""

from pyspark.sql import functions as F

from barloom.operators import identity, lake
from barloom.operators import quality as dq
from barloom.plans.registry import query

query("d1_duplicate_keys", "SELECT exchange, symbol, series, date, count(*) AS n FROM tape GROUP BY ALL HAVING count(*) > 1")(
    lambda wb: dq.duplicate_keys(wb.tape))
query("d2_ohlc_order", """SELECT exchange, symbol, series, date, 'fatal' AS severity FROM bars WHERE vwap < greatest(open, close, low)""")(
    lambda wb: dq.ohlc_order(wb.bars.withColumn("high", F.col("vwap"))).select("exchange", "symbol", "series", "date", "severity"))
query("d3_non_positive", """
SELECT exchange, symbol, series, date, 'close' AS "check" FROM bars WHERE close - 200 <= 0
UNION ALL SELECT exchange, symbol, series, date, 'volume' FROM bars WHERE volume - 10 < 0
UNION ALL SELECT exchange, symbol, series, date, 'turnover' FROM bars WHERE turnover - 5000 < 0""")(
    lambda wb: dq.non_positive(wb.bars.withColumn("close", F.col("close") - 200).withColumn("volume", F.col("volume") - 10)
                               .withColumn("turnover", F.col("turnover") - 5000)))
query("d4_delivery_exceeds_volume", """SELECT *, n_over <= least(5, floor(n_rows * 0.005)) AS tolerated FROM (
  SELECT exchange, date, count(*) AS n_rows, count(*) FILTER (WHERE delivery_qty * 2 > volume) AS n_over FROM bars GROUP BY ALL) WHERE n_over > 0""")(
    lambda wb: dq.delivery_exceeds_volume(wb.bars.withColumn("delivery_qty", F.col("delivery_qty") * 2)))
query("d5_turnover_implausible", """SELECT exchange, symbol, series, date, implied, turnover / implied AS ratio FROM (
  SELECT *, volume * (low * low / high) AS implied FROM bars) WHERE implied >= 10000 AND NOT (turnover / implied BETWEEN 0.33 AND 3.0)""", "implied ratio")(
    lambda wb: dq.turnover_implausible(wb.bars.withColumn("vwap", F.col("low") * F.col("low") / F.col("high")))
    .select("exchange", "symbol", "series", "date", "implied", "ratio"))
query("d6_wrong_date", """SELECT exchange, requested, count(*) AS n_rows, string_agg(DISTINCT CAST(date AS VARCHAR), ',' ORDER BY CAST(date AS VARCHAR)) AS found
FROM (SELECT exchange, date, CAST(date_trunc('week', date) AS DATE) AS requested FROM tape) WHERE date <> requested GROUP BY exchange, requested""")(
    lambda wb: dq.wrong_date(wb.tape.withColumn("requested", F.trunc("date", "week"))))


def _idx_open(wb):
    w = F.lag("close").over(lake.Window.partitionBy("index_code").orderBy("date"))
    one = wb.idx.withColumn("open", w)
    # Captured feed: prices under 50 arrive as zero, and the printed name can be published twice.
    low = one.withColumn("close", F.when(F.dayofmonth("date") == 7, F.col("close") - F.col("high")).otherwise(F.col("close")))
    return low.unionByName(low.filter(F.dayofmonth("date") == 21))


query("d7_index_problems", """
WITH o AS (SELECT *, lag(close) OVER (PARTITION BY index_code ORDER BY date) AS open FROM idx),
c AS (SELECT * REPLACE (CASE WHEN day(date) = 7 THEN close - high ELSE close END AS close) FROM o),
u AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE day(date) = 21)
SELECT index_code, date, 'duplicate' AS "check" FROM u GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT index_code, date, 'negative_close' FROM u WHERE close < 0
UNION ALL SELECT index_code, date, 'zero_close' FROM u WHERE close = 0 AND index_code = 'BROAD_500'
UNION ALL SELECT index_code, date, 'high_below_low' FROM u WHERE high < low
UNION ALL SELECT index_code, date, 'high_below_price' FROM u WHERE high < greatest(open, close, low)""")(
    lambda wb: dq.index_problems(_idx_open(wb), F.col("index_code") == "BROAD_500"))
query("d8_missing_days", """
SELECT c.exchange, s.series, c.date FROM calendar c JOIN (SELECT exchange, series, min(date) AS lo FROM bars GROUP BY ALL) s ON s.exchange = c.exchange AND c.date >= s.lo
WHERE c.is_trading AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.exchange = c.exchange AND b.series = s.series AND b.date = c.date)""")(
    lambda wb: dq.missing_days(wb.calendar, wb.bars, ["exchange", "series"]))
query("d9_stale_symbols", """
WITH cut AS (SELECT exchange, min(date) AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY date DESC) AS rn FROM calendar WHERE is_trading) WHERE rn <= 2 GROUP BY exchange)
SELECT b.exchange, symbol, max(date) AS last_date, cutoff FROM bars b JOIN cut ON cut.exchange = b.exchange
WHERE b.symbol IN (SELECT symbol FROM bars WHERE turnover > 150000) GROUP BY ALL HAVING max(date) < cutoff""")(
    lambda wb: dq.stale_symbols(wb.bars, wb.calendar, wb.bars.groupBy("symbol").agg(F.max("turnover").alias("m")).filter("m > 150000")
                                .select("symbol", F.explode(F.array(F.lit("NSE"), F.lit("BSE"))).alias("exchange")), 2))
JUMPS = """
SELECT exchange, symbol, series, date, prev, close, close / prev AS ratio FROM (
  SELECT b.*, s.session, lag(close) OVER w AS prev, lag(session) OVER w AS ps
  FROM adj b JOIN (SELECT exchange, date, row_number() OVER (PARTITION BY exchange ORDER BY date) AS session FROM (SELECT DISTINCT exchange, date FROM adj)) s USING (exchange, date)
  WINDOW w AS (PARTITION BY exchange, symbol, series ORDER BY date))
WHERE session = ps + 1 AND (close / prev < 0.6 OR close / prev > 1.6)"""
query("d10_adjusted_jumps", JUMPS, "prev close ratio")(lambda wb: dq.adjusted_jumps(wb.adj))
query("d11_classify_jumps", f"""
WITH j AS ({JUMPS}), own AS (SELECT symbol, min(security_id) AS security_id FROM (SELECT symbol, security_id FROM symhist UNION SELECT symbol, security_id FROM listings) GROUP BY symbol),
a AS (SELECT security_id, ex_date, price_factor FROM factored JOIN own USING (symbol))
SELECT j.*, own.security_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.security_id = own.security_id AND abs(a.ex_date - j.date) <= 5 AND a.price_factor IS NULL) THEN 'known_hole' ELSE 'unexplained' END AS kind
FROM j LEFT JOIN own USING (symbol)
WHERE j.symbol NOT IN (SELECT canonical_symbol FROM securities WHERE isin LIKE 'INF%')""", "prev close ratio")(
    lambda wb: dq.classify_jumps(
        dq.adjusted_jumps(wb.adj), wb.factored,
        wb.symhist.select("symbol", "security_id").unionByName(wb.listings.select("symbol", "security_id")).groupBy("symbol").agg(F.min("security_id").alias("security_id")),
        identity.fund_symbols(wb.securities)))
query("d12_benchmark_gaps", """SELECT DISTINCT date FROM bars WHERE exchange = 'NSE' AND date >= (SELECT min(date) FROM idx WHERE index_code = 'BROAD_500')
AND NOT EXISTS (SELECT 1 FROM idx i WHERE i.index_code = 'BROAD_500' AND i.date = bars.date)""")(
    lambda wb: dq.benchmark_gaps(wb.bars.filter("exchange = 'NSE'"), wb.idx, "BROAD_500"))
query("d13_adjusted_freshness", """SELECT exchange, last_bar, last_ex_date, last_ex_date IS NULL OR last_bar >= last_ex_date AS is_fresh
FROM (SELECT exchange, max(date) AS last_bar FROM adj GROUP BY 1) LEFT JOIN (SELECT exchange, max(ex_date) AS last_ex_date FROM actions WHERE ex_date <= DATE '1998-11-30' GROUP BY 1) USING (exchange)""")(
    lambda wb: dq.adjusted_freshness(wb.adj, wb.actions, "1998-11-30"))
query("d14_parse_status_counts", "SELECT parse_status, count(DISTINCT action_id) AS n FROM parsed GROUP BY 1")(
    lambda wb: dq.parse_status_counts(wb.parsed))
HEALTH = """SELECT job, day, max(attempt) AS attempt, arg_max(status, attempt) AS status FROM job_runs GROUP BY job, day HAVING arg_max(status, attempt) IN ('failed', 'degraded')"""
query("d15_job_health", f"SELECT * FROM ({HEALTH}) WHERE isodow(day) < 6 AND day <> DATE '2024-01-26'")(
    lambda wb: dq.job_health(wb.job_runs, identity.weekday_calendar(wb.job_runs, "day", holidays=["2024-01-26"])))
query("d16_job_alerts", """
WITH l AS (SELECT job, day, scheduled FROM job_runs GROUP BY ALL HAVING arg_max(status, attempt) = 'failed' AND day > (SELECT max(day) FROM job_runs) - 3)
SELECT job, day, scheduled, 'failed' AS status FROM l WHERE scheduled OR NOT EXISTS (SELECT 1 FROM l p WHERE p.scheduled AND p.job = l.job AND p.day = l.day)""")(
    lambda wb: dq.job_alerts(wb.job_runs, wb.job_runs.agg(F.max("day").alias("as_of"))))
query("d17_failure_streaks", """SELECT job, count(*) AS n, count(*) AS n_failed FROM (
 SELECT *, row_number() OVER (PARTITION BY job ORDER BY attempt DESC) AS rn FROM job_runs WHERE status <> 'skipped') WHERE rn <= 2
 GROUP BY job HAVING bool_and(status = 'failed') AND count(*) = 2""")(lambda wb: dq.failure_streaks(wb.job_runs, 2))
query("d18_source_freshness", """
WITH n AS (SELECT 'filings' AS source, max(available_on) AS newest, 130 AS limit_days FROM filings UNION ALL SELECT 'master', max(captured_on), 21 FROM actions)
SELECT *, date_diff('day', newest, (SELECT max(date) FROM tape)) AS age_days, date_diff('day', newest, (SELECT max(date) FROM tape)) > limit_days AS is_stale FROM n""")(
    lambda wb: dq.source_freshness(
        wb.filings.agg(F.max("available_on").alias("newest")).select(F.lit("filings").alias("source"), "newest", F.lit(130).alias("limit_days"))
        .unionByName(wb.actions.agg(F.max("captured_on").alias("newest")).select(F.lit("master").alias("source"), "newest", F.lit(21).alias("limit_days"))),
        wb.tape.agg(F.max("date").alias("as_of"))))
query("d18_inactive_counts", "SELECT status, count(*) AS n FROM securities WHERE status <> 'ACTIVE' GROUP BY 1")(
    lambda wb: dq.inactive_counts(wb.securities))
query("d19_replayable_failures", f"""SELECT * FROM ({HEALTH}) h WHERE status = 'failed' AND EXISTS (
 SELECT 1 FROM ticks t WHERE t.symbol = h.job AND CAST(t.ts AS DATE) = h.day AND t.price > 100)""")(
    lambda wb: dq.replayable_failures(wb.job_runs, wb.ticks.filter("price > 100").select(F.col("symbol").alias("source"), F.to_date("ts").alias("day"))))
query("d20_unclassified_universe", "SELECT exchange, count(DISTINCT symbol) AS n_symbols FROM bars WHERE exchange = 'BSE' GROUP BY 1")(
    lambda wb: dq.unclassified_exchanges(wb.bars, identity.classify_isin(
        wb.securities.select(F.lit("NSE").alias("exchange"), F.col("canonical_symbol").alias("symbol"), "isin"))))
query("d20_outage_counts", """SELECT job, count(*) AS n_failed FROM job_runs WHERE status = 'failed'
AND finished_at >= (SELECT max(finished_at) FROM job_runs) - INTERVAL 48 HOUR GROUP BY 1""")(
    lambda wb: dq.outage_counts(wb.job_runs, wb.job_runs.agg(F.max("finished_at").alias("as_of"))))
