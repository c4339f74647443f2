"""Read models, stores, normalisers and intraday tables (survey 2.1, 2.12, 2.13)."""

import uuid

from pyspark.sql import functions as F

from barloom.functions.lineage import cut, shared_folder
from barloom.operators import evaluation as ev
from barloom.operators import identity as idn
from barloom.operators import lake
from barloom.operators import ledger as lg
from barloom.operators import outcomes as oc
from barloom.operators import views as vw
from barloom.plans.derived import TABLE_SQL, outcome_sql
from barloom.plans.evaluation_queries import LIVE, NAMES
from barloom.plans.ledger_queries import CAP, snaps
from barloom.plans.outcome_queries import FILLS, fills
from barloom.plans.registry import query
from barloom.sources import daily_files as files
from barloom.sources import store
from barloom.streaming import candles as cd
from barloom.streaming import jobs

CUT = "2001-06-30"
TABLE_SQL["live"] = f"WITH {LIVE} SELECT * FROM live"
TABLE_SQL["tracked"] = "WITH numbered_asof AS (SELECT * FROM numbered WHERE date <= DATE '2001-06-30') " + outcome_sql(
    "SELECT * FROM picks WHERE date <= DATE '2001-06-30'", "symbol", "0.0026").replace("numbered", "numbered_asof").replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")"


def tracked(wb):
    if not hasattr(wb, "_tracked"):
        from barloom.functions.lineage import cut
        wb._tracked = cut(oc.track_picks(wb.picks.select("rule", "symbol", "date", "stop_pct", "target_pct", "hold_days"), wb.panel, ["rule", "date"], CUT, 0.0026))
    return wb._tracked


def live(wb):
    return ev.live_stats(tracked(wb))


# ---- read models --------------------------------------------------------------------------------
query("v1_picks_view", """
SELECT p.rule, p.symbol, p.date, p.horizon, p.rank, p.score, t.status, t.net_return, t.last_date, s.company_name, l.hit_rate, l.closed
FROM picks p LEFT JOIN tracked t USING (rule, symbol, date) LEFT JOIN securities s ON s.canonical_symbol = p.symbol LEFT JOIN live l ON l.rule = p.rule
WHERE p.date = (SELECT max(date) FROM picks WHERE date <= DATE '2001-05-31' AND horizon = 'momentum') AND horizon = 'momentum'""", "score net_return hit_rate")(
    lambda wb: vw.picks_view(wb.picks.filter("date <= '2001-05-31'"), tracked(wb), wb.securities, live(wb), horizon="momentum")
    .select("rule", "symbol", "date", "horizon", "rank", "score", "status", "net_return", "last_date", "company_name", "hit_rate", "closed"))
STATUS = "SELECT DISTINCT rule, CASE WHEN rule LIKE 's%' THEN 'live' ELSE 'candidate' END AS status FROM picks"
query("v2_strategy_board", f"""SELECT s.rule, s.status, o.cagr AS backtest_cagr, o.win_rate AS backtest_win_rate, o.max_drawdown AS backtest_drawdown, o.trades, l.* EXCLUDE (rule)
FROM ({STATUS}) s LEFT JOIN oos o USING (rule) LEFT JOIN live l USING (rule)""", "backtest_cagr:4 backtest_win_rate backtest_drawdown hit_rate live_return avg_hold_days")(
    lambda wb: vw.strategy_board(wb.oos, live(wb), wb.picks.select("rule").distinct().withColumn("status", F.when(F.col("rule").startswith("s"), "live").otherwise("candidate"))))
query("v3_recent_trades", """
WITH m AS (SELECT rule, symbol, entry_date, exit_date, net_return, 'live' AS origin FROM tracked WHERE status = 'closed' AND rule LIKE 's%'),
a AS (SELECT * FROM m UNION ALL SELECT rule, symbol, entry_date, exit_date, net_return, 'backtest' FROM trades WHERE rule NOT IN (SELECT rule FROM m))
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY exit_date DESC, symbol, entry_date DESC) AS rn FROM a) WHERE rn <= 12""", "net_return")(
    lambda wb: vw.recent_trades(tracked(wb).filter("rule LIKE 's%'"), wb.trades))
query("v4_flagged_by", """SELECT * EXCLUDE (rn) FROM (SELECT symbol, date, rule, rank, score, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, rule) AS rn FROM picks) WHERE rn <= 10""", "score")(
    lambda wb: vw.flagged_by(wb.picks))
PK = "rule, symbol, date, horizon, score"
query("v5_capped_per_horizon", f"SELECT {PK} FROM (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY round(score, 6) DESC, symbol, rule) AS rn FROM picks) WHERE rn <= 2", "score")(
    lambda wb: vw.capped_per_horizon(wb.picks.withColumn("score", F.round("score", 6)), 2).select(*PK.split(", ")))
query("v6_round_robin", f"""SELECT {PK}, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY turn, round(score, 6) DESC, rule) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY date, rule ORDER BY round(score, 6) DESC, symbol) AS turn FROM picks) WHERE turn <= 2) WHERE place <= 5""", "score")(
    lambda wb: vw.round_robin(wb.picks.withColumn("score", F.round("score", 6)), 2, 5).select(*PK.split(", "), "turn", "place"))
MOVES = ["BROAD_500", "WIDE_200"]


def _briefs(wb):
    return vw.brief_payload(wb.picks.withColumn("score", F.round("score", 6)), lake.index_moves(wb.idx, wb.picks.select(F.col("date").alias("day")).distinct(), MOVES), lg.positions(wb.trades_in_order))


def _opened(wb):
    """The payloads read back: one row per day with what they say."""
    text = F.from_json("payload", "date date, picks array<struct<rule:string,rank:int,symbol:string,score:double>>, indices array<struct<index_code:string,close:double,move_pct:double,is_stale:boolean>>, open_positions long")
    return _briefs(wb).select("date", text.alias("x")).select(
        "date", (F.col("date") == F.col("x.date")).alias("same_date"), F.array_join(F.transform("x.picks", lambda p: F.concat_ws(":", p["rule"], p["rank"], p["symbol"])), ",").alias("picks"),
        F.aggregate("x.picks", F.lit(0.0), lambda a, p: a + p["score"]).alias("scores"), F.array_join(F.transform("x.indices", lambda i: i["index_code"]), ",").alias("indices"), "x.open_positions")


query("v7_brief_payload", f"""SELECT p.date, TRUE AS same_date, string_agg(rule || ':' || rank || ':' || symbol, ',' ORDER BY rule, rank, symbol) AS picks, sum(round(score, 6)) AS scores,
 (SELECT string_agg(index_code, ',' ORDER BY index_code) FROM (SELECT DISTINCT index_code FROM idx i WHERE i.date <= p.date)) AS indices, (SELECT count(*) FROM pos WHERE qty > 0) AS open_positions FROM picks p GROUP BY p.date""", "scores:4")(_opened)
query("v8_expected_data", """
SELECT s.exchange, s.first_date, s.latest_date, c.expected_date, coalesce(s.latest_date < c.expected_date, FALSE) AS is_stale
FROM (SELECT exchange, min(date) AS first_date, max(date) AS latest_date FROM bars WHERE exchange = 'NSE' OR date < DATE '2001-10-20' GROUP BY 1) s
LEFT JOIN (SELECT exchange, max(date) AS expected_date FROM calendar WHERE is_trading AND date <= DATE '2001-10-30' GROUP BY 1) c USING (exchange)""")(
    lambda wb: vw.expected_data(wb.calendar, lake.lake_span(wb.bars.filter("exchange = 'NSE' OR date < '2001-10-20'")), "2001-10-31 09:00:00"))


def _availability(wb):
    """First day each kind of input exists in the lake, and what each rule needs from which day."""
    have = (wb.metrics.agg(F.min("available_on").alias("available_from")).select(F.lit("fundamentals").alias("feature"), "available_from", F.lit("filings start late").alias("reason"))
            .unionByName(wb.idx.filter("index_code = 'BROAD_500'").agg(F.min("date").alias("available_from")).select(F.lit("index").alias("feature"), "available_from", F.lit("benchmark starts late").alias("reason"))))
    need = wb.picks.groupBy("rule").agg(F.date_sub(F.min("date"), 1400).alias("run_start")).select(
        "rule", "run_start", F.explode(F.when(F.col("rule").startswith("long"), F.array(F.lit("fundamentals"), F.lit("index"))).otherwise(F.array(F.lit("index")))).alias("feature"))
    return need, have


query("v9_approximation_reasons", """
WITH n AS (SELECT rule, min(date) - 1400 AS rs FROM picks GROUP BY 1), fa AS (SELECT min(available_on) AS d FROM metrics), ia AS (SELECT min(date) AS d FROM idx WHERE index_code = 'BROAD_500'),
r AS (SELECT rule, 'benchmark starts late' AS reason FROM n, ia WHERE ia.d > rs UNION ALL SELECT rule, 'filings start late' FROM n, fa WHERE fa.d > rs AND rule LIKE 'long%')
SELECT rule, string_agg(reason, '; ' ORDER BY reason) AS reasons, count(*) AS n_features FROM r GROUP BY rule""")(lambda wb: vw.approximation_reasons(*_availability(wb)))
query("v10_run_summary", """
WITH r AS (SELECT rule, count(*) AS run_id FROM trades GROUP BY rule ORDER BY run_id DESC, rule LIMIT 5)
SELECT r.rule, run_id, (SELECT count(*) FROM wmetrics w WHERE w.rule = r.rule) * 2 AS n_metrics, (SELECT count(*) FROM trades t WHERE t.rule = r.rule) AS n_trades, (SELECT count(*) FROM wmetrics w WHERE w.rule = r.rule) AS n_windows,
 (SELECT w.sharpe FROM wmetrics w WHERE w.rule = r.rule AND label = 'W5') AS sharpe_w5 FROM r""", "sharpe_w5")(
    lambda wb: vw.run_summary(ev.metrics_long(wb.wmetrics, ["rule", "label"], ["sharpe", "max_drawdown"]), wb.trades, wb.wmetrics, wb.trades.groupBy("rule").agg(F.count("*").alias("run_id")), 5)
    .select("rule", "run_id", F.size("metrics").cast("long").alias("n_metrics"), "n_trades", "n_windows", F.try_element_at("metrics", F.lit("W5/sharpe")).alias("sharpe_w5")))


def _closed_book(wb):
    f = fills(wb).select("order_id", F.col("candle_start").alias("closed_at"))
    return wb.book.join(f, "order_id", "left").withColumn("status", F.when(F.col("closed_at").isNotNull(), "filled").otherwise(F.col("status")))


query("v11_order_activity", f"""WITH f AS ({FILLS}) SELECT b.order_id, b.symbol, CASE WHEN f.order_id IS NULL THEN 'open' ELSE 'filled' END AS status, f.candle_start AS closed_at FROM book b LEFT JOIN f USING (order_id)
WHERE f.order_id IS NULL OR f.candle_start >= TIMESTAMP '2024-01-23 00:00:00'""")(
    lambda wb: vw.order_activity(_closed_book(wb), "2024-01-30 00:00:00").select("order_id", "symbol", "status", "closed_at"))
TO = "orderkey, linenumber, partkey, suppkey, amount, side"
query("v11_newest_trades", f"SELECT portfolio, symbol, date, {TO}, qty FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY date DESC, {', '.join(c + ' DESC' for c in TO.split(', '))}) AS rn FROM ledger) WHERE rn <= 100", "amount:2")(
    lambda wb: vw.newest_trades(wb.ledger, TO.split(", ")).select("portfolio", "symbol", "date", *TO.split(", "), "qty"))
query("v11_rebased_curve", f"SELECT portfolio, date, value, bench_close / first_value(bench_close IGNORE NULLS) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * {CAP} AS benchmark_value FROM snaps", "value:2 benchmark_value:2")(
    lambda wb: vw.rebased_curve(snaps(wb), CAP))
query("v12_usage_totals", """SELECT job AS kind, round(sum(cost), 2) AS known_cost, count(*) FILTER (WHERE cost IS NULL) AS unknown, count(*) AS n_runs FROM (
 SELECT job, day, CASE WHEN status <> 'skipped' THEN (SELECT value FROM events e WHERE e.event_id = attempt) END AS cost FROM job_runs) WHERE day > (SELECT max(day) FROM job_runs) - 10 GROUP BY 1""", "known_cost:2")(
    lambda wb: vw.usage_totals(wb.job_runs.join(wb.read("events").select(F.col("event_id").alias("attempt"), "value"), "attempt")
                               .select(F.col("job").alias("kind"), "day", F.when(F.col("status") != "skipped", F.col("value")).alias("cost")), 10).withColumn("known_cost", F.round("known_cost", 2)))
query("v13_review_calendar", """
WITH d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS date FROM job_runs)
SELECT date, CASE WHEN date IN (SELECT day FROM job_runs GROUP BY day HAVING count(*) FILTER (WHERE status = 'failed') * 100 < count(*) * 22) THEN 'ready' ELSE 'pending' END AS state FROM d
WHERE isodow(date) < 6 AND date <> DATE '2024-01-26' AND date > (SELECT max(date) FROM d) - 14""")(
    lambda wb: vw.review_calendar(
        wb.job_runs.groupBy("day").agg(F.count(F.when(F.col("status") == "failed", 1)).alias("f"), F.count("*").alias("n")).filter("f * 100 < n * 22").select(F.col("day").alias("date")),
        idn.weekday_calendar(wb.job_runs, "day", ["2024-01-26"])))

# ---- sources and store --------------------------------------------------------------------------
BARSEL = "date, exchange, symbol, series, open, high, low, close, prev_close, volume, turnover, trades, delivery_qty"
S3 = BARSEL.removesuffix(", delivery_qty")


def _raw(df, **cols):
    """Bars printed as the text columns of a file layout."""
    return df.select(*[c.alias(n) for n, c in cols.items()])


def _s(c):
    return F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.4f", F.col(c)))


def _l(c):
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def _full(wb):
    raw = _raw(wb.bars.filter("exchange = 'NSE'"), SYMBOL=F.concat(F.lit(" "), "symbol"), SERIES=F.concat(F.lit(" "), "series"), DATE1=F.concat(F.lit(" "), F.date_format("date", "dd-MMM-yyyy")), PREV_CLOSE=_s("prev_close"),
               OPEN_PRICE=_s("open"), HIGH_PRICE=_s("high"), LOW_PRICE=_s("low"), LAST_PRICE=F.lit("-"), CLOSE_PRICE=_s("close"), AVG_PRICE=F.lit("-"), TTL_TRD_QNTY=_l("volume"),
               TURNOVER_LACS=F.format_string("%.10f", F.col("turnover") / 100000), NO_OF_TRADES=_l("trades"), DELIV_QTY=_l("delivery_qty"), DELIV_PER=F.lit(" -"))
    return files.normalise_full_daily(raw)


query("s1_full_daily", f"SELECT {BARSEL} FROM bars WHERE exchange = 'NSE'", "open high low close prev_close turnover:2")(lambda wb: _full(wb).select(*BARSEL.split(", ")))
query("s2_legacy_daily", "SELECT date, exchange, symbol, series, open, high, low, close, prev_close, volume, turnover, CAST(NULL AS BIGINT) AS delivery_qty FROM bars WHERE exchange = 'NSE'", "open high low close prev_close turnover:2")(
    lambda wb: files.normalise_legacy_daily(_raw(wb.bars.filter("exchange = 'NSE'"), SYMBOL=F.col("symbol"), SERIES=F.col("series"), OPEN=_s("open"), HIGH=_s("high"), LOW=_s("low"), CLOSE=_s("close"), LAST=F.lit(""),
                                                 PREVCLOSE=_s("prev_close"), TOTTRDQTY=_l("volume"), TOTTRDVAL=_s("turnover"), TIMESTAMP=F.upper(F.date_format("date", "d-MMM-yyyy"))))
    .select("date", "exchange", "symbol", "series", "open", "high", "low", "close", "prev_close", "volume", "turnover", "delivery_qty"))
query("s3_scripcode_daily", f"SELECT {S3} FROM bars WHERE exchange = 'BSE'", "open high low close prev_close turnover:2")(
    lambda wb: files.normalise_scripcode_daily(_raw(wb.bars.filter("exchange = 'BSE'"), SC_CODE=F.col("symbol"), SC_GROUP=F.concat("series", F.lit("  ")), OPEN=_s("open"), HIGH=_s("high"), LOW=_s("low"), CLOSE=_s("close"), LAST=F.lit(""),
                                                    PREVCLOSE=_s("prev_close"), NO_TRADES=_l("trades"), NO_OF_SHRS=_l("volume"), NET_TURNOV=_s("turnover"), _file=F.concat(F.lit("EQ"), F.date_format("date", "ddMMyy"), F.lit(".CSV"))), F.col("_file"))
    .withColumn("date", F.when(F.year("date") > 2050, F.add_months("date", -1200)).otherwise(F.col("date"))).select(*S3.split(", ")))
query("s4_udiff", f"SELECT {S3} FROM bars WHERE series <> 'BZ' AND exchange = 'BSE'", "open high low close prev_close turnover:2")(
    lambda wb: files.normalise_udiff(_raw(wb.bars.filter("exchange = 'BSE'"), TradDt=F.col("date").cast("string"), FinInstrmTp=F.when(F.col("series") == "BZ", "BND").when(F.col("series") == "BE", "").otherwise("STK"), ISIN=F.lit(""), TckrSymb=F.col("symbol"),
                                          SctySrs=F.col("series"), OpnPric=_s("open"), HghPric=_s("high"), LwPric=_s("low"), ClsPric=_s("close"), LastPric=F.lit("-"), PrvsClsgPric=_s("prev_close"), TtlTradgVol=_l("volume"), TtlTrfVal=_s("turnover"),
                                          TtlNbOfTxsExctd=_l("trades")), "BSE").select(*S3.split(", ")))
query("s5_index_close", "SELECT date, index_name, index_code, low, high, close FROM idx WHERE day(date) <> 20", "low high close")(
    lambda wb: files.normalise_index_close(wb.idx.select(
        F.col("index_name").alias("Index Name"), F.date_format("date", "dd-MM-yyyy").alias("Index Date"), F.lit("-").alias("Open Index Value"), _s("high").alias("High Index Value"), _s("low").alias("Low Index Value"),
        F.when(F.dayofmonth("date") == 20, F.lit("-")).otherwise(F.col("close").cast("string")).alias("Closing Index Value"), *[F.lit("-").alias(c) for c in ("Points Change", "Change(%)", "Volume", "Turnover (Rs. Cr.)", "P/E", "P/B", "Div Yield")]),
        {"broad five hundred": "BROAD_500", "broad 500": "BROAD_500", "wide 200": "WIDE_200"}).select("date", "index_name", "index_code", "low", "high", "close"))
query("s13_union_sources", """
SELECT exchange, symbol, series, date, close, source FROM bars WHERE exchange = 'NSE' AND ((source = 'legacy' AND date < DATE '1998-01-01') OR (source = 'full' AND date BETWEEN DATE '1998-01-01' AND DATE '2000-06-30') OR (source = 'unified' AND date > DATE '2000-06-30'))
UNION ALL SELECT exchange, symbol, series, date, close, source FROM bars WHERE exchange = 'BSE' AND source = 'unified'""", "close")(
    lambda wb: store.union_sources({s: wb.bars.filter(F.col("source") == s) for s in ("legacy", "full", "unified")},
                                   [("legacy", "NSE", None, "1997-12-31"), ("full", "NSE", "1998-01-01", "2000-06-30"), ("unified", "NSE", "2000-07-01", None), ("unified", "BSE", None, None)])
    .select("exchange", "symbol", "series", "date", "close", "source"))
query("s14_replace_dates", """
WITH n AS (SELECT exchange, symbol, series, date, volume * 2 AS volume FROM bars WHERE series = 'EQ' AND month(date) = 3)
SELECT * FROM n UNION ALL SELECT exchange, symbol, series, date, volume FROM bars b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.exchange = b.exchange AND n.date = b.date)""")(
    lambda wb: store.replace_dates(wb.bars.select("exchange", "symbol", "series", "date", "volume"),
                                   wb.bars.filter("series = 'EQ' AND month(date) = 3").select("exchange", "symbol", "series", "date", (F.col("volume") * 2).alias("volume"))))


def _committed(wb):
    """A store to which the bars came first and a correction of the EQ series in March after."""
    if not hasattr(wb, "_store"):
        wb._store = f"{shared_folder(wb.spark)}/store-{uuid.uuid4().hex}"
        b = wb.bars.select("exchange", "symbol", "series", "date", "volume")
        store.upsert_bars(wb.spark, wb._store, b)
        store.upsert_bars(wb.spark, wb._store, b.filter("series = 'EQ' AND month(date) = 3").withColumn("volume", F.col("volume") * 2))
    return wb._store, wb.bars.select("exchange", "symbol", "series", "date", "volume").schema


query("s14_upsert_committed", """
WITH n AS (SELECT exchange, symbol, series, date, volume * 2 AS volume FROM bars WHERE series = 'EQ' AND month(date) = 3)
SELECT * FROM n UNION ALL SELECT exchange, symbol, series, date, volume FROM bars b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.exchange = b.exchange AND n.date = b.date)""")(
    lambda wb: store.read_committed(wb.spark, *_committed(wb)))
query("s15_committed_manifest", """
WITH n AS (SELECT exchange, symbol, series, date FROM bars WHERE series = 'EQ' AND month(date) = 3), a AS (SELECT exchange, date FROM n UNION ALL SELECT exchange, date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.exchange = b.exchange AND n.date = b.date))
SELECT exchange, year(date) AS year, count(*) AS n_rows, TRUE AS same_content, CASE WHEN (exchange, year(date)) IN (SELECT exchange, year(date) FROM n) THEN 2 ELSE 1 END::BIGINT AS commit FROM a GROUP BY ALL""")(
    lambda wb: (lambda path, schema: store.current_manifest(wb.spark, path).join(store.partition_manifest(store.read_committed(wb.spark, path, schema)).withColumnRenamed("fingerprint", "_f").drop("n_rows"), ["exchange", "year"], "left")
                .join(store.manifests(wb.spark, path).groupBy("version").agg(F.min("commit").alias("first")), "version")
                .select("exchange", "year", "n_rows", F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False)).alias("same_content"), F.col("first").alias("commit")))(*_committed(wb)))
query("s15_partition_manifest", "SELECT exchange, year(date) AS year, count(*) AS n_rows FROM bars GROUP BY ALL")(lambda wb: store.partition_manifest(wb.bars).drop("fingerprint"))
query("s15_verify_manifest", """
SELECT exchange, year(date) AS year, count(*) AS old_rows, CASE WHEN year(date) <> 1999 THEN count(*) FILTER (WHERE NOT (year(date) = 1997 AND series = 'BZ')) END AS n_rows,
 CASE WHEN year(date) = 1999 THEN 'missing' WHEN year(date) = 1997 THEN 'row_count' ELSE 'content' END AS problem FROM bars WHERE year(date) IN (1997, 1998, 1999) GROUP BY exchange, year(date)""")(
    lambda wb: store.verify_manifest(store.partition_manifest(wb.bars), store.partition_manifest(
        wb.bars.filter("year(date) <> 1999 AND NOT (year(date) = 1997 AND series = 'BZ')").withColumn("volume", F.when(F.year("date") == 1998, F.col("volume") + 1).otherwise(F.col("volume"))))))
query("s16_dedupe_artifacts", """SELECT job AS source, day, count(*) AS n_captures, count(DISTINCT status) AS n_contents, count(DISTINCT status) > 1 AS republished FROM job_runs GROUP BY ALL""")(
    lambda wb: store.dedupe_artifacts(wb.job_runs.select(F.col("job").alias("source"), "day", F.sha2("status", 256).alias("sha256"), F.col("finished_at").alias("captured_at"))).drop("newest_sha256"))

# ---- intraday -----------------------------------------------------------------------------------
C5 = """SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS candle_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS candle_end, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, row(ts, event_id)) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM ticks GROUP BY ALL"""
query("x1_candles", C5)(lambda wb: cd.candles(wb.ticks, "5 minutes", tiebreak="event_id"))


def _streamed(wb):
    """The same candles from a stream over the events table, run to its end."""
    base = f"{shared_folder(wb.spark)}/candles-{uuid.uuid4().hex}"
    src = wb.spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(wb.dir)
    ticks = src.select(F.concat("event_type", F.lit("-"), F.expr("user_id div 50").cast("string")).alias("symbol"), "ts", F.col("value").alias("price"), "event_id", (1 + F.col("event_id") % 100).alias("qty"))
    jobs.start_candles(ticks, f"{base}/out", f"{base}/state").awaitTermination()
    return wb.spark.read.parquet(f"{base}/out")


query("x1_candles_stream", f"SELECT * FROM ({C5}) WHERE candle_end <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE")(_streamed)
NOW = "2024-01-30 23:00:00"
HEALTH = f"""SELECT symbol, newest_end, epoch(TIMESTAMP '{NOW}') - epoch(newest_end) AS lag_s, CASE WHEN epoch(TIMESTAMP '{NOW}') - epoch(newest_end) > 1500 THEN 'stale' ELSE 'ok' END AS status
FROM (SELECT symbol, max(candle_start) + INTERVAL 30 MINUTE AS newest_end FROM candles WHERE candle_start < TIMESTAMP '2024-01-30 22:30:00' GROUP BY symbol)"""


def _half_hour(wb):
    return wb.candles.withColumn("candle_end", F.col("candle_start") + F.expr("INTERVAL 30 MINUTES"))


def _health(wb):
    return cd.feed_health(_half_hour(wb).filter("candle_start < '2024-01-30 22:30:00'"), NOW)


query("x2_feed_health", f"SELECT symbol, newest_end, CAST(lag_s AS BIGINT) AS lag_s, status FROM ({HEALTH})")(_health)
query("x3_touch_fills_batch_twin", f"""SELECT order_id, symbol, candle_start, fill_price FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('g' || oco_group, 'o' || order_id) ORDER BY candle_start, type <> 'stop_loss', order_id) AS k FROM ({FILLS})) WHERE k = 1""", "fill_price")(
    lambda wb: oc.oco_first(fills(wb)).select("order_id", "symbol", "candle_start", "fill_price"))
# The candles of the month come in batches of ten days; each batch is a file of the stream.
PARTS = 3


def _part(start):
    return F.least(F.floor((F.dayofmonth(start) - 1) / 10), F.lit(PARTS - 1)).cast("int")


def _filled(wb):
    """Fills and poll log of the order stream over all candles, run to its end."""
    if not hasattr(wb, "_fill_stream"):
        base = f"{shared_folder(wb.spark)}/fills-{uuid.uuid4().hex}"
        c = cut(_half_hour(wb))
        for k in range(PARTS):  # one after the other, as a stream takes files by their age
            c.filter(_part(F.col("candle_start")) == k).coalesce(1).write.parquet(f"{base}/in/{k}")
        src = wb.spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        jobs.start_fills(src, cut(wb.book), f"{base}/fills", f"{base}/log", f"{base}/checkpoint", f"{base}/state").awaitTermination()
        wb._fill_stream = base
    return wb._fill_stream


ONCE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('g' || oco_group, 'o' || order_id) ORDER BY candle_start, type <> 'stop_loss', order_id) AS k FROM ({FILLS})) WHERE k = 1"
PART = f"least((day(candle_start) - 1) // 10, {PARTS - 1})"
query("x3_touch_fill_stream", f"SELECT order_id, symbol, candle_start, fill_price FROM ({ONCE})", "fill_price")(
    lambda wb: wb.spark.read.parquet(f"{_filled(wb)}/fills").select("order_id", "symbol", "candle_start", "fill_price"))
query("x6_poll_log", f"""WITH p AS (SELECT CAST(unnest(range({PARTS})) AS INTEGER) AS part),
h AS (SELECT part, symbol, max(candle_start) + INTERVAL 30 MINUTE AS newest FROM p JOIN candles ON {PART} <= part GROUP BY ALL), n AS (SELECT *, max(newest) OVER (PARTITION BY part) AS now FROM h)
SELECT part AS batch_id, count(*) AS symbols, CAST(max(epoch(now) - epoch(newest)) AS BIGINT) AS max_lag_s, count(*) FILTER (epoch(now) - epoch(newest) > 1500) AS stale_symbols, (SELECT count(*) FROM ({ONCE}) WHERE {PART} = part) AS fills FROM n GROUP BY part""")(
    lambda wb: wb.spark.read.parquet(f"{_filled(wb)}/log").select("batch_id", "symbols", "max_lag_s", "stale_symbols", "fills"))
query("x4_park_stale_orders", f"SELECT b.order_id, b.symbol, CASE WHEN b.order_id % 3 = 0 THEN CASE WHEN h.status = 'ok' THEN 'open' ELSE 'pending_eod' END WHEN h.status = 'ok' THEN 'open' ELSE 'pending_eod' END AS status FROM book b LEFT JOIN ({HEALTH}) h USING (symbol)")(
    lambda wb: cd.park_stale_orders(wb.book.withColumn("status", F.when(F.col("order_id") % 3 == 0, "pending_eod").otherwise("open")), _health(wb)).select("order_id", "symbol", "status"))
query("x5_eod_fallback", """
WITH d AS (SELECT symbol, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close FROM ticks WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY symbol),
f AS (SELECT b.*, CASE WHEN type = 'market' AND created_at > TIMESTAMP '2024-01-15 09:15:00' THEN close WHEN type = 'market' THEN open WHEN type = 'limit' AND side = 'buy' AND low <= limit_price THEN least(limit_price, open)
   WHEN type = 'limit' AND side = 'sell' AND high >= limit_price THEN greatest(limit_price, open) WHEN type = 'stop_loss' AND low <= trigger_price THEN least(trigger_price, open) WHEN type = 'target' AND high >= trigger_price THEN greatest(trigger_price, open) END AS fill_price
 FROM book b JOIN d USING (symbol) WHERE created_at < TIMESTAMP '2024-01-15 15:30:00' AND (created_at <= TIMESTAMP '2024-01-15 09:15:00' OR type = 'market'))
SELECT order_id, symbol, fill_price FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('g' || oco_group, 'o' || order_id) ORDER BY type <> 'stop_loss', order_id) AS k FROM f WHERE fill_price IS NOT NULL) WHERE k = 1""", "fill_price")(
    lambda wb: cd.eod_fallback(wb.book, cd.candles(wb.ticks, "1 day", tiebreak="event_id").withColumn("date", F.to_date("candle_start")), "2024-01-15").select("order_id", "symbol", "fill_price"))
query("x7_symbols_to_watch", f"WITH f AS ({FILLS}) SELECT DISTINCT symbol FROM book WHERE order_id NOT IN (SELECT order_id FROM f) UNION SELECT symbol FROM pos WHERE qty > 0")(
    lambda wb: cd.symbols_to_watch(_closed_book(wb), lg.positions(wb.trades_in_order)))
