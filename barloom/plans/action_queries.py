"""Corporate actions and back-adjustment (survey 2.5)."""

from pyspark.sql import functions as F

from barloom.operators import actions as act
from barloom.plans.registry import query
from barloom.plans.workbench import SERIES

NUM = "amount num den fv_from fv_to premium price_factor volume_factor"
query("c1_parse_subjects", "SELECT * FROM parsed", NUM)(lambda wb: wb.parsed)
query("c2_ratio_factors", """SELECT action_type, price_factor, volume_factor, count(*) AS n FROM parsed WHERE price_factor IS NOT NULL GROUP BY ALL""", "price_factor volume_factor")(
    lambda wb: wb.parsed.filter("price_factor IS NOT NULL").groupBy("action_type", "price_factor", "volume_factor").agg(F.count("*").alias("n")))
query("c3_rights_factor", """SELECT action_id, symbol, ex_date, num, den, premium, price_factor, volume_factor FROM factored WHERE action_type = 'rights'""",
      "premium price_factor volume_factor")(
    lambda wb: wb.factored.filter("action_type = 'rights'").select("action_id", "symbol", "ex_date", "num", "den", "premium", "price_factor", "volume_factor"))
query("c4_cum_price", "SELECT a.action_id, a.symbol, a.ex_date, c.cum_price FROM actions a LEFT JOIN cumprice c USING (action_id)", "cum_price")(
    lambda wb: act.cum_price(wb.actions, wb.bars, SERIES).select("action_id", "symbol", "ex_date", "cum_price"))
query("c5_face_value_asof", "SELECT a.action_id, a.symbol, a.ex_date, f.face_value FROM actions a JOIN facevalue f USING (action_id)", "face_value")(
    lambda wb: act.face_value_asof(wb.actions, wb.parsed, wb.securities).select("action_id", "symbol", "ex_date", "face_value"))


def _captured(wb):
    """Actions as captured: some under the former symbol, some with a stored id, some under an unknown symbol."""
    m = F.col("action_id") % 4
    sym = F.when(m == 1, F.concat(F.lit("OLD"), "symbol")).when(m == 2, F.concat(F.lit("X"), "symbol")).otherwise(F.col("symbol"))
    return wb.actions.select("action_id", sym.alias("symbol"), "ex_date", F.when(m == 3, F.col("action_id")).alias("security_id"))


query("c6_resolve_action_identity", """
WITH c AS (SELECT action_id, CASE action_id % 4 WHEN 1 THEN 'OLD' || symbol WHEN 2 THEN 'X' || symbol ELSE symbol END AS symbol, ex_date, CASE WHEN action_id % 4 = 3 THEN action_id END AS security_id FROM actions),
o AS (SELECT symbol, min(security_id) AS sid FROM (SELECT symbol, security_id FROM symhist UNION SELECT symbol, security_id FROM listings) GROUP BY symbol HAVING count(DISTINCT security_id) = 1)
SELECT c.*, coalesce(c.security_id, o.sid) AS resolved_id, coalesce(CAST(coalesce(c.security_id, o.sid) AS VARCHAR), c.symbol) AS identity_key FROM c LEFT JOIN o USING (symbol)""")(
    lambda wb: act.resolve_action_identity(_captured(wb), wb.symhist, wb.listings))


def _recaptured(wb):
    """The feed published again a month later for half of the actions."""
    p = wb.parsed
    again = p.filter("action_id % 2 = 0").withColumn("captured_on", F.date_add("captured_on", 30)).withColumn("action_id", F.col("action_id") + 1000000)
    return p.unionByName(again)


query("c7_dedupe_actions", """
WITH r AS (SELECT * FROM parsed UNION ALL SELECT * REPLACE (captured_on + 30 AS captured_on, action_id + 1000000 AS action_id) FROM parsed WHERE action_id % 2 = 0)
SELECT action_id, symbol, ex_date, captured_on, action_type, price_factor FROM (
 SELECT *, row_number() OVER (PARTITION BY exchange, symbol, ex_date, action_type, num, den, round(price_factor, 12) ORDER BY captured_on DESC, action_id DESC) AS rn FROM r WHERE price_factor IS NOT NULL AND parse_status = 'parsed') WHERE rn = 1""",
      "price_factor")(lambda wb: act.dedupe_actions(_recaptured(wb)).select("action_id", "symbol", "ex_date", "captured_on", "action_type", "price_factor"))
query("c8_excluded_actions", """
SELECT *, reason = 'closeable_hole' AS degraded FROM (
 SELECT CASE WHEN action_type IN ('demerger', 'capital_reduction') THEN 'permanent' WHEN action_type IN ('dividend', 'distribution', 'interest', 'buyback', 'agm') THEN 'cash_like'
             WHEN action_type = 'bonus' AND parse_status = 'parsed' THEN 'cash_like' ELSE 'closeable_hole' END AS reason, action_type, count(*) AS n_actions
 FROM factored WHERE price_factor IS NULL OR parse_status <> 'parsed' GROUP BY ALL)""")(lambda wb: act.excluded_actions(wb.factored))
query("c9_factor_timeline", "SELECT * FROM timeline", "price_factor volume_factor cumulative_price_factor cumulative_volume_factor")(lambda wb: wb.timeline)
query("c9_factor_timeline_aliases", """SELECT t.* REPLACE (v.s AS symbol) FROM timeline t JOIN (
 SELECT canonical_symbol AS symbol, canonical_symbol AS s FROM securities UNION SELECT canonical_symbol, 'OLD' || canonical_symbol FROM securities) v USING (symbol)""",
      "price_factor volume_factor cumulative_price_factor cumulative_volume_factor")(
    lambda wb: act.factor_timeline(act.dedupe_actions(wb.factored), wb.securities.select(F.col("canonical_symbol").alias("symbol"), F.concat(F.lit("OLD"), "canonical_symbol").alias("alias"))))
query("c10_adjust_bars", "SELECT exchange, symbol, series, date, open, high, low, close, volume, delivery_qty, turnover, cumulative_price_factor FROM adj",
      "open high low close turnover cumulative_price_factor")(
    lambda wb: wb.adj.select("exchange", "symbol", "series", "date", "open", "high", "low", "close", "volume", "delivery_qty", "turnover", "cumulative_price_factor"))
RENAMED = "CASE WHEN exchange = 'NSE' AND date < DATE '1998-01-01' THEN 'OLD' || symbol ELSE symbol END"


def _rebuilt(wb):
    """Bars of NSE printed under the symbol of their day; actions come under today's symbol."""
    return act.rebuild_adjusted(wb.bars.withColumn("symbol", F.expr(RENAMED)), wb.actions, wb.securities, SERIES, wb.symhist, wb.listings)


query("c11_rebuild_adjusted", f"""SELECT exchange, {RENAMED} LIKE 'OLD%' AS former, year(date) AS year, count(*) AS n, round(avg(close / cumulative_price_factor), 4) AS avg_raw_close,
 count(*) FILTER (WHERE cumulative_price_factor <> 1) AS n_adjusted, avg(prev_close / close) AS avg_back FROM adj GROUP BY ALL""", "avg_raw_close avg_back", 4)(
    lambda wb: _rebuilt(wb).groupBy("exchange", F.col("symbol").startswith("OLD").alias("former"), F.year("date").alias("year")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("close") / F.col("cumulative_price_factor")), 4).alias("avg_raw_close"),
        F.count(F.when(F.col("cumulative_price_factor") != 1, 1)).alias("n_adjusted"), F.avg(F.col("prev_close") / F.col("close")).alias("avg_back")))
query("c11_rebuilt_bars", f"SELECT exchange, {RENAMED} AS symbol, series, date, close, volume, cumulative_price_factor FROM adj", "close cumulative_price_factor")(
    lambda wb: _rebuilt(wb).select("exchange", "symbol", "series", "date", "close", "volume", "cumulative_price_factor"))
query("c12_reparse", """
WITH o AS (SELECT action_id, ex_date, max(parse_status) AS new_status, CASE WHEN action_id % 3 = 0 THEN 'unparsed' WHEN action_id % 3 = 1 THEN 'parsed' ELSE 'ambiguous' END AS old_status FROM parsed GROUP BY ALL)
SELECT old_status, new_status, count(*) AS n_actions, count(DISTINCT ex_date) AS n_ex_dates, 3 AS parser_version FROM o GROUP BY ALL""")(
    lambda wb: act.reparse(wb.actions.select("action_id", F.when(F.col("action_id") % 3 == 0, "unparsed").when(F.col("action_id") % 3 == 1, "parsed").otherwise("ambiguous").alias("parse_status")),
                           wb.actions, 3))
