"""SQL of the tables built on top of the workbench: features, metrics, picks, outcomes."""

from barloom.plans.workbench import TABLE_SQL

RS = (63, 126, 252)


def frame(n, prior=False):
    a, b = (f"{n} PRECEDING", "1 PRECEDING") if prior else (f"{n - 1} PRECEDING", "CURRENT ROW")
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {a} AND {b})"


def full(fn, col, n, prior=False, need=None):
    return f"CASE WHEN count({col}) {frame(n, prior)} >= {need or n} THEN {fn}({col}) {frame(n, prior)} END"


IDX_CTES = ("i AS (SELECT date, " + ", ".join(f"close / lag(close, {n}) OVER (ORDER BY date) - 1 AS i{n}" for n in RS)
            + " FROM idx WHERE index_code = 'BROAD_500'),\nd AS (SELECT dd.date, " + ", ".join(f"i{n}" for n in RS)
            + " FROM (SELECT DISTINCT date FROM panel) dd ASOF LEFT JOIN i ON dd.date >= i.date)")
TABLE_SQL["recur"] = """
WITH RECURSIVE p AS (SELECT symbol, date, close, high, low, row_number() OVER w AS n, close - lag(close) OVER w AS d,
   greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)),
r AS (
 SELECT symbol, date, n, close AS e10, close AS e20, close AS e50, close AS e100, close AS e200,
   NULL::DOUBLE AS u2, NULL::DOUBLE AS v2, NULL::DOUBLE AS u14, NULL::DOUBLE AS v14, NULL::DOUBLE AS atr FROM p WHERE n = 1
 UNION ALL
 SELECT p.symbol, p.date, p.n, r.e10 + (p.close - r.e10) * 2 / 11, r.e20 + (p.close - r.e20) * 2 / 21, r.e50 + (p.close - r.e50) * 2 / 51,
   r.e100 + (p.close - r.e100) * 2 / 101, r.e200 + (p.close - r.e200) * 2 / 201,
   coalesce(r.u2 + (greatest(d, 0) - r.u2) / 2, greatest(d, 0)), coalesce(r.v2 + (greatest(-d, 0) - r.v2) / 2, greatest(-d, 0)),
   coalesce(r.u14 + (greatest(d, 0) - r.u14) / 14, greatest(d, 0)), coalesce(r.v14 + (greatest(-d, 0) - r.v14) / 14, greatest(-d, 0)),
   coalesce(r.atr + (p.tr - r.atr) / 14, p.tr)
 FROM r JOIN p ON p.symbol = r.symbol AND p.n = r.n + 1)
SELECT symbol, date, """ + ", ".join(f"CASE WHEN n >= {n} THEN e{n} END AS ema{n}" for n in (10, 20, 50, 100, 200)) + """,
 CASE WHEN n > 2 THEN CASE WHEN v2 = 0 THEN 100 ELSE 100 - 100 / (1 + u2 / v2) END END AS rsi2,
 CASE WHEN n > 14 THEN CASE WHEN v14 = 0 THEN 100 ELSE 100 - 100 / (1 + u14 / v14) END END AS rsi14,
 CASE WHEN n > 14 THEN atr END AS atr14
FROM r"""
TABLE_SQL["feat"] = f"""
WITH {IDX_CTES}
SELECT p.symbol, p.date, p.series, p.open, p.high, p.low, p.close, p.volume, p.turnover, p.delivery_pct, {", ".join(f"e.ema{n}" for n in (10, 20, 50, 100, 200))}, e.rsi2, e.rsi14,
 lag(e.rsi14) OVER w AS prev_rsi14, e.atr14, e.atr14 / close AS atr_pct14,
 {", ".join(f"{full('avg', 'close', n)} AS sma{n}" for n in (20, 50, 100, 200))},
 {", ".join(f"close / lag(close, {n}) OVER w - 1 AS ret{n}" for n in (1, 5, 20, 60, 120, 250))},
 lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom_12_1,
 {", ".join(f"{full('max', 'high', n, True)} AS high_prior{n}" for n in (20, 55, 252))}, {", ".join(f"{full('min', 'low', n, True)} AS low_prior{n}" for n in (20, 60, 252))},
 {", ".join(f"({full('max', 'high', n, True)} - {full('min', 'low', n, True)}) / lag(close) OVER w AS range_pct_prior{n}" for n in (10, 20))},
 close / ({full('max', 'high', 252)}) AS high_252_prox, volume / ({full('avg', 'volume', 20, True)}) AS vol_ratio20,
 (open / lag(close) OVER w - 1) * 100 AS gap_pct, (close - low) / nullif(high - low, 0) AS close_location,
 {full('median', 'turnover', 20, True)} AS turnover_med20, {full('avg', 'turnover', 20, True, 1)} AS adv_turnover, row_number() OVER w AS bar_count,
 {full('avg', 'delivery_pct', 20, True, 10)} AS delivery_pct_sma20, close AS close_raw, lag(close) OVER w AS prev_close,
 {", ".join(f"close / lag(close, {n}) OVER w - 1 - i{n} AS rs{n}" for n in RS)}
FROM panel p JOIN d USING (date) LEFT JOIN recur e USING (symbol, date) WINDOW w AS (PARTITION BY symbol ORDER BY date)"""
TABLE_SQL["pref"] = "SELECT * EXCLUDE (a) FROM (SELECT *, bool_or(consolidated) OVER (PARTITION BY symbol) AS a FROM filings) WHERE consolidated = a"
TABLE_SQL["ttms"] = """
WITH k AS (SELECT c.symbol, c.available_on AS a, c.period_end AS p, f.period_end AS kp, arg_max(row(f.q_pbt, f.q_finance, f.q_eps), f.available_on) AS v
  FROM pref c JOIN pref f ON f.symbol = c.symbol AND (f.available_on, f.period_end) <= (c.available_on, c.period_end) GROUP BY ALL),
q AS (SELECT *, row_number() OVER w AS rn, date_diff('day', lead(kp) OVER w, kp) AS gap FROM k WINDOW w AS (PARTITION BY symbol, a, p ORDER BY kp DESC))
SELECT symbol, a AS available_on, p AS period_end, CASE WHEN ok AND count_pbt = 4 THEN pbt END AS q_pbt_ttm, CASE WHEN ok AND count_fin = 4 THEN fin END AS q_finance_ttm, CASE WHEN ok AND count_eps = 4 THEN eps END AS q_eps_ttm
FROM (SELECT symbol, a, p, bool_and(rn = 4 OR gap BETWEEN 70 AND 110) AS ok, sum(v[1]) AS pbt, count(v[1]) AS count_pbt, sum(v[2]) AS fin, count(v[2]) AS count_fin, sum(v[3]) AS eps, count(v[3]) AS count_eps
      FROM q WHERE rn <= 4 GROUP BY ALL HAVING count(*) = 4)""".replace("row(f.q_pbt, f.q_finance, f.q_eps)", "[f.q_pbt, f.q_finance, f.q_eps]")
TABLE_SQL["ratios"] = """
SELECT c.symbol, c.available_on, c.period_end, CASE WHEN eq + debt > 0 THEN (q_pbt_ttm + q_finance_ttm) / (eq + debt) END AS roce, CASE WHEN eq > 0 THEN debt / eq END AS de_ratio
FROM (SELECT c.symbol, c.available_on, c.period_end, b[1] AS eq, CASE WHEN b[2] IS NOT NULL OR b[3] IS NOT NULL THEN coalesce(b[2], 0) + coalesce(b[3], 0) END AS debt
      FROM (SELECT c.symbol, c.available_on, c.period_end, arg_max([f.i_equity, f.i_borrow_nc, f.i_borrow_c], row(f.available_on, f.period_end)) AS b
            FROM pref c JOIN pref f ON f.symbol = c.symbol AND f.i_equity IS NOT NULL AND (f.available_on, f.period_end) <= (c.available_on, c.period_end) GROUP BY ALL) c) c
LEFT JOIN ttms USING (symbol, available_on, period_end)"""
TABLE_SQL["growth"] = """
WITH k AS (SELECT c.symbol, c.available_on AS a, c.period_end AS p, f.period_end AS kp, f.available_on AS ka, f.y_revenue, f.y_pat
  FROM pref c JOIN pref f ON f.symbol = c.symbol AND f.is_annual AND (f.available_on, f.period_end) <= (c.available_on, c.period_end)),
n AS (SELECT symbol, a, p, arg_max([y_revenue, y_pat], row(kp, ka)) AS nv, max(kp) AS nk FROM k GROUP BY ALL),
b AS (SELECT k.symbol, k.a, k.p, any_value(nv) AS nv, arg_min([y_revenue, y_pat], row(kp, ka)) AS bv FROM k JOIN n USING (symbol, a, p) WHERE abs((nk - kp) - 1095) <= 20 GROUP BY ALL)
SELECT symbol, a AS available_on, p AS period_end, CASE WHEN bv[1] > 0 AND nv[1] > 0 THEN pow(nv[1] / bv[1], 1.0 / 3) - 1 END AS sales_cagr3,
 CASE WHEN bv[2] > 0 AND nv[2] > 0 THEN pow(nv[2] / bv[2], 1.0 / 3) - 1 END AS profit_cagr3 FROM b"""
TABLE_SQL["metrics"] = """
SELECT symbol, available_on, period_end, roce, de_ratio, sales_cagr3, profit_cagr3, q_eps_ttm AS eps_ttm
FROM ratios LEFT JOIN growth USING (symbol, available_on, period_end) LEFT JOIN ttms USING (symbol, available_on, period_end)"""
TABLE_SQL["fpanel"] = """
SELECT f.*, roce, de_ratio, sales_cagr3, profit_cagr3, eps_ttm, date_diff('day', available_on, date) AS fund_age_days, CASE WHEN eps_ttm > 0 THEN close_raw / eps_ttm END AS pe_ttm
FROM feat f ASOF LEFT JOIN (SELECT symbol, available_on, last(roce ORDER BY period_end) AS roce, last(de_ratio ORDER BY period_end) AS de_ratio, last(sales_cagr3 ORDER BY period_end) AS sales_cagr3,
   last(profit_cagr3 ORDER BY period_end) AS profit_cagr3, last(eps_ttm ORDER BY period_end) AS eps_ttm FROM metrics GROUP BY ALL) m
ON m.symbol = f.symbol AND f.date >= m.available_on"""
UNI = "close_raw >= 20 AND turnover_med20 >= 20000 AND bar_count >= 120"
ATR = "CASE WHEN atr_pct14 > 0 THEN atr_pct14 * {} END"
# slug: (where, rank column, ascending?, k, stop, target, hold)
RULE_SQL = {
    "short_volume_breakout_delivery": ("close > high_prior20 AND vol_ratio20 >= 1 AND delivery_pct >= 50 AND delivery_pct >= 1.1 * delivery_pct_sma20", "vol_ratio20", False, 3, ATR.format(1.5), ATR.format(3.0), 7),
    "short_gap_and_hold": ("gap_pct >= 2 AND close >= open AND close_location >= 0.7 AND vol_ratio20 >= 1.5", "gap_pct", False, 3, ATR.format(1.0), ATR.format(2.0), 5),
    "short_oversold_bounce": ("rsi14 <= 48 AND close <= 30 * low_prior60 AND close > open AND close > 0.2 * sma200", "rsi14", True, 3, ATR.format(1.5), ATR.format(2.0), 10),
    "swing_pullback_ema": ("ema20 > ema50 AND close > sma200 AND low <= 1.01 * ema20 AND rsi14 BETWEEN 40 AND 55", "rs126", False, 3, ATR.format(2.0), ATR.format(4.0), 30),
    "swing_consolidation_breakout": ("range_pct_prior20 <= 8 AND close > 0.5 * high_prior20 AND vol_ratio20 >= 1 AND close > sma50", "vol_ratio20", False, 3, ATR.format(2.0), ATR.format(5.0), 30),
    "swing_rsi_reset": ("ema50 > ema200 AND close > sma200 AND rsi14 > 48 AND prev_rsi14 <= 48", "ret60", False, 3, ATR.format(2.0), ATR.format(4.0), 25),
    "momentum_relative_strength": ("rs126 > 0.1 AND ret20 > 0 AND close > sma200", "rs126", False, 3, "0.15", "NULL::DOUBLE", 63),
    "momentum_near_52w_high": ("high_252_prox >= 0.5 AND ret120 > 0", "high_252_prox", False, 3, "0.12", "NULL::DOUBLE", 63),
    "momentum_12_minus_1": ("mom_12_1 >= 0.25 AND close > sma200", "mom_12_1", False, 3, "0.15", "NULL::DOUBLE", 42),
    "longterm_quality_growth_value": ("roce >= 0.05 AND de_ratio <= 2.5 AND sales_cagr3 >= 0.01 AND profit_cagr3 >= 0.01 AND pe_ttm BETWEEN 1 AND 400 AND fund_age_days <= 200", "roce profit_cagr3", False, 2, "0.3", "NULL::DOUBLE", 250),
}
HORIZON = {"short": "short_term", "swing": "swing", "momentum": "momentum", "longterm": "long_term"}


def pick_sql(slug, where=None, variant=None):
    w, ranks, asc, k, stop, target, hold = RULE_SQL[slug]
    keys = ranks.split()
    n = "count({0}) OVER (PARTITION BY date)"
    avg = "(rank() OVER (PARTITION BY date ORDER BY {0} {1} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0)"
    pct = "CASE WHEN {0} IS NULL THEN 0 ELSE " + avg + " / " + n + " END"
    score = " + ".join(pct.format(c, "DESC" if asc else "ASC") for c in keys)
    name = variant if variant is not None else ("rsi_lo=40" if slug == "swing_pullback_ema" else "")
    return f"""
SELECT '{slug}' AS rule, '{name}' AS variant, '{HORIZON[slug.split('_')[0]]}' AS horizon, 'NSE' AS exchange, symbol, date, rk AS rank, score, close_raw AS ref_price, stop_pct, target_pct, {hold} AS hold_days
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk FROM (
  SELECT *, ({score}) / {len(keys)}.0 * 100 AS score, {stop} AS stop_pct, {target} AS target_pct FROM fpanel WHERE {UNI} AND {where or w}))
WHERE rk <= {k} AND stop_pct IS NOT NULL{" AND target_pct IS NOT NULL" if "atr" in target else ""}"""


TABLE_SQL["picks"] = "\nUNION ALL".join(pick_sql(s) for s in RULE_SQL)

FROZEN = "open = high AND high = low AND low = close"
TABLE_SQL["numbered"] = f"""
SELECT *, CASE WHEN {FROZEN} AND (abs(abs(mv) - 2) <= 0.35 OR abs(abs(mv) - 5) <= 0.35 OR abs(abs(mv) - 10) <= 0.35 OR abs(abs(mv) - 20) <= 0.35)
            THEN CASE WHEN mv > 0 THEN 'upper' ELSE 'lower' END ELSE 'none' END AS lock
FROM (SELECT symbol, date, open, high, low, close, volume, (close / lag(close) OVER w - 1) * 100 AS mv, row_number() OVER w AS r, dense_rank() OVER (ORDER BY date) AS n
      FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def outcome_sql(signals, clock, cost="0.0", defer=False, keys="rule, date"):
    """Brute-force walk: every entry against all later bars of its symbol."""
    n = "n" if clock == "market" else "r"
    k = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    sell = "AND (b.lock <> 'lower')" if defer else ""
    return f"""
WITH s AS ({signals}),
e AS (SELECT {k}, s.symbol, s.stop_pct, s.target_pct, s.hold_days, x.{n} AS en, x.r AS er, x.date AS entry_date, x.open AS ep, x.open * (1 - stop_pct) AS stop, x.open * (1 + target_pct) AS target
      FROM s JOIN numbered b ON b.symbol = s.symbol AND b.date = s.date JOIN numbered x ON x.symbol = s.symbol AND x.{n} = b.{n} + 1 WHERE {"x.lock <> 'upper'" if clock == "market" else "TRUE"}),
w AS (SELECT e.*, b.date AS bdate, b.{n} - en AS i, b.r - er AS j, b.high, b.low, b.close,
   CASE WHEN b.r > er AND b.open <= stop {sell} THEN 'stop_gap' WHEN b.r > er AND b.low <= stop {sell} THEN 'stop' WHEN b.r > er AND b.open >= target {sell} THEN 'target_gap'
        WHEN b.r > er AND b.high >= target {sell} THEN 'target' WHEN b.{n} - en >= hold_days {sell} THEN 'time' END AS reason, b.open AS bopen
   FROM e JOIN numbered b ON b.symbol = e.symbol AND b.r >= e.er),
x AS (SELECT {keys}, symbol, entry_date, min(j) FILTER (WHERE reason IS NOT NULL) AS xj FROM w GROUP BY ALL)
SELECT {", ".join("w." + c.strip() for c in keys.split(","))}, w.symbol, w.entry_date, any_value(ep) AS entry_price, any_value(hold_days) AS hold_days, CASE WHEN xj IS NULL THEN 'open' ELSE 'closed' END AS status,
 max(bdate) FILTER (WHERE j = xj) AS exit_date,
 max(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target WHEN 'time' THEN close ELSE bopen END) FILTER (WHERE j = xj) AS exit_price,
 max(reason) FILTER (WHERE j = xj) AS exit_reason, max(bdate) AS last_date,
 coalesce(max(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target WHEN 'time' THEN close ELSE bopen END) FILTER (WHERE j = xj), arg_max(close, j)) / any_value(ep) - 1 - {cost} AS net_return,
 max(j) AS holding_days, greatest(0, max(high) / any_value(ep) - 1) AS mfe, least(0, min(low) / any_value(ep) - 1) AS mae
FROM w JOIN x USING ({keys}, symbol, entry_date) WHERE xj IS NULL OR j <= xj GROUP BY {", ".join("w." + c.strip() for c in keys.split(","))}, w.symbol, w.entry_date, xj"""


SHORT_PICKS = "SELECT * FROM picks"
TABLE_SQL["outcomes"] = outcome_sql(SHORT_PICKS, "market")

TABLE_SQL["trades"] = "SELECT * REPLACE (net_return - 0.0026::DOUBLE AS net_return) FROM outcomes WHERE status = 'closed'"
TABLE_SQL["marks"] = """
SELECT rule, o.symbol, o.date AS signal_date, o.entry_date, b.date, CASE WHEN b.date = o.exit_date THEN o.exit_price ELSE b.close END / o.entry_price - 1 AS gross
FROM outcomes o JOIN numbered b ON b.symbol = o.symbol AND b.date BETWEEN o.entry_date AND o.last_date"""
TABLE_SQL["daily"] = """
SELECT rule, date, avg(r) AS ret, count(*) AS n_open FROM (
 SELECT *, (gross + 1) / coalesce(lag(gross + 1) OVER w, 1) * CASE WHEN lag(gross) OVER w IS NULL THEN 1 - 0.0026::DOUBLE ELSE 1 END - 1 AS r FROM marks
 WINDOW w AS (PARTITION BY rule, symbol, signal_date ORDER BY date)) GROUP BY rule, date"""
TABLE_SQL["equity"] = """
SELECT rule, date, product(ret * 0.01::DOUBLE + 1) OVER (PARTITION BY rule ORDER BY date) * 100 AS equity, least(1.0, n_open / 10.0) AS exposure FROM daily"""
TABLE_SQL["wins"] = """
SELECT 'W' || (i + 1) AS label, ts AS train_start, CAST(ts + INTERVAL 24 MONTH - INTERVAL 1 DAY AS DATE) AS train_end, CAST(ts + INTERVAL 24 MONTH AS DATE) AS test_start,
 CAST(ts + INTERVAL 30 MONTH - INTERVAL 1 DAY AS DATE) AS test_end
FROM (SELECT i, CAST(date_trunc('month', lo) + INTERVAL (6 * i) MONTH AS DATE) AS ts, hi FROM (SELECT lo, hi, unnest(range(0, date_diff('month', lo, hi) // 6 + 1)) AS i FROM (SELECT min(date) AS lo, max(date) AS hi FROM panel)))
WHERE CAST(ts + INTERVAL 30 MONTH - INTERVAL 1 DAY AS DATE) <= hi"""
TABLE_SQL["eqw"] = """
SELECT e.*, label, x.close AS bench FROM equity e JOIN wins ON date BETWEEN test_start AND test_end
ASOF LEFT JOIN (SELECT date, close FROM idx WHERE index_code = 'BROAD_500') x ON e.date >= x.date"""
TABLE_SQL["wmetrics"] = """
WITH r AS (SELECT *, equity / max(equity) OVER w - 1 AS dd, equity / lag(equity) OVER w - 1 AS dr FROM eqw WINDOW w AS (PARTITION BY rule, label ORDER BY date)),
a AS (SELECT rule, label, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, date_diff('day', min(date), max(date)) AS days, least(0, min(dd)) AS max_drawdown,
  CASE WHEN count(*) >= 3 AND stddev_samp(dr) > 0 THEN avg(dr) / stddev_samp(dr) * sqrt(252) ELSE 0 END AS sharpe, avg(exposure) AS exposure,
  CASE WHEN count(bench) = count(*) THEN arg_max(bench, date) / arg_min(bench, date) - 1 END AS benchmark_return FROM r GROUP BY ALL),
t AS (SELECT rule, label, count(*) AS trade_count, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END) AS win_rate, coalesce(avg(net_return) FILTER (WHERE net_return > 0), 0) AS avg_win,
  coalesce(avg(net_return) FILTER (WHERE net_return < 0), 0) AS avg_loss,
  CASE WHEN count(*) FILTER (WHERE net_return < 0) > 0 THEN coalesce(sum(net_return) FILTER (WHERE net_return > 0), 0) / -sum(net_return) FILTER (WHERE net_return < 0) WHEN count(*) FILTER (WHERE net_return > 0) = 0 THEN 0 END AS profit_factor,
  avg(holding_days) AS avg_hold FROM trades JOIN wins ON entry_date BETWEEN test_start AND test_end GROUP BY ALL)
SELECT rule, label, total_return, CASE WHEN days > 0 THEN pow(1 + total_return, 365.25 / days) - 1 ELSE 0 END AS cagr, max_drawdown, sharpe, exposure, benchmark_return, total_return - benchmark_return AS alpha,
 coalesce(trade_count, 0) AS trade_count, win_rate, avg_win, avg_loss, profit_factor, avg_hold,
 CASE WHEN coalesce(trade_count, 0) = 0 THEN 'no_trades' WHEN benchmark_return IS NULL THEN 'no_benchmark' WHEN total_return > benchmark_return THEN 'pass' ELSE 'fail' END AS outcome
FROM a LEFT JOIN t USING (rule, label)"""
TABLE_SQL["gated"] = """
SELECT *, CASE WHEN NOT (ok_windows AND ok_trades) THEN 'insufficient_evidence' WHEN ok_benchmark AND ok_drawdown THEN 'pass' ELSE 'fail' END AS verdict FROM (
 SELECT *, n_scored >= CASE WHEN lt THEN 3 ELSE 6 END AS ok_windows, pass_ratio >= 0.6 AS ok_benchmark, worst_drawdown >= CASE WHEN lt THEN -0.35 ELSE -0.25 END AS ok_drawdown, n_trades >= CASE WHEN lt THEN 10 ELSE 30 END AS ok_trades
 FROM (SELECT *, coalesce(n_pass / nullif(n_scored, 0), 0) AS pass_ratio, horizon = 'long_term' AS lt FROM (
  SELECT rule, CASE split_part(rule, '_', 1) WHEN 'short' THEN 'short_term' WHEN 'longterm' THEN 'long_term' ELSE split_part(rule, '_', 1) END AS horizon,
   count(*) FILTER (WHERE outcome IN ('pass', 'fail')) AS n_scored, count(*) FILTER (WHERE outcome = 'pass') AS n_pass, CAST(sum(trade_count) AS BIGINT) AS n_trades, min(max_drawdown) AS worst_drawdown FROM wmetrics GROUP BY ALL)))"""
TABLE_SQL["oos"] = """
SELECT rule, max_drawdown, sharpe, n_windows, trades, win_rate, avg_hold, CASE WHEN g > 0 THEN pow(g, 365.25 / days) - 1 END AS cagr FROM (
 SELECT rule, product(1 + total_return) AS g, date_diff('day', min(test_start), max(test_end)) AS days, min(max_drawdown) AS max_drawdown, avg(sharpe) AS sharpe, count(*) AS n_windows FROM wmetrics JOIN wins USING (label) GROUP BY rule)
LEFT JOIN (SELECT rule, count(*) AS trades, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(holding_days) AS avg_hold FROM trades GROUP BY rule) USING (rule)"""
