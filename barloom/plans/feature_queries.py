"""Technical features (survey 2.6)."""

from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import lake
from barloom.plans.registry import query

PW = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def rows(n, lead=0):
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" if not lead else f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def tr(fn, col, n, lead=0, need=None):
    return f"CASE WHEN count({col}) {rows(n, lead)} >= {need or n} THEN {fn}({col}) {rows(n, lead)} END"


def feature(name, fn, exprs: dict, digits=6, rounded=None):
    cols = list(exprs)
    sql = "SELECT symbol, date, " + ", ".join(f"{e} AS {c}" for c, e in exprs.items()) + f" FROM panel {PW}"
    query(name, sql, " ".join(cols if rounded is None else rounded), digits)(lambda wb: fn(wb.panel).select("symbol", "date", *cols))


RSI_ATR = """
WITH RECURSIVE p AS (SELECT symbol, date, close, high, low, row_number() OVER w AS n, close - lag(close) OVER w AS d,
   greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)),
x AS (SELECT symbol, date, close, n, greatest(d, 0) AS u, greatest(-d, 0) AS v, tr FROM p),
r AS (
 SELECT symbol, date, close, n, u AS u2, v AS v2, u AS u14, v AS v14, tr AS atr FROM x WHERE n = 2
 UNION ALL
 SELECT x.symbol, x.date, x.close, x.n, r.u2 + (x.u - r.u2) / 2, r.v2 + (x.v - r.v2) / 2, r.u14 + (x.u - r.u14) / 14, r.v14 + (x.v - r.v14) / 14, r.atr + (x.tr - r.atr) / 14
 FROM r JOIN x ON x.symbol = r.symbol AND x.n = r.n + 1)"""
EMA_CTE = """
WITH RECURSIVE p AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM panel),
r AS (
 SELECT symbol, date, n, close AS e10, close AS e20, close AS e50, close AS e100, close AS e200 FROM p WHERE n = 1
 UNION ALL
 SELECT p.symbol, p.date, p.n, r.e10 + (p.close - r.e10) * 2 / 11, r.e20 + (p.close - r.e20) * 2 / 21, r.e50 + (p.close - r.e50) * 2 / 51, r.e100 + (p.close - r.e100) * 2 / 101, r.e200 + (p.close - r.e200) * 2 / 201
 FROM r JOIN p ON p.symbol = r.symbol AND p.n = r.n + 1)"""
EMAS = ", ".join(f"CASE WHEN n >= {n} THEN e{n} END AS ema{n}" for n in ft.EMA)


def rsi_sql(n):
    return f"CASE WHEN n > {n} THEN CASE WHEN v{n} = 0 THEN 100 ELSE 100 - 100 / (1 + u{n} / v{n}) END END"


feature("f1_sma", ft.sma, {f"sma{n}": tr("avg", "close", n) for n in ft.SMA})
query("f2_ema", EMA_CTE + f" SELECT symbol, date, {EMAS} FROM r", " ".join(f"ema{n}" for n in ft.EMA), 3)(
    lambda wb: ft.ema(wb.panel).select("symbol", "date", *[f"ema{n}" for n in ft.EMA]))
query("f3_rsi", RSI_ATR + f" SELECT p.symbol, p.date, {rsi_sql(2)} AS rsi2, {rsi_sql(14)} AS rsi14 FROM (SELECT symbol, date FROM p) p LEFT JOIN r USING (symbol, date)", "rsi2 rsi14", 5)(
    lambda wb: ft.rsi(wb.panel).select("symbol", "date", "rsi2", "rsi14"))
query("f4_atr", RSI_ATR + " SELECT p.symbol, p.date, CASE WHEN n > 14 THEN atr END AS atr14, CASE WHEN n > 14 THEN atr / close END AS atr_pct14 FROM (SELECT symbol, date FROM p) p LEFT JOIN r USING (symbol, date)", "atr14 atr_pct14", 3)(
    lambda wb: ft.atr(wb.panel).select("symbol", "date", "atr14", "atr_pct14"))
feature("f5_returns", ft.returns, {f"ret{n}": f"close / lag(close, {n}) OVER w - 1" for n in ft.RETURNS})
feature("f6_momentum_12_1", ft.momentum_12_1, {"mom_12_1": "lag(close, 21) OVER w / lag(close, 252) OVER w - 1"})
HL = {**{f"high_prior{n}": tr("max", "high", n, 1) for n in (20, 55, 252)}, **{f"low_prior{n}": tr("min", "low", n, 1) for n in (20, 60, 252)}}
feature("f7_prior_extremes", ft.prior_extremes, HL)
feature("f8_prior_range", ft.prior_range, {f"range_pct_prior{n}": f"({tr('max', 'high', n, 1)} - {tr('min', 'low', n, 1)}) / lag(close) OVER w" for n in (10, 20)})
feature("f9_high_proximity", ft.high_proximity, {"high_252_prox": f"close / ({tr('max', 'high', 252)})"})
feature("f10_volume_ratio", ft.volume_ratio, {"vol_ratio20": f"volume / ({tr('avg', 'volume', 20, 1)})"})
feature("f11_gap_and_location", ft.gap_and_location, {"gap_pct": "(open / lag(close) OVER w - 1) * 100", "close_location": "(close - low) / nullif(high - low, 0)"})
feature("f12_turnover_history", ft.turnover_history, {"turnover_med20": tr("median", "turnover", 20, 1), "adv_turnover": tr("avg", "turnover", 20, 1, 1)}, 8)
feature("f13_bar_count", ft.bar_count, {"bar_count": "row_number() OVER w"}, rounded=[])
feature("f14_delivery_average", ft.delivery_average, {"delivery_pct_sma20": tr("avg", "delivery_pct", 20, 1, 10)})
query("f15_raw_and_previous_close", """SELECT symbol, date, close / cumulative_price_factor AS close_raw, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY CASE series WHEN 'EQ' THEN 1 WHEN 'BE' THEN 2 ELSE 3 END) AS rn FROM adj WHERE exchange = 'NSE') WHERE rn = 1""",
      "close_raw prev_close", 4)(lambda wb: ft.raw_and_previous_close(lake.panel(wb.adj.filter("exchange = 'NSE'")))
                                 .select("symbol", "date", "close_raw", "prev_close"))
IDXR = """
i AS (SELECT date, """ + ", ".join(f"close / lag(close, {n}) OVER (ORDER BY date) - 1 AS i{n}" for n in ft.RS) + """ FROM idx WHERE index_code = 'BROAD_500'),
d AS (SELECT dd.date, """ + ", ".join(f"i{n}" for n in ft.RS) + """ FROM (SELECT DISTINCT date FROM panel) dd ASOF LEFT JOIN i ON dd.date >= i.date)"""
query("f16_relative_strength", f"WITH {IDXR} SELECT symbol, date, " + ", ".join(f"close / lag(close, {n}) OVER w - 1 - i{n} AS rs{n}" for n in ft.RS)
      + f" FROM panel JOIN d USING (date) {PW}", "rs63 rs126 rs252")(
    lambda wb: ft.relative_strength(wb.panel, wb.idx.filter("index_code = 'BROAD_500'")).select("symbol", "date", "rs63", "rs126", "rs252"))
feature("f17_prev_columns", lambda p: ft.prev_columns(p, ["close", "volume"]), {"prev_close": "lag(close) OVER w", "prev_volume": "lag(volume) OVER w"}, rounded=["prev_close"])


def _diff(wb):
    def fn(p):
        return ft.features(p)
    return ft.look_ahead_diff(fn, wb.panel, "1999-06-30", ["sma20", "ema20", "rsi14", "atr_pct14", "ret20", "high_prior20", "low_prior20", "vol_ratio20", "turnover_med20"])


query("f18_look_ahead_diff", "SELECT symbol, date, close AS sma20, close AS ema20, close AS rsi14, close AS atr_pct14, close AS ret20, close AS high_prior20, close AS low_prior20, close AS vol_ratio20, close AS turnover_med20 FROM panel WHERE 1 = 0")(_diff)
CUTS = ["1996-03-29", "1999-06-30", "2001-11-15"]


def _every_feature(wb):
    """All feature columns with the index, over several cut days; columns that the panel has itself are no features."""
    index = wb.idx.filter("index_code = 'BROAD_500'")
    return ft.look_ahead_counts(lambda p: ft.features(p, index), wb.panel.drop("prev_close"), CUTS)


FEATURES = sorted([*[f"sma{n}" for n in ft.SMA], *[f"ema{n}" for n in ft.EMA], *[f"ret{n}" for n in ft.RETURNS], *[f"rs{n}" for n in ft.RS], *[f"high_prior{n}" for n in (20, 55, 252)], *[f"low_prior{n}" for n in (20, 60, 252)],
                   "rsi2", "rsi14", "atr14", "atr_pct14", "mom_12_1", "range_pct_prior10", "range_pct_prior20", "high_252_prox", "vol_ratio20", "gap_pct", "close_location", "turnover_med20", "adv_turnover", "bar_count",
                   "delivery_pct_sma20", "close_raw", "prev_close", "cumulative_price_factor"])
query("f18_look_ahead_counts", f"""SELECT c.cut, f.feature, (SELECT count(*) FROM panel p WHERE p.date <= c.cut) AS n_rows, 0::BIGINT AS n_changed
FROM (SELECT unnest({CUTS}::DATE[]) AS cut) c, (SELECT unnest({FEATURES}) AS feature) f""")(_every_feature)
ALL = ["sma20", "sma200", "ema20", "ema200", "rsi2", "rsi14", "atr14", "atr_pct14", "ret1", "ret250", "mom_12_1", "high_prior20", "high_prior252", "low_prior60", "range_pct_prior20", "high_252_prox",
       "vol_ratio20", "gap_pct", "close_location", "turnover_med20", "adv_turnover", "bar_count", "delivery_pct_sma20", "close_raw", "prev_close", "rs63", "rs126", "rs252"]
DIGITS = {"sma20": ":6", "sma200": ":6", "ema20": ":3", "ema200": ":3", "atr14": ":3", "vol_ratio20": ":6", "adv_turnover": ":8"}
F0_SQL = RSI_ATR.replace("r AS (", "rr AS (").replace("FROM r JOIN x ON x.symbol = r.symbol AND x.n = r.n + 1", "FROM rr r JOIN x ON x.symbol = r.symbol AND x.n = r.n + 1") + ", " + IDXR + ", " + EMA_CTE.split("WITH RECURSIVE ")[1].replace("p AS (", "q AS (").replace("FROM p WHERE", "FROM q p WHERE").replace("JOIN p ON", "JOIN q p ON") + f"""
SELECT symbol, date, {tr('avg', 'close', 20)} AS sma20, {tr('avg', 'close', 200)} AS sma200, e.ema20, e.ema200, k.rsi2, k.rsi14, k.atr14, k.atr14 / close AS atr_pct14,
 close / lag(close, 1) OVER w - 1 AS ret1, close / lag(close, 250) OVER w - 1 AS ret250, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom_12_1,
 {HL['high_prior20']} AS high_prior20, {HL['high_prior252']} AS high_prior252, {HL['low_prior60']} AS low_prior60,
 ({tr('max', 'high', 20, 1)} - {tr('min', 'low', 20, 1)}) / lag(close) OVER w AS range_pct_prior20, close / ({tr('max', 'high', 252)}) AS high_252_prox,
 volume / ({tr('avg', 'volume', 20, 1)}) AS vol_ratio20, (open / lag(close) OVER w - 1) * 100 AS gap_pct, (close - low) / nullif(high - low, 0) AS close_location,
 {tr('median', 'turnover', 20, 1)} AS turnover_med20, {tr('avg', 'turnover', 20, 1, 1)} AS adv_turnover, row_number() OVER w AS bar_count,
 {tr('avg', 'delivery_pct', 20, 1, 10)} AS delivery_pct_sma20, close AS close_raw, lag(close) OVER w AS prev_close,
 {', '.join(f'close / lag(close, {n}) OVER w - 1 - i{n} AS rs{n}' for n in ft.RS)}
FROM panel JOIN d USING (date)
LEFT JOIN (SELECT symbol, date, {EMAS} FROM r) e USING (symbol, date)
LEFT JOIN (SELECT symbol, date, {rsi_sql(2)} AS rsi2, {rsi_sql(14)} AS rsi14, CASE WHEN n > 14 THEN atr END AS atr14 FROM rr) k USING (symbol, date) {PW}"""
query("f0_features", F0_SQL, " ".join(c + DIGITS.get(c, "") for c in ALL if c != "bar_count"), 4)(
    lambda wb: ft.features(wb.panel, wb.idx.filter("index_code = 'BROAD_500'")).select("symbol", "date", *ALL))
