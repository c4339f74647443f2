"""Fundamentals and screening rules (survey 2.7, 2.8)."""

import copy

from pyspark.sql import functions as F

from barloom.functions import lattice
from barloom.functions import rules as rl
from barloom.operators import features as ft
from barloom.operators import fundamentals as fd
from barloom.operators import screening as sc
from barloom.plans.derived import RULE_SQL, UNI, pick_sql
from barloom.plans.registry import query
from barloom.plans.workbench import Workbench
from barloom.rules import seed_rules

# ---- fundamentals -------------------------------------------------------------------------------
TAG = {"q_revenue": ("OneD", "RevenueFromOperations", "quarter", "revenue"), "q_pbt": ("OneD", "ProfitBeforeTax", "quarter", "pbt"),
       "q_pat": ("OneD", "ProfitLossForPeriod", "quarter", "pat"), "q_finance": ("OneD", "FinanceCosts", "quarter", "finance_costs"),
       "q_eps": ("OneD", "BasicEarningsLossPerShareFromContinuingOperations", "quarter", "eps"), "y_revenue": ("FourD", "RevenueFromOperations", "ytd", "revenue"),
       "y_pat": ("FourD", "ProfitLossForPeriod", "ytd", "pat"), "i_equity": ("OneI", "Equity", "instant", "equity"),
       "i_borrow_nc": ("OneI", "BorrowingsNoncurrent", "instant", "borrowings_noncurrent"), "i_borrow_c": ("OneI", "BorrowingsCurrent", "instant", "borrowings_current")}


def _fid(f):
    return F.concat_ws("|", "symbol", F.col("consolidated").cast("string"), F.col("period_end").cast("string"), F.col("available_on").cast("string"))


FID = "concat_ws('|', symbol, CAST(consolidated AS VARCHAR), CAST(period_end AS VARCHAR), CAST(available_on AS VARCHAR))"


def _xml(wb: Workbench):
    """The filings as documents: three plain contexts, one dimensioned context and a comment to ignore."""
    ctx = "".join(f'<xbrli:context id="{c}"><xbrli:entity>x</xbrli:entity><xbrli:period/></xbrli:context>' for c in ("OneD", "FourD", "OneI"))
    dim = '<xbrli:context id="OneD_seg"><xbrli:entity><xbrli:segment>a</xbrli:segment></xbrli:entity></xbrli:context>'
    noise = '<!-- <in:Equity contextRef="OneI" unitRef="INR">1</in:Equity> --><in:ProfitBeforeTax contextRef="OneD_seg" unitRef="INR">7</in:ProfitBeforeTax>'
    facts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<in:{tag} contextRef="{cx}" unitRef="INR" decimals="2"> '), F.format_string("%.12f", F.col(c)), F.lit(f" </in:{tag}>")))
             for c, (cx, tag, _, _) in TAG.items()]
    return wb.filings.select(_fid(wb.filings).alias("filing_id"), F.concat_ws("", F.lit(f"<xbrl>{ctx}{dim}{noise}"), *facts, F.lit("</xbrl>")).alias("xml"))


query("p1_extract_filing_facts", "\nUNION ALL ".join(
    f"SELECT {FID} AS filing_id, '{k}' AS kind, '{i}' AS item, {c} AS value, '{t}' AS tag FROM filings WHERE {c} IS NOT NULL" for c, (_, t, k, i) in TAG.items()), "value", 10)(
    lambda wb: fd.extract_filing_facts(_xml(wb)))


def _facts(wb):
    f = wb.filings
    cols = {"revenue": F.when(F.month("period_end") != 6, F.col("q_revenue")), "pbt": F.when(F.col("q_pbt") > 0, F.col("q_pbt")), "pat": F.when(~((F.month("period_end") == 6) & (F.col("q_pbt") <= 0)), F.col("q_pat")), "eps": F.col("q_eps"),
            "paid_up_capital": F.when(F.col("consolidated"), 100000.0).otherwise(1000.0), "face_value": F.lit(10.0)}
    return f.select(_fid(f).alias("filing_id"), F.lit("quarter").alias("kind"), F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.cast("double").alias("value")) for k, v in cols.items()])).alias("x")).select("filing_id", "kind", "x.*")


query("p2_filing_sanity", f"""
SELECT *, CASE WHEN n_missing = 3 THEN 'unsupported' WHEN n_missing > 0 OR scale_slip THEN 'partial' ELSE 'parsed' END AS status FROM (
 SELECT id AS filing_id, (revenue IS NULL)::INT + (pbt IS NULL)::INT + (pat IS NULL)::INT AS n_missing,
  coalesce(pat <> 0 AND q_eps * paid / 10 / pat > 0 AND NOT (q_eps * paid / 10 / pat BETWEEN 0.1 AND 10), FALSE) AS scale_slip
 FROM (SELECT {FID} AS id, CASE WHEN month(period_end) <> 6 THEN q_revenue END AS revenue, CASE WHEN q_pbt > 0 THEN q_pbt END AS pbt, CASE WHEN NOT (month(period_end) = 6 AND q_pbt <= 0) THEN q_pat END AS pat, q_eps, CASE WHEN consolidated THEN 100000.0 ELSE 1000.0 END AS paid FROM filings))""")(
    lambda wb: fd.filing_sanity(_facts(wb)))
query("p3_pending_filings", f"""SELECT {FID} AS filing_id, symbol, consolidated, period_end FROM filings f
WHERE period_end >= DATE '1997-01-01' AND month(period_end) <> 9 AND (consolidated OR symbol NOT IN (SELECT symbol FROM filings WHERE consolidated))""")(
    lambda wb: fd.pending_filings(wb.filings.select(_fid(wb.filings).alias("filing_id"), "symbol", "consolidated", "period_end"),
                                  wb.filings.filter("month(period_end) = 9").select(_fid(wb.filings).alias("filing_id")), "1997-01-01"))
query("p4_preferred_basis", "SELECT symbol, period_end, available_on, consolidated FROM pref")(
    lambda wb: fd.preferred_basis(wb.filings).select("symbol", "period_end", "available_on", "consolidated"))
query("p5_available_on", "SELECT symbol, consolidated, period_end, broadcast, coalesce(broadcast + 1, period_end + 60) AS usable_from, broadcast IS NULL AS is_estimate FROM filings")(
    lambda wb: wb.filings.select("symbol", "consolidated", "period_end", "broadcast", fd.available_on(F.col("broadcast"), F.col("period_end"))[0].alias("usable_from"),
                                 fd.available_on(F.col("broadcast"), F.col("period_end"))[1].alias("is_estimate")))
query("p6_ttm", "SELECT * FROM ttms", "q_pbt_ttm:6 q_finance_ttm:6 q_eps_ttm:10")(lambda wb: fd.ttm(fd.preferred_basis(wb.filings), ["q_pbt", "q_finance", "q_eps"]))
query("p7_balance_ratios", "SELECT * FROM ratios", "roce de_ratio")(
    lambda wb: fd.balance_ratios(fd.preferred_basis(wb.filings), fd.ttm(fd.preferred_basis(wb.filings), ["q_pbt", "q_finance", "q_eps"])))
query("p8_growth3", "SELECT * FROM growth", "sales_cagr3 profit_cagr3")(lambda wb: fd.growth3(fd.preferred_basis(wb.filings)))
query("p9_attach_fundamentals", "SELECT symbol, date, roce, de_ratio, sales_cagr3, profit_cagr3, eps_ttm, fund_age_days, pe_ttm FROM fpanel", "roce de_ratio sales_cagr3 profit_cagr3 eps_ttm:10 pe_ttm", 5)(
    lambda wb: fd.attach_fundamentals(wb.panel.withColumn("close_raw", F.col("close")), wb.metrics).select("symbol", "date", *fd.COLUMNS, "fund_age_days", "pe_ttm"))
query("p10_latest_fundamentals", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY available_on DESC, period_end DESC) AS rn FROM metrics) WHERE rn = 1""",
      "roce de_ratio sales_cagr3 profit_cagr3 eps_ttm:10", 5)(lambda wb: fd.latest_fundamentals(wb.metrics))

# ---- rules --------------------------------------------------------------------------------------
UNIVERSE = {"min_price_raw": 20, "min_median_turnover_inr": 20000, "min_listed_days": 120, "exclude_series": ["SM", "ST", "MF", "GB", "IV"]}


def workbench_rules() -> dict[str, dict]:
    """The seed rules with thresholds that fit the workbench's wild prices."""
    rules = copy.deepcopy(seed_rules())
    for r in rules.values():
        r["universe"] = UNIVERSE
    e = {k: r["entry"]["all"] for k, r in rules.items()}
    e["short_volume_breakout_delivery"][1]["right"] = 1
    e["short_volume_breakout_delivery"][3]["right"]["mul"][0] = 1.1
    b = e["short_oversold_bounce"]
    b[0]["right"], b[1]["right"]["mul"][0], b[3]["right"] = 48, 30, {"mul": [0.2, {"ind": "sma", "period": 200}]}
    c = e["swing_consolidation_breakout"]
    c[0]["right"], c[1]["right"], c[2]["right"] = 8, {"mul": [0.5, {"ind": "high_prior", "period": 20}]}, 1
    e["swing_rsi_reset"][2]["right"] = 48
    e["momentum_near_52w_high"][0]["right"] = 0.5
    q = e["longterm_quality_growth_value"]
    for i, v in ((0, 0.05), (1, 2.5), (2, 0.01), (3, 0.01), (4, [1, 400])):
        q[i]["right"] = v
    return rules


def mask(name, node, sql, cols=("close", "open")):
    """Rule over every bar: which rows it accepts."""
    spec = {"params": {"k": {"default": 2.0, "grid": [1, 2, 3]}}}

    def build(wb):
        f = ft.prev_columns(ft.volume_ratio(ft.sma(ft.rsi(wb.panel), (20, 50))), ["close", "sma20"])
        return f.select("symbol", "date", rl.rule_column(node, rl.resolve_params(spec), f.columns).alias("hit"))
    body = f"SELECT symbol, date, coalesce({sql}, FALSE) AS hit FROM (SELECT *, lag(close) OVER w AS p_close, lag(sma20) OVER w AS p_sma20 FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY date))"
    query(name, body)(build)


C, S20, S50 = {"ind": "close"}, {"ind": "sma", "period": 20}, {"ind": "sma", "period": 50}
mask("r1_operands", {"left": {"div": [{"sub": [C, S20]}, {"sub": [{"ind": "open"}, C]}]}, "op": ">", "right": {"add": [{"mul": [{"param": "k"}, 1.5]}, -2.0]}},
     "(close - sma20) / nullif(open - close, 0) > 2.0 * 1.5 - 2.0")
mask("r2_comparators", {"all": [{"left": C, "op": ">=", "right": S20}, {"left": C, "op": "<", "right": {"mul": [3, S50]}}, {"left": {"ind": "rsi", "period": 14}, "op": "between", "right": [45, 60]}, {"left": {"ind": "volume"}, "op": "<=", "right": 60}]},
     "close >= sma20 AND close < 3 * sma50 AND rsi14 BETWEEN 45 AND 60 AND volume <= 60")
mask("r3_crosses", {"any": [{"left": C, "op": "crosses_above", "right": S20}, {"left": C, "op": "crosses_below", "right": 1000}]},
     "coalesce(close > sma20 AND p_close <= p_sma20, FALSE) OR coalesce(close < 1000 AND p_close >= 1000, FALSE)")
mask("r4_trees", {"any": [{"not": {"left": C, "op": ">", "right": S20}}, {"all": [{"left": C, "op": ">", "right": S50}, {"not": {"left": {"ind": "vol_ratio", "period": 20}, "op": "<", "right": 2}}]}]},
     "NOT coalesce(close > sma20, FALSE) OR (coalesce(close > sma50, FALSE) AND NOT coalesce(vol_ratio20 < 2, FALSE))")
query("r5_universe_filter", f"SELECT symbol, date FROM feat WHERE {UNI} AND series <> 'BZ'")(
    lambda wb: (lambda f: f.filter(rl.universe_column({**UNIVERSE, "exclude_series": ["BZ"]}, f.columns)).select("symbol", "date"))(
        ft.bar_count(ft.turnover_history(wb.panel)).withColumn("close_raw", F.col("close"))))


def _grid(wb):
    spec = {"slug": "rsi", "params": {"lo": {"default": 1, "grid": [30, 35, 40]}, "hi": {"default": 1, "grid": [55, 60]}},
            "entry": {"left": {"ind": "rsi", "period": 14}, "op": "between", "right": [{"param": "lo"}, {"param": "hi"}]}}
    f = ft.rsi(wb.panel).filter("rsi14 IS NOT NULL")
    return lattice.counts(f, spec).withColumn("n_rows", f.agg(F.count("*")).scalar())


query("r6_param_grid", """SELECT lo, hi, count(*) FILTER (WHERE rsi14 BETWEEN lo AND hi) AS n_hits, count(*) AS n_rows
FROM feat, (VALUES (30.0), (35.0), (40.0)) a(lo), (VALUES (55.0), (60.0)) b(hi) WHERE rsi14 IS NOT NULL GROUP BY ALL""", "lo hi")(_grid)


def _scored(wb):
    r = workbench_rules()
    two = copy.deepcopy(r["momentum_relative_strength"])
    two["rank"]["by"] = [{"ind": "rs", "period": 126, "dir": "desc", "weight": 2.0}, {"ind": "atr_pct14", "dir": "asc", "weight": 1.0}, {"ind": "rs", "period": 252, "dir": "desc", "weight": 1.0}]
    f = wb.feat
    return sc.score(sc.candidates(f, [(two, {})]))


PCT = "CASE WHEN {0} IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY date ORDER BY {0} {1} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date) END"
SCORED = f"""SELECT symbol, date, (2 * {PCT.format('rs126', 'ASC')} + {PCT.format('atr_pct14', 'DESC')} + {PCT.format('rs252', 'ASC')}) / 4.0 * 100 AS score
FROM feat WHERE {UNI} AND rs126 > 0.1 AND ret20 > 0 AND close > sma200"""
query("r7_score", SCORED, "score")(lambda wb: _scored(wb).select("symbol", "date", "score"))
query("r8_top_per_day", f"SELECT * FROM (SELECT symbol, date, score, row_number() OVER (PARTITION BY date ORDER BY round(score, 6) DESC, symbol) AS rank FROM ({SCORED}) WHERE symbol <> 'Brand#3-0') WHERE rank <= 3", "score")(
    lambda wb: (lambda s: sc.top_per_day(s, 3, s.filter("symbol = 'Brand#3-0'").select(*sc.KEYS, "symbol")))(_scored(wb).withColumn("score", F.round("score", 6))).select("symbol", "date", "score", "rank"))
query("r9_protection", """SELECT symbol, date, CASE WHEN atr_pct14 > 0 THEN atr_pct14 * 1.5 END AS stop_pct, 0.2::DOUBLE AS target_pct FROM feat WHERE close > high_prior20 AND atr_pct14 > 0
UNION ALL SELECT symbol, date, 0.1, NULL FROM feat WHERE close > high_prior20""", "stop_pct target_pct", 4)(
    lambda wb: (lambda f: sc.with_protection(f.select("symbol", "date", rl.distance({"type": "atr", "mult": 1.5}).alias("stop_pct"), rl.distance({"type": "pct", "value": 0.2}).alias("target_pct"), F.lit(True).alias("needs_stop"), F.lit(True).alias("needs_target"))
                                             .unionByName(f.select("symbol", "date", F.lit(0.1).alias("stop_pct"), F.lit(None).cast("double").alias("target_pct"), F.lit(True).alias("needs_stop"), F.lit(False).alias("needs_target")))).drop("needs_stop", "needs_target"))(
        ft.atr(ft.prior_extremes(wb.panel)).filter("close > high_prior20")))
WEEK = "wd AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) < 6)"
END = f"SELECT p.*, b.day AS window_end FROM (SELECT p.*, wd.n FROM ({{}}) p ASOF JOIN wd ON p.date <= wd.day) p JOIN wd b ON b.n = p.n + p.hold_days + 1"
PCOLS = "rule, variant, exchange, symbol, date, rank, score, ref_price, ref_price * (1 - stop_pct) AS stop_price, ref_price * (1 + target_pct) AS target_price, window_end"
PRND = "score ref_price stop_price:2 target_price:2"
PSEL = ["rule", "variant", "exchange", "symbol", "date", "rank", "score", "ref_price", "stop_price", "target_price", "window_end"]


def rule_picks(wb, slugs, grid=False, day=None):
    r = workbench_rules()
    return sc.scan(wb.fpanel, sc.variants_of([r[s] for s in slugs], grid), day)


query("r10_scan_one_day", f"WITH {WEEK} SELECT {PCOLS} FROM ({END.format('SELECT * FROM picks')}) WHERE date = DATE '1999-09-15'", PRND)(
    lambda wb: rule_picks(wb, RULE_SQL, day="1999-09-15").select(*PSEL))
query("r10_scan_all_days", f"WITH {WEEK} SELECT {PCOLS} FROM ({END.format('SELECT * FROM picks')})", PRND)(lambda wb: wb.picks.select(*PSEL))
query("r11_window_end", f"WITH {WEEK} SELECT symbol, date, hold_days, window_end FROM ({END.format('SELECT symbol, date, CAST(1 + volume % 60 AS INTEGER) AS hold_days FROM panel')})")(
    lambda wb: wb.panel.select("symbol", "date", (1 + F.col("volume") % 60).cast("int").alias("hold_days")).withColumn("window_end", sc.window_end(F.col("date"), F.col("hold_days"))))
query("r12_upsert_picks", """SELECT rule, count(*) FILTER (WHERE date >= DATE '2000-01-01') AS inserted, count(*) FILTER (WHERE date < DATE '2000-01-01') AS known FROM picks GROUP BY rule""")(
    lambda wb: (lambda p: sc.upsert_counts(sc.upsert_picks(p.filter("date < '2000-01-01'"), p), p))(wb.picks))
STATUS = {"short_gap_and_hold": "candidate", "swing_rsi_reset": "draft", "momentum_12_minus_1": "live"}
query("r13_preview", "SELECT rule, symbol, date, rank, score, CASE rule WHEN 'swing_rsi_reset' THEN 'draft' ELSE 'candidate' END AS status FROM picks WHERE rule IN ('short_gap_and_hold', 'swing_rsi_reset')", "score")(
    lambda wb: sc.preview(wb.fpanel, sc.variants_of(list(workbench_rules().values())), STATUS).select("rule", "symbol", "date", "rank", "score", "status"))
for _slug in RULE_SQL:
    query(f"r14_{_slug}", f"SELECT rule, symbol, date, rank, score, ref_price, stop_pct, target_pct, hold_days FROM ({pick_sql(_slug)})", "score ref_price stop_pct:4 target_pct:4")(
        lambda wb, s=_slug: rule_picks(wb, [s]).select("rule", "symbol", "date", "rank", "score", "ref_price", "stop_pct", "target_pct", "hold_days"))
def swept_rule() -> dict:
    """Relative strength with thresholds to choose from, spread so that every point has picks of its own."""
    rule = copy.deepcopy(workbench_rules()["momentum_relative_strength"])
    rule["entry"]["all"][0]["right"], rule["entry"]["all"][1]["right"] = {"param": "rs"}, {"param": "ret"}
    rule["params"] = {"rs": {"default": 0.1, "grid": SWEPT["rs"]}, "ret": {"default": 0, "grid": SWEPT["ret"]}}
    return rule


SWEPT = {"rs": [0.1, 0.6, 1.5], "ret": [0, 0.5, 2]}
SWEEP = "\nUNION ALL ".join(pick_sql("momentum_relative_strength", RULE_SQL["momentum_relative_strength"][0].replace("rs126 > 0.1", f"rs126 > {a}").replace("ret20 > 0", f"ret20 > {b}"), f"ret={b:g},rs={a:g}") for a in SWEPT["rs"] for b in SWEPT["ret"])
query("r15_sweep", f"SELECT rule, variant, symbol, date, rank, score FROM ({SWEEP})", "score")(
    lambda wb: sc.sweep(wb.fpanel, [swept_rule()]).select("rule", "variant", "symbol", "date", "rank", "score"))
# a thousand points
TEN = {"a": [-0.5 + 0.25 * k for k in range(10)], "b": [-0.4 + 0.2 * k for k in range(10)], "c": [30.0 + 4 * k for k in range(10)]}


def _thousand() -> dict:
    left = lambda ind, period: {"ind": ind, "period": period}
    return {"slug": "thousand", "universe": {}, "params": {k: {"default": v[0], "grid": v} for k, v in TEN.items()},
            "entry": {"all": [{"left": {"param": "a"}, "op": "<", "right": left("rs", 126)}, {"all": [{"left": left("ret", 20), "op": ">=", "right": {"param": "b"}}, {"left": left("rsi", 14), "op": "between", "right": [20, {"param": "c"}]}]},
                              {"left": {"ind": "close"}, "op": ">", "right": left("sma", 200)}]}}


query("r6_lattice_counts", f"""WITH p AS (SELECT unnest({TEN['a']}::DOUBLE[]) AS a), q AS (SELECT unnest({TEN['b']}::DOUBLE[]) AS b), r AS (SELECT unnest({TEN['c']}::DOUBLE[]) AS c), f AS (SELECT rs126, ret20, rsi14 FROM feat WHERE close > sma200)
SELECT a, b, c, count(rs126) AS n_hits FROM p, q, r LEFT JOIN f ON rs126 > a AND ret20 >= b AND rsi14 BETWEEN 20 AND c GROUP BY ALL""", "a b c")(lambda wb: lattice.counts(wb.feat, _thousand()))
