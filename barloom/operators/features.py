"""Daily technical features per symbol. Nothing looks ahead: "prior" frames end yesterday."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ewm import ewm
from barloom.functions.joins import asof_join
from barloom.functions.lineage import written
from barloom.functions.rolling import rolling
from barloom.functions.windows import median, safe_div, symbol_window, trailing

SMA = (20, 50, 100, 200)
EMA = (10, 20, 50, 100, 200)
RETURNS = (1, 5, 20, 60, 120, 250)
RS = (63, 126, 252)


def _w():
    return symbol_window("symbol")


def sma(panel: DataFrame, spans=SMA) -> DataFrame:
    return rolling(panel, _w(), {f"sma{n}": ("avg", "close", n, False) for n in spans})


def ema(panel: DataFrame, spans=EMA) -> DataFrame:
    return ewm(panel, {f"ema{n}": (F.col("close"), 2.0 / (n + 1), n, 0) for n in spans})


def rsi(panel: DataFrame, spans=(2, 14)) -> DataFrame:
    """Wilder's RSI from the second row on; 100 when there were no losses."""
    d = panel.withColumn("_d", F.col("close") - F.lag("close").over(_w()))
    up, down = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    specs = {}
    for n in spans:
        specs[f"_up{n}"] = (up, 1.0 / n, n, 1)
        specs[f"_dn{n}"] = (down, 1.0 / n, n, 1)
    e = ewm(d, specs)
    return e.select(*panel.columns, *[
        F.when(F.col(f"_dn{n}") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col(f"_up{n}") / F.when(F.col(f"_dn{n}") != 0, F.col(f"_dn{n}"))))
        .alias(f"rsi{n}") for n in spans])


def atr(panel: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's average true range; the first row has no true range."""
    t = panel.withColumn("_pc", F.lag("close").over(_w()))
    tr = F.when(F.col("_pc").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))))
    e = ewm(t, {f"atr{n}": (tr, 1.0 / n, n, 1)})
    return e.select(*panel.columns, f"atr{n}", safe_div(F.col(f"atr{n}"), F.col("close")).alias(f"atr_pct{n}"))


def returns(panel: DataFrame, spans=RETURNS) -> DataFrame:
    return panel.select("*", *[(safe_div(F.col("close"), F.lag("close", n).over(_w())) - 1).alias(f"ret{n}") for n in spans])


def momentum_12_1(panel: DataFrame) -> DataFrame:
    return panel.withColumn("mom_12_1", safe_div(F.lag("close", 21).over(_w()), F.lag("close", 252).over(_w())) - 1)


def prior_extremes(panel: DataFrame, highs=(20, 55, 252), lows=(20, 60, 252)) -> DataFrame:
    return rolling(panel, _w(), {**{f"high_prior{n}": ("max", "high", n, True) for n in highs}, **{f"low_prior{n}": ("min", "low", n, True) for n in lows}})


def prior_range(panel: DataFrame, spans=(10, 20)) -> DataFrame:
    r = rolling(panel, _w(), {**{f"_h{n}": ("max", "high", n, True) for n in spans}, **{f"_l{n}": ("min", "low", n, True) for n in spans}})
    pc = F.lag("close").over(_w())
    return r.select(*panel.columns, *[safe_div(F.col(f"_h{n}") - F.col(f"_l{n}"), pc).alias(f"range_pct_prior{n}") for n in spans])


def high_proximity(panel: DataFrame, n: int = 252) -> DataFrame:
    r = rolling(panel, _w(), {"_h": ("max", "high", n, False)})
    return r.select(*panel.columns, safe_div(F.col("close"), F.col("_h")).alias(f"high_{n}_prox"))


def volume_ratio(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn(f"vol_ratio{n}", safe_div(F.col("volume"), trailing(F.avg, "volume", n, _w(), prior=True)))


def gap_and_location(panel: DataFrame) -> DataFrame:
    """Opening gap in percent points and where the close sits in the day's range (NULL on a frozen bar)."""
    pc = F.lag("close").over(_w())
    return panel.select("*", ((safe_div(F.col("open"), pc) - 1) * 100).alias("gap_pct"),
                        safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("close_location"))


def turnover_history(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.select("*", trailing(median, "turnover", n, _w(), prior=True).alias(f"turnover_med{n}"),
                        trailing(F.avg, "turnover", n, _w(), prior=True, min_rows=1).alias("adv_turnover"))


def bar_count(panel: DataFrame) -> DataFrame:
    return panel.withColumn("bar_count", F.row_number().over(_w()))


def delivery_average(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn(f"delivery_pct_sma{n}", trailing(F.avg, "delivery_pct", n, _w(), prior=True, min_rows=n // 2))


def raw_and_previous_close(panel: DataFrame) -> DataFrame:
    return panel.withColumn("close_raw", safe_div(F.col("close"), F.col("cumulative_price_factor"))).withColumn(
        "prev_close", F.lag("close").over(_w()))


def index_returns(index: DataFrame, dates: DataFrame, spans=RS) -> DataFrame:
    """(date, idx_ret{n}): returns over index sessions carried forward onto the given dates, never
    backward. ``index`` is one series (date, close), so this is one row per calendar day."""
    one = index.groupBy("date").agg(F.max("close").alias("close")).withColumn("k", F.lit(0))
    w = symbol_window("k")
    r = one.select("k", F.col("date").alias("idx_date"), *[(safe_div(F.col("close"), F.lag("close", n).over(w)) - 1).alias(f"idx_ret{n}") for n in spans])
    hit = asof_join(dates.select(F.lit(0).alias("k"), "date"), r, ["k"], "date", "idx_date", [f"idx_ret{n}" for n in spans])
    return hit.select("date", *[f"idx_ret{n}" for n in spans])


def relative_strength(panel: DataFrame, index: DataFrame, spans=RS) -> DataFrame:
    """Stock return minus index return. The index side has one row per calendar day whatever the
    number of symbols (tens of thousands of rows per century), hence the broadcast."""
    idx = index_returns(index, panel.select("date").distinct(), spans)
    own = panel.select("*", *[(safe_div(F.col("close"), F.lag("close", n).over(_w())) - 1).alias(f"_r{n}") for n in spans])
    return own.join(F.broadcast(idx), "date", "left").select(*panel.columns, *[(F.col(f"_r{n}") - F.col(f"idx_ret{n}")).alias(f"rs{n}") for n in spans])


def prev_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    kept = [c for c in df.columns if c not in {f"prev_{x}" for x in cols}]
    return df.select(*kept, *[F.lag(c).over(_w()).alias(f"prev_{c}") for c in cols])


def features(panel: DataFrame, index: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """All feature columns. Every step windows on the symbol, so the plan has one exchange on it. Other columns of the panel
    are carried. ``days``: the panel's dates, where a cheaper table than the panel has them."""
    p = panel if "cumulative_price_factor" in panel.columns else panel.withColumn("cumulative_price_factor", F.lit(1.0))
    w = _w()
    pc = F.lag("close").over(w)
    p = p.withColumn("prev_close", pc).withColumn("_d", F.col("close") - pc)
    tr = F.when(F.col("prev_close").isNotNull(), F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))))
    up, down = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    e = ewm(p, {**{f"ema{n}": (F.col("close"), 2.0 / (n + 1), n, 0) for n in EMA}, "_up2": (up, 0.5, 2, 1), "_dn2": (down, 0.5, 2, 1),
                "_up14": (up, 1.0 / 14, 14, 1), "_dn14": (down, 1.0 / 14, 14, 1), "atr14": (tr, 1.0 / 14, 14, 1)})
    e = rolling(e, w, {
        **{f"sma{n}": ("avg", "close", n, False) for n in SMA}, **{f"high_prior{n}": ("max", "high", n, True) for n in (20, 55, 252)},
        **{f"low_prior{n}": ("min", "low", n, True) for n in (20, 60, 252)}, "_h10": ("max", "high", 10, True), "_l10": ("min", "low", 10, True),
        "_h252": ("max", "high", 252, False), "_v20": ("avg", "volume", 20, True), "adv_turnover": ("avg", "turnover", 20, True, 1),
        "delivery_pct_sma20": ("avg", "delivery_pct", 20, True, 10)}, nullable=("delivery_pct",))

    def r(n):
        return F.when(F.col(f"_dn{n}") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col(f"_up{n}") / F.when(F.col(f"_dn{n}") != 0, F.col(f"_dn{n}"))))
    lagged = [(safe_div(F.col("close"), F.lag("close", n).over(w)) - 1).alias(f"ret{n}") for n in RETURNS]
    strength = [(safe_div(F.col("close"), F.lag("close", n).over(w)) - 1).alias(f"_r{n}") for n in RS]
    out = e.select(
        *[c for c in e.columns if not c.startswith("_")],
        r(2).alias("rsi2"), r(14).alias("rsi14"), safe_div(F.col("atr14"), F.col("close")).alias("atr_pct14"), *lagged, *strength,
        (safe_div(F.lag("close", 21).over(w), F.lag("close", 252).over(w)) - 1).alias("mom_12_1"),
        safe_div(F.col("_h10") - F.col("_l10"), F.col("prev_close")).alias("range_pct_prior10"),
        safe_div(F.col("high_prior20") - F.col("low_prior20"), F.col("prev_close")).alias("range_pct_prior20"),
        safe_div(F.col("close"), F.col("_h252")).alias("high_252_prox"), safe_div(F.col("volume"), F.col("_v20")).alias("vol_ratio20"),
        ((safe_div(F.col("open"), F.col("prev_close")) - 1) * 100).alias("gap_pct"),
        safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("close_location"),
        trailing(median, "turnover", 20, w, prior=True).alias("turnover_med20"), F.row_number().over(w).alias("bar_count"),
        safe_div(F.col("close"), F.col("cumulative_price_factor")).alias("close_raw"))
    if index is None:
        return out.select(*[c for c in out.columns if not c.startswith("_r")], *[F.lit(None).cast("double").alias(f"rs{n}") for n in RS])
    idx = index_returns(index, panel.select("date").distinct() if days is None else days)
    return out.join(F.broadcast(idx), "date", "left").select(
        *[c for c in out.columns if not c.startswith("_r")], *[(F.col(f"_r{n}") - F.col(f"idx_ret{n}")).alias(f"rs{n}") for n in RS])


def look_ahead_diff(fn, panel: DataFrame, cut, cols: list[str], digits: int = 6) -> DataFrame:
    """Feature rows up to ``cut`` that change when later bars are removed; empty for honest features."""
    day = F.lit(cut).cast("date")

    def rows(df):
        return fn(df).filter(F.col("date") <= day).select("symbol", "date", *[F.round(c, digits).alias(c) for c in cols])
    return rows(panel).exceptAll(rows(panel.filter(F.col("date") <= day)))


def look_ahead_counts(fn, panel: DataFrame, cuts: list, digits: int = 6) -> DataFrame:
    """For each cut day and every feature column of fn: the rows up to the day, and how many of them change, or come or go,
    when later bars are removed. Honest features change nowhere. The whole features are written once, as every cut day reads them."""
    whole, out = fn(panel), []
    cols = [c for c in whole.columns if c not in panel.columns]
    whole = written(whole.select("symbol", "date", *cols))
    for cut in cuts:
        day = F.lit(cut).cast("date")
        early = fn(panel.filter(F.col("date") <= day)).select("symbol", "date", F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in cols])
        j = whole.filter(F.col("date") <= day).withColumn("_here", F.lit(True)).join(early, ["symbol", "date"], "full")
        same = F.col("_here").isNotNull() & F.col("_there").isNotNull()
        tests = [F.struct(F.lit(c).alias("feature"), (same & F.round(F.col(c).cast("double"), digits).eqNullSafe(F.round(F.col(f"_{c}").cast("double"), digits))).alias("ok")) for c in cols]
        out.append(j.select(F.explode(F.array(*tests)).alias("t")).groupBy("t.feature").agg(F.count("*").alias("n_rows"), F.count(F.when(~F.col("t.ok"), 1)).alias("n_changed")).select(day.alias("cut"), "feature", "n_rows", "n_changed"))
    return reduce(DataFrame.unionByName, out)
