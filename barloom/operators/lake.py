"""Reads over the daily-bar lake: panels, latest rows, liquidity and index moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.joins import asof_join
from barloom.functions.windows import in_list_order, latest_per, median, safe_div, symbol_window

PRECEDENCE = ["EQ", "BE", "BZ"]


def bars_from_trades(trades: DataFrame, key: Column) -> DataFrame:
    """Daily bars per (exchange, symbol, series); every aggregate combines before the shuffle. ``key``
    orders the trades of a day (see ``order_key``). The bars are dealt by symbol, which serves this window
    and every later one over a symbol, its exchanges, series and days, without another shuffle."""
    agg = trades.groupBy("exchange", "symbol", "series", "date").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.sum("qty").cast("long").alias("volume"),
        F.round(F.sum("amount"), 2).alias("turnover"), F.count("*").alias("trades"),
        F.sum(F.when(F.col("discount") < 0.05, F.col("qty"))).cast("long").alias("delivery_qty")).repartition("symbol")
    w = symbol_window("exchange", "symbol", "series")
    return agg.select(
        "*", F.lag("close").over(w).alias("prev_close"), (F.col("turnover") / F.col("volume")).alias("vwap"),
        (F.col("delivery_qty") * 100.0 / F.col("volume")).alias("delivery_pct"),
        F.when(F.col("series") == "EQ", "full").when(F.col("series") == "BE", "legacy")
        .otherwise("unified").alias("source"))


def between(df: DataFrame, start=None, end=None, col: str = "date", year_partitioned: bool = False) -> DataFrame:
    """Date range filter; on a lake partitioned by year the year is filtered too, so that whole
    partitions are skipped (it cannot be derived from the date predicate)."""
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is None:
            continue
        b = F.lit(bound).cast("date")
        df = df.filter(F.col(col) >= b if op == ">=" else F.col(col) <= b)
        if year_partitioned:
            y = F.lit(int(str(bound)[:4]))
            df = df.filter(F.col("year") >= y if op == ">=" else F.col("year") <= y)
    return df


def dates_present(bars: DataFrame, exchange: str, start=None, end=None) -> DataFrame:
    return between(bars.filter(F.col("exchange") == exchange), start, end).select("date").distinct()


def lake_span(bars: DataFrame) -> DataFrame:
    return bars.groupBy("exchange").agg(F.min("date").alias("first_date"), F.max("date").alias("latest_date"))


def partition_row_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("exchange", F.year("date").alias("year")).agg(F.count("*").alias("n_rows"))


def bars_for_symbol(bars: DataFrame, exchange: str, symbol: str, start=None, end=None) -> DataFrame:
    return between(bars.filter((F.col("exchange") == exchange) & (F.col("symbol") == symbol)), start, end)


def latest_bar_per_symbol(bars: DataFrame) -> DataFrame:
    return bars.groupBy("exchange", "symbol").agg(F.max("date").alias("last_date"))


def bars_with_identity(bars: DataFrame, history: DataFrame, listings: DataFrame,
                       securities: DataFrame) -> DataFrame:
    """Resolve each bar's security: reported id, else the owner of the symbol on that day (half-open
    validity), else the current listing. The listing side is made unique per (exchange, symbol)
    first, so several series do not multiply the bars."""
    hist = history.select("exchange", "symbol", F.col("security_id").alias("_hist_id"), "valid_from", "valid_to")
    cur = listings.groupBy("exchange", "symbol").agg(F.min("security_id").alias("_list_id"))
    sec = securities.select(F.col("security_id").alias("resolved_id"), "isin", "company_name")
    b = bars.alias("b")
    h = hist.alias("h")
    on = ((F.col("b.exchange") == F.col("h.exchange")) & (F.col("b.symbol") == F.col("h.symbol"))
          & (F.col("b.date") >= F.col("h.valid_from"))
          & (F.col("h.valid_to").isNull() | (F.col("b.date") < F.col("h.valid_to"))))
    out = b.join(h, on, "left").select("b.*", "h._hist_id").join(cur, ["exchange", "symbol"], "left")
    out = out.withColumn("resolved_id", F.coalesce("security_id", "_hist_id", "_list_id"))
    return out.drop("_hist_id", "_list_id").join(sec, "resolved_id", "left")


def benchmark_series(index: DataFrame, code: str, start=None, end=None) -> DataFrame:
    return between(index.filter(F.col("index_code") == code), start, end).select("date", "close")


def one_series_per_day(bars: DataFrame, precedence: list[str] = PRECEDENCE, keys=("symbol", "date")) -> DataFrame:
    known = bars.withColumn("_p", in_list_order("series", precedence)).filter(F.col("_p").isNotNull())
    return latest_per(known, list(keys), [F.col("_p")]).drop("_p")


def last_trade_closes(trades: DataFrame, day: Column, order: list[str | Column], precedence: list[str] = PRECEDENCE) -> DataFrame:
    """Close of each (exchange, symbol) on its last day up to ``day``, in the first of its series: what bars say, without
    building them. ``order`` orders the trades of a day; each map task keeps one trade a symbol."""
    known = trades.filter(F.col("date") <= day).withColumn("_p", in_list_order("series", precedence)).filter(F.col("_p").isNotNull())
    by = [F.col("date").desc(), F.col("_p"), *[(F.col(c) if isinstance(c, str) else c).desc() for c in order]]
    return latest_per(known, ["exchange", "symbol"], by).select("exchange", "symbol", "date", F.col("price").alias("close"))


def panel(bars: DataFrame, precedence: list[str] = PRECEDENCE, floor: float = 0.0,
          start=None, end=None) -> DataFrame:
    """One row per (symbol, date). A symbol stays only if its best single day reached ``floor``
    rupees of turnover (a median never exceeds a maximum)."""
    scoped = between(bars, start, end).filter(F.col("series").isin(precedence))
    if floor > 0:
        w = Window.partitionBy("symbol")
        # Same key as every later per-symbol window: the exchange is reused, no semi join needed.
        scoped = scoped.withColumn("_peak", F.max("turnover").over(w)).filter(F.col("_peak") >= floor).drop("_peak")
    return one_series_per_day(scoped, precedence)


def panel_for_symbols(bars: DataFrame, symbols: list[str], precedence: list[str] = PRECEDENCE,
                      start=None, end=None) -> DataFrame:
    return panel(bars.filter(F.col("symbol").isin(symbols)), precedence, 0.0, start, end)


def liquidity_metrics(bars: DataFrame, exchange: str, as_of, n: int = 20, dedupe: bool = False) -> DataFrame:
    """Medians over each symbol's last ``n`` rows; ``listed_days`` counts the full history."""
    seen = between(bars.filter(F.col("exchange") == exchange), None, as_of)
    if dedupe:
        seen = one_series_per_day(seen)
    order = [F.col("date").desc(), in_list_order("series", PRECEDENCE)]
    recent = latest_per(seen, ["symbol"], order, n).groupBy("symbol").agg(
        median(F.col("turnover")).alias("median_turnover"), median(F.col("volume")).alias("median_volume"),
        median(F.col("trades")).alias("median_trades"), median(F.col("delivery_pct")).alias("median_delivery_pct"),
        F.avg("close").alias("avg_price"))
    listed = seen.groupBy("symbol").agg(F.countDistinct("date").alias("listed_days"))
    return recent.join(listed, "symbol")


def liquid_universe(liquidity: DataFrame, listings: DataFrame, securities: DataFrame) -> DataFrame:
    """Liquid rows on the security's primary exchange."""
    pairs = listings.select("exchange", "symbol", "security_id").distinct()
    sec = securities.select("security_id", "isin", "canonical_symbol", "primary_exchange")
    return (liquidity.filter("is_liquid").join(pairs, ["exchange", "symbol"]).join(sec, "security_id")
            .filter(F.col("exchange") == F.col("primary_exchange")))


def adv(bars: DataFrame, exchange: str, as_of, n: int = 20, precedence: list[str] = PRECEDENCE) -> DataFrame:
    """Median turnover over the last ``n`` sessions, one series a day."""
    days = one_series_per_day(between(bars.filter(F.col("exchange") == exchange), None, as_of), precedence)
    return (latest_per(days, ["symbol"], [F.col("date").desc()], n)
            .groupBy("symbol").agg(median(F.col("turnover")).alias("adv_turnover")))


def bars_on_day(bars: DataFrame, exchange: str, day, precedence: list[str] = PRECEDENCE) -> DataFrame:
    d = bars.filter((F.col("exchange") == exchange) & (F.col("date") == F.lit(day).cast("date")))
    return one_series_per_day(d, precedence, keys=("symbol",))


def last_closes(bars: DataFrame, day, precedence: list[str] = PRECEDENCE) -> DataFrame:
    """Newest close up to a day of every (exchange, symbol), the preferred series first."""
    key = F.struct("date", -in_list_order("series", precedence))
    return (between(bars, None, day).filter(F.col("series").isin(precedence)).groupBy("exchange", "symbol")
            .agg(F.max("date").alias("close_date"), F.max_by("close", key).alias("close")))


def last_close_on_or_before(bars: DataFrame, exchange: str, day, precedence: list[str] = PRECEDENCE) -> DataFrame:
    return last_closes(bars.filter(F.col("exchange") == exchange), day, precedence).drop("exchange")


def last_change(panel_df: DataFrame) -> DataFrame:
    """Latest two closes and the move between them, for every symbol."""
    two = latest_per(panel_df.select("symbol", "date", "close"), ["symbol"], [F.col("date").desc()], 2)
    agg = two.groupBy("symbol").agg(
        F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"),
        F.when(F.count("*") == 2, F.min_by("close", "date")).alias("previous_close"))
    return agg.withColumn("change_pct", (safe_div(F.col("last_close"), F.col("previous_close")) - 1) * 100)


def index_moves(index: DataFrame, days: DataFrame, codes: list[str], max_age: int = 10) -> DataFrame:
    """For every (code, day): the last close at or before the day (not older than ``max_age`` days),
    the row before it, the move, and whether the figure is from another day."""
    w = Window.partitionBy("index_code").orderBy("date")
    rows = index.select("index_code", "date", "close", F.lag("close").over(w).alias("prev_close"))
    grid = days.select("day", F.explode(F.array(*[F.lit(c) for c in codes])).alias("index_code"))
    hit = asof_join(grid, rows.withColumn("idx_date", F.col("date")), ["index_code"], "day", "idx_date",
                    ["close", "prev_close"])
    return hit.filter(F.datediff("day", "idx_date_asof") <= max_age).select(
        "index_code", "day", "close", F.col("idx_date_asof").alias("close_date"),
        ((safe_div(F.col("close"), F.col("prev_close")) - 1) * 100).alias("move_pct"),
        (F.col("idx_date_asof") != F.col("day")).alias("is_stale"))


def search_securities(securities: DataFrame, q: str, limit: int = 15) -> DataFrame:
    """Active securities by exact symbol, then symbol prefix, then name substring."""
    text = q.strip().upper()
    sym, name = F.upper("canonical_symbol"), F.upper("company_name")
    rank = F.when(sym == text, 0).when(sym.startswith(text), 1).when(name.contains(text), 2)
    return (securities.filter(F.col("status") == "ACTIVE").withColumn("match_rank", rank)
            .filter(F.col("match_rank").isNotNull()).orderBy("match_rank", "canonical_symbol").limit(limit))


def close_on_dates(panel_df: DataFrame, dates: DataFrame, keys: list[str], col: Column | None = None) -> DataFrame:
    """Last known close per key for every requested (key, date)."""
    src = panel_df.select(*keys, F.col("date").alias("mark_date"), (col if col is not None else F.col("close")).alias("mark"))
    return asof_join(dates, src, keys, "date", "mark_date", ["mark"])
