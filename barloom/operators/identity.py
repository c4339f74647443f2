"""Securities, renames, trading calendars, lifecycle and the liquid universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.joins import asof_join
from barloom.functions.lineage import cut
from barloom.functions.windows import in_list_order, latest_per, median

EPOCH = "1900-01-01"
# Universe thresholds.
THRESHOLDS = {"min_median_turnover": 20_000_000.0, "min_median_trades": 500, "min_price": 10.0, "min_listed_days": 120}
EXCLUDED_SERIES = ["SM", "ST", "MF", "GB", "IV"]
EXCLUDED_GROUPS = ["Z", "ZP", "ZY"]
FLAG_ONLY_SERIES = ["BE", "BZ"]
FLAG_ONLY_GROUPS = ["T", "TS", "XT", "MT"]


def merge_master(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(securities, listings): one security per ISIN described by its NSE record when there is one,
    and every distinct (exchange, symbol, series). Records without an ISIN are left out."""
    known = records.filter(F.col("isin").isNotNull())
    key = F.struct((F.col("exchange") != "NSE").alias("o"), "symbol", "series")
    best = known.groupBy("isin").agg(F.min_by(F.struct("exchange", "symbol", "company_name", "face_value"), key).alias("b"),
                                     F.count("*").alias("n_records"))
    securities = best.select("isin", F.col("b.symbol").alias("canonical_symbol"), F.col("b.company_name").alias("company_name"),
                             F.col("b.face_value").alias("face_value"), F.col("b.exchange").alias("primary_exchange"), "n_records")
    listings = known.select("exchange", "symbol", "series", "isin").distinct()
    return securities, listings


def detect_renames(previous: DataFrame, current: DataFrame, day) -> DataFrame:
    """Validity rows opened and closed on ``day``: a security that shows another symbol on the same
    exchange ends its old symbol and starts the new one."""
    d = F.lit(day).cast("date")
    p = previous.select("security_id", "exchange", F.col("symbol").alias("old_symbol")).distinct()
    c = current.select("security_id", "exchange", F.col("symbol").alias("new_symbol")).distinct()
    gone = p.join(c.withColumnRenamed("new_symbol", "old_symbol"), ["security_id", "exchange", "old_symbol"], "left_anti")
    moved = gone.join(c, ["security_id", "exchange"])
    closed = moved.select("security_id", "exchange", F.col("old_symbol").alias("symbol"), F.lit(EPOCH).cast("date").alias("valid_from"), d.alias("valid_to"))
    opened = moved.select("security_id", "exchange", F.col("new_symbol").alias("symbol"), d.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return closed.unionByName(opened).distinct()


def rename_targets(changes: DataFrame) -> DataFrame:
    """Each change with the last symbol of its chain, however long. Pointers double each round, so a chain
    without repeats ends after as many rounds as the number of changes has binary digits; what then still
    points on goes round in a circle and comes out with ``complete`` = False."""
    c = changes.select("old_symbol", "new_symbol", "changed_on")
    nxt = c.select(F.col("old_symbol").alias("_o"), F.col("new_symbol").alias("_n"), F.col("changed_on").alias("_d"))
    hop = (c.join(nxt, (c.new_symbol == nxt["_o"]) & (nxt["_d"] >= c.changed_on), "left")
           .groupBy("old_symbol", "new_symbol", "changed_on").agg(F.min_by(F.struct("_o", "_n", "_d"), "_d").alias("_next")))
    cur = hop.select("old_symbol", "new_symbol", "changed_on", F.col("new_symbol").alias("final_symbol"),
                     F.col("_next._n").alias("_pn"), F.col("_next._d").alias("_pd"), F.col("_next._o").alias("_po"))
    for _ in range(changes.count().bit_length()):
        cur = cut(cur)
        if cur.filter("_po IS NOT NULL").isEmpty():
            break
        ahead = cur.select(F.col("old_symbol").alias("_ao"), F.col("new_symbol").alias("_an"), F.col("changed_on").alias("_ad"),
                           F.col("final_symbol").alias("_af"), F.col("_po").alias("_qo"), F.col("_pn").alias("_qn"), F.col("_pd").alias("_qd"))
        j = cur.join(ahead, (cur["_po"] == ahead["_ao"]) & (cur["_pn"] == ahead["_an"]) & (cur["_pd"] == ahead["_ad"]), "left")
        cur = j.select("old_symbol", "new_symbol", "changed_on", F.coalesce("_af", "final_symbol").alias("final_symbol"),
                       F.col("_qn").alias("_pn"), F.col("_qd").alias("_pd"), F.col("_qo").alias("_po"))
    return cur.select("old_symbol", "new_symbol", "changed_on", "final_symbol", F.col("_po").isNull().alias("complete"))


def symbol_history_from_changes(changes: DataFrame, listings: DataFrame, exchange: str) -> DataFrame:
    """Validity of every former symbol, with status resolved / conflict (the old symbol is listed
    again by someone) / unresolved (the chain does not end in a listed symbol)."""
    listed = listings.filter(F.col("exchange") == exchange).groupBy("symbol").agg(F.min("security_id").alias("security_id"))
    t = rename_targets(changes)
    into = changes.select(F.col("new_symbol").alias("old_symbol"), F.col("changed_on").alias("_from"))
    prior = (t.join(into, "old_symbol", "left").filter(F.col("_from").isNull() | (F.col("_from") <= F.col("changed_on")))
             .groupBy("old_symbol", "new_symbol", "changed_on").agg(F.max("_from").alias("_from")))
    out = (t.join(prior, ["old_symbol", "new_symbol", "changed_on"], "left")
           .join(listed.select(F.col("symbol").alias("final_symbol"), "security_id"), "final_symbol", "left")
           .join(listed.select(F.col("symbol").alias("old_symbol"), F.lit(True).alias("_reused")), "old_symbol", "left"))
    status = F.when(F.col("_reused"), "conflict").when(F.col("security_id").isNull() | ~F.col("complete"), "unresolved").otherwise("resolved")
    return out.select(F.col("old_symbol").alias("symbol"), "final_symbol", "security_id",
                      F.coalesce("_from", F.lit(EPOCH).cast("date")).alias("valid_from"), F.col("changed_on").alias("valid_to"), status.alias("status"))


def isin_class(isin: Column) -> Column:
    return F.when(isin.startswith("INF"), "fund").when(isin.startswith("INE"), "equity").when(isin.isNotNull(), "other")


def classify_isin(df: DataFrame) -> DataFrame:
    return df.withColumn("instrument_class", isin_class(F.col("isin")))


def fund_symbols(securities: DataFrame) -> DataFrame:
    return (securities.filter(isin_class(F.col("isin")) == "fund").select(F.col("canonical_symbol").alias("symbol")))


def inherit_class(changes: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes for former symbols, taken from the last symbol of their chain; a symbol that already
    has a class keeps it."""
    known = classes.filter("instrument_class IS NOT NULL").select("symbol", "instrument_class")
    got = (rename_targets(changes).filter("complete").select(F.col("old_symbol").alias("symbol"), F.col("final_symbol").alias("_t"), "changed_on")
           .join(known.select(F.col("symbol").alias("_t"), "instrument_class"), "_t"))
    newest = got.groupBy("symbol").agg(F.max_by("instrument_class", "changed_on").alias("instrument_class"))
    return newest.join(known.select("symbol"), "symbol", "left_anti")


def exclude_funds(panel: DataFrame, classes: DataFrame) -> DataFrame:
    return panel.join(classes.filter("instrument_class = 'fund'").select("symbol"), "symbol", "left_anti")


def lifecycle(listings: DataFrame, snapshot: DataFrame, day, suspend_after: int = 1, delist_after: int = 20,
              max_absent: float = 0.10) -> DataFrame:
    """Missed-snapshot count and status per security. A listing absent from the snapshot counts one
    more miss a day at most, a seen one starts over; an exchange with too many absent is left alone
    (a truncated snapshot). The status follows the listing missed least."""
    seen = snapshot.select("exchange", "symbol").distinct().withColumn("_seen", F.lit(True))
    j = listings.join(seen, ["exchange", "symbol"], "left")
    ratio = j.groupBy("exchange").agg((F.count(F.when(F.col("_seen").isNull(), 1)) / F.count("*")).alias("_r"))
    d = F.lit(day).cast("date")
    miss = (F.when(F.col("_r") > max_absent, F.col("missed")).when(F.col("_seen"), 0)
            .when(F.col("last_missed_on") == d, F.col("missed")).otherwise(F.col("missed") + 1))
    counted = j.join(ratio, "exchange").withColumn("missed", miss)
    least = counted.groupBy("security_id").agg(F.min("missed").alias("missed"), F.count("*").alias("n_listings"))
    return least.withColumn("status", F.when(F.col("missed") >= delist_after, "DELISTED")
                            .when(F.col("missed") >= suspend_after, "SUSPENDED").otherwise("ACTIVE"))


def enrich_identity(bars: DataFrame, dims: DataFrame) -> DataFrame:
    """Fill missing security_id / isin from (exchange, symbol) dimension rows; present values stay."""
    d = dims.select("exchange", "symbol", F.col("security_id").alias("_sid"), F.col("isin").alias("_isin")).dropDuplicates(["exchange", "symbol"])
    return (bars.join(d, ["exchange", "symbol"], "left").withColumn("security_id", F.coalesce("security_id", "_sid"))
            .withColumn("isin", F.coalesce("isin", "_isin")).drop("_sid", "_isin"))


def day_span(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Every calendar day between the first and last value of ``col`` (per keys)."""
    return (df.groupBy(*(keys or [])).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
            .select(*(keys or []), F.explode(F.sequence("_lo", "_hi")).alias("date")))


def weekday_calendar(df: DataFrame, col: str, holidays: list[str]) -> DataFrame:
    closed = (F.weekday("date") >= 5) | F.col("date").isin([F.lit(h).cast("date") for h in holidays])
    return day_span(df, col).withColumn("is_trading", ~closed)


def trading_days(spans: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays of each (exchange, start, end) without the holidays (exchange, date)."""
    days = spans.select("exchange", F.explode(F.sequence("start", "end")).alias("date")).filter(F.weekday("date") < 5)
    return days.join(holidays.select("exchange", "date"), ["exchange", "date"], "left_anti")


def calendar_from_bars(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Weekdays between the first and last bar, flagged by whether anything traded."""
    days = day_span(bars, "date", keys).filter(F.weekday("date") < 5)
    seen = bars.select(*keys, "date").distinct().withColumn("is_trading", F.lit(True))
    return days.join(seen, [*keys, "date"], "left").withColumn("is_trading", F.coalesce("is_trading", F.lit(False)))


def merge_calendar(sources: DataFrame, ranking: list[str]) -> DataFrame:
    """One answer per (exchange, date): the best ranked source wins."""
    key = in_list_order("source", ranking)
    return (sources.groupBy("exchange", "date")
            .agg(F.min_by("is_trading", key).alias("is_trading"), F.min_by("source", key).alias("source")))


def is_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Tri-state: TRUE / FALSE, NULL where the calendar says nothing."""
    return days.join(calendar.select("exchange", "date", "is_trading"), ["exchange", "date"], "left")


def previous_trading_day(days: DataFrame, calendar: DataFrame, bound: int = 14) -> DataFrame:
    """Last known trading day strictly before each date, NULL when none lies within ``bound`` days."""
    opens = calendar.filter("is_trading").select("exchange", F.col("date").alias("open_day"))
    hit = asof_join(days.select("exchange", "date"), opens, ["exchange"], "date", "open_day", [], strict=True)
    return hit.select("exchange", "date", F.when(F.datediff("date", "open_day_asof") <= bound, F.col("open_day_asof")).alias("previous_day"))


def trading_days_between(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days in each closed span (span_id, exchange, start, end), NULL unless every calendar
    day of it is known. Counts come from running totals at both ends, so a span is two look-ups."""
    w = Window.partitionBy("exchange").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = calendar.select("exchange", "date", F.sum(F.col("is_trading").cast("int")).over(w).alias("_open"),
                          F.count("*").over(w).alias("_known"), F.col("is_trading").cast("int").alias("_self"))
    a = run.select("exchange", F.col("date").alias("start"), (F.col("_open") - F.col("_self")).alias("_o0"), (F.col("_known") - 1).alias("_k0"))
    b = run.select("exchange", F.col("date").alias("end"), F.col("_open").alias("_o1"), F.col("_known").alias("_k1"))
    j = spans.join(a, ["exchange", "start"], "left").join(b, ["exchange", "end"], "left")
    full = (F.col("_k1") - F.col("_k0")) == F.datediff("end", "start") + 1
    return j.select(*spans.columns, F.when(full, F.col("_o1") - F.col("_o0")).alias("n_days"))


def is_liquid(metrics: DataFrame, t: dict | None = None) -> DataFrame:
    """Adds is_liquid and the first failing rule; a missing trade count skips that rule."""
    t = {**THRESHOLDS, **(t or {})}
    reason = (F.when(F.col("listed_days") < t["min_listed_days"], "listed_days")
              .when(F.coalesce(F.col("median_turnover") < t["min_median_turnover"], F.lit(True)), "median_turnover")
              .when(F.col("median_trades") < t["min_median_trades"], "median_trades")
              .when(F.coalesce(F.col("avg_price") < t["min_price"], F.lit(True)), "price").otherwise(""))
    return metrics.withColumn("reason", reason).withColumn("is_liquid", F.col("reason") == "")


def liquidity_daily(bars: DataFrame, n: int = 20, t: dict | None = None) -> DataFrame:
    """Liquidity row for every (exchange, symbol, date) in one pass: medians over the last ``n`` rows."""
    w = Window.partitionBy("exchange", "symbol").orderBy("date", "_p")
    fr = w.rowsBetween(-(n - 1), 0)
    wd = Window.partitionBy("exchange", "symbol").orderBy("date")
    rows = bars.withColumn("_p", -in_list_order("series", ["EQ", "BE", "BZ"]))
    out = rows.select(
        "exchange", "symbol", "date", "_p", median(F.col("turnover")).over(fr).alias("median_turnover"),
        median(F.col("volume")).over(fr).alias("median_volume"), median(F.col("trades")).over(fr).alias("median_trades"),
        F.avg("close").over(fr).alias("avg_price"), F.dense_rank().over(wd).alias("listed_days"),
        (F.coalesce(F.lead("date").over(w), F.lit("9999-12-31").cast("date")) > F.col("date")).alias("_last"))
    return is_liquid(out.filter("_last").drop("_last", "_p"), t)


def intraday_tradeable(listings: DataFrame) -> DataFrame:
    """Whether a listing may be traded at all and within the day."""
    nse = F.col("exchange") == "NSE"
    out = F.when(nse, F.col("series").isin(EXCLUDED_SERIES)).otherwise(F.col("series").isin(EXCLUDED_GROUPS))
    flag = F.when(nse, F.col("series").isin(FLAG_ONLY_SERIES)).otherwise(F.col("series").isin(FLAG_ONLY_GROUPS))
    return listings.withColumn("is_excluded", out).withColumn("is_tradeable_intraday", ~out & ~flag)


def universe_current(liquidity: DataFrame, listings: DataFrame) -> DataFrame:
    """Latest liquidity row per security; symbols without a security are skipped."""
    owner = listings.groupBy("exchange", "symbol").agg(F.min("security_id").alias("security_id"))
    rows = liquidity.join(owner, ["exchange", "symbol"]).filter(F.col("security_id").isNotNull())
    return latest_per(rows, ["security_id"], [F.col("date").desc(), F.col("exchange").desc(), F.col("symbol")])
