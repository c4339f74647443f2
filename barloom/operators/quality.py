"""Data-quality jobs over bars, indices, job runs and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import latest_per, safe_div, symbol_window

# Series whose OHLC order must hold.
STRICT_SERIES = ["EQ", "BE", "BZ", "SM", "ST"]


def duplicate_keys(bars: DataFrame, keys=("exchange", "symbol", "series", "date")) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ohlc_order(bars: DataFrame) -> DataFrame:
    """Bars whose high is below open, close or low; fatal in ordinary series, else an anomaly."""
    bad = F.col("high") < F.greatest("open", "close", "low")
    sev = F.when(F.col("series").isin(STRICT_SERIES), "fatal").otherwise("anomaly")
    return bars.filter(bad).withColumn("severity", sev)


def _flag_rows(df: DataFrame, checks: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per (row, failed check)."""
    failed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]),
                      lambda x: x.isNotNull())
    return df.select(*keep, F.explode(failed).alias("check"))


def non_positive(bars: DataFrame) -> DataFrame:
    return _flag_rows(bars, {"close": F.col("close") <= 0, "volume": F.col("volume") < 0,
                             "turnover": F.col("turnover") < 0}, ["exchange", "symbol", "series", "date"])


def delivery_exceeds_volume(bars: DataFrame) -> DataFrame:
    """Per day: how many rows report more delivered than traded, and whether that is tolerable
    (at most five rows and at most 0.5% of the batch)."""
    over = F.count(F.when(F.col("delivery_qty") > F.col("volume"), 1))
    n = F.count("*")
    return (bars.groupBy("exchange", "date").agg(n.alias("n_rows"), over.alias("n_over")).filter("n_over > 0")
            .withColumn("tolerated", F.col("n_over") <= F.least(F.lit(5), F.floor(F.col("n_rows") * 0.005))))


def turnover_implausible(bars: DataFrame, lo: float = 0.33, hi: float = 3.0, min_implied: float = 10000.0) -> DataFrame:
    implied = F.col("volume") * F.col("vwap")
    ratio = F.col("turnover") / implied
    return (bars.withColumn("implied", implied).filter(F.col("implied") >= min_implied).withColumn("ratio", ratio)
            .filter(~F.col("ratio").between(lo, hi)))


def wrong_date(rows: DataFrame) -> DataFrame:
    """Files whose content carries dates other than the requested one (the few distinct dates of one file)."""
    return (rows.filter(F.col("date") != F.col("requested")).groupBy("exchange", "requested")
            .agg(F.count("*").alias("n_rows"), F.array_join(F.sort_array(F.collect_set(F.col("date").cast("string"))), ",").alias("found")))


def index_problems(index: DataFrame, price_level: Column) -> DataFrame:
    """Index rows failing a check; missing open/high/low are ignored, not treated as zero."""
    dup = (index.groupBy("index_code", "date").agg(F.count("*").alias("n")).filter("n > 1")
           .select("index_code", "date", F.lit("duplicate").alias("check")))
    rest = _flag_rows(index, {
        "negative_close": F.col("close") < 0, "zero_close": (F.col("close") == 0) & price_level,
        "high_below_low": F.col("high") < F.col("low"),
        "high_below_price": F.col("high") < F.greatest("open", "close", "low"),
    }, ["index_code", "date"])
    return dup.unionByName(rest)


def missing_days(calendar: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Known trading days from the first bar on without any bar, per key (``exchange`` included)."""
    span = bars.groupBy(*keys).agg(F.min("date").alias("_lo"))
    days = calendar.filter("is_trading").join(span, "exchange").filter(F.col("date") >= F.col("_lo")).drop("_lo")
    return days.select(*keys, "date").join(bars.select(*keys, "date").distinct(), [*keys, "date"], "left_anti")


def stale_symbols(bars: DataFrame, calendar: DataFrame, universe: DataFrame, n: int) -> DataFrame:
    """Universe symbols whose last bar is before the n-th last trading day."""
    cutoff = (latest_per(calendar.filter("is_trading"), ["exchange"], [F.col("date").desc()], n)
              .groupBy("exchange").agg(F.min("date").alias("cutoff")))
    last = bars.groupBy("exchange", "symbol").agg(F.max("date").alias("last_date"))
    return (last.join(cutoff, "exchange").filter(F.col("last_date") < F.col("cutoff"))
            .join(universe.select("exchange", "symbol"), ["exchange", "symbol"], "left_semi"))


def session_numbers(bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, session): positions in the market's own calendar, ranked on distinct dates only."""
    w = Window.partitionBy(*keys).orderBy("date")
    return bars.select(*keys, "date").distinct().withColumn("session", F.row_number().over(w))


def adjusted_jumps(adj: DataFrame, lo: float = 0.6, hi: float = 1.6) -> DataFrame:
    """Close-to-close ratio outside the band between bars of consecutive market sessions."""
    one = adj.join(session_numbers(adj, ["exchange"]), ["exchange", "date"])
    w = symbol_window("exchange", "symbol", "series")
    pairs = one.withColumn("prev", F.lag("close").over(w)).withColumn("prev_session", F.lag("session").over(w))
    ratio = safe_div(F.col("close"), F.col("prev"))
    return (pairs.filter(F.col("session") == F.col("prev_session") + 1).withColumn("ratio", ratio)
            .filter((F.col("ratio") < lo) | (F.col("ratio") > hi))
            .select("exchange", "symbol", "series", "date", "prev", "close", "ratio"))


def classify_jumps(jumps: DataFrame, actions: DataFrame, owners: DataFrame, fund_symbols: DataFrame,
                   days: int = 5) -> DataFrame:
    """known_hole when an action of the same security within ``days`` has no factor, else unexplained.
    ``owners`` maps every symbol a security ever had to its id."""
    j = jumps.join(fund_symbols.select("symbol"), "symbol", "left_anti").join(owners, "symbol", "left")
    a = (actions.select("symbol", "ex_date", "price_factor").join(owners, "symbol")
         .select(F.col("security_id").alias("_sid"), "ex_date", "price_factor",
                 F.explode(F.sequence(F.date_sub("ex_date", days), F.date_add("ex_date", days))).alias("_d"))
         .groupBy("_sid", "_d").agg(
             F.min_by("price_factor", F.struct(F.col("price_factor").isNotNull().alias("h"),
                                               F.abs(F.datediff("ex_date", "_d")).alias("d"))).alias("_pf"),
             F.min(F.col("price_factor").isNotNull()).alias("_all_known")))
    kind = F.when(F.col("_all_known") == False, "known_hole").otherwise("unexplained")  # noqa: E712
    hit = j.join(a, (j.security_id == a["_sid"]) & (j.date == a["_d"]), "left")
    return hit.select(*jumps.columns, "security_id", kind.alias("kind"))


def benchmark_gaps(bars: DataFrame, index: DataFrame, code: str) -> DataFrame:
    """Bar dates from the benchmark's first day on for which it has no value."""
    bench = index.filter(F.col("index_code") == code).select("date")
    return (bars.select("date").distinct().filter(F.col("date") >= bench.agg(F.min("date")).scalar())
            .join(bench, "date", "left_anti"))


def adjusted_freshness(adj: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Whether the adjusted series reaches past the newest ex-date of its exchange up to ``as_of``; an ex-date
    announced for later can't make it stale yet."""
    a = adj.groupBy("exchange").agg(F.max("date").alias("last_bar"))
    x = actions.filter(F.col("ex_date") <= F.lit(as_of).cast("date")).groupBy("exchange").agg(F.max("ex_date").alias("last_ex_date"))
    return a.join(x, "exchange", "left").withColumn(
        "is_fresh", F.col("last_ex_date").isNull() | (F.col("last_bar") >= F.col("last_ex_date")))


def parse_status_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("parse_status").agg(F.countDistinct("action_id").alias("n"))


def job_health(runs: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Latest attempt per (job, day) that failed or was degraded, known non-trading days left out.
    The latest attempt is an aggregate, so a hot job combines before the shuffle."""
    last = runs.groupBy("job", "day").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"))
    bad = last.filter(F.col("status").isin("failed", "degraded"))
    if calendar is not None:
        closed = calendar.filter(~F.col("is_trading")).select(F.col("date").alias("day"))
        bad = bad.join(closed, "day", "left_anti")
    return bad.select("job", "day", "attempt", "status")


def job_alerts(runs: DataFrame, as_of: DataFrame, days: int = 3) -> DataFrame:
    """Failures of the last ``days`` days: scheduled ones always, a bare run only where no scheduled
    run of that job failed the same day. ``as_of`` is one row with column ``as_of``."""
    last = runs.groupBy("job", "day", "scheduled").agg(F.max_by("status", "attempt").alias("status"))
    recent = last.filter("status = 'failed'").filter(F.col("day") > F.date_sub(as_of.scalar(), days))
    planned = recent.filter("scheduled")
    bare = recent.filter(~F.col("scheduled")).join(planned.select("job", "day"), ["job", "day"], "left_anti")
    return planned.unionByName(bare.select(*planned.columns))


def failure_streaks(runs: DataFrame, k: int = 3) -> DataFrame:
    """Jobs whose last k runs that were not skipped all failed."""
    tail = latest_per(runs.filter("status <> 'skipped'"), ["job"], [F.col("attempt").desc()], k)
    return (tail.groupBy("job").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"))
            .filter((F.col("n") == k) & (F.col("n_failed") == k)))


def source_freshness(newest: DataFrame, as_of: DataFrame) -> DataFrame:
    """``newest``: (source, newest, limit_days); stale when older than the limit."""
    return newest.withColumn("age_days", F.datediff(as_of.scalar(), F.col("newest"))).withColumn(
        "is_stale", F.col("age_days") > F.col("limit_days"))


def inactive_counts(securities: DataFrame) -> DataFrame:
    return securities.filter("status <> 'ACTIVE'").groupBy("status").agg(F.count("*").alias("n"))


def replayable_failures(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Failed (job, day) whose stored file exists, so it can be replayed without fetching."""
    return job_health(runs).filter("status = 'failed'").join(
        artifacts.select(F.col("source").alias("job"), "day").distinct(), ["job", "day"], "left_semi")


def unclassified_exchanges(bars: DataFrame, classes: DataFrame) -> DataFrame:
    """Exchanges that have bars but not one classified symbol."""
    seen = bars.groupBy("exchange").agg(F.countDistinct("symbol").alias("n_symbols"))
    return seen.join(classes.filter("instrument_class IS NOT NULL").select("exchange").distinct(), "exchange", "left_anti")


def outage_counts(runs: DataFrame, as_of: DataFrame, hours: int = 48) -> DataFrame:
    """Failed feed runs per job in the last ``hours`` before ``as_of``."""
    recent = runs.filter("status = 'failed'").filter(
        F.col("finished_at") >= as_of.scalar() - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.groupBy("job").agg(F.count("*").alias("n_failed"))
