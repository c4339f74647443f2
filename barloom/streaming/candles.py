"""Intraday candles, feed health and order matching, as batch functions that streams reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import order_key


def candles(ticks: DataFrame, width: str = "5 minutes", *, tiebreak: str | None = None,
            watermark: str | None = None) -> DataFrame:
    """OHLCV per symbol and tumbling window; with ``watermark`` the same plan runs on a stream."""
    src = ticks.withWatermark("ts", watermark) if watermark else ticks
    key = order_key([(F.unix_micros(F.col("ts").cast("timestamp")), 19), (F.col(tiebreak), 18)]) if tiebreak else F.col("ts")
    out = src.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.sum("qty").cast("long").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("candle_start"), F.col("w.end").alias("candle_end"),
                      "open", "high", "low", "close", "volume")


def feed_health(candle_df: DataFrame, now, stale_after_s: int = 1500) -> DataFrame:
    """Newest candle end per symbol, its lag at ``now`` and ok / stale."""
    at = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    out = candle_df.groupBy("symbol").agg(F.max("candle_end").alias("newest_end"))
    lag = F.unix_timestamp(at) - F.unix_timestamp("newest_end")
    return out.withColumn("lag_s", lag).withColumn("status", F.when(F.col("lag_s") > stale_after_s, "stale").otherwise("ok"))


def park_stale_orders(orders: DataFrame, health: DataFrame) -> DataFrame:
    """Working orders after a poll: open ones of a stale (or silent) feed wait for the end of day, waiting
    ones of a live feed are open again."""
    j = orders.join(health.select("symbol", F.col("status").alias("_feed")), "symbol", "left")
    live = F.coalesce(F.col("_feed") == "ok", F.lit(False))
    status = (F.when((F.col("status") == "open") & ~live, "pending_eod").when((F.col("status") == "pending_eod") & live, "open").otherwise(F.col("status")))
    return j.withColumn("status", status).select(*orders.columns)


def eod_fallback(orders: DataFrame, bars: DataFrame, day, open_time: str = "09:15:00", close_time: str = "15:30:00") -> DataFrame:
    """Fills against the day's real bar as one candle. Run after orders were rescaled for the day's
    corporate actions."""
    from barloom.operators.outcomes import oco_first, touch_fills
    d = F.lit(day).cast("date")
    one = bars.filter(F.col("date") == d).select("symbol", F.lit(f"{day} {open_time}").cast("timestamp").alias("candle_start"),
                                                 F.lit(f"{day} {close_time}").cast("timestamp").alias("candle_end"), "open", "high", "low", "close")
    return oco_first(touch_fills(orders.filter(F.col("created_at") < F.lit(f"{day} {close_time}").cast("timestamp")), one, on_day=day))


def symbols_to_watch(orders: DataFrame, positions: DataFrame) -> DataFrame:
    active = orders.filter(F.col("status").isin("open", "pending_eod")).select("symbol")
    return active.union(positions.filter("qty > 0").select("symbol")).distinct()
