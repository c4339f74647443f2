"""Dated charges, depository charge, slippage, participation cap and circuit locks, as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dated schedules as (first day, rate); the first entry also covers all earlier days.
GST = "0.18"
STT = {("delivery", "buy"): "0.001", ("delivery", "sell"): "0.001", ("intraday", "buy"): "0", ("intraday", "sell"): "0.00025"}
STAMP = {("delivery", "buy"): "0.00015", ("intraday", "buy"): "0.00003"}
EXCHANGE = {"NSE": [("2024-10-01", "0.0000297"), ("2026-03-01", "0.000030699")], "BSE": [("2024-10-01", "0.0000375")]}
IPFT = {"NSE": [("2010-01-01", "0.000001"), ("2026-03-01", "0.000000001")], "BSE": [("2010-01-01", "0")]}
SEBI = "0.000001"
INTRADAY_PCT, INTRADAY_FLAT = "0.0003", "20"
DP_CHARGE = "13"
TIERS = [(500_000_000.0, 5), (100_000_000.0, 10), (20_000_000.0, 20), (0.0, 40)]
PARTICIPATION = 0.05
BANDS = [2.0, 5.0, 10.0, 20.0]
BAND_TOLERANCE = 0.35
NOMINAL = 100_000


def _d(text: str) -> Column:
    return F.lit(Decimal(text)).cast("decimal(12,10)")


def _paise(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def dated_rate(schedule: list[tuple[str, str]], date: Column) -> Column:
    """Rate in force on a day. The schedules are a handful of constants, so this is an expression on
    the row, not a join."""
    out = _d(schedule[0][1])
    for day, rate in schedule[1:]:
        out = F.when(date >= F.lit(day).cast("date"), _d(rate)).otherwise(out)
    return out


def _by_exchange(table: dict, exchange: Column, date: Column) -> Column:
    out = _d("0")
    for name, sched in table.items():
        out = F.when(exchange == name, dated_rate(sched, date)).otherwise(out)
    return out


def _by_leg(table: dict, product: Column, side: Column) -> Column:
    out = _d("0")
    for (p, s), rate in table.items():
        out = F.when((product == p) & (side == s), _d(rate)).otherwise(out)
    return out


def rates_asof(trades: DataFrame) -> DataFrame:
    return (trades.withColumn("exchange_rate", _by_exchange(EXCHANGE, F.col("exchange"), F.col("date")))
            .withColumn("ipft_rate", _by_exchange(IPFT, F.col("exchange"), F.col("date")))
            .withColumn("stt_rate", _by_leg(STT, F.col("product"), F.col("side"))).withColumn("stamp_rate", _by_leg(STAMP, F.col("product"), F.col("side"))))


def charge_columns(turnover: Column, exchange: Column, date: Column, product: Column, side: Column) -> dict[str, Column]:
    """Every charge rounded to paise; GST on the rounded taxable ones only."""
    t = turnover.cast("decimal(18,2)")
    out = {
        "brokerage": _paise(F.when(product == "intraday", F.least(t * _d(INTRADAY_PCT), F.lit(Decimal(INTRADAY_FLAT)).cast("decimal(18,2)"))).otherwise(_d("0"))),
        "stt": _paise(t * _by_leg(STT, product, side)), "stamp_duty": _paise(t * _by_leg(STAMP, product, side)),
        "exchange_txn": _paise(t * _by_exchange(EXCHANGE, exchange, date)), "ipft": _paise(t * _by_exchange(IPFT, exchange, date)),
        "sebi_fee": _paise(t * _d(SEBI)),
    }
    taxable = out["brokerage"] + out["exchange_txn"] + out["sebi_fee"] + out["ipft"]
    out["gst"] = _paise(taxable * _d(GST))
    out["total"] = (out["brokerage"] + out["stt"] + out["stamp_duty"] + out["exchange_txn"] + out["ipft"] + out["sebi_fee"] + out["gst"]).cast("decimal(18,2)")
    return out


def charges(trades: DataFrame) -> DataFrame:
    """Itemised charges per trade; ``turnover`` is quantity times price in rupees."""
    turnover = F.round(F.col("qty") * F.col("price"), 2).cast("decimal(18,2)")
    cols = charge_columns(turnover, F.col("exchange"), F.col("date"), F.col("product"), F.col("side"))
    return trades.withColumn("turnover", turnover).select("*", *[c.alias(n) for n, c in cols.items()])


def dp_charge() -> Column:
    return _paise(F.lit(Decimal(DP_CHARGE)).cast("decimal(12,2)") * (F.lit(Decimal(1)) + _d(GST)))


def dp_charges(trades: DataFrame) -> DataFrame:
    """One depository charge per (portfolio, symbol, day) with a delivery sale."""
    return (trades.filter("side = 'sell' AND product = 'delivery'").groupBy("portfolio", "symbol", "date")
            .agg(F.count("*").alias("n_sells")).withColumn("dp_charge", dp_charge()))


def slippage_bps(adv: Column, tiers=TIERS) -> Column:
    """Basis points by median turnover; an unknown turnover gets the worst tier."""
    out = F.lit(max(b for _, b in tiers))
    for floor, bps in sorted(tiers):
        out = F.when(adv >= floor, bps).otherwise(out)
    return out


def slipped(price: Column, side: Column, bps: Column) -> Column:
    return price * (1 + F.when(side == "buy", bps).otherwise(-bps) / 10000.0)


def cap_qty(want: Column, volume: Column, cap: float = PARTICIPATION) -> Column:
    return F.least(want, F.floor(volume * cap))


def circuit_lock(o: Column, h: Column, lo: Column, c: Column, prev: Column, bands=BANDS, tol: float = BAND_TOLERANCE) -> Column:
    """upper / lower when the bar is frozen about one band away from the previous close, else none."""
    move = (c / F.when(prev > 0, prev) - 1) * 100
    frozen = (o == h) & (h == lo) & (lo == c)
    near = F.exists(F.array(*[F.lit(b) for b in bands]), lambda b: F.abs(F.abs(move) - b) <= tol)
    return F.when(frozen & near, F.when(move > 0, "upper").otherwise("lower")).otherwise("none")


def round_trip_cost_pct(exchange: Column, date: Column, nominal: int = NOMINAL) -> Column:
    """Buy plus sell plus depository charge on a nominal delivery position, as a fraction of it."""
    legs = [charge_columns(F.lit(Decimal(nominal)), exchange, date, F.lit("delivery"), F.lit(s))["total"] for s in ("buy", "sell")]
    return ((legs[0] + legs[1] + dp_charge()).cast("double") / float(nominal))
