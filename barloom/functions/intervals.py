"""States that hold from a day until the next change, and the days that fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(states: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Run-length table of a state table with one row per key and date: adds ``until``, the date of the key's next row
    (null: still holds). Keys are bounded by the calendar."""
    return states.withColumn("until", F.lead(date).over(Window.partitionBy(*keys).orderBy(date)))


def on_days(states: DataFrame, days: DataFrame, day: str = "day", *, date: str = "date", on: list[str] | None = None, after: bool = False) -> DataFrame:
    """Rows of ``intervals`` joined to the days on which they hold: from ``date`` (``after``: the day after it) up to the day
    before ``until`` (``after``: up to ``until``).

    An interval is dealt to the months it touches, up to the last wanted day, and meets the days of those months by
    equality, so the rows on the way are the months and days held, not every pair. ``on`` names further columns that both
    sides must share; without it the days are one row per calendar day and go to every task."""
    shift = 1 if after else 0
    first = F.date_add(date, shift)
    last = F.least(F.date_add("until", shift - 1), days.agg(F.max(day)).scalar())
    held = states.withColumn("_last", last).filter(first <= F.col("_last"))
    held = held.withColumn("_month", F.explode(F.sequence(F.trunc(first, "month"), F.trunc("_last", "month"), F.expr("INTERVAL 1 MONTH"))))
    months = days.withColumn("_month", F.trunc(day, "month"))
    out = held.join(months if on else F.broadcast(months), [*(on or []), "_month"])
    return out.filter((F.col(day) >= first) & (F.col(day) <= F.col("_last"))).drop("_last", "_month")
