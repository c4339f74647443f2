"""Window helpers for per-symbol time series.

Groups are (symbol) or (exchange, symbol, series) with at most one row per session, so a window
partition is bounded by the trading calendar (about 250 rows a year), whatever the data volume.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding


def symbol_window(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(agg, col: Column | str, n: int, w: WindowSpec, *, prior: bool = False,
             min_rows: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows (including today, or ending yesterday when ``prior``).

    NULL until the frame holds ``min_rows`` (default ``n``) non-null values.
    """
    c = F.col(col) if isinstance(col, str) else col
    frame = w.rowsBetween(-n, -1) if prior else w.rowsBetween(-(n - 1), 0)
    need = n if min_rows is None else min_rows
    return F.when(F.count(c).over(frame) >= need, agg(c).over(frame))


def median(c: Column) -> Column:
    """Exact interpolated median; unlike ``F.median`` it also accepts a ROWS frame."""
    return F.percentile(c, F.lit(0.5))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or missing (never an error under ANSI mode)."""
    return a / F.when(b != 0, b)


def latest_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key. ``row_number() <= k`` lets Spark prune each map task to ``k`` rows
    per key before the shuffle (window group limit), so a hot key never reaches one task whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def in_list_order(col: Column | str, values: list[str]) -> Column:
    """1-based position of a value in a fixed list, NULL when absent."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(values, 1))):
        expr = F.when(c == v, F.lit(i)).otherwise(expr)
    return expr


def iso_weekday(c: Column) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(c)


def add_weekdays(c: Column, n: Column | int) -> Column:
    """The n-th weekday counted from ``c`` with a weekend start rolled forward to Monday first
    (position 0 is the first weekday on or after ``c``)."""
    n = F.lit(n) if isinstance(n, int) else n
    roll = F.when(F.weekday(c) == 5, 2).when(F.weekday(c) == 6, 1).otherwise(0)
    start = F.date_add(c, roll)
    total = F.weekday(start) + n
    days = F.floor(total / 5) * 7 + F.pmod(total, F.lit(5)) - F.weekday(start)
    return F.date_add(start, days.cast("int"))


def order_key(parts: list[tuple[Column, int]]) -> Column:
    """Several non-negative whole numbers as one decimal that sorts like the tuple; each comes with the
    digits it may take (38 in all; a longer value raises under ANSI mode instead of sorting wrongly).
    Unlike a struct, a decimal keeps ``min_by`` / ``max_by`` in hash aggregation."""
    if sum(d for _, d in parts) > 38:
        raise ValueError("order key exceeds 38 digits")
    groups: list[tuple[Column, int]] = []  # parts of up to 18 digits together fit a long, whose arithmetic is far cheaper
    for c, digits in parts:
        whole = F.when(c >= 10**digits, F.raise_error(F.lit(f"order key: a value exceeds {digits} digits")).cast("long")).otherwise(c.cast("long")) if digits <= 18 else None
        if whole is None:
            groups.append((c.cast(f"decimal({digits},0)"), digits))
        elif groups and groups[-1][1] + digits <= 18:
            groups[-1] = (groups[-1][0] * 10**digits + whole, groups[-1][1] + digits)
        else:
            groups.append((whole, digits))
    shift, out = 0, None
    for c, digits in reversed(groups):
        term = c.cast(f"decimal({digits},0)")
        if shift:
            term = term * F.lit(Decimal(10) ** shift).cast(f"decimal({shift + 1},0)")
        out = term if out is None else out + term
        shift += digits
    return out.cast("decimal(38,0)")
