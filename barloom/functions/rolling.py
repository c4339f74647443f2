"""Long rolling sums and extremes from short tiles.

A sliding frame of n rows costs n updates per row in Spark. Here only 10-row frames slide; a longer
window is the sum (or extreme) of lagged tiles, so 252 rows cost about as much as 10.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

TILE = 10
AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(agg: str, parts: list[Column]) -> Column:
    if agg == "sum":
        return reduce(lambda a, b: a + b, parts)
    if len(parts) == 1:
        return parts[0]
    return F.greatest(*parts) if agg == "max" else F.least(*parts)


def _lag(c: str, k: int, w: WindowSpec) -> Column:
    return F.lag(c, k).over(w) if k else F.col(c)


def rolling(df: DataFrame, w: WindowSpec, specs: dict[str, tuple], nullable: tuple[str, ...] = ()) -> DataFrame:
    """Add columns per spec ``name: (kind, col, n, prior[, min_rows])`` with kind avg, max or min.

    ``prior`` windows end yesterday. A value needs ``min_rows`` (default n) non-null rows; columns not
    named in ``nullable`` count every row. Sums tile exactly (n a multiple of 10); extremes may overlap.
    """
    need_sum = {s[1] for s in specs.values() if s[0] == "avg"}
    need = [("sum", c) for c in sorted(need_sum)] + sorted({(s[0], s[1]) for s in specs.values() if s[0] != "avg"})
    frame = w.rowsBetween(-(TILE - 1), 0)
    zero = [c for c in need_sum]
    one = df.select("*", F.row_number().over(w).alias("_rn"), *[AGG[a](c).over(frame).alias(f"_{a}10_{c}") for a, c in need],
                    *[F.count(c).over(frame).alias(f"_cnt10_{c}") for c in zero if c in nullable])
    wide = {c: max(s[2] for s in specs.values() if s[0] == "avg" and s[1] == c) for c in need_sum}
    two = one.select("*",
                     *[_combine(a, [_lag(f"_{a}10_{c}", k, w) for k in (0, TILE)]).alias(f"_{a}20_{c}") for a, c in need if a != "sum"],
                     *[_combine("sum", [_lag(f"_sum10_{c}", k, w) for k in range(0, 50, TILE)]).alias(f"_sum50_{c}") for c in need_sum if wide[c] > 50])

    def column(kind, c, n, prior, min_rows=None):
        d = 1 if prior else 0
        enough = min_rows or n
        if kind != "avg":
            size = 20 if n >= 20 else TILE
            at = sorted({*range(0, n - size + 1, size), n - size})
            value = _combine(kind, [_lag(f"_{kind}{size}_{c}", k + d, w) for k in at])
            return F.when(F.col("_rn") >= n + d, value)
        if min_rows is None and n > 50:
            total = _combine("sum", [_lag(f"_sum50_{c}", k + d, w) for k in range(0, n, 50)])
        else:
            total = _combine("sum", [F.coalesce(_lag(f"_sum10_{c}", k + d, w), F.lit(0)) for k in range(0, n, TILE)])
        rows = F.least(F.col("_rn") - d, F.lit(n))
        if c in nullable:
            rows = _combine("sum", [F.coalesce(_lag(f"_cnt10_{c}", k + d, w), F.lit(0)) for k in range(0, n, TILE)])
        return F.when(rows >= enough, total / F.when(rows > 0, rows))
    return two.select(*df.columns, *[column(*s).alias(name) for name, s in specs.items()])
