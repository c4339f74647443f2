"""Recursive exponential means with window functions only.

``e[t] = a * x[t] + (1 - a) * e[t-1]`` with ``e[first] = x[first]`` is a sum of earlier rows whose weights fall by
q = 1 - a a row. A sum over the last n rows, shifted by n, 2n and 3n rows and weighted by powers of ``q**n``, makes the
sum over 4n rows; this goes on until the rows left out weigh less than SMALL. All passes are lags over one sort on the
symbol, the same as of every other feature; no arrays, no Python worker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight below which a row is lost in a double anyway (half a unit of its last place is 1.1e-16).
SMALL = 1e-17


def ewm(df: DataFrame, specs: dict[str, tuple[Column, float, int, int]], key: str = "symbol", order: str = "date") -> DataFrame:
    """Add one column per spec ``name: (value, alpha, min_rows, skip)``; NULL before ``min_rows`` rows.
    ``skip`` leading rows of a key do not take part (a change needs a previous row)."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.select("*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"_x_{n}") for n, (v, _, _, _) in specs.items()],
                    (F.row_number().over(w) - 1).alias("_n"))

    def own(n, a, skip):
        return F.when(F.col("_n") == skip, F.col(f"_x_{n}")).when(F.col("_n") > skip, F.col(f"_x_{n}") * a).otherwise(0.0)
    out = out.select(*df.columns, "_n", *[own(n, a, skip).alias(f"_x_{n}") for n, (_, a, _, skip) in specs.items()])
    reach = 1
    while any((1.0 - a) ** reach > SMALL for _, a, _, _ in specs.values()):
        def longer(n, a, reach=reach):
            c, q = F.col(f"_x_{n}"), (1.0 - a) ** reach
            return c if q <= SMALL else reduce(lambda s, k: s + F.lag(c, k * reach, 0.0).over(w) * q ** k, (1, 2, 3), c)
        out = out.select(*df.columns, "_n", *[longer(n, a).alias(f"_x_{n}") for n, (_, a, _, _) in specs.items()])
        reach *= 4
    return out.select(*df.columns, *[F.when(F.col("_n") - skip + 1 >= rows, F.col(f"_x_{n}")).alias(n) for n, (_, _, rows, skip) in specs.items()])
