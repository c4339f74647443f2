"""As-of joins and skew-safe ranks built from plain DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.lineage import cut


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              cols: list[str], *, direction: str = "backward", strict: bool = False,
              tiebreak: list[str] | None = None) -> DataFrame:
    """Attach to every left row the nearest right row by time: at or before it (``backward``) or at
    or after it (``forward``); ``strict`` excludes equal times. One union, one shuffle on ``keys``,
    one sort; no row pairs are produced. For keys bounded by the calendar (one row per session).
    """
    payload = F.struct(F.col(right_time).alias("_rt"), *[F.col(c) for c in cols])
    r_side, l_side = (1, 0) if strict else (0, 1)
    lf = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(l_side))
    rf = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_t"), F.lit(r_side).alias("_side"), payload.alias("_r"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tiebreak or [])])
    t = F.col("_t").asc() if direction == "backward" else F.col("_t").desc()
    ties = [F.col(f"_k{i}").asc_nulls_first() for i, _ in enumerate(tiebreak or [])]
    w = (Window.partitionBy(*keys).orderBy(t, "_side", *ties)
         .rowsBetween(Window.unboundedPreceding, 0))
    return (lf.unionByName(rf, allowMissingColumns=True)
            .withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
            .filter(F.col("_side") == l_side)
            .select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in cols],
                    F.col("_hit._rt").alias(f"{right_time}_asof")))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, n_out: str,
                 *, buckets: int = 32) -> DataFrame:
    """Average rank (ties share the mean position, smallest value first) and group size per key.

    Equal values are first collapsed to one counted row, then each group is cut into ``buckets``
    value ranges (mergeable quantile sketch of bounded size), ranked inside a range and shifted by
    the totals of the lower ranges; so neither a hot group nor a hot value meets one task.
    The sketch depends on the order in which parts arrive, and totals and ranks both need the same ranges, so the ranges
    are written once. NULL values get a NULL rank and do not count.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, 200).alias("_e"))
    ranged = cut(counts.join(edges, keys)
                 .withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e"))
    totals = ranged.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    offs = totals.select(
        *keys, "_b",
        F.coalesce(F.sum("_bc").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lo"),
        F.sum("_bc").over(Window.partitionBy(*keys)).alias(n_out))
    wv = (Window.partitionBy(*keys, "_b").orderBy(value)
          .rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.withColumn("_cum", F.sum("_c").over(wv)).join(offs, [*keys, "_b"]).select(
        *keys, value, n_out,
        (F.col("_lo") + F.col("_cum") - (F.col("_c") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*keys, value], "left")
