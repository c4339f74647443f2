"""Prefix scans over ordered rows of keys that may be hot.

Rows are sorted by key and order over ranges that Spark sizes from a sample, and numbered: the number of the range and
the place in it. Runs of BLOCK numbers are blocks. What a block does to a key's state is one affine map, state -> a * state
+ b (a = 1: a plain sum), and maps compose, so a scan goes up and down three levels: the rows of a block, the blocks of a
range, the ranges of a key. No group on the way holds more than BLOCK rows, the blocks of one range, or the ranges of the
table, and no level gathers rows in lists. Where sums do not do, a level's reach grows fourfold with every pass over lags,
so n rows need log4(n) passes over one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.lineage import cut

#: Rows of a block, a power of two.
BLOCK = 256
#: Bits of a row's place in its range, as monotonically_increasing_id lays them out.
PLACE = 33
UNB = Window.unboundedPreceding


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df sorted by keys and order over ranges, with its place there in ``_n``; written once, as every scan reads it twice."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut(ranged.withColumn("_n", F.monotonically_increasing_id()))


def _widened(df: DataFrame, w: WindowSpec, reach: int) -> DataFrame:
    """Maps _a, _b of single rows -> of all rows up to each, for groups of at most ``reach`` rows. A pass joins the maps of
    four stretches, so half as many passes copy the rows as with two."""
    step = 1
    while step < reach:
        far = [k for k in (1, 2, 3) if k * step < reach]
        df = df.select("*", *[F.lag("_a", k * step, 1.0).over(w).alias(f"_a{k}") for k in far], *[F.lag("_b", k * step, 0.0).over(w).alias(f"_b{k}") for k in far])
        a, b = F.col(f"_a{far[-1]}"), F.col(f"_b{far[-1]}")
        for x, y in [(F.col(f"_a{k}"), F.col(f"_b{k}")) for k in reversed(far[:-1])] + [(F.col("_a"), F.col("_b"))]:
            a, b = x * a, x * b + y
        df = df.select(*[c for c in df.columns if c not in ("_a", "_b") and c not in [f"_{m}{k}" for m in "ab" for k in far]], a.alias("_a"), b.alias("_b"))
        step *= 4
    return df


def _entering(df: DataFrame, group: list[str], by: str, affine: bool, reach: int) -> DataFrame:
    """Adds _xa, _xb: the map of all earlier rows of the group."""
    w = Window.partitionBy(*group).orderBy(by)
    if not affine:
        return df.withColumn("_xa", F.lit(1.0)).withColumn("_xb", F.coalesce(F.sum("_b").over(w.rowsBetween(UNB, -1)), F.lit(0)))
    own = df.withColumn("_oa", F.col("_a")).withColumn("_ob", F.col("_b"))
    out = _widened(own, w, reach).withColumn("_xa", F.lag("_a", 1, 1.0).over(w)).withColumn("_xb", F.lag("_b", 1, 0.0).over(w))
    return out.withColumn("_a", F.col("_oa")).withColumn("_b", F.col("_ob")).drop("_oa", "_ob")


def _totals(df: DataFrame, group: list[str], by: str, affine: bool) -> DataFrame:
    """One map a group: the product of all a, and every b times the a that follow it."""
    if not affine:
        return df.groupBy(*group).agg(F.sum("_b").alias("_b"))
    rest = F.coalesce(F.product("_a").over(Window.partitionBy(*group).orderBy(F.desc(by)).rowsBetween(UNB, -1)), F.lit(1.0))
    return df.withColumn("_r", F.col("_b") * rest).groupBy(*group).agg(F.product("_a").alias("_a"), F.sum("_r").alias("_b"))


def prefix_scan(ordered: DataFrame, keys: Sequence[str], value: Column, before: str, after: str, keep: Column | None = None, block: int = BLOCK, *, numbered: DataFrame | None = None) -> DataFrame:
    """Adds the state before and after each row of ``in_order``: after = keep * before + value (no ``keep``: a running
    sum), starting from 0 for each key. ``numbered``: a table with the same numbers that is cheaper to read, as the written
one that ``ordered`` comes from."""
    affine, keys, reach = keep is not None, list(keys), {"blocks": 1, "ranges": 1}
    if affine:
        place = F.col("_n").bitwiseAND(F.lit(2**PLACE - 1))
        most = (numbered or ordered).agg(F.coalesce(F.max(place), F.lit(0)).alias("place"), F.coalesce(F.max(F.shiftright("_n", PLACE)), F.lit(0)).alias("range")).first()
        reach = {"blocks": most["place"] // block + 1, "ranges": most["range"] + 1}
    rows = ordered.withColumn("_block", F.shiftright("_n", block.bit_length() - 1)).withColumn("_b", value)
    if affine:
        rows = rows.withColumn("_a", keep)
    in_block, in_range = ["_block", *keys], ["_range", *keys]
    blocks = _totals(rows, in_block, "_n", affine).withColumn("_range", F.shiftright("_block", PLACE - block.bit_length() + 1))
    ranges = _entering(_totals(blocks, in_range, "_block", affine), keys, "_range", affine, reach["ranges"])
    start = ranges.select(*in_range, F.col("_xb").alias("_s"))
    blocks = _entering(blocks, in_range, "_block", affine, reach["blocks"]).join(start, in_range)
    start = blocks.select(*in_block, (F.col("_xa") * F.col("_s") + F.col("_xb") if affine else F.col("_s") + F.col("_xb")).alias("_s"))
    out = _entering(rows, in_block, "_n", affine, block).join(start, in_block)
    out = out.withColumn(before, F.col("_xa") * F.col("_s") + F.col("_xb") if affine else F.col("_s") + F.col("_xb"))
    out = out.withColumn(after, (F.col("_a") * F.col(before) if affine else F.col(before)) + F.col("_b"))
    return out.select(*ordered.columns, before, after)
