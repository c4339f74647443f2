"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words from its weight, at most `copies` times what it has. Each copy of a shuffled
document gets a virtual finish time, the words of its source up to and including it divided by the source's target; all
copies are ordered by that time and the order is cut where the running number of words passes the total budget.

Null texts and texts without words have size 0: they take no part and are taken 0 times. Sources may be null (ordered
last). Equal ids are told apart by size only; rows equal in both are interchangeable. The shuffle is md5 of seed and id,
so reruns agree. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, copies: int = 2) -> DataFrame:
    """source, rows, source_size, target: one row per source.

    Sources in code point order take the weights in turn. A target is the source's share by weight of `share` times all
    words; where that passes `copies` times the source, the excess goes to the others by weight, until none is above.
    With sources ordered by cap over weight the capped ones come first, so running sums over the sources solve it."""
    own = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1)
    own = own.withColumn("w", w).withColumn("cap", F.col("source_size") * copies)
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    own = own.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(every))
    return own.select("source", "rows", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.col("cap").cast("double")).alias("target"))


def _place(key: Column) -> Column:
    """The first 32 bits of an md5 as a number from 0 to 1, in the order of the md5."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _timed(rows: DataFrame, plan: DataFrame, block_rows: int) -> DataFrame:
    """Adds the source's figures and upto, the words of the source up to and including the row in shuffled order.

    A source is split into blocks by ranges of its shuffle key, so that one which holds most rows never meets in one
    task: block sums are added up first, rows inside their block second."""
    p = plan.select(F.col("source").alias("of"), "rows", "source_size", "target")
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("block", F.floor(_place(F.col("key")) * F.ceil(F.col("rows") / block_rows)))
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("source").alias("of"), F.col("block").alias("at"), (F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")).alias("before"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
    inside = Window.partitionBy("source", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.col("before") + F.sum("size").over(inside))


def _finish(copy: int | Column) -> Column:
    """Virtual finish time of a copy, counted from 0."""
    return (F.lit(copy) * F.col("source_size") + F.col("upto")) / F.col("target")


def _mixed(df: DataFrame, columns: dict[str, Column], id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, copies: int, seed: int, block_rows: int) -> DataFrame:
    keys = {"id": F.col(id_col), "source": F.col(source_col), "size": common.word_count(F.col(text_col)), "key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))}
    sized = common.cut(df.select(*[c.alias(k) for k, c in keys.items()]))
    plan = common.cut(targets(sized, weights, share, copies))
    total = plan.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("target").alias("words")).first()
    budget, slots = total["words"] or 0.0, -(-total["rows"] // block_rows)

    timed = _timed(sized, plan, block_rows)
    slot = lambda finish: F.floor(finish * F.lit(slots))
    queue = timed.filter("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(copies)]))).withColumn("finish", _finish(F.col("copy"))).withColumn("slot", slot(F.col("finish")))
    sums = queue.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("slot")))
    last = sums.filter(F.col("upto") > F.lit(budget + 0.5)).orderBy("slot").select("slot", (F.col("upto") - F.col("words")).alias("before")).first()
    edge, before = (last["slot"], last["before"]) if last else (2**62, 0)

    run = Window.partitionBy("slot").orderBy("finish", "source", "key", "id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    picked = queue.filter(F.col("slot") == edge).withColumn("run", F.sum("size").over(run) + F.lit(before)).filter(F.col("run") <= F.lit(budget + 0.5))
    picked = picked.groupBy(F.col("source").alias("of"), F.col("upto").alias("at")).agg(F.count(F.lit(1)).alias("more"))
    rows = _timed(df.select(*[c.alias(k) for k, c in {**keys, **columns}.items()]) if columns else sized, plan, block_rows)
    out = rows.join(picked, F.col("source").eqNullSafe(F.col("of")) & (F.col("upto") == F.col("at")) & (F.col("size") > 0), "left")
    certain = sum((F.when(slot(_finish(k)) < edge, 1).otherwise(0) for k in range(copies)), F.lit(0))
    return out.withColumn("times", F.when(F.col("size") > 0, certain + F.coalesce(F.col("more"), F.lit(0))).otherwise(0).cast("long"))


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, copies: int = 2, seed: int = 0, block_rows: int = 20_000) -> DataFrame:
    """One row per row of df: the id, source, size, source_size, target, times (copies taken) and taken (words taken).

    The queue is summed over slots of time that hold about block_rows rows; only the slot in which the budget ends is
    summed row by row. To the driver come three numbers: the rows, the budget and the place where it ends."""
    out = _mixed(df, {}, id_col, text_col, source_col, weights, share, copies, seed, block_rows)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, copies: int = 2, seed: int = 0, block_rows: int = 20_000) -> DataFrame:
    """The mixed rows with df's columns: a row for each copy taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = _mixed(df, {"row": row}, id_col, text_col, source_col, weights, share, copies, seed, block_rows)
    return common.unwrap(out.filter("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")), df.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(common.table(spark, sf_dir, "documents")).drop("times")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (3 - [0, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::INT AS w FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size AS cap, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, w * (SELECT max(level) FROM l WHERE cap / w >= level)), cap::DOUBLE) AS target FROM l),
u AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY (copy * source_size + upto) / target, source, key, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS run FROM u, range(2) r(copy) WHERE size > 0),
k AS (SELECT doc_id, sum(size) AS taken FROM q WHERE run <= (SELECT sum(target) FROM t) + 0.5 GROUP BY doc_id)
SELECT u.doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM u LEFT JOIN k ON u.doc_id = k.doc_id"""
