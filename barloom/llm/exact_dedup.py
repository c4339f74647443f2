"""Exact de-duplication: group by a 128-bit hash of the normalised text, compare bytes inside groups, keep one stable id.

Texts are equal when their bytes are, after lower-casing A-Z; a null text counts as empty. Rows that repeat an id with
an equal text are one document and share its decision; a null id loses against any other id. An empty table gives an
empty result. Other columns of the input are carried or ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Parts into which a group's texts are dealt.
SALTS = 32


def content_hash(text: Column) -> list[Column]:
    """128 bits: two 64-bit hashes of the text with different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def normalised(text_col: str) -> Column:
    return common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hashes: Callable[[Column], list[Column]] = content_hash) -> DataFrame:
    """One row per group of at least two equal texts: h1, h2, sha, n, keep_id.

    Rows are first counted by hash without their texts. Only texts whose hash repeats go on, dealt by hash and salt so
    that no group meets in one task, and are grouped by the text itself: hash aggregation compares bytes and collapses
    copies before the last shuffle, and texts that merely share a hash part company."""
    text = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    text = text.select("id", "t", *[h.alias(f"h{k}") for k, h in enumerate(hashes(F.col("t")), 1)], F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    repeated = text.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeated.select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pick = F.min("id") if keep == "min" else F.max("id")
    same = text.join(repeated, ["h1", "h2", "salt"], "left_semi").groupBy("h1", "h2", "t").agg(F.count(F.lit(1)).alias("n"), pick.alias("keep_id"))
    return same.filter("n > 1").select("h1", "h2", F.sha2(F.col("t"), 256).alias("sha"), "n", "keep_id")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hashes: Callable[[Column], list[Column]] = content_hash) -> DataFrame:
    """One row per row of df: the id, keep_id, group_size, kept, text_sha256."""
    slim = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    slim = slim.select("id", *[h.alias(f"h{k}") for k, h in enumerate(hashes(F.col("t")), 1)], F.sha2(F.col("t"), 256).alias("sha"))
    out = slim.join(duplicate_groups(df, id_col, text_col, keep, hashes), ["h1", "h2", "sha"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of df that are kept, with df's columns."""
    t = normalised(text_col)
    h1, h2 = content_hash(t)
    rows = common.whole_rows(df, id=F.col(id_col), h1=h1, h2=h2, sha=F.sha2(t, 256))
    out = rows.join(duplicate_groups(df, id_col, text_col, keep), ["h1", "h2", "sha"], "left")
    return common.unwrap(out.filter(F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))), df.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"), keep="max")


OP2_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)"""
