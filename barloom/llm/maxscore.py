"""Exact top-k by inner product with MaxScore.

Dimensions are the terms of a query, components its weights. Each shard of candidates keeps, for every dimension, a
posting column and its smallest and largest value; the least that all dimensions add to a score, and for each the width
between that and the most, bound every score. Sorted by width, the narrowest dimensions whose widths together can't lift
a candidate from the least over the tenth best score so far are non-essential. Essential columns are traversed for all
candidates of a block; the others are probed, widest first, only for candidates that are still competitive. Shards' best
lists are merged by a window. Candidates are dealt to shards once and stay there: a task holds one shard at a time and
the queries pass by in batches.

A component x becomes floor(scale * x). Vectors that are null or hold a null or non-finite component take no part;
shorter vectors count as ended by zeros, an empty one has score 0 with all. A null id takes no part. Ties go to the
smaller id. Rows that repeat an id are queries and candidates of their own; only a query's own row is no candidate. An
empty table gives an empty result; other columns are ignored. Scores are exact while they fit 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, SCALE = 10, 1024
#: Rows of a shard, which bound the memory of a task.
SHARD = 4096
#: Candidates scored between two looks at the thresholds.
BLOCK = 1024


def _matrix(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Shard:
    """Posting columns of candidates and their bounds."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.keys, self.ids, self.values = keys[order], ids[order], values[order]
        self.low, self.high = self.values.min(0), self.values.max(0)
        peak = int(np.abs(self.values).max(initial=0))
        self.exact = lambda q: peak * int(np.abs(q).max(initial=0)) * max(1, q.shape[-1]) < 2**53  # noqa: E731  sums are exact as doubles

    def top(self, key: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best candidates but the row of that key, best first."""
        kind = np.float64 if self.exact(q) else np.int64
        upper = np.maximum(q * self.low, q * self.high)
        lower = np.minimum(q * self.low, q * self.high)
        order = np.argsort(lower - upper, kind="stable")  # widest first
        after = np.concatenate([np.cumsum(upper[order][::-1])[::-1], [0]])  # the most that the dimensions from here on add
        lift = np.concatenate([np.cumsum((upper - lower)[order][::-1])[::-1], [0]])  # their widths
        least = int(lower.sum())
        weights = q[order].astype(kind)
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for a in range(0, len(self.ids), BLOCK):
            block = self.values[a : a + BLOCK]
            live = np.flatnonzero(self.keys[a : a + BLOCK] != key)
            essential = len(order)
            if len(ids) == k:  # the first place from which on nothing beats the k-th score
                essential = int(np.searchsorted(-lift, least - int(scores[-1]), side="left"))
            got = block[np.ix_(live, order[:essential])].astype(kind) @ weights[:essential]
            at = essential
            while at < len(order) and len(live):
                keep = got + after[at] > scores[-1]
                live, got = live[keep], got[keep]
                step = min(len(order), at + 8)
                got = got + block[np.ix_(live, order[at:step])].astype(kind) @ weights[at:step]
                at = step
            ids, scores = np.concatenate([ids, self.ids[a + live]]), np.concatenate([scores, np.asarray(got).astype(np.int64)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, null if the vector takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fit, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates. Both have key (of a row), id and vector (whole
    numbers). Only queries are copied, once for each shard; k rows of each copy leave its task."""
    total = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    asked = queries.agg(F.max(F.size("vector")).alias("d")).first()
    shards, dims = max(1, -(-total["n"] // SHARD)), max(total["d"] or 0, asked["d"] or 0, 1)
    given = candidates.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "key", "id", "vector")
    asking = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "key", "id", "vector")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ready = None, [], None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for a, b in zip([0, *edges], [*edges, len(numbers)], strict=True):
                if a == b:
                    continue
                if shard != numbers[a]:
                    shard, held, ready = numbers[a], [], None
                keys, ids = (batch.column(c).slice(a, b - a).to_numpy() for c in (2, 3))
                values = _matrix(batch.column(4).slice(a, b - a).to_pylist(), dims)
                if kinds[a] == 0:
                    held.append((keys, ids, values))
                elif held or ready:
                    ready = ready or Shard(*[np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
                    out += [(key, qid, *ready.top(int(key), q, k)) for key, qid, q in zip(keys, ids, values, strict=True)]
            size = [len(x[2]) for x in out]
            cols = [np.repeat([x[c] for x in out], size) for c in (0, 1)] + [np.concatenate([x[c] for x in out]) if out else [] for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "query_id", "vec_id", "score"])

    met = common.ship(given.union(asking)).repartition("shard").sortWithinPartitions("shard", "kind")
    best = met.mapInArrow(meet, "key long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "embeddings")
    rows = table.select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding")).alias("vector")).filter("id is not null and vector is not null")
    rows = common.cut(rows.select(F.monotonically_increasing_id().alias("key"), "id", "vector"))
    return top_k(rows.filter("id % 100 = 0"), rows)


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.key, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.key <> c.key)
SELECT query_id, (row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) <= 10"""
