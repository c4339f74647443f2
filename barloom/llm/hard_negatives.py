"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of codes is a cell, and a cell's rows lie in
pieces of bounded size. For a query, the inner product of a half with any member of a code is at most that with the
centroid plus the query's length times the code's radius. A heap over both sorted lists of half bounds (the multi-sequence
order) yields cells by falling sum. A query first visits the cells that hold FIRST rows; the k-th best score then found,
or the window's lower end, is the threshold, and the second round visits every further cell whose bound reaches it, in the
same order, and stops: what is left can't enter the window. Cells that lie above a window as a whole are passed over too.
So results are exact, whatever the codebooks.

Rows are dealt by piece. In a task a piece's rows come first and its visits follow in batches, so no candidate is copied
for a query and no group of queries is held. Codebooks are fitted on a bounded sample (`fit_values` numbers), radii and
counts cover all rows, and the directory has at most codes**2 rows.

A component x becomes floor(scale * x). Rows with a null id or label, a null vector or a null or non-finite component
take no part; shorter vectors count as ended by zeros. An anchor's own row is no candidate, other rows that repeat its
id are. Rows that repeat an anchor's id are anchors of their own. Ties go to the smaller id. An empty table gives an empty
result; other columns are ignored. Scores are exact while they fit 64 bits."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .maxscore import whole_numbers

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Codes of a half, numbers in the fitting sample, rows of a piece, rows that a query visits before it has a threshold.
CODES, FIT_VALUES, PIECE, FIRST = 16, 2**20, 4096, 1024
LEAST, MOST = -(2**63), 2**63 - 1

WINS = "array<struct<w:long,low:long,high:long,floor:long>>"
ROW = f"piece long, kind int, key long, id long, label int, vector array<long>, wins {WINS}"


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones ended by zeros."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced distinct points."""
    points = points.astype(np.float64)
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        centres = np.stack([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and distance of each point."""
    points = points.astype(np.float64)
    code = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
    return code, np.linalg.norm(points - centres[code], axis=1)


def falling_cells(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs of codes by falling sum of their half bounds. A pair enters the heap when both pairs just before it, in its
    row and its column, have been visited, so the heap never has more entries than the shorter list."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    u, v = first[a].tolist(), second[b].tolist()
    upto = [0] * len(u)  # how many pairs of each row have been visited
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), -total
        upto[i] = j + 1
        if j + 1 < len(v) and (i == 0 or upto[i - 1] > j + 1):
            heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
        if i + 1 < len(u) and upto[i + 1] == j:
            heapq.heappush(heap, (-(u[i + 1] + v[j]), i + 1, j))


class Directory:
    """Codebooks, radii of the codes, and rows and pieces of the cells that have any."""

    def __init__(self, books: list[np.ndarray], radii: list[np.ndarray], rows: dict[tuple[int, int], int], piece: int):
        self.books, self.radii, self.rows, self.piece = books, radii, rows, piece

    def number(self, i: int, j: int, part: int = 0) -> int:
        return (i * len(self.books[1]) + j) << 32 | part

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The most and the least that each code of each half can add to the query's score."""
        half, high, low = len(self.books[0][0]), [], []
        for part, book, radius in zip((q[:half], q[half:]), self.books, self.radii, strict=True):
            part = part.astype(np.float64)
            middle, reach = book @ part, np.linalg.norm(part) * radius
            slack = 1e-9 * (np.abs(book) @ np.abs(part) + reach + 1)  # rounding
            high.append(middle + reach + slack)
            low.append(middle - reach - slack)
        return high, low

    def visits(self, q: np.ndarray, wins: list[dict], later: bool, first: int) -> Iterator[tuple[int, list[dict]]]:
        """Piece numbers and the windows that may gain there: of the first round, or of all later cells."""
        if not wins:
            return
        (h1, h2), (l1, l2) = self.bounds(q)
        covered, least = 0, min(w["floor"] if later else w["low"] for w in wins)
        for i, j, bound in falling_cells(h1, h2):
            if bound < least:
                return
            n = self.rows.get((i, j), 0)
            if not n or all(l1[i] + l2[j] > w["high"] for w in wins):
                continue
            early = covered < first
            covered += n
            if not early and not later:
                return
            if early and later:
                continue
            gains = [w for w in wins if bound >= w["floor" if later else "low"] and l1[i] + l2[j] <= w["high"]]
            if gains:
                for part in range(-(-n // self.piece)):
                    yield self.number(i, j, part), gains


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    peak = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    return np.rint(q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if peak < 2**53 else q @ v.T


def _walk(dims: int, same: bool, k: int):
    """The task: rows of a piece, then its visits; yields key, w, id, score of the k best rows in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, ready = None, [], None
        for batch in batches:
            pieces, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, ids, labels, wins = (batch.column(c) for c in (2, 3, 4, 6))
            edges = np.flatnonzero((np.diff(pieces) != 0) | (np.diff(kinds) != 0)) + 1
            out: dict[str, list] = {"key": [], "w": [], "id": [], "score": []}
            for a, b in zip([0, *edges], [*edges, len(pieces)], strict=True):
                if a == b:
                    continue
                if piece != pieces[a]:
                    piece, held, ready = pieces[a], [], None
                q = matrix(batch.column(5).slice(a, b - a), dims)
                own = keys.slice(a, b - a).to_numpy(), labels.slice(a, b - a).to_numpy()
                if kinds[a] == 0:
                    held.append((q, *own, ids.slice(a, b - a).to_numpy()))
                    continue
                if ready is None and held:
                    ready = [np.concatenate(x) for x in zip(*held, strict=True)]
                if ready is None:
                    continue
                values, row_keys, row_labels, row_ids = ready
                for n, scores in enumerate(_products(q, values)):
                    fit = (row_labels == own[1][n]) & (row_keys != own[0][n]) if same else row_labels != own[1][n]
                    for win in wins[a + n].as_py():
                        at = np.flatnonzero(fit & (scores >= win["low"]) & (scores <= win["high"]))
                        at = at[best(scores[at], row_ids[at], k)]
                        for name, x in (("key", np.full(len(at), own[0][n])), ("w", np.full(len(at), win["w"])), ("id", row_ids[at]), ("score", scores[at])):
                            out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out.values()], list(out))

    return run


class Index:
    """Rows (key, id, label, vector) in pieces of cells, in a table of the shared folder."""

    def __init__(self, rows: DataFrame, codes: int = CODES, fit_values: int = FIT_VALUES, piece: int = PIECE, first: int = FIRST):
        self.first, self.dims = first, max(2, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
        dims, half = self.dims, self.dims // 2
        sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(max(1, fit_values // dims)).select("vector").toArrow()["vector"].combine_chunks()
        points = matrix(sample, dims)
        books = [fit_codebook(points[:, :half], codes), fit_codebook(points[:, half:], codes)] if len(points) else [np.zeros((1, half)), np.zeros((1, dims - half))]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column(3), dims)
                (i, d1), (j, d2) = nearest(v[:, :half], books[0]), nearest(v[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d1), pa.array(d2)], ["key", "id", "label", "vector", "i", "j", "d1", "d2"])

        schema = "key long, id long, label int, vector array<long>, i int, j int, d1 double, d2 double"
        self.rows = common.cut(rows.select("key", "id", "label", "vector").mapInArrow(assign, schema))
        cells = self.rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("r1"), F.max("d2").alias("r2")).collect()  # codes**2 rows at most
        radii = [np.zeros(len(b)) for b in books]
        for c in cells:
            radii[0][c.i], radii[1][c.j] = max(radii[0][c.i], c.r1), max(radii[1][c.j], c.r2)
        self.directory = Directory(books, radii, {(c.i, c.j): c.n for c in cells}, piece)
        parts = self.rows.sparkSession.createDataFrame([(c.i, c.j, self.directory.number(c.i, c.j), -(-c.n // piece)) for c in cells], "i int, j int, number long, parts long")
        dealt = self.rows.join(F.broadcast(parts), ["i", "j"])
        self.dealt = dealt.select((F.col("number") + F.pmod(F.xxhash64("key"), "parts")).alias("piece"), F.lit(0).alias("kind"), "key", "id", "label", "vector", F.lit(None).cast(WINS).alias("wins"))

    def _round(self, asks: DataFrame, same: bool, k: int, later: bool) -> DataFrame:
        directory, dims, first = self.directory, self.dims, self.first

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                queries = matrix(batch.column(2), dims)
                for n, wins in enumerate(batch.column(3)):
                    to = list(directory.visits(queries[n], wins.as_py() or [], later, first))
                    one = batch.slice(n, 1)
                    for a in range(0, len(to), 1024):
                        part = to[a : a + 1024]
                        again = [pa.concat_arrays([one.column(c)] * len(part)) for c in range(3)]
                        cells = pa.array([p for p, _ in part], pa.int64())
                        yield pa.RecordBatch.from_arrays([cells, pa.array([1] * len(part), pa.int32()), again[0], again[0], again[1], again[2], pa.array([g for _, g in part], batch.column(3).type)], ["piece", "kind", "key", "id", "label", "vector", "wins"])

        visits = asks.select("key", "label", "vector", "wins").mapInArrow(plan, ROW)
        met = self.dealt.union(visits).repartition("piece").sortWithinPartitions("piece", "kind")
        return met.mapInArrow(_walk(dims, same, k), "key long, w long, id long, score long")

    def search(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """key, w, place (from 1), id, score: the k best rows of the same or of other labels in each window of the asks
        (key, label, vector, wins)."""
        place = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "id"))
        ranked = lambda found: found.withColumn("place", place).filter(F.col("place") <= k).select("key", "w", "place", "id", "score")
        early = common.cut(ranked(self._round(asks, same, k, False)))
        full = early.filter(F.col("place") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))  # a handful of windows an ask
        raised = asks.join(full, "key", "left").withColumn("wins", F.transform("wins", lambda w: F.struct(w["w"].alias("w"), w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.col("reached")[w["w"]], w["low"]).alias("floor"))))
        return ranked(early.drop("place").union(self._round(raised, same, k, True)))


def _windows(spans: Column) -> Column:
    return spans.cast(WINS)


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100, **build: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has id, label and vector (whole numbers); is_anchor is a condition on them. A negative's score is from low to high
    percent of the positive's."""
    rows = common.cut(rows.filter("id is not null and label is not null and vector is not null").select(F.monotonically_increasing_id().alias("key"), F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "vector"))
    index = Index(common.ship(rows), **build)
    anchors = rows.filter(is_anchor)
    whole = F.array(F.struct(F.lit(0), F.lit(LEAST), F.lit(MOST), F.lit(LEAST)))
    near = common.cut(index.search(anchors.withColumn("wins", _windows(whole)), True, positives))
    # one window for each distinct score of an anchor's positives; scores under zero have an empty one
    scores = near.filter("score >= 0").groupBy("key").agg(F.collect_set("score").alias("scores"))
    least = lambda s: F.expr("0L") - F.floor((F.lit(0).cast("decimal(38,0)") - s * F.lit(low)) / F.lit(100)).cast("long")
    most = lambda s: F.floor((s.cast("decimal(38,0)") * F.lit(high)) / F.lit(100)).cast("long")
    near = near.drop("w", "place")
    asks = anchors.join(scores, "key").withColumn("wins", _windows(F.transform("scores", lambda s: F.struct(s, least(s), most(s), least(s)))))
    far = index.search(asks, False, negatives).select(F.col("key").alias("of"), "w", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.join(far, (F.col("key") == F.col("of")) & (F.col("score") == F.col("w")))
    pairs = pairs.select("key", F.col("id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
    return pairs.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.select(F.col("vec_id").alias("id"), label.alias("label"), whole_numbers(F.col("embedding"), SCALE).alias("vector")), "id % 100 = 0")


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.key, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.key <> c.key),
p AS (SELECT key, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS place FROM s WHERE same WINDOW w AS (PARTITION BY key ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.key, place ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.key = s.key AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
