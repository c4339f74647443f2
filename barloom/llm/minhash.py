"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct shingles of k words (words between ASCII white space, A-Z lower-cased; the whole
sequence as one shingle where there are fewer words). One hash per shingle fills all bins of the signature: a bin holds
its smallest hash, and an empty bin borrows from the first filled bin in an order of its own (optimal densification).
Bands of bins give buckets. In each bucket members are compared with a centre only, the member that shares most buckets;
links are confirmed on the full sets. A bucket whose members are then in one component is done; in others further centres
are taken, each compared with the members of other components, until every pair across components has been compared. So
a group of n copies costs about n comparisons, and no link that joins two components is lost within the buckets.

Null and empty texts have an empty set and link with nothing. Equal sets are one class, represented by its smallest id.
Rows that repeat an id are one node. A null id takes no part; its component is null and it is kept. An empty table gives
an empty result. Other columns are ignored or carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .stars import star_links

SHINGLE = 5
#: Bands and bins a band. At a similarity of 0.8 a pair shares no band with probability 3e-7, at 0.85 with 5e-11.
BANDS, ROWS = 50, 6
#: Numbers of 64 bits that sketch a set. A slot that only one of two sets falls into holds a hash the other lacks, so
#: sketches bound the intersection from above.
WORDS = 16

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 2**64, 256, dtype=_U)
_STEP = _U(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grow(n: int) -> None:
    """Powers of the step and of its inverse modulo 2**64, n of them at least."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", int(_STEP)), ("down", pow(int(_STEP), -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, _U)
    flat = np.frombuffer(b" ".join(words), np.uint8)
    _grow(len(flat) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[flat] * _powers["up"][: len(flat)], dtype=_U)])
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) >= k:
        start, end = start[: len(words) - k + 1], end[k - 1 :]
    else:
        start, end = start[:1], end[-1:]
    return np.unique(_mix((total[end] - total[start]) * _powers["down"][start]))


class Signer:
    """Signatures of bands * rows bins, hashed band by band."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.Generator(np.random.PCG64(11))
        self.order = rng.permuted(np.tile(np.arange(self.bins, dtype=np.int32), (self.bins, 1)), axis=1)
        self.odd = rng.integers(0, 2**63, rows, dtype=_U) * _U(2) + _U(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        of = ((hashes >> _U(32)) * _U(self.bins) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        filled, out = of[first], np.zeros(self.bins, _U)
        out[filled] = hashes[first]
        empty = np.ones(self.bins, bool)
        empty[filled] = False
        out[empty] = out[filled[self.order[np.ix_(empty, filled)].argmin(1)]]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        s = _mix((_mix(self.signature(hashes)).reshape(self.bands, self.rows) * self.odd).sum(1, dtype=_U) + np.arange(self.bands, dtype=_U))
        return s.view(np.int64)


def _features(df: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, n (size of the set), s1 and s2 (a 128-bit fingerprint of the set), keys (one bucket key a band), bits (which of
    64 * WORDS slots the set's hashes fall into)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            n, s1, s2, keys, bits = [], [], [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), k)
                n.append(len(h))
                s1.append(int(h.sum(dtype=_U).view(np.int64)))
                s2.append(int(_mix(h + _STEP).sum(dtype=_U).view(np.int64)))
                keys.append(signer.keys(h) if len(h) else None)
                slots = np.zeros(64 * WORDS, bool)
                slots[(h % _U(64 * WORDS)).astype(np.int64)] = True
                bits.append(np.packbits(slots, bitorder="little").view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, longs), pa.array(bits, longs)], ["id", "n", "s1", "s2", "keys", "bits"])

    return common.ship(df).select("id", "text").mapInArrow(common.tidied(run), "id long, n long, s1 long, s2 long, keys array<long>, bits array<long>")


def _sets(df: DataFrame, k: int) -> DataFrame:
    """id, hashes: the full set as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in batch.column(1)], pa.binary())], ["id", "hashes"])

    return df.select("id", "text").mapInArrow(common.tidied(run), "id long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort()
                common_ = int((both[1:] == both[:-1]).sum())
                hit.append(100 * common_ >= percent * (len(both) - common_))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    of_b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    of_a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "ha", "hb").mapInArrow(common.tidied(run), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of df: the id (a long), n_shingles, component_id, kept."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    features = common.cut(_features(texts, shingle, bands, rows))
    used = features.filter("id is not null and n > 0")
    classes = common.cut(used.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    firsts = used.join(classes.select("n", "s1", "s2", F.col("rep").alias("id")), ["n", "s1", "s2", "id"], "left_semi").dropDuplicates(["id", "n", "s1", "s2"])
    with_sets = lambda ids: common.cut(_sets(common.rows_with(texts.filter("id is not null"), ids, "id"), shingle))
    sketches = firsts.select("id", "n", *[F.col("bits")[k].alias(f"w{k}") for k in range(WORDS)])
    own, other = (" + ".join(f"bit_count({a}w{k} & ~{b}w{k})" for k in range(WORDS)) for a, b in (("", "other_"), ("other_", "")))
    most = f"least(n - ({own}), other_n - ({other}))"
    near = f"100 * {most} >= {percent} * (n + other_n - {most})"
    links = star_links(firsts.select(F.explode("keys").alias("key"), "id"), sketches, near, with_sets, lambda pairs, sets: _confirmed(pairs, sets, percent))

    of_class = features.join(classes, ["n", "s1", "s2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    twice = used.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("id")
    same_id = of_class.join(twice, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comps = components(same_id if links is None else links.union(same_id)).withColumnRenamed("id", "rep")
    out = of_class.join(comps, "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of df that are kept, one document of each component, with df's columns."""
    dropped = near_duplicates(df, id_col, text_col, percent, shingle, bands, rows).filter(~F.col("kept")).select(F.col(id_col).alias("gone"))
    return common.unwrap(common.whole_rows(df, id=F.col(id_col).cast("long")).join(dropped, F.col("id") == F.col("gone"), "left_anti"), df.columns)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), percent=85, bands=40, rows=8)  # misses a pair at 0.85 with probability 3e-6
