"""Removal of byte strings that occur more than once, by a distributed merge sort of suffixes.

Every string of `length` bytes that also starts somewhere else, in the same or another document, is to go. Each such window
has an anchor: the place in it of the gram (`gram` bytes) with the smallest hash, leftmost on ties, so equal windows have
equal anchors at equal places. Anchors whose gram occurs once are done with. An anchor's context is all that a window with
that anchor can reach; of equal contexts, told by a 128-bit hash, all windows repeat, and one stands for all from here on.
For grams with several contexts the suffixes that start at the anchor are sorted, as far as the context reaches:

* a task sorts its suffixes into runs and front-codes them: the length of the prefix shared with the one before, then the
  rest. Runs are dealt by ranges of their grams' hashes, so equal grams meet and no common beginning makes a range large;
* runs of a range are merged by a loser tree that knows for each run's head how long a prefix it shares with the last
  suffix put out. A longer known prefix wins unseen; only equal ones are compared, from the known prefix on. So the merge
  also yields the common prefix of neighbours;
* two windows that reach o bytes to the left of their anchors are equal if no neighbour between their suffixes shares less
  than length - o bytes, and their o bytes to the left have the same hash.

Grams with more than `hot` contexts would make one range too large: hashes of their windows are counted by Spark instead,
which collapses equal ones before the shuffle; that is the exact way for the rest.

Null texts count as empty. Texts shorter than `length` lose nothing. Documents are told apart by a 64-bit hash of id and
text, and rows that are equal in both count as occurrences of each other. Null ids are ids like others. Very long texts
are hashed whole, in memory of some 60 times their size. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .minhash import _BYTE, _U, _grow, _mix, _powers

LENGTH, GRAM, HOT = 400, 160, 20_000
#: Suffixes of a run and of a range.
RUN, RANGE = 40_000, 40_000
_HIGH = _U(0xFFFFFFFF00000000)
_LOW = _U(0xFFFFFFFF)


class Hashes:
    """Hashes of all substrings of a text."""

    def __init__(self, flat: np.ndarray):
        _grow(len(flat) + 1)
        self.total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[flat] * _powers["up"][: len(flat)], dtype=_U)])

    def of(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _mix((self.total[start + size] - self.total[start]) * _powers["down"][start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every i."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, reach of the leftmost and of the rightmost window before it, and gram hash of each anchor."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, _U)
    flat = np.frombuffer(data, np.uint8)
    grams = Hashes(flat).of(np.arange(len(data) - gram + 1), gram)
    least = sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=_U), length - gram + 1)
    at = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    return place, place - first, place - last, grams[place]


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    while known < n:
        end = min(n, known + 64)
        x = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
        if x:
            return end - (x.bit_length() + 7) // 8
        known = end
    return n


class LoserTree:
    """Merges sorted runs of (shared prefix with the one before, suffix)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs, self.next = runs, [0] * len(runs)
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.heads: list[bytes | None] = [None] * self.leaves
        self.known = [0] * self.leaves
        for r, (_, suffixes) in enumerate(runs):
            self.heads[r] = suffixes[0] if suffixes else None
        self.losers = [0] * self.leaves
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lose
        return win

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """Winner and loser. known[r]: the prefix that run r's head shares with the last winner both have met."""
        a, b = self.heads[x], self.heads[y]
        if b is None:
            return x, y
        if a is None:
            return y, x
        i, j = self.known[x], self.known[y]
        if i != j:
            return (x, y) if i > j else (y, x)
        k = shared_prefix(a, b, i)
        if (len(a) == k) or (len(b) > k and a[k] < b[k]):
            self.known[y] = k
            return x, y
        self.known[x] = k
        return y, x

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """run, place in it, and prefix shared with the suffix before."""
        while self.heads[self.winner] is not None:
            w = self.winner
            yield w, self.next[w], self.known[w]
            self.next[w] += 1
            shared, suffixes = self.runs[w]
            n = self.next[w]
            self.heads[w], self.known[w] = (suffixes[n], shared[n]) if n < len(suffixes) else (None, 0)
            node = (w + self.leaves) // 2
            while node:
                win, self.losers[node] = self._play(w, self.losers[node])
                w, node = win, node // 2
            self.winner = w


def repeated_reach(shared: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes the smallest and largest reach to the left of a window that occurs more than once, or -1.

    left[i, o]: the byte o + 1 before the anchor. Windows of anchor i reach from low[i] to high[i]. many: the whole
    context occurs more than once, so all of its windows do."""
    n = len(shared)
    least, most = np.where(many, low, -1), np.where(many, high, -1)
    value = np.zeros(n, _U)
    for o in range(int(high.max(initial=-1)) + 1):
        if o:
            value = (value + _BYTE[left[:, o - 1]]) * _U(0x9E3779B97F4A7C15)
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        group = np.cumsum(shared < length - o)[own].astype(_U)
        key = _mix(value[own] ^ _mix(group))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(own), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit = own[hit]
        least[hit] = np.where(least[hit] < 0, o, np.minimum(least[hit], o))
        most[hit] = np.maximum(most[hit], o)
    return least, most


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, place, high, low, gram, context (a hash of all that the anchor's windows reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, place, high, low, grams, context = [], [], [], [], [], []
            for k, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                p, h, l_, g = anchors(data, length, gram)
                if len(p):
                    key.append(np.full(len(p), k))
                    place.append(p)
                    high.append(h)
                    low.append(l_)
                    grams.append(g.view(np.int64))
                    whole = Hashes(np.frombuffer(data, np.uint8)).of(p - h, h - l_ + length)
                    context.append((_mix(whole ^ (h << 32 | l_).astype(_U))).view(np.int64))
            if key:
                of = lambda x, t=np.int64: pa.array(np.concatenate(x).astype(t))
                yield pa.RecordBatch.from_arrays([of(key), of(place), of(high, np.int32), of(low, np.int32), of(grams), of(context)], ["key", "place", "high", "low", "gram", "context"])

    return docs.select("key", "text").mapInArrow(run, "key long, place long, high int, low int, gram long, context long")


RUNS = "range long, run long, n int, shared binary, size binary, rest binary, left_size binary, left binary, key binary, place binary, reach binary, many binary"


def _runs(joined: DataFrame, ranges: int, length: int) -> DataFrame:
    """Front-coded sorted runs, one row per run and range. joined: key, text, found (place, high, low, gram, many)."""

    def rows(entries: list[tuple], run_id: int) -> pa.RecordBatch:
        by_range: dict[int, list[tuple]] = {}
        for e in entries:
            by_range.setdefault(e[0], []).append(e)
        out: dict[str, list] = {f.split()[0]: [] for f in RUNS.split(", ")}
        for part, own in by_range.items():
            own.sort(key=lambda e: e[1])
            shared, rest, before = [], [], b""
            for e in own:
                k = shared_prefix(before, e[1], 0)
                shared.append(k)
                rest.append(e[1][k:])
                before = e[1]
            pack = lambda x, t: np.array(x, t).tobytes()
            row = (part, run_id, len(own), pack(shared, "<u2"), pack([len(r) for r in rest], "<u2"), b"".join(rest), pack([len(e[2]) for e in own], "<u2"), b"".join(e[2] for e in own), pack([e[3] for e in own], "<i8"), pack([e[4] for e in own], "<i8"), pack([(e[5], e[6]) for e in own], "<u2"), pack([e[7] for e in own], "?"))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 9]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        entries: list[tuple] = []
        for batch in batches:
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                for f in found.as_py():
                    p, high, low = f["place"], f["high"], f["low"]
                    part = (f["gram"] + 2**63) * ranges >> 64
                    entries.append((part, data[p : p - low + length], data[p - high : p], key, p, low, high, f["many"]))
                if len(entries) >= RUN:
                    yield rows(entries, number)
                    entries, number = [], number + 1
        if entries:
            yield rows(entries, number)

    return joined.mapInArrow(run, RUNS)


def _merge(table: pa.Table, length: int) -> pa.Table:
    """Spans of the range's repeated windows: key, start, end."""
    rows = sorted(table.to_pylist(), key=lambda r: r["run"])
    runs, lefts, keys, places, reach, many = [], [], [], [], [], []
    for r in rows:
        get = lambda name, t, r=r: np.frombuffer(r[name], t)
        shared, suffixes, before, at = get("shared", "<u2").tolist(), [], b"", 0
        for k, size in zip(shared, get("size", "<u2").tolist(), strict=True):
            before = before[:k] + r["rest"][at : at + size]
            at += size
            suffixes.append(before)
        runs.append((shared, suffixes))
        ends = np.cumsum(get("left_size", "<u2").astype(np.int64))
        lefts.append([r["left"][e - s : e] for e, s in zip(ends.tolist(), get("left_size", "<u2").tolist(), strict=True)])
        keys.append(get("key", "<i8"))
        places.append(get("place", "<i8"))
        reach.append(get("reach", "<u2").reshape(-1, 2))
        many.append(get("many", "?"))
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    order, shared = [], []
    for r, n, k in LoserTree(runs):
        order.append(at[r] + n)
        shared.append(k)
    order, shared = np.array(order, np.int64), np.array(shared, np.int64)
    key, place, (low, high) = np.concatenate(keys)[order], np.concatenate(places)[order], np.concatenate(reach)[order].astype(np.int64).T
    left = [x for own in lefts for x in own]
    many = np.concatenate(many)[order]
    bytes_left = np.zeros((len(order), int(high.max(initial=0))), np.uint8)
    for n, i in enumerate(order):
        bytes_left[n, : high[n]] = np.frombuffer(left[i], np.uint8)[::-1]
    least, most = repeated_reach(shared, bytes_left, low, high, many, length)
    hit = (least >= 0) & ~many
    return pa.table({"key": key[hit], "start": (place - most)[hit], "end": (place - least + length)[hit]})


def _hot_windows(joined: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows among the anchors given, by counting window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                own = [(np.arange(f["place"] - f["high"], f["place"] - f["low"] + 1), 1 + f["many"]) for f in found.as_py()]
                start, times = np.concatenate([x for x, _ in own]), np.concatenate([np.full(len(x), n) for x, n in own])
                flat = np.frombuffer(data, np.uint8)
                one, two = Hashes(flat).of(start, length), Hashes(flat[::-1]).of(len(flat) - start - length, length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), key)), pa.array(start), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(times, pa.int64())], ["key", "start", "w1", "w2", "times"])

    windows = common.cut(joined.mapInArrow(run, "key long, start long, w1 long, w2 long, times long"))
    again = windows.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").select("w1", "w2")
    return windows.join(again, ["w1", "w2"], "left_semi").select("key", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, start, end of stretches in which every byte is in a repeated window; they may overlap. docs: key, text."""
    found = common.cut(_anchor_rows(docs, length, gram))
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("gram")
    again = common.cut(found.join(often, "gram", "left_semi"))
    contexts = common.cut(again.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("key"), F.min_by(F.col("place"), F.col("key")).alias("place"), F.min("high").alias("high"), F.min("low").alias("low")))
    copied = again.join(contexts.filter("times > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    spans = copied.select("key", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end"))
    varied = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    sort = contexts.join(varied, "gram").select("key", "place", "high", "low", "gram", (F.col("times") > 1).alias("many"), (F.col("contexts") > hot).alias("hot"))
    sort = common.cut(sort.groupBy("key", "hot").agg(F.collect_list(F.struct("place", "high", "low", "gram", "many")).alias("found"), F.count(F.lit(1)).alias("n")))
    few, hot_ones = sort.filter(~F.col("hot")), sort.filter("hot")
    ranges = max(1, -(-(few.agg(F.sum("n")).first()[0] or 0) // RANGE))
    # only texts that have any anchors left to sort are shuffled
    texts = lambda rows: common.rows_with(docs.select("key", "text"), rows, "key").join(rows.select("key", "found"), "key")
    runs = _runs(texts(few), ranges, length)
    spans = spans.unionByName(runs.groupBy("range").applyInArrow(lambda t: _merge(t, length), "key long, start long, end long"))
    if hot_ones.isEmpty():
        return spans
    return spans.unionByName(_hot_windows(texts(hot_ones), length))


def merged_spans(spans: DataFrame) -> DataFrame:
    """key, start, end of the maximal runs of bytes that spans, which may overlap or touch, cover. Few runs are left of the
    many spans of a repeated passage."""
    w = Window.partitionBy("key").orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.distinct().withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1))
    return new.withColumn("run", F.sum("new").over(w)).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of df: the id, n_bytes, n_removed, n_spans and kept, the bytes that stay."""
    docs = common.ship(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64(F.col("id"), F.col("text")))
    runs = common.cut(merged_spans(repeated_spans(docs, length, gram, hot)))
    spans, several = runs.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), runs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, count, kept = [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data, pieces, at, n, removed = text.as_py().encode(), [], 0, 0, 0
                for a, b in sorted((s["start"], s["end"]) for s in own.as_py() or ()):
                    if not n or a > at:
                        n += 1
                        pieces.append(data[at:a])
                        removed += b - a
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                pieces.append(data[at:])
                size.append(len(data))
                gone.append(removed)
                count.append(n)
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    # up to common.FEW runs go to every task, so that texts stay where they are; more are joined by a shuffle
    rows = docs.join(F.broadcast(spans) if several <= common.FEW else spans, "key", "left").select("id", "text", "spans")
    schema = T.StructType([rows.schema.fields[0], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
