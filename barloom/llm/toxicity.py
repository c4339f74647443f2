"""Toxicity scores from a learnt, weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin, digits and signs that stand for letters
to those letters. The lexicon holds whole words and word beginnings whose document frequency among toxic texts is far
above that among others. The weight is the lower confidence bound of the smoothed log odds, so how many texts a term needs
depends on the sizes of the classes, and a term seen in few weighs little. Hits inside exception phrases do not count. The sum
of weights and its share of the text's length give the score through a fitted logistic curve.

Null and empty texts have no hits and get the score of a text without hits. Equal texts get equal scores. Rows without a
label teach nothing; with none of one class, the lexicon is empty and every score is the share of toxic labels. Very long
texts are folded and matched whole. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Look-alikes and substitutions, each with the letter it stands for. Fixed values.
HOMOGLYPHS = dict(zip("аеорсухікмтвнѕјԁɡοαενρτυκιχ", "aeopcyxikmtbhsjdgoaevptukix", strict=False))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FULLWIDTH = {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)}
#: Harmless phrases that hold words of abuse.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid mistake of mine", "sore loser board")
WORD = re.compile(r"[^\W_]+")
#: Signs that stand for letters do so inside a word only.
SIGNS = re.compile(r"(?<=\w)[@$!](?=\w)")
#: A learnt word beginning has so many letters at least and at most.
BEGINNINGS = range(4, 7)


@cache
def _letters() -> dict[int, str]:
    return str.maketrans({**HOMOGLYPHS, **FULLWIDTH})


_DIGITS = str.maketrans({k: v for k, v in SUBSTITUTES.items() if k.isdigit()})


def fold(text: str) -> str:
    """Digits are replaced in words that also hold a letter, so numbers stay numbers."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_letters())
    if "@" in text or "$" in text or "!" in text:
        text = SIGNS.sub(lambda m: SUBSTITUTES[m[0]], text)
    return _MIXED.sub(lambda m: m[0].translate(_DIGITS), text)


_MIXED = re.compile(r"(?:[^\W\d_]+\d|\d+[^\W\d_])\w*")


@dataclass
class Lexicon:
    """words and beginnings with their weights; phrases in which they don't count; the curve's coefficients."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = field(default=(0.0, 0.0, 0.0))
    _tree: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tree"}

    def tree(self) -> ahocorasick.Automaton:
        """Built in the worker. Values: length, weight, whether the whole word must match, whether an exception."""
        if self.__dict__.get("_tree") is None:
            tree = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for w, weight in self.beginnings.items():
                entries.setdefault(w, []).append((len(w), weight, False, False))
            for w, weight in self.words.items():
                entries.setdefault(w, []).append((len(w), weight, True, False))
            for w in self.exceptions:
                entries.setdefault(w, []).append((len(w), 0.0, True, True))
            for w, values in entries.items():
                tree.add_word(w, values)
            tree.make_automaton()
            self._tree = tree
        return self._tree

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """start, end, weight of the hits outside exception phrases; of hits that begin together the heaviest."""
        tree = self.tree()
        if not tree.kind == ahocorasick.AHOCORASICK:
            return []
        found, exempt = {}, []
        for last, values in tree.iter(folded):
            for size, weight, whole, exception in values:
                a, b = last - size + 1, last + 1
                if (a and folded[a - 1].isalnum()) or (whole and b < len(folded) and folded[b].isalnum()):
                    continue
                if exception:
                    exempt.append((a, b))
                elif found.get(a, (0, 0.0))[1] < weight:
                    found[a] = (b, weight)
        out, reach, ahead = [], 0, iter(sorted(exempt) + [(len(folded) + 1, 0)])
        begin, end = next(ahead)
        for a, (b, w) in sorted(found.items()):  # both by their begin: reach is the furthest end of phrases begun so far
            while begin <= a:
                reach, (begin, end) = max(reach, end), next(ahead)
            if b > reach:
                out.append((a, b, w))
        return out

    def features(self, text: str | None) -> tuple[float, float, int]:
        """log of the summed weight, log of its density per thousand characters, number of hits."""
        folded = fold(text or "")
        found = self.hits(folded)
        total = sum(w for _, _, w in found)
        return math.log1p(total), math.log1p(1000 * total / (len(folded) + 200)), len(found)

    def score(self, features: tuple[float, float, int]) -> float:
        x = self.curve[0] + self.curve[1] * features[0] + self.curve[2] * features[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    hold = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (y - p) - hold @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int) -> DataFrame:
    """text, y of at most per_class labelled rows of each class, those with the smallest hash of their id."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = common.smallest_hashes(known, "y", "doc_id", per_class)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("text", "y")  # at most 2 * per_class short rows


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 10_000, min_odds: float = 3.0, sure: float = 2.576, most: int = 2_000) -> Lexicon:
    """Fits the lexicon and the curve on at most per_class labelled texts of each class.

    Document frequencies of words and beginnings are counted by Spark; at most `most` entries come to the driver, then
    three numbers a sampled text for the curve. A term's log odds are at least `min_odds`, and `sure` standard errors less
    (2.576: 99 %) is its weight, which must be above 0."""
    sample = common.cut(_sample(common.ship(docs), labels, label_col, per_class))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, y = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(fold(text or "")))
                own = {f"={w}" for w in words} | {w[:k] for w in words for k in BEGINNINGS if len(w) >= k}
                term += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(y, pa.int32())], ["term", "y"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        share = min(max(pos / max(pos + neg, 1), 1e-6), 1 - 1e-6)
        return Lexicon({}, {}, curve=(math.log(share / (1 - share)), 0.0, 0.0))
    counted = sample.mapInArrow(terms, "term string, y int").groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).filter(F.col("t") > 0)
    odds = F.log((F.col("t") + 0.5) / (pos + 1.0)) - F.log((F.col("c") + 0.5) / (neg + 1.0))
    error = F.sqrt(1 / (F.col("t") + 0.5) - 1 / (pos + 1.0) + 1 / (F.col("c") + 0.5) - 1 / (neg + 1.0))
    rows = counted.filter(odds >= min_odds).withColumn("weight", odds - sure * error).filter("weight > 0").orderBy(F.desc(F.col("weight") * F.col("t")), "term").limit(most).collect()
    words, beginnings = {}, {}
    for r in sorted(rows, key=lambda r: (len(r["term"].lstrip("=")), r["term"].startswith("="))):
        term, whole = r["term"].lstrip("="), r["term"].startswith("=")
        if any(term[:k] in beginnings and beginnings[term[:k]] >= r["weight"] - 0.7 for k in BEGINNINGS):
            continue  # a shorter beginning says as much
        (words if whole else beginnings)[term] = r["weight"]
    lexicon = Lexicon(words, beginnings)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1)], ["total", "density", "y"])

    got = sample.mapInArrow(features, "total double, density double, y int").toPandas()
    weights = np.column_stack([got["total"], got["density"]])
    lexicon.curve = fit_curve(weights, got["y"].to_numpy(float))
    return lexicon


def score_texts(df: DataFrame, lexicon: Lexicon, text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """The carried columns (the id if none are named) with score, predicted and n_hits."""
    carry = carry or {"doc_id": F.col("doc_id")}
    rows = common.ship(df).select(F.col(text_col).cast("string").alias(common.free_name("text", carry)), *[c.alias(k) for k, c in carry.items()])
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # a bounded number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            found = [lexicon.features(t.as_py()) for t in batch.column(0)]
            score = [lexicon.score(f) for f in found]
            cols = [*batch.columns[1:], pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[1:], "score", "predicted", "n_hits"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.LongType())]))


def held_out() -> Column:
    return common.bucket_of_id("doc_id", 5) == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    lexicon = learn(docs.filter(~held_out()), labels.filter(~held_out()))
    return score_texts(docs, lexicon, carry={"doc_id": F.col("doc_id"), "held_out": held_out()})
