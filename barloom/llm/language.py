"""Language identification with spans, by script ranges, per-word scores and Viterbi.

A word is a maximal run of letters. Its script narrows the candidate languages to those seen in that script; each gets a
score from hashed character n-grams of the word. Viterbi with a switching penalty then labels the words of a text, which
splits mixed text into spans; the text's language is the one with most letters, the score its share of all letters.

Null and empty texts, and texts without a letter, are `und` with score 0. A word whose script no language was learnt in
keeps every language as candidate, all equal. With nothing to learn from, every text is `und`. Equal rows get equal
results; ties go to the language first in order. Very long texts are scored in pieces of whole words. An empty table
gives an empty result; other columns are ignored or carried."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: First code point of each script's ranges (Unicode blocks). Fixed values.
SCRIPT_RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPTS = len(SCRIPT_RANGES) + 1
UNKNOWN = "und"
#: Code points scored at once, and words whose paths are found at once.
PIECE, PATHS = 150_000, 150_000
#: Numbers of languages.
LABEL = np.int16


@cache
def script_table() -> np.ndarray:
    """0 for what is no letter, else the number of its script; letters of other scripts share the last number."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    out = np.where(letter, SCRIPTS, 0).astype(np.int8)
    for k, ranges in enumerate(SCRIPT_RANGES.values(), 1):
        for a, b in ranges:
            out[a : b + 1] = np.where(letter[a : b + 1], k, 0)
    return out


@dataclass
class Model:
    """grams[size]: log probability of a hashed n-gram by language; scripts[script, language]: seen or not."""

    languages: list[str]
    grams: list[np.ndarray]
    scripts: np.ndarray
    penalty: float


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts put end to end: code points (0 for no letter), and each word's start, length and text."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.int32)
    letter = script_table()[code] > 0
    code = np.where(letter, code, 0)
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edge = np.concatenate([[0], edge]) if len(letter) and letter[0] else edge
    start, size = edge[::2], edge[1::2] - edge[::2]
    return code, start, size, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[start] if len(start) else np.empty(0, np.int64)


def gram_hashes(code: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """n-grams of 2, 3 and 4 code points that end inside a word or just after it, its borders counted as one: their
    places and words, and for each size the bucket, or -1 where the n-gram would begin before the border."""
    word = np.repeat(np.arange(len(start)), size + 1)
    place = np.repeat(start, size + 1) + np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    inside = place - start[word]
    back = [code[np.maximum(place - k, 0)].astype(np.uint32) for k in range(4)]
    back[1][(inside == 0)] = 0
    out, mixed = [], back[0] * np.uint32(0x9E3779B1)
    for k in range(1, 4):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + back[k] * np.uint32(0xC2B2AE35)
        bucket = ((mixed ^ (mixed >> np.uint32(16))) % np.uint32(buckets)).astype(np.int32)
        out.append(np.where(inside >= k - 1, bucket, -1))
    return place, word, out


def word_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of every language, letters, and number of the text, for each word."""
    code, start, size, text = words_of(texts)
    if not len(start):
        return np.empty((0, len(model.languages)), np.float32), size, text
    _, word, buckets = gram_hashes(code, start, size, len(model.grams[0]))
    each = sum(np.where((b >= 0)[:, None], g[b], np.float32(0)) for b, g in zip(buckets, model.grams, strict=True)) / np.float32(len(model.grams))
    first = np.cumsum(size + 1) - size - 1
    scores = np.add.reduceat(each, first, axis=0)
    seen = model.scripts[script_table()[code[start]]]
    scores[~seen & seen.any(1)[:, None]] = -1e6
    scores[~seen.any(1)] = 0
    return scores, size, text


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, where a change of label costs the penalty. All texts take a step at a time."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(steps), side="left")
    label = np.zeros(len(scores), LABEL)
    if not steps:
        return label
    own = np.arange(scores.shape[1], dtype=LABEL)
    came = np.empty((len(scores), scores.shape[1]), LABEL)
    value = scores[first[: active[0]]].astype(np.float64)
    last = np.empty(active[0], LABEL)
    for t in range(1, steps + 1):
        now = active[t] if t < steps else 0
        last[now : len(value)] = value[now:].argmax(1)
        if not now:
            break
        value = value[:now]
        top = value.argmax(1)
        switch = value[np.arange(now), top] - penalty
        stay = value >= switch[:, None]
        at = first[:now] + t
        came[at] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, switch[:, None]) + scores[at]
    state = np.empty(active[0], LABEL)
    for t in range(steps - 1, -1, -1):
        n, after = active[t], active[t + 1] if t + 1 < steps else 0
        state[after:n] = last[after:n]
        at = first[:n] + t
        if after:
            state[:after] = came[at[:after] + 1, state[:after]]
        label[at] = state[:n]
    return label


def whole_word_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about that many code points, cut where no word is; only a longer word is cut itself."""
    a = 0
    while True:
        b = a + size
        if b < len(text):
            while b > a and text[b].isalpha() and text[b - 1].isalpha():
                b -= 1
            b = b if b > a else a + size
        yield text[a:b]
        a = b
        if a >= len(text):
            return


def label_texts(texts: list[str], model: Model) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]], list[float]]:
    """Language, score, spans (first word, words, language) and fit, the share of letters in learnt scripts, of each text."""
    pieces, held, held_size = [], [], 0
    for n, text in enumerate(texts):
        for piece in whole_word_pieces(text):
            held.append((n, piece))
            held_size += len(held[-1][1])
            if held_size >= PIECE:
                pieces.append(held)
                held, held_size = [], 0
    pieces.append(held)
    parts = []
    for held in pieces:
        if held:
            scores, size, text = word_scores([t for _, t in held], model)
            parts.append((scores, size, np.array([n for n, _ in held])[text]))
    if not parts:
        return [], [], [], []
    scores, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    label = best_paths(scores, first, count, model.penalty)
    many = len(model.languages)
    letters = np.bincount(text * many + label, weights=size, minlength=len(texts) * many).reshape(len(texts), many)
    total, best = letters.sum(1), letters.argmax(1)
    names = [model.languages[b] if s else UNKNOWN for b, s in zip(best, total, strict=True)]
    share = np.where(total > 0, letters[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
    spans = []
    for n in range(len(texts)):
        own = label[first[n] : first[n] + count[n]]
        cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
        spans.append([(int(a), int(b - a), model.languages[own[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    fit = np.bincount(text, weights=size * scores.any(1), minlength=len(texts)) / np.maximum(total, 1)
    return names, share.tolist(), spans, fit.tolist()


def _fit_rows(df: DataFrame, lang_col: str, id_col: str, text_col: str, per_language: int) -> DataFrame:
    """At most per_language texts of each language, those with the smallest hash of their id."""
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    picked = common.smallest_hashes(known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id")), "lang", "id", per_language)
    rows = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(picked.distinct()), ["lang", "id"], "left_semi").select("lang", "text")  # per_language short rows a language


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, buckets: int = 1 << 15, penalty: float = 6.0) -> Model:
    """Fits the model on at most per_language labelled texts of each language; the counts that come to the driver are
    at most 3 * buckets numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, of_lang in texts.items():
                code, start, size, _ = words_of(of_lang)
                own = held.setdefault(lang, np.zeros(3 * buckets + SCRIPTS + 1, np.int64))
                if len(start):
                    for k, b in enumerate(gram_hashes(code, start, size, buckets)[2]):
                        own[k * buckets : (k + 1) * buckets] += np.bincount(b[b >= 0], minlength=buckets)
                    own[3 * buckets :] += np.bincount(script_table()[code[start]], minlength=SCRIPTS + 1)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "at", "n"])

    rows = _fit_rows(common.ship(df), lang_col, id_col, text_col, per_language)
    found = rows.mapInArrow(common.tidied(count), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(found["lang"]))
    counts = np.zeros((3 * buckets + SCRIPTS + 1, len(languages)))
    counts[found["at"], [languages.index(x) for x in found["lang"]]] = found["n"]
    grams = []
    for k in range(3):
        part = counts[k * buckets : (k + 1) * buckets] + 0.1
        grams.append(np.log(part / part.sum(0)).astype(np.float32))
    scripts = counts[3 * buckets :]
    return Model(languages, grams, scripts >= 0.01 * np.maximum(scripts.sum(0), 1), penalty)


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType())]))


def detect(df: DataFrame, model: Model, text_col: str = "text", carry: dict[str, Column] | None = None, with_spans: bool = False) -> DataFrame:
    """The carried columns (all of df's if none are named) with lang_pred, score, fit and, if asked for, spans."""
    carry = carry if carry is not None else {c: F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score", "fit", "spans")}
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by buckets and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and held < 6 * PATHS:
                    texts.append(batch.column(0)[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                names, share, spans, fit = label_texts(texts, model) if model.languages else ([UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts), [0.0] * len(texts))
                part = batch.slice(at, len(texts))
                cols = [*part.columns[1:], pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(fit, pa.float64())]
                if with_spans:
                    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
                    cols.append(pa.array([[{"first_word": a, "n_words": b, "lang": c} for a, b, c in s] for s in spans], kind))
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[1:], "lang_pred", "score", "fit", *["spans"] * with_spans])
                at += len(texts)

    rows = common.ship(df).select(F.col(text_col).cast("string").alias(common.free_name("text", carry)), *[c.alias(k) for k, c in carry.items()])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType()), *[T.StructField("spans", SPANS)] * with_spans])
    return rows.mapInArrow(common.tidied(run), schema)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", min_fit: float = 0.5) -> DataFrame:
    """The rows, with df's columns, that have letters, at least min_fit of them in scripts of learnt languages. A text in
    several languages is identified span by span, so none of them need prevail."""
    rows = detect(df, model, text_col, {"row": F.struct(*[F.col(f"`{c}`") for c in df.columns])})
    return common.unwrap(rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("fit") >= min_fit)), df.columns)


def held_out() -> Column:
    return common.bucket_of_id("doc_id", 4) == 2


def learn_documents(docs: DataFrame) -> Model:
    return learn(docs.filter(~held_out()))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return detect(docs, learn_documents(docs), carry={"doc_id": F.col("doc_id"), "held_out": held_out()})
