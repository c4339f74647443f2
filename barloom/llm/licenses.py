"""License notices by diagonal voting.

Every rolling bigram of a text's words is joined by hash to the places where it stands in the notice templates. A hit at
word p of the text and word q of a template votes for the diagonal p - q, the place where the template would begin.
A diagonal and the next WIDTH, as inserted or dropped words make them, are a span. It is verified by the share of the
template's bigrams that voted, each counted once, and the words that tell a notice from its siblings must be among them. A base phrase is found where every one of its bigrams votes on one diagonal: there its
words stand consecutively.

Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. Null texts count as empty and have no
words. Every row gets a row, also rows that repeat an id or have a null one. Very long texts are exploded word by word
and need no more memory than their words. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label and phrase, found where the words stand consecutively.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: label and opening words of public license notices, found also with some words changed.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("public-domain", "released into the public domain"),
)
#: Words that stand together in a notice of the label and tell it from its siblings.
TELLING = {"apache": "apache", "cc-by-nc": "nc", "cc-by-sa": "sa", "gpl": "gnu general", "lgpl": "lesser", "mpl": "mozilla", "public-domain": "domain"}
#: Share of a notice's bigrams that a span needs (a changed word costs three), and the distance of diagonals that are merged.
COVERAGE, NEAR = 0.55, 2
#: Diagonals of a span after its first: two steps.
WIDTH = 2 * NEAR


def template_rows(base: tuple = BASE, notices: tuple = NOTICES) -> list[tuple]:
    """template, base, label, bigrams, q, the words at q, q + 1 and q + 2, and whether they hold the telling words."""
    rows = []
    for number, (label, phrase) in enumerate([*base, *notices]):
        words = phrase.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {phrase}")
        key = TELLING.get(label, "").split() if number >= len(base) else []
        keyed = any(words[k : k + len(key)] == key for k in range(len(words))) and bool(key)
        for q in range(len(words) - 1):
            seen = words[q : q + 3]
            tells = not keyed or any(seen[k : k + len(key)] == key for k in range(len(seen)))
            rows.append((number, number < len(base), label, len(words) - 1, q, *seen[:2], seen[2] if len(seen) > 2 else None, tells))
    return rows


def templates(spark: SparkSession, base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row per bigram place: a fixed table of a few hundred short rows."""
    table = spark.createDataFrame(template_rows(base, notices), "template int, base boolean, label string, bigrams int, q int, t1 string, t2 string, t3 string, tells boolean")
    return table.withColumn("gram", F.xxhash64("t1", "t2"))


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """row (a number of the input row), the id, n_words, and for each span label, base, first_word, coverage,
    verified. A row of the input without hits has one row with null label."""
    text = common.ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.array_remove(F.split(text, SEPARATOR), "").alias("words"))
    grams = rows.select("row", "id", "words", F.posexplode_outer("words").alias("p", "w1"))
    grams = grams.select("row", "id", F.size("words").alias("n_words"), "p", "w1", F.get("words", F.col("p") + 1).alias("w2"), F.get("words", F.col("p") + 2).alias("w3"))
    known = F.broadcast(templates(df.sparkSession, base, notices))
    match = (F.xxhash64("w1", "w2") == F.col("gram")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("t3").isNull() | (F.col("t3") == F.col("w3")))
    hits = grams.join(known, match, "left").filter(F.col("gram").isNotNull() | (F.coalesce("p", F.lit(0)) == 0))
    votes = hits.groupBy("row", "id", "template", "base", "label", "bigrams", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.max("n_words").alias("n_words"), F.collect_set("q").alias("voted"), F.max("tells").alias("tells"))
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, WIDTH)
    voted = lambda c, wide: F.when(F.col("base"), F.col(c)).otherwise(wide)
    spans = votes.withColumn("all_voted", voted("voted", F.array_distinct(F.flatten(F.collect_list("voted").over(near))))).withColumn("tells", voted("tells", F.max("tells").over(near)))
    coverage = F.when(F.col("label").isNotNull(), F.size("all_voted") / F.col("bigrams"))
    verified = F.col("tells") & (coverage >= F.when(F.col("base"), 1.0).otherwise(COVERAGE))
    return spans.select("row", "id", "n_words", "label", "base", F.col("diagonal").alias("first_word"), coverage.alias("coverage"), verified.alias("verified"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row per row of df: the id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = license_spans(df, id_col, text_col, base, notices)
    sure = F.col("base") & F.col("verified")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("row", "id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(sure, 1)).alias("n_base"), F.min(F.when(sure, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(sure, F.col("first_word"))).cast("long").alias("last_word"), listed(sure).alias("base_labels"), listed(F.col("verified")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"))
    return out.drop("row").withColumnRenamed("id", id_col)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


OP1_SQL = rf"""
WITH t(template, base, label, bigrams, q, t1, t2, t3, tells) AS (VALUES {", ".join(f"({', '.join(map(_sql, r))})" for r in template_rows())}),
w AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{SEPARATOR}'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT row, p, words[p + 1] AS w1, words[p + 2] AS w2, words[p + 3] AS w3 FROM (SELECT row, words, unnest(range(len(words) - 1)) AS p FROM w)),
h AS (SELECT row, template, base, label, bigrams, q, tells, p - q AS diagonal FROM g JOIN t ON w1 = t1 AND w2 = t2 AND (t3 IS NULL OR w3 = t3)),
d AS (SELECT DISTINCT row, template, base, label, bigrams, diagonal FROM h),
s AS (SELECT d.*, count(DISTINCT h.q) / d.bigrams AS coverage, bool_or(h.tells) AS tells FROM d JOIN h ON h.row = d.row AND h.template = d.template AND h.diagonal BETWEEN d.diagonal AND d.diagonal + CASE WHEN d.base THEN 0 ELSE {WIDTH} END GROUP BY d.row, d.template, d.base, d.label, d.bigrams, d.diagonal),
k AS (SELECT *, tells AND coverage >= CASE WHEN base THEN 1 ELSE {COVERAGE} END AS verified FROM s)
SELECT w.doc_id, any_value(len(words)) AS n_words, count(*) FILTER (base AND verified) AS n_base, min(diagonal) FILTER (base AND verified) AS first_word, max(diagonal) FILTER (base AND verified) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND verified), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels, coalesce(max(coverage), 0) AS score
FROM w LEFT JOIN k ON w.row = k.row GROUP BY w.row, w.doc_id"""
