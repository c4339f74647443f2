"""Hard negatives against brute force, and the parts of the index."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import hard_negatives as hn
from barloom.llm.maxscore import whole_numbers


def brute(rows):
    """rows: id, vector, label."""
    used = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, [math.floor(256 * x) for x in v], lab))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731,B905  shorter vectors end in zeros
    out = []
    for k, (i, v, lab) in enumerate(used):
        if i % 100:
            continue
        others = sorted((-dot(v, w), j, other) for n, (j, w, other) in enumerate(used) if n != k)
        for minus, j, other in [x for x in others if x[2] == lab][:5]:
            p = -minus
            fit = [(-m, n) for m, n, other in others if other != lab and 80 * p <= 100 * -m <= 100 * p][:5]
            out += [(i, j, rank, n, p, score) for rank, (score, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **build):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, piece int, wins string")
    return sorted(tuple(r) for r in hn.hard_negatives(df.select(F.col("vec_id").alias("id"), "label", whole_numbers(F.col("embedding"), 256).alias("vector"), "piece", "wins"), "id % 100 = 0", **build).collect())


def test_hard_negatives_against_brute_force(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for k in range(700):
        c = centres[0 if k % 3 == 0 else rng.randrange(5)]  # a hot cell
        rows.append((k, [round(x + rng.gauss(0, 0.2), 1) for x in c], rng.randrange(3)))
    rows += [(800 + k, rows[5][1], 1) for k in range(40)]  # equal vectors
    rows += [(100, rows[7][1], 2), (100, rows[8][1], 1), (250, [0.5], 1), (251, [], 2), (260, None, 1), (None, rows[3][1], 1), (261, rows[3][1], None), (262, [None, 1.0], 1), (300, [math.nan] * 6, 1), (400, [math.inf, 1.0], 2)]
    rows += [(-100, [-x for x in rows[4][1]], 1), (1000, [0.0] * 6, 0)]
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows, codes=4, piece=50, first=30) == want
    assert mined(spark, rows, codes=1, piece=1000, first=0) == want


def test_hard_negatives_edges(spark):
    df = spark.createDataFrame([], "id long, label int, vector array<long>")
    assert hn.hard_negatives(df, "id % 100 = 0").count() == 0
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == [] and mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == brute([(0, [], 1), (1, [], 1), (2, [], 2)])
    assert mined(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]) == []  # no anchor


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (7, 3), (9, 9)):
        a, b = rng.normal(size=n), np.round(rng.normal(size=m), 1)
        got = list(hn.falling_cells(a, b))
        assert sorted((i, j) for i, j, _ in got) == [(i, j) for i in range(n) for j in range(m)]
        bounds = [x for _, _, x in got]
        assert bounds == sorted(bounds, reverse=True) and all(math.isclose(x, a[i] + b[j]) for i, j, x in got)


def test_bounds_hold_for_every_member_and_rounds_part_the_cells():
    rng = np.random.default_rng(2)
    points = rng.integers(-900, 900, (400, 8))
    books = [hn.fit_codebook(points[:, :4], 5), hn.fit_codebook(points[:, 4:], 5)]
    (i, d1), (j, d2) = hn.nearest(points[:, :4], books[0]), hn.nearest(points[:, 4:], books[1])
    radii = [np.array([d[c == k].max(initial=0) for k in range(5)]) for c, d in ((i, d1), (j, d2))]
    rows = {}
    for cell in zip(i.tolist(), j.tolist(), strict=True):
        rows[cell] = rows.get(cell, 0) + 1
    directory = hn.Directory(books, radii, rows, 3)
    for q in rng.integers(-900, 900, (20, 8)):
        (h1, h2), (l1, l2) = directory.bounds(q)
        scores = points @ q
        assert (scores <= h1[i] + h2[j]).all() and (scores >= l1[i] + l2[j]).all()
        low, high = int(np.quantile(scores, 0.3)), int(np.quantile(scores, 0.9))
        wins = [{"w": 0, "low": low, "high": high, "floor": low}]
        early = {p for p, _ in directory.visits(q, wins, False, 60)}
        later = {p for p, _ in directory.visits(q, wins, True, 60)}
        assert not early & later
        inside = {directory.number(int(a), int(b)) for a, b, s in zip(i, j, scores, strict=True) if low <= s <= high}
        assert inside <= early | later
