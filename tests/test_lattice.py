"""Parameter lattices against one predicate per grid point."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import lattice
from barloom.functions import rules as rl
from barloom.operators import screening as sc

X, Y, Z = {"ind": "x"}, {"ind": "y"}, {"ind": "z"}


def spec(entry, grids, **more):
    return {"slug": "s", "name": "S", "horizon": "swing", "universe": {}, "entry": entry, "params": {k: {"default": v[0], "grid": v} for k, v in grids.items()},
            "exit": {"stop": {"type": "pct", "value": 0.1}, "target": None, "max_hold_days": 5}, "rank": {"by": [{"ind": "x", "dir": "desc"}], "max_new_per_day": 2}, **more}


LATTICE = spec({"all": [{"left": X, "op": ">", "right": {"param": "a"}}, {"left": {"param": "a"}, "op": ">=", "right": {"sub": [Y, 3]}}, {"all": [{"left": Y, "op": "between", "right": [{"param": "b"}, {"param": "c"}]}]}, {"not": {"left": Z, "op": "<", "right": 1}}]},
               {"a": [3, 1, 2, 2], "b": [0, 2, 4], "c": [1, 5]})
NONE = spec({"any": [{"left": X, "op": ">", "right": {"param": "a"}}, {"left": Y, "op": ">", "right": {"mul": [2, {"param": "a"}]}}]}, {"a": [1, 2]})


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(3)
    rows = [(f"S{k % 9}", f"2020-01-{k // 9 + 1:02d}", 10.0, *[rng.choice([None, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]) for _ in range(3)]) for k in range(250)]
    return spark.createDataFrame(rows, "symbol string, date string, close_raw double, x double, y double, z double").withColumn("date", F.to_date("date"))


def brute(features, s):
    return {tuple(sorted(p.items())): features.filter(rl.entry_column(s, features.columns, p)).count() for p in rl.param_grid(s)}


def test_counts_at_every_point(features):
    got = {tuple(sorted(zip("abc", (r.a, r.b, r.c), strict=True))): r.n_hits for r in lattice.counts(features, LATTICE).collect()}
    want = brute(features, LATTICE)
    assert len(got) == 18 and got == {tuple((k, float(v)) for k, v in p): n for p, n in want.items()} and len(set(want.values())) > 4


def test_a_thousand_points_in_one_plan(spark, features):
    s = spec(LATTICE["entry"], {"a": [k / 2 for k in range(10)], "b": [k / 3 for k in range(10)], "c": [k / 2 for k in range(10)]})
    plan = lattice.counts(features, s)
    assert plan.count() == 1000 and plan._jdf.queryExecution().optimizedPlan().toString().count("Filter") < 6


def test_sweep_equals_a_scan_of_every_point(features):
    key = lambda df: sorted((r.rule, r.variant, str(r.date), r.symbol, r["rank"], round(r.score, 9)) for r in df.collect())
    both = [LATTICE, {**NONE, "slug": "n", "rank": {"by": [{"ind": "x", "dir": "desc"}, {"ind": "z", "dir": "asc"}], "max_new_per_day": 2}}]
    points = sc.variants_of([{**s, "params": {k: {"default": 0, "grid": sorted(set(p["grid"]))} for k, p in s["params"].items()}} for s in both], grid=True)
    got, want = key(sc.sweep(features, both)), key(sc.scan(features, points))
    assert got == want and len({v for _, v, *_ in got}) > 10


def test_what_is_no_lattice(features):
    assert lattice.split(NONE) is None and lattice.boxes(features, NONE) is None
    assert lattice.split(spec({"not": {"left": X, "op": ">", "right": {"param": "a"}}}, {"a": [1]})) is None
    with pytest.raises(ValueError, match="no lattice"):
        lattice.counts(features, NONE)
    with pytest.raises(KeyError, match="unknown key"):
        lattice.boxes(features, {**LATTICE, "entri": 1})
