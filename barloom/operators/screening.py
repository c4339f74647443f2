"""Evaluate many rules over all days at once: candidates, cross-sectional scores, daily picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import lattice
from barloom.functions import rules as rl
from barloom.functions.joins import average_rank
from barloom.functions.lineage import cut
from barloom.functions.windows import add_weekdays, latest_per, symbol_window

KEYS = ["rule", "variant", "date"]
PICK_KEY = ["rule", "variant", "exchange", "symbol", "date"]


def variants_of(specs: list[dict], grid: bool = False) -> list[tuple[dict, dict]]:
    """(spec, parameters) pairs: the defaults, or every point of each rule's grid."""
    return [(s, p) for s in specs for p in (rl.param_grid(s) if grid else [rl.resolve_params(s)])]


def variant_name(params: dict) -> str:
    return ",".join(f"{k}={params[k]:g}" for k in sorted(params))


def with_previous(features: DataFrame, specs: list[dict]) -> DataFrame:
    """Previous-day values of the features that crossing rules read."""
    need = sorted(set().union(set(), *[rl.crossed_features(s["entry"]) for s in specs]))
    w = symbol_window("symbol")
    return features.select("*", *[F.lag(c).over(w).alias(rl.PREV + c) for c in need if rl.PREV + c not in features.columns])


def _hit(spec: dict, variant: Column, n_keys: int) -> list[Column]:
    """What a candidate carries on: its rule, its exit distances and its rank keys."""
    keys, ex = spec["rank"]["by"], spec["exit"]
    rank = []
    for i in range(n_keys):
        k = keys[i] if i < len(keys) else None
        rank += [(F.col(rl.feature_name(k["ind"], k.get("period"))) if k else F.lit(None)).cast("double").alias(f"r{i}"),
                 F.lit(float(k.get("weight", 1.0)) if k else 0.0).alias(f"w{i}"), F.lit(bool(k) and k["dir"] == "asc").alias(f"asc{i}")]
    return [F.lit(spec["slug"]).alias("rule"), variant.alias("variant"), F.lit(spec["horizon"]).alias("horizon"),
            F.lit(int(ex["max_hold_days"])).alias("hold_days"), F.lit(int(spec["rank"]["max_new_per_day"])).alias("k"),
            rl.distance(ex.get("stop")).alias("stop_pct"), rl.distance(ex.get("target")).alias("target_pct"),
            F.lit(ex.get("stop") is not None).alias("needs_stop"), F.lit(ex.get("target") is not None).alias("needs_target"), *rank]


def candidates(features: DataFrame, variants: list[tuple[dict, dict]], n_keys: int = 1) -> DataFrame:
    """Rows passing each rule, one pass over the features: every (rule, parameters) is a predicate in
    one projection, and only the hits are exploded."""
    cols, n_keys = features.columns, max(n_keys, *[len(s["rank"]["by"]) for s, _ in variants])
    hits = [F.when(rl.entry_column(spec, cols, params), F.struct(*_hit(spec, F.lit(variant_name(params)), n_keys))) for spec, params in variants]
    return features.select("symbol", "date", "close_raw", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("symbol", "date", "close_raw", "h.*")


def grid_candidates(features: DataFrame, specs: list[dict]) -> DataFrame:
    """Rows passing each grid point of each rule. A rule whose parameters are bare thresholds is evaluated once, for the box
    of points that a row passes, and only these are exploded; any other rule has a predicate per point."""
    n_keys, out = max(len(s["rank"]["by"]) for s in specs), []
    for spec in specs:
        boxed = lattice.boxes(features, spec)
        if boxed is not None:
            out.append(lattice.points(boxed, spec).select("symbol", "date", "close_raw", *_hit(spec, F.col("_variant"), n_keys)))
    rest = [s for s in specs if lattice.split(s) is None]
    if rest:
        out.append(candidates(features, variants_of(rest, grid=True), n_keys))
    return reduce(DataFrame.unionByName, out)


def score(cands: DataFrame) -> DataFrame:
    """Weighted mean of percentile ranks among the day's candidates, 0 to 100. The best value scores 1
    whichever direction is best, ties share the mean rank, a missing value scores 0.

    The candidates are cut once, since ranks and the final join both read them; the rank keys are
    stacked, so all of them are ranked in one pass. The keys of a row are added in their order: sums in the order of
    arrival differ in their last digits, which decide ties.
    """
    n_keys = sum(1 for c in cands.columns if c.startswith("asc"))
    base = cut(cands)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"r{i}").alias("v"), F.col(f"w{i}").alias("w"), F.col(f"asc{i}").alias("asc")) for i in range(n_keys)])
    long = base.select(*KEYS, "symbol", F.explode(keys).alias("x")).select(*KEYS, "symbol", F.col("x.i").alias("key"), "x.v", "x.w", "x.asc").filter("w <> 0")
    ranked = average_rank(long, [*KEYS, "key"], "v", "_rank", "_n")
    pct = F.when(F.col("asc"), (F.col("_n") + 1 - F.col("_rank")) / F.col("_n")).otherwise(F.col("_rank") / F.col("_n"))
    def added(c: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.when(F.col("key") == i, c)), F.lit(0.0)) for i in range(n_keys)])
    total = ranked.groupBy(*KEYS, "symbol").agg((added(F.col("w") * F.coalesce(pct, F.lit(0.0))) / added(F.col("w")) * 100).alias("score"))
    return base.join(total, [*KEYS, "symbol"])


def top_per_day(scored: DataFrame, max_k: int, held: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of every (rule, variant, day), ties by symbol; names in ``held`` (KEYS + symbol)
    are left out first. The constant bound lets each map task keep only ``max_k`` rows per key."""
    free = scored if held is None else scored.join(held, [*KEYS, "symbol"], "left_anti")
    w = Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), F.col("symbol"))
    return (free.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_k).filter(F.col("rank") <= F.col("k")))


def with_protection(ranked: DataFrame) -> DataFrame:
    """Drop picks whose rule demands a stop or target that cannot be computed."""
    return ranked.filter((~F.col("needs_stop") | F.col("stop_pct").isNotNull()) & (~F.col("needs_target") | F.col("target_pct").isNotNull()))


def window_end(signal: Column, hold: Column) -> Column:
    """Last weekday of the holding window: hold + 1 weekdays after the signal (holidays not considered)."""
    return add_weekdays(signal, hold + 1)


def _picks(cands: DataFrame, specs: list[dict], exchange: str, held: DataFrame | None) -> DataFrame:
    max_k = max(s["rank"]["max_new_per_day"] for s in specs)
    top = with_protection(top_per_day(score(cands), max_k, held))
    names = F.create_map(*[x for s in {s["slug"]: s for s in specs}.values() for x in (F.lit(s["slug"]), F.lit(s["name"]))])
    ref = F.col("close_raw")
    return top.select("rule", "variant", "horizon", F.lit(exchange).alias("exchange"), "symbol", "date", "rank", "score", ref.alias("ref_price"),
                      (ref * (1 - F.col("stop_pct"))).alias("stop_price"), (ref * (1 + F.col("target_pct"))).alias("target_price"),
                      "stop_pct", "target_pct", "hold_days", window_end(F.col("date"), F.col("hold_days")).alias("window_end"), names[F.col("rule")].alias("reason"))


def _on_day(features: DataFrame, specs: list[dict], day) -> DataFrame:
    f = with_previous(features, specs)
    return f if day is None else f.filter(F.col("date") == F.lit(day).cast("date"))


def scan(features: DataFrame, variants: list[tuple[dict, dict]], day=None, exchange: str = "NSE", held: DataFrame | None = None) -> DataFrame:
    """Picks of every rule on every day (or one day)."""
    specs = [s for s, _ in variants]
    return _picks(candidates(_on_day(features, specs, day), variants), specs, exchange, held)


def upsert_picks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing picks stay, picks with an unseen key are appended; ``is_new`` tells which."""
    fresh = new.join(existing.select(*PICK_KEY), PICK_KEY, "left_anti").withColumn("is_new", F.lit(True))
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh)


def upsert_counts(merged: DataFrame, new: DataFrame) -> DataFrame:
    """Inserted and already known rows per rule among the new picks."""
    seen = new.select(*PICK_KEY).join(merged.select(*PICK_KEY, "is_new"), PICK_KEY)
    return seen.groupBy("rule").agg(F.count(F.when(F.col("is_new"), 1)).alias("inserted"), F.count(F.when(~F.col("is_new"), 1)).alias("known"))


def preview(features: DataFrame, variants: list[tuple[dict, dict]], status: dict[str, str], day=None) -> DataFrame:
    """The same scan over rules that are not live, stamped with their status."""
    chosen = [(s, p) for s, p in variants if status.get(s["slug"]) in ("candidate", "draft", "rejected")]
    stamp = F.create_map(*[x for s, _ in chosen for x in (F.lit(s["slug"]), F.lit(status[s["slug"]]))])
    return scan(features, chosen, day).withColumn("status", stamp[F.col("rule")])


def sweep(features: DataFrame, specs: list[dict], day=None, exchange: str = "NSE", held: DataFrame | None = None) -> DataFrame:
    """Picks of every parameter point of every rule in one pass."""
    return _picks(grid_candidates(_on_day(features, specs, day), specs), specs, exchange, held)
