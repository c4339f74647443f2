"""Parameter grids of a rule as lattices.

A condition that compares something with a bare parameter is monotone: of the parameter's sorted grid values a row passes
all up to, or all from, one place. Several such conditions on one parameter leave a range, and the ranges of all parameters
a box. One pass over the rows finds every box; the grid points that a row passes are the points of its box, and the number
of rows at every point comes from the boxes' corners by running sums along each axis. No predicate is evaluated per point."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import rules as rl

MIRROR = {">": "<", ">=": "<=", "<": ">", "<=": ">="}


def axes(spec: dict) -> dict[str, list[float]]:
    """Sorted distinct grid values of each parameter, in the order of their names."""
    return {k: sorted({float(v) for v in p.get("grid") or [p["default"]]}) for k, p in sorted(spec.get("params", {}).items())}


def _params(node) -> set[str]:
    if isinstance(node, dict):
        return {node["param"]} if "param" in node else set().union(set(), *[_params(v) for v in node.values()])
    return set().union(set(), *[_params(v) for v in node]) if isinstance(node, list) else set()


def _is_param(node) -> bool:
    return isinstance(node, dict) and set(node) == {"param"}


def split(spec: dict) -> tuple[list[dict], list[tuple[dict, str, str]]] | None:
    """The rule as conditions without parameters and (side, op, parameter) of monotone ones, all of which must hold; None if
    it can't be had that way (a parameter inside arithmetic, an alternative or a negation)."""
    fixed, monotone, todo = [], [], [spec["entry"]]
    while todo:
        node = todo.pop()
        if not _params(node):
            fixed.append(node)
        elif "all" in node:
            todo += node["all"]
        elif node.get("op") == "between" and not _params(node["left"]):
            low, high = node["right"]
            todo += [{"left": node["left"], "op": ">=", "right": low}, {"left": node["left"], "op": "<=", "right": high}]
        elif node.get("op") in MIRROR and _is_param(node["right"]) and not _params(node["left"]):
            monotone.append((node["left"], node["op"], node["right"]["param"]))
        elif node.get("op") in MIRROR and _is_param(node["left"]) and not _params(node["right"]):
            monotone.append((node["right"], MIRROR[node["op"]], node["left"]["param"]))
        else:
            return None
    return fixed, monotone


def _passed(side: Column, op: str, values: list[float]) -> Column:
    test = {">": lambda v: side > v, ">=": lambda v: side >= v, "<": lambda v: side < v, "<=": lambda v: side <= v}[op]
    return reduce(lambda a, b: a + b, [F.coalesce(test(v), F.lit(False)).cast("int") for v in values])


def boxes(features: DataFrame, spec: dict) -> DataFrame | None:
    """Rows that pass some point, with the range [_lo_<parameter>, _hi_<parameter>) of grid places on each axis; None if the
    rule is no lattice."""
    parts = split(spec)
    if parts is None:
        return None
    rl.only_known("rule", spec, rl.RULE_KEYS)
    cols, grid = features.columns, axes(spec)
    out = features.filter(reduce(lambda a, b: a & b, [rl.rule_column(n, {}, cols) for n in parts[0]], rl.universe_column(spec.get("universe", {}), cols)))
    for name, values in grid.items():
        low, high = [F.lit(0)], [F.lit(len(values))]
        for side, op, param in parts[1]:
            if param == name:
                n = _passed(rl.operand(side, {}, cols), op, values)
                if op in (">", ">="):
                    high.append(n)
                else:
                    low.append(F.lit(len(values)) - n)
        out = out.withColumn(f"_lo_{name}", F.greatest(*low) if len(low) > 1 else low[0]).withColumn(f"_hi_{name}", F.least(*high) if len(high) > 1 else high[0])
    return out.filter(reduce(lambda a, b: a & b, [F.col(f"_lo_{k}") < F.col(f"_hi_{k}") for k in grid], F.lit(True)))


def points(boxed: DataFrame, spec: dict) -> DataFrame:
    """One row for every grid point of each row's box, with ``_variant``, its name."""
    grid, cols = axes(spec), [c for c in boxed.columns if not c.startswith(("_lo_", "_hi_"))]
    for name in grid:
        boxed = boxed.withColumn(f"_at_{name}", F.explode(F.sequence(F.col(f"_lo_{name}"), F.col(f"_hi_{name}") - 1)))
    names = [F.element_at(F.array(*[F.lit(f"{k}={v:g}") for v in values]), F.col(f"_at_{k}") + 1) for k, values in grid.items()]
    return boxed.select(*cols, F.concat_ws(",", *names).alias("_variant"))


def counts(features: DataFrame, spec: dict) -> DataFrame:
    """Rows that pass, ``n_hits``, at every point of the grid (a column per parameter), points without any included.

    Rows are summed by box first, each box is its corners with signs, and running sums along one axis after the other turn
    corners into counts: the work after the first aggregate depends on the grid only."""
    boxed, grid = boxes(features, spec), axes(spec)
    if boxed is None:
        raise ValueError(f"the grid of {spec.get('slug')} is no lattice")
    ends = [f"_{e}_{k}" for k in grid for e in ("lo", "hi")]
    summed = boxed.groupBy(*ends).agg(F.count(F.lit(1)).alias("n"))
    for k in grid:
        ends = F.array(F.struct(F.col(f"_lo_{k}").alias("at"), F.lit(1).alias("sign")), F.struct(F.col(f"_hi_{k}").alias("at"), F.lit(-1).alias("sign")))
        summed = summed.withColumn("_e", F.explode(ends)).withColumn(f"_at_{k}", F.col("_e.at")).withColumn("n", F.col("n") * F.col("_e.sign"))
    at = [f"_at_{k}" for k in grid]
    corners = summed.groupBy(*at).agg(F.sum("n").alias("n"))
    every = [(*p, *[values[i] for i, values in zip(p, grid.values(), strict=True)]) for p in product(*[range(len(v)) for v in grid.values()])]
    out = features.sparkSession.createDataFrame(every, ", ".join([*[f"_at_{k} int" for k in grid], *[f"`{k}` double" for k in grid]])).join(corners, at, "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    for a in at:
        others = [x for x in at if x != a]
        out = out.withColumn("n", F.sum("n").over(Window.partitionBy(*others).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*[F.col(f"`{k}`") for k in grid], F.col("n").cast("long").alias("n_hits"))
