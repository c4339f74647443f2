"""Screening rules: a nested rule spec becomes one Spark column, so Catalyst sees plain predicates."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ARITHMETIC = {"mul": lambda a, b: a * b, "add": lambda a, b: a + b, "sub": lambda a, b: a - b,
              "div": lambda a, b: a / F.when(b != 0, b)}
PREV = "prev_"
# The keys that rule files may have.
RULE_KEYS = {"dsl_version", "slug", "name", "horizon", "universe", "params", "entry", "exit", "rank", "sizing", "notes"}
UNIVERSE_KEYS = {"exchange", "min_price_raw", "min_median_turnover_inr", "min_listed_days", "exclude_series"}


def only_known(what: str, given: dict, known: set[str]) -> None:
    """A key that is not understood would silently loosen a rule, so it raises."""
    unknown = set(given) - known
    if unknown:
        raise KeyError(f"unknown key in {what}: {sorted(unknown)}")


def feature_name(ind: str, period=None) -> str:
    return ind if period is None else f"{ind}{period}"


def resolve_params(spec: dict, overrides: dict | None = None) -> dict:
    defaults = {k: v["default"] for k, v in spec.get("params", {}).items()}
    unknown = set(overrides or {}) - set(defaults)
    if unknown:
        raise KeyError(f"unknown parameter {sorted(unknown)}")
    return {**defaults, **(overrides or {})}


def param_grid(spec: dict) -> list[dict]:
    """Every combination of the parameters' grid values."""
    params = spec.get("params", {})
    names = list(params)
    grids = [params[n].get("grid") or [params[n]["default"]] for n in names]
    return [dict(zip(names, c)) for c in itertools.product(*grids)]


def operand(node, params: dict, columns: list[str], prev: bool = False) -> Column:
    """Number, feature, parameter or arithmetic node; x / 0 is NULL. Unknown names raise."""
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    if "ind" in node:
        name = feature_name(node["ind"], node.get("period"))
        name = PREV + name if prev else name
        if name not in columns:
            raise KeyError(f"unknown feature {name!r}")
        return F.col(name)
    if "param" in node:
        if node["param"] not in params:
            raise KeyError(f"unknown parameter {node['param']!r}")
        value = params[node["param"]]
        return value if isinstance(value, Column) else F.lit(float(value))
    (op, (a, b)), = node.items()
    return ARITHMETIC[op](operand(a, params, columns, prev), operand(b, params, columns, prev))


def condition(node: dict, params: dict, columns: list[str]) -> Column:
    """One comparison. A missing side is False here, before any NOT can see it."""
    only_known("condition", node, {"left", "op", "right"})
    op = node["op"]
    left = operand(node["left"], params, columns)
    if op == "between":
        lo, hi = (operand(x, params, columns) for x in node["right"])
        test = (left >= lo) & (left <= hi)
    else:
        right = operand(node["right"], params, columns)
        if op in ("crosses_above", "crosses_below"):
            pl, pr = (operand(node[s], params, columns, prev=True) for s in ("left", "right"))
            test = (left > right) & (pl <= pr) if op == "crosses_above" else (left < right) & (pl >= pr)
        else:
            test = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(test, F.lit(False))


def rule_column(node: dict, params: dict, columns: list[str]) -> Column:
    if "all" in node:
        return reduce(lambda a, b: a & b, [rule_column(n, params, columns) for n in node["all"]])
    if "any" in node:
        return reduce(lambda a, b: a | b, [rule_column(n, params, columns) for n in node["any"]])
    if "not" in node:
        return ~rule_column(node["not"], params, columns)
    return condition(node, params, columns)


def universe_column(u: dict, columns: list[str]) -> Column:
    only_known("universe", u, UNIVERSE_KEYS)
    tests = [F.lit(True)]
    for key, col in (("min_price_raw", "close_raw"), ("min_median_turnover_inr", "turnover_med20"), ("min_listed_days", "bar_count")):
        if u.get(key, 0) > 0:
            tests.append(F.coalesce(F.col(col) >= u[key], F.lit(False)))
    if u.get("exclude_series") and "series" in columns:
        tests.append(~F.coalesce(F.col("series").isin(u["exclude_series"]), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def entry_column(spec: dict, columns: list[str], overrides: dict | None = None) -> Column:
    only_known("rule", spec, RULE_KEYS)
    return universe_column(spec.get("universe", {}), columns) & rule_column(spec["entry"], resolve_params(spec, overrides), columns)


def crossed_features(node: dict) -> set[str]:
    """Features whose previous value a rule reads."""
    found: set[str] = set()

    def names(x):
        if isinstance(x, dict):
            if "ind" in x:
                found.add(feature_name(x["ind"], x.get("period")))
            elif "param" not in x:
                for v in next(iter(x.values())):
                    names(v)
    for key in ("all", "any"):
        for n in node.get(key, []):
            found |= crossed_features(n)
    if "not" in node:
        found |= crossed_features(node["not"])
    if str(node.get("op", "")).startswith("crosses"):
        names(node["left"])
        names(node["right"])
    return found


def distance(rule: dict | None) -> Column:
    """Stop or target distance as a fraction of the price; NULL when an ATR is needed but missing."""
    if rule is None:
        return F.lit(None).cast("double")
    if rule["type"] == "pct":
        return F.lit(float(rule["value"]))
    return F.when(F.col("atr_pct14") > 0, F.col("atr_pct14") * float(rule["mult"]))
