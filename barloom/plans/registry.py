"""Query registry: a Spark callable plus the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.workbench import TABLE_SQL, Workbench


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Workbench], DataFrame]
    sql: str | None
    rounded: dict[str, int]

    def run(self, spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
        df = self.build(Workbench(spark, sf_dir) if fresh else Workbench.shared(spark, sf_dir))
        if not self.rounded:
            return df
        return df.select(*[_quantised(c, self.rounded[c]) if c in self.rounded else F.col(c) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip().rstrip(";")
        if self.rounded:
            reps = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e{d} + 0.5) / 1e{d} AS {c}"
                             for c, d in self.rounded.items())
            body = f"SELECT * REPLACE ({reps}) FROM (\n{body}\n)"
        else:
            body = f"SELECT * FROM (\n{body}\n)"
        return with_tables(body)


def _quantised(c: str, digits: int):
    """Half-up rounding by the same floating-point steps on both engines."""
    m = float(10 ** digits)
    return (F.floor(F.col(c).cast("double") * m + 0.5) / m).alias(c)


QUERIES: dict[str, Query] = {}


# ``rounded``: blank-separated columns, each optionally "column:digits".
def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        pairs = (c.partition(":") for c in rounded.split())
        QUERIES[name] = Query(name, fn, sql, {c: int(d or digits) for c, _, d in pairs})
        return fn
    return register


def _needs(text: str) -> set[str]:
    return {t for t in TABLE_SQL if re.search(rf"\b{t}\b", text)}


def with_tables(body: str) -> str:
    """Prefix a statement with the derived tables it mentions (and theirs), in definition order."""
    want, frontier = set(), _needs(body)
    while frontier:
        want |= frontier
        frontier = set().union(*[_needs(TABLE_SQL[t]) for t in frontier]) - want
    ctes = [f"{t} AS MATERIALIZED (\n{TABLE_SQL[t].strip()}\n)" for t in TABLE_SQL if t in want]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
