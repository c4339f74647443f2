"""Links inside buckets by stars instead of pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Centres of a bucket in the second round; each later one takes four times as many.
CENTRES = 32


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair of a member id and its centre other_id once, as a (the centre), b, low, high."""
    pairs = met.groupBy(F.least("id", "other_id").alias("low"), F.greatest("id", "other_id").alias("high")).agg(F.min("other_id").alias("a"))
    return pairs.withColumn("b", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")))


def star_links(rows: DataFrame, features: DataFrame, near: str, details: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
    """Confirmed links a, b between ids that share a key, from rows (key, id); None if no key is shared.

    In each bucket the member that shares most buckets is the centre, and only pairs of the centre and another member are
    compared, if they pass `near`, a condition on the member's features (id and other columns) and the centre's (prefixed
    other_). Links make components. A bucket whose members are in one component is done. In the others the centres, having
    met everyone, leave, and further ones are compared with the members of other components, until no bucket is left. So
    every pair that passes `near` has been compared or joins ids that are in one component anyway, and n copies of a text
    cost about n comparisons. details(ids) gives what confirm(pairs, details) needs to know of the ids.

    Only (key, id) is shuffled for all rows. Buckets of one go at once; features are joined to pairs in the first round,
    and to the members of unsettled buckets later, where they keep hopeless pairs from leaving the join."""
    own = [c for c in features.columns if c != "id"]
    full = rows.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    members = common.cut(rows.join(full, "key"))
    if members.isEmpty():
        return None
    degree = members.groupBy("id").agg(F.sum("others").alias("degree"))
    known = common.cut(features.join(degree, "id"))
    facts = details(known.select("id"))
    of = lambda prefix, to: known.select(F.col("id").alias(to), *[F.col(c).alias(f"{prefix}{c}") for c in own])

    def confirmed(pairs: DataFrame) -> DataFrame:
        return common.cut(confirm(pairs.select("a", "b"), facts))

    def joined(links: DataFrame, comps: DataFrame | None) -> DataFrame:
        """comp, now of the components that the links between comps make."""
        if comps is not None:
            for end in ("a", "b"):
                links = links.join(comps.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}")), end)
            links = links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        return components(links).select(F.col("id").alias("comp"), F.col("comp").alias("now"))

    # first round: one centre a bucket, found by a hash aggregate
    members = common.cut(members.select("key", "id").join(known.select("id", "degree"), "id"))
    best = members.groupBy("key").agg(F.expr("max_by(id, cast(degree * 1e19bd - id as decimal(38,0)))").alias("other_id"))
    met = members.select("key", "id").join(best, "key").filter("id <> other_id")
    pairs = _pairs(met).join(of("", "b"), "b").join(of("other_", "a"), "a").filter(near)
    seen = common.cut(pairs.select("a", "b", "low", "high").distinct())  # an id may have several features
    links = confirmed(seen)
    now = joined(links, None)
    rest = members.join(best.select("key", F.col("other_id").alias("id")), ["key", "id"], "left_anti")
    rest = rest.withColumn("comp", F.col("id"))
    seen, centres = seen.select("low", "high"), CENTRES
    while True:
        rest = rest.join(now, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
        unsettled = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
        rest = common.cut(rest.join(unsettled, "key", "left_semi"))
        if rest.isEmpty():
            return links
        full_rows = common.cut(rest.drop("degree").join(known, "id"))
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "id"))
        chosen = full_rows.withColumn("rank", rank).filter(F.col("rank") <= centres).drop("rank", "degree")
        chosen = common.cut(chosen.select("key", *[F.col(c).alias(f"other_{c}") for c in chosen.columns if c != "key"]))
        met = full_rows.join(chosen, "key").filter(f"comp <> other_comp and {near}")
        pairs = common.cut(_pairs(met).join(seen, ["low", "high"], "left_anti"))
        found = confirmed(pairs)
        links, seen = links.union(found), seen.union(pairs.select("low", "high"))
        now = joined(found, full_rows.select("id", "comp").distinct())
        rest = rest.join(chosen.select("key", F.col("other_id").alias("id")), ["key", "id"], "left_anti")
        centres *= 4
