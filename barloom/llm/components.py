"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """id, comp for every end of the links a, b: comp is the smallest id that can be reached, the id itself included.

    Each round gives an id the smallest label among itself and its neighbours, then the label of that label, so paths
    shorten by half; only one number a round comes to the driver. Links with a null end are left out."""
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = common.cut(links.union(links.select("b", "a")).distinct())
    labels, last = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), None
    while True:
        labels = common.cut(labels)
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return labels
        last = total
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        of = labels.select(F.col("id").alias("at"), F.col("comp").alias("further"))
        labels = step.join(of, step["comp"] == of["at"], "left").select("id", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
