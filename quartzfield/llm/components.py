"""Connected components by joins: labels spread along edges and then jump to the label of their label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each end of an edge (``a, b``) can reach, itself included.

    Each round takes the least label among neighbours, by a sum before the shuffle, and then that label's own label, so the
    rounds grow with the logarithm of the longest path. Every round is written to the shared folder; only the number of
    changed labels comes to the driver. Nulls, loops and repeated edges add nothing.
    """
    one_way = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().where("a <> b")
    both = materialise(one_way.union(one_way.select("b", "a")).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        spread = labels.join(heard, labels.node == heard.a).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        new = materialise(spread.join(jump, "next").select("node", "old", F.least("next", "further").alias("component")))
        discard(labels)
        labels = new
        if new.where("old <> component").isEmpty():
            discard(both)
            return new.select("node", "component")
