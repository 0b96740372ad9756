"""Connected components of a table of links, by hooking to the smallest neighbour and pointer
jumping. Every round is written to the shared folder; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import settle


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, label): label is the smallest node of the component.

    Only nodes with a link to another node are in the result. Labels halve their distance to the
    smallest node in each round, so chains take a logarithmic number of rounds. A node with very
    many links is one key of equi-joins (split by adaptive execution) and of minima that
    combine on the map side.
    """
    one, other = edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = settle(one.unionByName(other).where("a <> b").distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        hooked = settle(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "least").alias("new")))
        above = hooked.select(F.col("node").alias("up"), F.col("new").alias("upper"))
        labels = settle(hooked.join(above, hooked.new == above.up).select("node", "old", F.least("new", "upper").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
