"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the least node of its component.

    A large star links a node's larger neighbours to the least of its
    neighbours and itself; a small star does so for the smaller ones. Both
    only rewire, and what they leave once nothing changes is a star around
    each root. Rows are sums over neighbours, never lists of them, so that a
    node of many neighbours is split like any other join key.
    """
    now = common.cut(edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("lo", "m").alias("m"))
        large = common.split_join(both, least, ["lo"]).filter("hi > lo").select(F.col("m").alias("lo"), "hi").distinct()
        # small star: a node's smaller neighbours, and the node, to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = common.split_join(large, low, ["hi"]).select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo <> hi").unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct()
        new = common.cut(small)
        # settled once no node is both a root and a leaf, and each leaf has one root
        roots = new.select(F.col("lo").alias("node")).distinct()
        unsettled = new.join(roots, F.col("hi") == F.col("node"), "left_semi")
        several = new.groupBy("hi").agg(F.count("*").alias("n")).filter("n > 1")
        if unsettled.isEmpty() and several.isEmpty():
            break
        now = new
    return new.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
