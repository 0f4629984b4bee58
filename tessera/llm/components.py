"""Connected components by distributed label spreading with pointer jumping; nothing comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """(node, comp) for every node of edges(a, b); comp is the smallest node of its component.

    Nodes are longs, not null; loops and repeated edges are allowed. An edge table without rows gives no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.written(both, "edges")
    label = common.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        side = common.within(label, 32, broadcast_bytes)
        near = both.join(side.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        took = common.written(label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("c")), "spread")
        jump = common.within(took, 32, broadcast_bytes).select(F.col("node").alias("c"), F.col("c").alias("comp"))
        new = common.written(took.join(jump, "c").select("node", "was", "comp"), "labels")
        label = new.select("node", "comp")
        if new.filter("was <> comp").isEmpty():
            return label
