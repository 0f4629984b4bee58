"""Property graphs and triples as DataFrames: expansion, typed edges, closure, components, beams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import shared_folder

#: Deepest closure that is followed; a cycle ends there too.
DEPTH = 5


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """edges(src, rel, dst) and their reverses."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Any edge from or to the seeds(node)."""
    return undirected(edges).join(seeds.withColumnRenamed("node", "src").distinct(), "src")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 300) -> DataFrame:
    """Edges around the seeds(node), as they are directed, ordered so that the limit is a definite one.

    One hop: edges from and to the seeds. Two hops: edges from and to all nodes reached (the far sides of bridges
    too), and all edges from siblings: nodes that refer to what a seed, or a node that refers to a seed, refers to.
    """

    def among(nodes: DataFrame, side: str) -> DataFrame:
        return edges.join(nodes.toDF(side).distinct(), side, "left_semi").select("src", "rel", "dst")

    seeds = seeds.select("node")
    one = _kept(among(seeds, "src").unionByName(among(seeds, "dst")))
    out = one.withColumn("hop", F.lit(1))
    if hops > 1:
        reached = one.select(F.col("src").alias("node")).union(one.select("dst")).distinct()
        referring = one.join(seeds.toDF("dst").distinct(), "dst", "left_semi").select("src")
        shared = _kept(among(seeds.union(referring), "src").select("dst").distinct())
        siblings = _kept(among(shared, "dst").select(F.col("src").alias("node")).distinct())
        two = among(reached.union(siblings), "src").unionByName(among(reached, "dst"))
        out = out.unionByName(two.withColumn("hop", F.lit(2)))
    return out.groupBy("src", "rel", "dst").agg(F.min("hop").alias("hop")).orderBy("hop", "src", "rel", "dst").limit(limit)


def typed_edges(edges: DataFrame, statements: DataFrame, wanted: list[str]) -> DataFrame:
    """Entities joined by the edge types wanted, in either direction, with the distinct statements that support them.

    statements(src, dst, text) is optional support; an edge without any has an empty list.
    """
    from tessera.functions.names import normal_edge

    both = undirected(edges).filter(normal_edge(F.col("rel")).isin(*wanted)).distinct()
    joined = both.join(statements, ["src", "dst"], "left")
    return joined.groupBy("src", "rel", "dst").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, sorted set of its neighbours in either direction."""
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("near"))


def closure(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(child, ancestor, level): ancestors up to `depth` levels; the level is the shortest."""
    step = pairs.select(F.col("child"), F.col("parent").alias("ancestor")).distinct().withColumn("level", F.lit(1))
    out = step
    for level in range(2, depth + 1):
        step = step.select("child", F.col("ancestor").alias("mid")).join(pairs.select(F.col("child").alias("mid"), F.col("parent").alias("ancestor")), "mid").select("child", "ancestor").distinct().withColumn("level", F.lit(level))
        out = out.unionByName(step)
    return out.groupBy("child", "ancestor").agg(F.min("level").alias("level"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable; labels spread with pointer jumping until nothing changes."""
    both = _kept(undirected(edges.withColumn("rel", F.lit(""))).select("src", "dst").distinct())
    label = nodes.select("node", F.col("node").alias("comp")).distinct()
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("comp").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        took = _kept(label.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("c", "comp")).alias("c")))
        jump = took.select(F.col("node").alias("c"), F.col("c").alias("comp"))
        new = _kept(took.join(jump, "c").select("node", "was", "comp"))
        label = new.select("node", "comp")
        if new.filter("was <> comp").isEmpty():
            return label


def beam(edges: DataFrame, seeds: DataFrame, width: int = 100, depth: int = 6, top: int = 50) -> DataFrame:
    """Best weighted paths: seeds(node, score), edges(src, dst, weight); a path's score is the product of its weights.

    At each level the `width` best nodes go on; of all nodes reached the `top` best are returned with their best score.
    """
    front = seeds.select("node", "score").withColumn("level", F.lit(0))
    reached = front
    for level in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight")).alias("score"))
        front = _kept(step.orderBy(F.desc("score"), "node").limit(width).withColumn("level", F.lit(level)))
        reached = reached.unionByName(front)
    best = reached.groupBy("node").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "node").limit(top)


def window_around(rows: DataFrame, seeds: DataFrame, hops: int, group: str = "doc", position: str = "pos") -> DataFrame:
    """Rows at most `hops` places from a seed row of the same group, the seeds themselves left out.

    Each seed names the places around it, so the join is an equality, not a range.
    """
    around = seeds.select(group, F.explode(F.sequence(F.col(position) - hops, F.col(position) + hops)).alias(position)).distinct()
    return rows.join(around, [group, position], "left_semi").join(seeds.select(group, position), [group, position], "left_anti")


def first_level(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 refers to nothing, else one more than the highest level it refers to; null on or behind a cycle.

    Self references don't count. A round settles a level, so there are as many rounds as levels.
    """
    left = _kept(pairs.filter("child <> parent").select("child", "parent").distinct())
    done = _kept(nodes.select("node").distinct().join(left.select(F.col("child").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while not left.isEmpty():
        level += 1
        settled = done.filter(F.col("level") == level - 1).select(F.col("node").alias("parent"))
        rest = _kept(left.join(settled, "parent", "left_anti"))
        free = left.select(F.col("child").alias("node")).distinct().join(rest.select(F.col("child").alias("node")), "node", "left_anti")
        free = _kept(free.withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done, left = done.unionByName(free), rest
    return nodes.select("node").distinct().join(done, "node", "left")


def reachable(pairs: DataFrame) -> DataFrame:
    """(child, ancestor) of any distance, by squaring: as many rounds as the logarithm of the longest path."""
    all_ = _kept(pairs.select("child", F.col("parent").alias("ancestor")).distinct())
    n = all_.count()
    while True:
        on = all_.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_far"))
        all_ = _kept(all_.unionByName(all_.join(on, "ancestor").select("child", F.col("_far").alias("ancestor"))).distinct())
        if (more := all_.count()) == n:
            return all_
        n = more


def cyclic(pairs: DataFrame) -> DataFrame:
    """(node) of the nodes that are their own ancestor.

    What refers to nothing or is referred to by nothing is on no cycle and is taken away first, again and again; only
    what is left is closed.
    """
    left = _kept(pairs.select("child", "parent").distinct())
    n = left.count()
    while n:
        left = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        left = _kept(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent"))
        if (fewer := left.count()) == n:
            break
        n = fewer
    return reachable(left).filter("child = ancestor").select(F.col("child").alias("node"))


def keep_best(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """One row a key: the best score, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
