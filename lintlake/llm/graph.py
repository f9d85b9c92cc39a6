"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b), and the smallest node it reaches.

    Large-star hands each larger neighbour of a node the node's smallest neighbour; small-star does so
    for the smaller ones.  Both are a combinable minimum, written, and an equi-join with it whose exchange of
    edges can be split where a node has very many; edges never pile up on a driver or in one group.  Each round is written to the shared folder, so a lost executor
    costs no earlier round; what a round no longer needs is deleted.  Null ends, loops and repeated edges are harmless.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    now = written(now, "edges")
    nodes = written(now.select("a").union(now.select("b")).distinct().withColumnRenamed("a", "node"), "nodes")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "large")
        fewest = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(fewest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(fewest.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, written(small, "stars")
        discard(before, least, large, fewest)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
