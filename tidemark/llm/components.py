"""Connected components of an edge table by alternating large-star / small-star rounds.

Both halves are a min per node (combined before the shuffle) and a join back, so a node with
millions of edges is never gathered into one task; each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root


def _signature(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b bigint) -> (node, component): component is the smallest node reachable.

    Nodes without an edge do not appear. Self loops, repeated and reversed edges are allowed; rows
    with a null end link nothing and are left out.
    """
    checkpoint_root(edges.sparkSession)
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint())
    before = _signature(e)
    while True:
        # large star: every neighbour larger than the node moves to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = _signature(e)
        if now == before:
            break
        before = now
    stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    centres = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)
