"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fenland.functions.tables import scratch, written

#: The least neighbours of nodes are broadcast while there are at most so many edges (16 bytes a node, two nodes an edge).
BROADCAST_EDGES = 500_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (node, comp): comp is the smallest node reachable; nodes without edges have no row.

    Each round is two aggregations and joins on node keys and is written to the shared folder; stars end after one or
    two. Nulls and loops are dropped.
    """
    with scratch(edges.sparkSession):
        e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        last, n = None, e.count()
        for _ in range(rounds):
            sent = F.broadcast if n <= BROADCAST_EDGES else lambda x: x
            both = e.union(e.select(F.col("b"), F.col("a")).toDF("a", "b"))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(sent(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("m < a").select("a", "m").toDF("a", "b")).where("a <> b")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            e = written(large.join(sent(low), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            n = now[0]
            if now == last:
                out = e.groupBy("a").agg(F.min("b").alias("comp")).union(e.select("b", "b").distinct()).toDF("node", "comp").groupBy("node").agg(F.min("comp").alias("comp"))
                return written(out, "components", kept=True)
            last = now
        raise RuntimeError(f"components are not settled after {rounds} rounds")
