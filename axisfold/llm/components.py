"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node.

    The large star links the larger neighbours only, the small star the smaller
    ones and the node itself.  Both keep components and never add links.  The
    least neighbours are a table of their own, so that Spark can split the rows of
    a node with very many links when they meet it.
    """
    if large:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        return around.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpointed(down.groupBy("a").agg(F.min("b").alias("m")))
    return down.join(least, "a").select(F.col("m").alias("x"), "b").unionByName(least.select(F.col("m").alias("x"), F.col("a").alias("b"))).where("x <> b").select(F.col("x").alias("a"), "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node.

    Both endpoints must be of one orderable type.  Rounds go on until nothing
    changes; their number grows with the logarithm of the longest path.
    """
    now = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = checkpointed(_stars(checkpointed(_stars(now, True)), False))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every link is (root, node)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))
