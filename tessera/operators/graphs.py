"""Reachability over links between blocks: traversal, garbage collection, version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

MOST_DEPTH = 128


def reach(edges: DataFrame, seeds: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """root, node, level: everything each seed (root, node) reaches, each node once a root, at its least level.

    A frontier loop: each level is a join with the edges and an anti-join with what was seen,
    so cycles end and the rounds are the graph's depth. Lineage is cut at each level, and the
    edges are computed once.
    """
    edges = checkpointed(edges.select("parent", "child"))
    seen = checkpointed(seeds.select("root", "node").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    raise ValueError(f"the graph is deeper than {depth} links")


def sweep(blocks: DataFrame, protected: DataFrame) -> DataFrame:
    """Blocks (node, size, corrupt) to delete: not protected, and not corrupt, which are kept for repair."""
    return blocks.filter(~F.col("corrupt")).join(protected.select("node").distinct(), "node", "left_anti")


def sweep_report(blocks: DataFrame, protected: DataFrame) -> DataFrame:
    """protected, deleted, reclaimed_bytes of a sweep, in one pass over the blocks."""
    kept = protected.select("node").distinct().withColumn("kept", F.lit(True))
    marked = blocks.join(kept, "node", "left")
    gone = F.col("kept").isNull() & ~F.col("corrupt")
    return marked.agg(F.count_if(F.col("kept").isNotNull()).alias("protected"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("reclaimed_bytes"))


def explain(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, relation: which roots protect each node, as the root itself or a descendant; null if none does."""
    return nodes.join(reached, "node", "left").select("node", "root", F.when(F.col("level") == 0, "root").when(F.col("level") > 0, "descendant").alias("relation"))


def logical_sizes(reached: DataFrame, sizes: DataFrame) -> DataFrame:
    """root, nodes, bytes: what a root holds in all, each node once. sizes: node, size."""
    return reached.join(sizes, "node").groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("bytes"))


def version_chain(versions: DataFrame) -> DataFrame:
    """key, version, previous, age (0 is the newest): a linear chain is an order, which needs no recursion."""
    at = Window.partitionBy("key").orderBy("version")
    return versions.withColumn("previous", F.lag("version").over(at)).withColumn("age", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version"))) - 1)


def new_frontier(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Nodes of the candidate that the base doesn't have: what a commit must store."""
    return candidate.select("node").distinct().join(base.select("node").distinct(), "node", "left_anti")
