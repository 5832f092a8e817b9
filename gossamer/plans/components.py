"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on (u, v) edges; a hub's edges are never gathered, only its minimum is, and
that one row is joined back (adaptive execution splits the hub's side). Rounds grow with the log of the graph's
diameter, and lineage is cut with a reliable checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the component's least node. Other nodes are their own root.

    Nodes may be of any type with an order: longs, strings.
    """
    e = checkpointed(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    before = _signature(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        e = checkpointed(_small_star(_large_star(e)))
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def resolve_pointers(links: DataFrame, node: str, parent: str, max_rounds: int = 60) -> DataFrame:
    """Follow ``parent`` to the end for every node (NULL parent = end), by pointer jumping."""
    cur = checkpointed(links.select(F.col(node).alias("node"), F.col(parent).alias("root")).withColumn("root", F.coalesce("root", "node")))
    for _ in range(max_rounds):
        up = cur.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        nxt = checkpointed(cur.join(up, "root", "left").select("node", F.coalesce("_next", "root").alias("root"),
                                                               (F.coalesce("_next", "root") != F.col("root")).alias("_moved")))
        if nxt.filter("_moved").isEmpty():
            return nxt.select("node", "root")
        cur = nxt.select("node", "root")
    raise RuntimeError("pointer chains do not end")
