"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, checkpointed, gated


#: A node of more edges than this is a hub: what is known of it is broadcast.
HUB_EDGES = 100_000


def _told(edges: DataFrame, few: bool) -> DataFrame:
    """(u, v, m): each edge with the smallest neighbour of its first end.

    With few edges the table of neighbours is broadcast.  Beyond that only the rows of hubs are, of which there are at
    most the number of edges over HUB_EDGES, so no task gathers the edges of a hub.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges"))
    if few:
        return edges.join(F.broadcast(low.drop("edges")), "u")
    low = checkpointed(low)
    hubs = gated(low.where(F.col("edges") > HUB_EDGES).select("u", "m"))
    rest = edges.join(hubs, "u", "left_anti").join(low.where(F.col("edges") <= HUB_EDGES).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _told(both, few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them; edges have u > v."""
    moved = _told(edges, few)
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has an edge to another one; the label is the component's smallest node.

    Each round halves the number of stars about a hub or more, so rounds grow with the logarithm of the number of
    nodes.  Only a count and a checksum come to the driver.  Loops and repeated edges are allowed, and an empty
    table gives no rows; an edge with a null end is ignored.  While the counted edges are few, a node's smallest
    neighbour is broadcast, which keeps the edges of a hub in place; beyond that the joins shuffle all but hubs.
    """
    now = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        few = 2 * state[0] <= BROADCAST_ROWS
        seen, now = state, checkpointed(_small_star(_large_star(now, few), few))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
