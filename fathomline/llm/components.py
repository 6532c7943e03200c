"""Connected components of a table of links, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, join_by_share


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over n edges (u, v) with u > v.

    Each step joins a node's smallest neighbour back to its edges; those of nodes
    with very many neighbours stay where they are.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    large = join_by_share(both, least, ["u"], "n", 2 * n).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = join_by_share(large, least, ["u"], "n", 2 * n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return small.where("u <> v").distinct()


def components(links: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(node, component) of every node that has a link (a, b); a component is its smallest node.

    Steps are repeated until the edges no longer change; each is kept in the
    shared folder. Links of a node to itself and repeated links have no effect.
    """
    start = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, state, step = shelf.put(f"{name}-0", start), None, 0
    look = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now = look(edges)
    while now != state and now[0]:
        state, step = now, step + 1
        edges = shelf.put(f"{name}-{step}", _stars(edges, now[0]))
        shelf.drop(f"{name}-{step - 1}")
        shelf.tidy()
        now = look(edges)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
