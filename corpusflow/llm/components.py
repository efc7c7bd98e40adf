"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, sized, stored


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """u, m, open: for each node the smallest of it and its neighbours, and whether it has a smaller neighbour
    and any other besides; edges of which no node is open are stars around the smallest nodes."""
    smaller = F.max(F.when(F.col("v") < F.col("u"), F.col("v")))
    least = _neighbours(edges).groupBy("u").agg(F.min("v").alias("low"), smaller.alias("smaller"), F.max("v").alias("high"))
    is_open = (F.col("low") < F.col("u")) & ((F.col("high") > F.col("u")) | (F.col("smaller") > F.col("low")))
    return stored(least.select("u", F.least("u", "low").alias("m"), is_open.alias("open")), "least")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of the node and its neighbours; u is the larger end."""
    return _neighbours(edges).where("v > u").join(sized(least.select("u", "m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    return down.join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge don't occur.

    ``edges`` has integer columns u and v.  Each round is written to the shared folder, so a lost
    executor costs one round at most; a hub's edges are summed before they are shuffled.  Edges that are
    stars around the smallest nodes take no round.
    """
    held = Stored(edges.where("u <> v").select("u", "v"), "edges")
    while not (least := _least(held.read())).where("open").isEmpty():
        held_next = Stored(_small_star(_large_star(held.read(), least)), "edges")
        held.drop()
        held = held_next
    return least.select(F.col("u").alias("node"), F.col("m").alias("component"))


def joined_components(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more ``links`` (u, v): only the links between components, and nodes without
    one, are gone through."""
    if comps is None:
        return connected_components(links)
    named = sized(comps.select("node", "component"))
    for k in "uv":
        links = links.join(named.select(F.col("node").alias(k), F.col("component").alias(f"_{k}")), k, "left")
    more = connected_components(links.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")))
    moved = sized(more.select(F.col("node").alias("component"), F.col("component").alias("_to")))
    before = comps.select("node", "component").join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return stored(before.unionAll(more.join(named, "node", "left_anti")), "components")
