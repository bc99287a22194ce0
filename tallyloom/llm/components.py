"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins; labels never leave Spark and
no neighbour list is gathered, so a node may have any number of links.  The
minima are written before they are joined: both sides of a join are then plain
tables, and Spark can split the links of a node that has very many.  Tables of few
links are written by few tasks, so a round of them takes moments whatever the number
of shuffle partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Links that one task handles, about.
LINKS = 50_000


def _star(edges: DataFrame, tasks: int, scratch: Scratch) -> DataFrame:
    """Each node's smallest neighbour, itself included: (u, m)."""
    return scratch.save(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks), "least")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links of any direction, repeats and self-links allowed, to (node, component), a written table.

    ``component`` is the smallest node reachable.  Only linked nodes appear;
    rows with a null end count as no link.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = scratch.save(pairs, "links"), None
    # No round has many more links than the first.
    tasks = max(1, math.ceil(current.count() / LINKS))
    while True:
        # Large star: every larger neighbour of a node hangs on the node's smallest neighbour.
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _star(both, tasks, scratch)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = scratch.save(large.coalesce(tasks).distinct().coalesce(tasks), "large")
        scratch.drop(current, least)
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = _star(large, tasks, scratch)
        small = large.join(least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = scratch.save(moved.where("u > v").coalesce(tasks).distinct().coalesce(tasks), "round")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(large, least)
        current = after
        if state == before:
            break
        before = state
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = scratch.save(nodes.coalesce(tasks), "components")
    scratch.drop(current)
    return out
