"""Connected components of links by alternating large and small stars, in DataFrame operations.

Links may repeat, run either way, and join a node with itself (such links say nothing); those with a null end are left out. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours. links: (u, v), u > v."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """Links every node, and its smaller neighbours, to the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (the smallest id reachable) of every id that stands in a link (columns a and b); roots are left out."""
    now = scratch.write(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        new = scratch.write(small_star(large_star(now).distinct()), "stars")
        found = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(now)
        now = new
        if found == mark:  # the stars no longer change
            out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._scratch_path = now._scratch_path
            return out
        mark = found
