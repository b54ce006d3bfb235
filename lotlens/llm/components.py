"""Connected components of a graph of links, by alternating large-star and small-star rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round: every node sends its larger (or smaller) neighbours to the least node it knows.

    The least neighbour is a minimum with partial sums and comes back by a join, so a hub's links need not lie in one task.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # the node itself joins its neighbours under the least of them
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): every node that has a link, with the least node that can be reached from it.

    ``links`` holds pairs ``a``, ``b`` of comparable ids; null ends, loops and repeats are ignored.  Ends when a round changes
    nothing; each round's links are written in the shared folder.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        before, links = links, settle(_stars(_stars(links, large=True), large=False))
        discard(before)
        # one row of counts and sums: equal marks mean that no link moved
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
        mark = now
    raise RuntimeError(f"links still move after {rounds} rounds")
