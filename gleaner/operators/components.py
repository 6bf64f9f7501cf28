"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import discard, stored

MOST_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) from (a, b); a component is named by its least node.

    Large-star and small-star steps take turns until the links stay as they are:
    every node ends up linked to the least of its component only.  A node with
    very many links is joined with its minimum, never gathered; the rounds grow
    with the logarithm of the nodes, whatever the length of a chain.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        turned = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = _least(turned).select("u", F.least("u", "m").alias("m"))
        large = turned.join(near, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _least(down)
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        before, links = links, stored(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        discard(before)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    ends = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
