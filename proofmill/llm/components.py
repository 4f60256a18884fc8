"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.store import discard, written


def _state(edges: DataFrame) -> tuple:
    """Number of links and the sum of their hashes: the same after a round that changes nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """The least node that each linked node reaches: node, component. ``links``: a, b (long), each link once or more.

    Every round lets each node point at the least node among its own and its neighbours' (a star around it), so the
    number of rounds grows with the logarithm of the longest chain. A row a link and node; no group is collected. The
    result is a stored table; those of the rounds are deleted as soon as the next one stands.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # Larger neighbours are handed to the least neighbour, then smaller ones: alternating, until each node points at its root.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = written(large.unionByName(edges).groupBy("u").agg(F.min("v").alias("v")), "stars")  # the least known for each
        rest = large.unionByName(edges).join(stars.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        following = written(stars.unionByName(rest).distinct(), "edges")
        discard(edges, least, stars)
        before, edges, state = state, following, _state(following)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    discard(edges)
    return found
