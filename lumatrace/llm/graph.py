"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node that u can reach.

    Each round points every node at its least neighbour, contracts the edges by these pointers and
    drops those that became loops. Nodes are hashes, so that the pointers fall at random and the edges
    shrink by a factor each round. A round is two joins and a map-side combined minimum; it is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    tidy = lambda e: e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    first = len(WRITTEN)
    edges = materialize(tidy(edges))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("root"))
    for _ in range(most_rounds):
        if edges.isEmpty():
            return nodes
        before = WRITTEN[first:]
        least = materialize(edges.groupBy(F.col("u").alias("from")).agg(F.min("v").alias("to")))
        follow = lambda df, c, least=least: df.join(least, df[c] == least["from"], "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")
        nodes = materialize(follow(nodes, "root"))
        edges = materialize(tidy(follow(follow(edges, "u"), "v")))
        discard(edges.sparkSession, [*before, WRITTEN[-3]])  # this round's nodes and edges hold all that is known
    raise RuntimeError(f"edges remain after {most_rounds} rounds")
