"""Connected components over an edge table, as joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import written


def forest(links: np.ndarray, n: int) -> np.ndarray:
    """Those of ``links`` (rows of two numbers below ``n``) that join what wasn't joined before."""
    parent, keep = list(range(n)), []
    for k, (a, b) in enumerate(links.tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[b] = a
            keep.append(k)
    return links[keep].reshape(-1, 2)


def with_key(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with an aggregate of one row for each ``key``, with a sort-merge join whose heavy keys Spark can split.

    Sort-merge by hint, as files of ids are so small that Spark would broadcast millions of rows. The second key keeps the
    aggregate's own shuffle from serving the join: Spark splits only what was dealt out for the join itself.
    """
    again = F.xxhash64(key).alias("_again")
    return rows.select("*", again).join(known.select("*", again).hint("merge"), [key, "_again"]).drop("_again")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node that links reach.

    Alternating large-star and small-star steps: each node passes its smallest neighbour to its larger (then
    smaller) neighbours, so hubs shrink to stars in a number of rounds that grows with the logarithm of a
    chain's length. Each step is one aggregate and one join, whose heavy keys Spark can split, and every round
    is written to the shared folder. Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # large star: every neighbour that is larger than the node goes to the node's least neighbour (or itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = with_key(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the neighbours that are smaller, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_key(large, least, "a")
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(step, "edges")
        sign = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
