"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varileaf.llm.common import discard, materialize


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def components(links: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node, for all nodes of links (a, b); loops and repeats don't matter.

    Every round is written to the shared folder; the links of a node with many neighbours are aggregated, never gathered. The
    rounds grow as the logarithm of the longest path. Without links the result is empty.
    """
    greater, less = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = materialize(links.select(greater, less).where("u <> v").distinct(), "edges")
    state = _print(edges)
    while state[0]:
        # large star: all larger neighbours of a node move to its smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours and itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        now = _print(after)
        discard(edges)
        edges = after
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select("v", "v").distinct())
