"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spend


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node that it reaches.

    Large-star and small-star rounds in turn: each node tells its larger, then its smaller neighbours of the smallest
    node that it knows, until every component is a star around its smallest node. The rounds number the logarithm of a
    component's size. Minima are partial aggregates and joins, so that a node with very many edges is no bottleneck;
    each round is a table in the shared folder, and the one before goes. Self-links and repeated edges do no harm.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = materialise(now, "edges")
    last = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(small.union(small_low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        spend(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).collect()[0]
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
