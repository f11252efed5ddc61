"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a grouping and a join; nothing is gathered on the driver but two numbers a round. A node's
neighbours are never collected into one value: minima are pre-aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, gather, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points at the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point at the least of them (u > v in every edge)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """cls, label of every node of the pairs (a, b): label is the least node of its component."""
    edges = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    sign = None
    for k in range(most_rounds):
        before, edges = edges, materialise(_small_star(_large_star(edges)), f"star{k}")
        discard(before)
        now = tuple(gather(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))))[0])
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("cls")).distinct().withColumn("label", F.col("cls"))
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).unionByName(roots)
