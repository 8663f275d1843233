"""Connected components of a table of links, by alternating large-star and small-star steps.

Links stay in tables; a step is an aggregation with partial results and a join, so neither a node with very many links nor a
large component meets in one task or at the driver. Every step is written, so a lost executor repeats one step at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import discard, stored


def large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y").select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least.hint("merge"), "b").filter("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return others.unionByName(least.select("b", F.col("m").alias("a"))).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being its smallest node. Loops and repeats don't matter."""
    spark = links.sparkSession
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{folder}/0")
    state, step = None, 0
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state or not now[0]:
            break
        state, step = now, step + 1
        edges = stored(small_star(large_star(edges)), f"{folder}/{step}")
        if step > 1:
            discard(spark, f"{folder}/{step - 1}")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
