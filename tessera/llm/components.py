"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crowds import join_counted
from tessera.plans.scratch import materialize


def _stars(edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step over distinct ``edges (u, v)`` with u > v, a written table of ``total`` rows.

    The edges of a hub don't meet in one task: its least neighbour comes from partial minima and goes to them.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")).select("u", F.least("u", "m").alias("m"), "__n")
    least = materialize(least, "stars-least")
    large = join_counted(both.filter("v > u"), least, "u", "__n", 2 * total)
    large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars-large")
    low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")), "stars-low")
    small = join_counted(large, low, "u", "__n", total)
    return (
        small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge in ``edges (a, b)``; the root is the component's least node.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest path. Loops and repeated edges are allowed.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = materialize(now, "stars")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        now = materialize(_stars(now, found[0]), "stars")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
