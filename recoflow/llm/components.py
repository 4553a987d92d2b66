"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex ties its larger neighbours to the smallest of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex ties its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: no vertex has two smaller neighbours, or both a
    smaller and a larger one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) with u > v, where v is the smallest vertex that u reaches; vertices that
    are the smallest of their component, or have no link, are left out.

    links: u, v (long), in either order; loops and repetitions do not matter.  Each
    round is written to the shared folder; a hub is never gathered, as only minima are
    grouped, and adaptive execution splits the join of its links.  Links that are stars
    need no round.  Raises if ``rounds`` do not suffice, which takes more vertices than
    any table has: rounds grow with the logarithm of a component.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    for done in range(rounds + 1):
        if _settled(edges):
            return edges
        if done < rounds:
            edges = written(_small_star(_large_star(edges)))
    raise RuntimeError(f"components are not settled after {rounds} rounds")
