"""Connected components of an edge table by alternating large and small stars.

Every step is a map-side combined minimum and an equi join, so a hub node's rows are
summed before they move and a skewed join side can be split. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v: point u and its smaller neighbours at the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    turned = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(turned).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest member.

    Edges are undirected; loops, repeats and null ends are ignored, and an empty table gives
    an empty one. Raises if it hasn't settled after ``max_rounds`` (rounds grow with the
    logarithm of the longest path).
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before, now = now, stored(_small_star(_large_star(now)), "edges")
        discard(before)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components have not settled")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
