"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is two aggregations and joins over edges; a node with many neighbours is a partial
minimum, never a list. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.filter("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b; a != b); root is the least node it reaches."""
    current = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        current = store(_small_star(_large_star(current)), "edges")
    own = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return own.union(current.select("b", "b").distinct())
