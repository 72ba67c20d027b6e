"""Connected components over a table of edges, by alternating large and small stars.

Each half step is one aggregation with partial sums and one join on the vertex. A vertex with more than a thousandth of all
edges would be one task's work in that join, so those (fewer than a thousand) are joined by broadcast and only the others
by a shuffle. Every round is cut to a written table, and the table of the round before goes. The number of rounds grows with
the logarithm of the longest chain. Two totals and the hot vertices of each half step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, dropped, join_hot


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_hot(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = join_hot(edges, least, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every vertex of edges (a, b) that is not itself the smallest of its component."""
    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(oriented), None
    while True:
        totals = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if totals == before or not totals[0]:
            return now.select("a", F.col("b").alias("root"))
        before, last = totals, now
        now = apart(edges.sparkSession, lambda: _small_star(cut(_large_star(last).distinct())).distinct())
        dropped(last)
