"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregates and two joins over the edges; the edges go to a
written table each round, so lineage stays short.  Nothing is collected but the
number and a checksum of the edges, to see that a round changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, free_shuffles


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "la")
    out = both.join(least, F.col("a") == F.col("la")).where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "la")
    out = down.join(least, F.col("a") == F.col("la"))
    moved = out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select(F.col("la").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has an edge to another; label is the smallest node of its component."""
    spark = edges.sparkSession
    edges = edges.select(F.greatest(edges[a], edges[b]).alias("a"), F.least(edges[a], edges[b]).alias("b")).where("a != b").distinct()
    table, mark = Written(edges, "edges"), None
    while True:
        after = Written(_small_star(_large_star(table.df)), "edges")
        table.drop()
        table = after
        free_shuffles(spark)
        # order-free checksum; two halves so that sums cannot overflow
        h = F.xxhash64("a", "b")
        now = table.df.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == mark:
            break
        mark = now
    stars = table.df
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
