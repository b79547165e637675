"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): component is the smallest node reachable.

    Self-links and null ends are ignored; nodes without a link do not appear. Every step is a
    grouped minimum (combined before the shuffle) and an equi-join, written durably, so no task or
    driver ever holds a whole component and a lost executor repeats one step at most.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        # done when every node points at one other, which points at none; this is cheaper to ask than a further step
        ends = now.select(F.col("b").alias("a")).distinct().withColumn("_end", F.lit(True))
        if not now.groupBy("a").agg(F.count("*").alias("k")).join(ends, "a", "left").where("k > 1 or _end").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        after = materialize(_small_star(_large_star(now)))
        discard(now)
        now = after
