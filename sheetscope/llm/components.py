"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetscope.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, of every node of ``edges`` (a, b).

    Stars are pulled together from both sides in turn (large-star, small-star) until
    every node hangs on its component's smallest; rounds grow with the logarithm of the
    graph. Each round's edges are written out. Hubs are keys of joins and of sums that
    combine in the task, never one task's rows. Loops and nulls are left out.
    """
    now = cut_lineage(_distinct(edges.select("a", "b")))
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut_lineage(_small_star(_large_star(now)))
    whole = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return whole.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    """Edges from the larger node ``a`` to the smaller ``b``, each once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _distinct(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _distinct(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
