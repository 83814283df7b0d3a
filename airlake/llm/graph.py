"""Connected components of an undirected graph as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.session import cut_lineage


def _least(edges: DataFrame, by: str, other: str) -> DataFrame:
    """The smallest ``other`` of every ``by`` (combined before the shuffle)."""
    return edges.groupBy(F.col(by).alias("node")).agg(F.min(other).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: component is the
    smallest node reachable. No edges give no rows; loops and repeated edges
    do no harm.

    Alternating large-star and small-star rounds: every node hands its
    neighbours the smallest node it knows, until only stars are left. A round
    moves each edge once; the edges never grow in number. The rounds join on
    node keys, where a hub's rows may be split by Spark's skew join, and each
    round is cut off with a reliable checkpoint.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    last = None
    while True:
        # large star: a node's larger neighbours are tied to its smallest one
        both = edges.union(edges.select("b", "a"))
        least = _least(both, "a", "b").select("node", F.least("node", "least").alias("least"))
        large = (edges.join(least, edges.b == least.node)
                 .select(F.col("a"), F.col("least").alias("b")).where("a <> b"))
        # small star: a node's smaller neighbours are tied to the smallest
        small = _least(large, "a", "b")
        nearer = (large.join(small, large.a == small.node)
                  .select(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = cut_lineage(nearer.union(small.select(F.col("node").alias("a"), F.col("least").alias("b")))
                            .where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
