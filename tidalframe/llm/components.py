"""Connected components by alternating stars, as joins and grouped minima over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds after which a graph counts as stuck; the stars need about the square of log2 of its size.
MAX_ROUNDS = 200


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (a, b) with a > b; the same components remain.

    Each node's least neighbour is a grouped minimum, so a node with very many neighbours is summed up
    before the shuffle, and the join with it can be split by the planner.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    floor = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(floor, "a")
    small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
    return small.distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node it reaches.

    ``edges`` has integer columns a and b. Loops, nulls, repeated and turned edges do no harm. Each
    round is written to the shared folder; the driver sees a count and a checksum.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(start, "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = written(_stars(now), "edges")
        last, seen = seen, _digest(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
