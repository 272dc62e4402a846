"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_hot, materialize

MOST_ROUNDS = 60


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One round over ``n`` edges: tie larger neighbours to the least neighbour, then the rest of each node's smaller
    side to its least. Nodes with very many neighbours are met by a bounded broadcast, not in one task."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    large = join_hot(both, least, "a", "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    small = join_hot(large, down, "a", "n", 2 * n)
    return small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Least neighbours come from sums with a map side; each round is a written table, so lost executors repeat one round
    at most, and only a count and a hash of the edges come to the driver. An edge from a node to itself is passed over;
    an empty table gives an empty one.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == seen or not said[0]:
            break
        seen, before = said, now
        now = materialize(_stars(before, said[0]), "stars")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
