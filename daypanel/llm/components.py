"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut

ROWS = 50_000  # rows of a small table in one partition


def packed(table: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` narrow rows in as few partitions as it needs; one partition is never shuffled."""
    return table.coalesce(max(1, -(-rows // ROWS)))


def _followed(table: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """``column`` replaced by where its value moves to, if it moves."""
    return (
        table.join(moves.select(F.col("_from").alias(column), "_to"), column, "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_to")
    )


def _rank(end: str) -> Column:
    """Ends in an order that has nothing to do with how they are numbered."""
    return F.struct(F.xxhash64(end).alias("h"), F.col(end).alias("v"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges between different ends, the end of lower rank first."""
    low, high = F.least(_rank("a"), _rank("b")), F.greatest(_rank("a"), _rank("b"))
    return edges.filter("a != b").select(low["v"].alias("a"), high["v"].alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b); ``root`` is the least id reachable.

    In each round a vertex moves to its neighbour of lowest rank, if that is lower than its own, further
    hops are followed, and the edges are carried over to the new ends. When no edge between different
    ends is left, equal ends are equal components. Ranks are hashes, so runs of falling rank are short
    whatever the shape: a path shrinks by a factor per round as a star does, and the number of rounds
    grows with the logarithm of the size. Grouping is a partial minimum and joins have unique keys on
    one side, so a vertex with very many edges is neither gathered nor multiplied. Each round is
    checkpointed, and its tables are packed into partitions by their size.
    """
    ends = cut(_oriented(edges))
    left = ends.count()
    ends = packed(ends, left)
    roots = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    roots = packed(cut(roots.withColumn("root", F.col("id"))), 2 * left)
    many = 2 * left
    while left:
        moves = ends.groupBy(F.col("b").alias("_from")).agg(F.min(_rank("a"))["v"].alias("_to"))
        for _ in range(2):
            onward = moves.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
            moves = moves.join(onward, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to"))
        moves = packed(cut(moves), left)
        roots = packed(cut(_followed(roots, "root", moves)), many)
        ends = cut(_oriented(_followed(_followed(ends, "a", moves), "b", moves)))
        left = ends.count()
        ends = packed(ends, left)
    least = cut(roots.groupBy("root").agg(F.min("id").alias("least")))
    return roots.join(least, "root").select("id", F.col("least").alias("root"))
