"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut


def _settled(edges: DataFrame) -> bool:
    """Are the edges (a > b) stars: does each ``a`` have one edge, and is no ``b`` an ``a`` as well?

    One shuffle after a partial aggregation; the driver receives a count.
    """
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    roles = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up = 1 and down = 1)").count() == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a > b): every neighbour is linked to the smallest one instead.

    Minima come from a partial aggregation, so a node with very many neighbours costs one row a task.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id that occurs in the edges (a, b), and the smallest id it can reach.

    Takes a number of rounds logarithmic in the length of chains; each is written to the shared
    folder, so a lost executor repeats one round at most. Edges may repeat, run either way or
    join an id with itself; ids without an edge to another id do not occur in the result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.where("a > b").distinct(), "edges")
    while not _settled(edges):
        edges = cut(_star(_star(edges, large=True), large=False), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
