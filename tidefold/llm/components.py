"""Connected components over a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _sum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node reachable, for a root too.

    Large stars hang each node's larger neighbours on its smallest one, small stars the others; the two alternate
    until nothing changes, in a number of rounds that grows with the log of the longest path. Minima are aggregated
    before they are shuffled; the joins are plain equi joins, whose hot nodes AQE splits. Each round's edges are
    written to the shared folder, so lost executors cost one round. Only counts and a checksum come to the driver.
    Loops and edges with a null end are ignored, repeated edges count once.
    """
    x, y = F.col(a), F.col(b)
    edges = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = _sum(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), "edges")
        if (now := _sum(edges)) == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
