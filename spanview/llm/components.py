"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. The smallest neighbour is a map-side combined minimum; no neighbourhood is gathered.
    The join deals out both sides by themselves, so that the links of a node with very many can be split.

    large: each node links its larger neighbours to the smallest node that it sees.
    Else: each node links itself and its smaller neighbours to that node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(spread(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Nodes without an edge are absent. Edges with a null end and loops are ignored. Rounds go on
    until one changes nothing. Each is written to the shared folder, so lost executors cost one
    round at most; links stay on the executors and only a count and a checksum reach the driver.
    """
    now = written(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        after_df = written(_star(_star(now, True), False), "edges")
        after = mark(after_df)
        dropped(now)
        now = after_df
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
