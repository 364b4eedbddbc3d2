"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise, release


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under exactly one other, which hangs under none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"))
    )
    counts = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("all"))
    return counts.filter((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("all") > 1))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Each round hangs the neighbours of every node under their smallest one
    (Kiveris and others, 2014), so a star of any size is one group sum and one
    join, never a collected list. Links of a node with itself, repeated links
    and null ends are ignored; no links give no rows.
    """
    edges = materialise(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("edge")
        )
        before = edges
        edges = materialise(
            small.select("edge.*").filter(F.col("u") != F.col("v")).distinct(), "edges"
        )
        release(before)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
