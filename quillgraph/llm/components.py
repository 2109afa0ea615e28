"""Connected components of a graph of links, with the links and labels as tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tables import stored


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): root is the least node of each component, for every node of a link.

    ``links`` has columns a and b of one orderable type. Alternates two star
    operations until nothing moves: each node's larger neighbours are hung onto its least
    one (large star), then its smaller neighbours are (small star). Both keep the
    components, and every link ends at a root after a number of rounds that is
    logarithmic in the longest path. A node with very many neighbours is met by an
    aggregate for its least neighbour and a join, which Spark can split, and never by a
    collected list. Each star is written to the shared folder, so lineage stays short."""
    ordered = links.select(F.least("a", "b").alias("hi_to"), F.greatest("a", "b").alias("hi")).where("hi != hi_to").select(F.col("hi").alias("u"), F.col("hi_to").alias("v")).distinct()
    edges = stored(ordered, name)
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        # done when every node hangs on one root and no root hangs on another; told by one count, as each job costs the driver memory
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        moving = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR (up = 1 AND n > 1)")
        if moving.count() == 0:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
