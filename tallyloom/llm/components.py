"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def connected_components(links: DataFrame) -> DataFrame:
    """``(node long, root long)`` for every node in ``links (a long, b long)``; ``root`` is the smallest reachable node.

    Large-star and small-star steps in turn: every node is tied to the
    smallest of its neighbourhood until nothing changes.  A node of many links
    is aggregated before it meets them again; its join is a plain one, which
    adaptive execution may split.  Each round is written once to the shared
    folder; only a count and a checksum come to the driver.
    """
    edges, before = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u != v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.union(nodes.select("root", "root").distinct())
