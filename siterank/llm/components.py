"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.sources.staging import drop_stage, stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie the neighbours of every node to the smallest node it knows: the larger ones, seen from both ends of an
    edge, or the smaller ones and itself. Edges are (u, v) with u > v. A node with very many edges is on the left
    side of the join only, where adaptive execution deals its rows to several tasks."""
    seen = edges
    if larger:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = seen.groupBy("u").agg(F.min("v").alias("m"))
    both = seen.join(low, "u")
    if larger:
        tied = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        tied = both.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return tied.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (u, v), of whole numbers: root is the smallest node it is connected to.

    Stars are contracted in alternation, so the number of rounds grows with the logarithm of the longest path. Each
    round starts from a table in the shared folder. NULLs and links of a node to itself are left out.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(edges, "edges")
    while True:
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        )
        seen = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not seen.agg(F.max((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1)))).first()[0]:
            break
        after = stage(_star(_star(now, True), False), "edges")
        drop_stage(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
