"""Connected components by alternating large-star and small-star steps.

Each round points every node's larger neighbours, and then its smaller ones,
at its smallest neighbour; the number of rounds grows with the logarithm of the
longest chain.  A round is joins and minima over edges, cut by a checkpoint;
minima combine before the shuffle and the joins may be split at hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import cut


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of u and its neighbours as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns u, v); component is the smallest node reachable.

    Edges with a null end are ignored; repeated edges and loops are harmless;
    no edges give no rows.
    """
    now = cut(_canonical(edges.dropna()))
    nodes = now
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(_canonical(large))
        now = cut(_canonical(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                             .unionByName(small.select("u", F.col("m").alias("v")))))
    roots = nodes.select(F.col("v").alias("node")).union(nodes.select("u")).distinct()
    return roots.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component"))
