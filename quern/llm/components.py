"""Connected components by alternating star contractions, in DataFrame operations only.

Each round gives every node's larger neighbours to the least node near it (large star), then each node's smaller
neighbours (small star). Minima are pre-aggregated before they are shuffled, the joins are plain equi-joins whose large
side Spark may split, and each round ends in a checkpoint, so neither a hub nor a lost executor stops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in links (a, b long), roots included.

    Links may repeat, point either way or join a node to itself; rows with a null end are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = checkpointed(edges.where(links["a"].isNotNull() & links["b"].isNotNull()).distinct())
    alone = edges.where("u = v").select(F.col("u").alias("node"))
    edges = edges.where("u <> v")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = stars.union(edges.select("v", "v").distinct()).union(alone.select("node", "node"))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))
