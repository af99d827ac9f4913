"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe.session import materialise


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node reachable.

    Alternates two steps: every node's larger neighbours, then every node's smaller neighbours and
    itself, are tied to the least node around it. Each step keeps the components, and a star
    around the least node is what stays unchanged. Only one number per round reaches the driver;
    each round is a written table, so a lost executor costs one round. Hubs are joined on
    one row per node, never gathered.
    """
    pairs = materialise(_oriented(edges), label)
    total = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        least = least.select("node", F.least("m", "node").alias("m"))
        # Neighbours above a node go to the least node around it.
        lifted = pairs.join(least, pairs.low == least.node).select(F.col("high").alias("a"), F.col("m").alias("b"))
        large = materialise(_oriented(lifted), label)
        below = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        joined = large.join(below, large.high == below.node)
        small = joined.select(F.col("low").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select(F.col("high").alias("a"), F.col("m").alias("b"))
        )
        pairs = materialise(_oriented(small), label)
        state = pairs.agg(
            F.count("*").alias("n"),
            F.count_distinct("high").alias("nodes"),
            F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("hash"),
        ).first()
        if state == total:
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        total = state


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    )
