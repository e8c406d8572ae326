"""Connected components of an edge table by alternating large-star and
small-star rounds. Every round is two grouped minima and two joins; nothing is
gathered per node, and each round is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import cut_lineage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (u, v) with u > v, again as pairs u > v."""
    both = pairs
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first: then both join sides are plain exchanges and AQE can
    # split the rows of a node with very many neighbours
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("m")))
    near = both.join(least, "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v") \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node of the component. Nodes without
    an edge to another node do not appear."""
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = cut_lineage(pairs)
    digest = None
    while True:
        # same set of pairs as before: every node hangs on its root
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == digest:
            break
        digest = now
        pairs = cut_lineage(_star(_star(pairs, large=True), large=False))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
