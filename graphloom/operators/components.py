"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component): component is the least node of the node's component.

    Alternates large-star and small-star steps, each of which links nodes to the least neighbour
    they know of, until every component is a star.  The number of rounds grows with the logarithm of
    the component size, a round moves each edge a constant number of times, and nothing gathers a
    node's neighbours in one place: the least neighbours are a written table, so a hub's edges can be
    split in the join with it.  Every round is written to the shared folder, so lineage stays
    short, and the round before is deleted.  Self-loops give a component of their own node; null ends
    are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    state = materialize(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(state):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # every edge now points from the greater to the lesser node
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(small.where("u <> v").distinct(), "edges")
        for spent in (state, least, large, low):
            discard(spent)
        state = after
    return nodes.join(state, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _stars(state: DataFrame) -> bool:
    """Whether every node has one greater end at most and no end is both a greater and a lesser one."""
    ends = state.select("u", F.lit(1).alias("above"), F.lit(0).alias("below")).union(state.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("above").alias("above"), F.sum("below").alias("below")).where("above > 1 or above = 1 and below > 0").isEmpty()
