"""Several graphs as one: aliases, alignment, union, masked search, sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace both ends by their canonical ids (alias, canonical)."""
    out = edges
    for end in ("src", "dst"):
        a = aliases.select(F.col("alias").alias(end), F.col("canonical").alias("_c"))
        out = out.join(a, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return out.select(*edges.columns)


def align_by_label(nodes: dict[str, DataFrame]) -> DataFrame:
    """Nodes of several sources with one normalised label share a canonical id: source, id,
    canonical.  Labels of a single source are not aligned."""
    every = None
    for source, df in nodes.items():
        part = df.select(F.lit(source).alias("source"), "id", F.regexp_replace(F.lower(F.trim("label")), r"\s+", " ").alias("key"))
        every = part if every is None else every.unionByName(part)
    shared = every.groupBy("key").agg(F.min("id").alias("canonical"), F.countDistinct("source").alias("sources")).where("sources > 1")
    return every.join(shared, "key").select("source", "id", "canonical")


def federated_union(graphs: dict[str, DataFrame], aliases: DataFrame | None = None) -> DataFrame:
    """Edges of all graphs on canonical ids; an edge of several graphs stands once with the best
    confidence and the number of its sources."""
    out = None
    for source, edges in graphs.items():
        part = (resolve_aliases(edges, aliases) if aliases is not None else edges).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.countDistinct("source").alias("sources"))


def masked_search(results: dict[str, DataFrame], top_k: int) -> DataFrame:
    """The best hits (id, type, score) over all sources, without other attributes."""
    out = None
    for source, df in results.items():
        part = df.select(F.lit(source).alias("source"), "id", "type", "score")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("score"), "id", "source").limit(top_k)


def shard_of(community: Column, shards: int) -> Column:
    """A stable shard of a community."""
    return F.pmod(F.conv(F.substring(F.md5(community.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def shard_sizes(members: DataFrame, shards: int) -> DataFrame:
    return members.groupBy(shard_of(F.col("cid"), shards).alias("shard")).agg(F.count("*").alias("n"))


def stitch_hops(first: DataFrame, second: DataFrame, top_k: int) -> DataFrame:
    """Join partial paths (query_id, path, tail, score) of two shards at their meeting node."""
    s = second.select("query_id", F.col("path")[0].alias("tail"), F.col("path").alias("more"), F.col("tail").alias("end"), F.col("score").alias("s2"))
    joined = first.join(s, ["query_id", "tail"]).select("query_id", F.concat("path", F.slice("more", F.lit(2), F.size("more"))).alias("path"), F.col("end").alias("tail"), F.sqrt(F.col("score") * F.col("s2")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.concat_ws("|", "path"))
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def apply_delta(communities: DataFrame, delta: DataFrame) -> DataFrame:
    """Communities (id, cid) after another worker's changes."""
    return communities.join(delta.select("id", F.col("cid").alias("_new")), "id", "full").select("id", F.coalesce("_new", "cid").alias("cid"))
