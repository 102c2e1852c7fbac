"""Graph access: lookups, expansion, statistics, search and edge updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine
from graphloom.operators import nearest
from graphloom.storage import materialize_parts
from graphloom.graph import nodes_of, symmetrised


def entity(nodes: DataFrame, entity_id: str) -> DataFrame:
    """One node; its label defaults to its id, its type to ``entity``."""
    return nodes.where(F.col("id") == entity_id).select("id", F.coalesce("label", "id").alias("label"), F.coalesce("type", F.lit("entity")).alias("type"))


def expand(frontier: DataFrame, edges: DataFrame, relations: list[str] | None = None, most: int | None = None, directed: bool = True, on: str = "id") -> DataFrame:
    """Edges out of the frontier's nodes.  ``most`` caps a node's edges, in order of (dst, rel, edge
    values), before the join, so that hubs do not blow it up."""
    out = edges if directed else symmetrised(edges)
    if relations:
        out = out.where(F.col("rel").isin(relations))
    out = out.join(frontier.select(F.col(on).alias("src")).distinct(), "src", "left_semi")
    return cap_per_node(out, most) if most else out


def cap_per_node(edges: DataFrame, most: int) -> DataFrame:
    """At most ``most`` edges of each source node, by a fixed order."""
    order = Window.partitionBy("src").orderBy("dst", "rel", "valid_from", "weight", "confidence")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """One ``RELATED_TO`` edge per pair of nodes."""
    return edges.groupBy("src", "dst").agg(F.lit("RELATED_TO").alias("rel"), F.count("*").alias("parallel"))


def relation_types(edges: DataFrame) -> DataFrame:
    """Sorted distinct outgoing relations of each node."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("rel")).alias("rels"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select("rel").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Total degree of every node: id, degree; both ends count."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def relation_statistics(edges: DataFrame) -> DataFrame:
    """Per relation: edges, distinct ends, and the sum of target degrees."""
    deg = degrees(edges).select(F.col("id").alias("dst"), "degree")
    return edges.join(deg, "dst").groupBy("rel").agg(F.count("*").alias("freq"), F.countDistinct("dst").alias("targets"), F.countDistinct("src").alias("sources"), F.sum("degree").alias("degree_sum"))


def adaptive_resolution(n_nodes: Column) -> Column:
    """Community resolution by graph size."""
    return F.when(n_nodes < 100, 0.5).when(n_nodes < 1000, 1.0).when(n_nodes < 10_000, 1.5).otherwise(2.0)


def valid_at(at: Column, hard: bool = True) -> Column:
    """Whether an edge is valid at a time; null bounds are open, the end counts only if ``hard``."""
    ok = F.col("valid_from").isNull() | (F.col("valid_from") <= at)
    return ok & (F.col("valid_to").isNull() | (at <= F.col("valid_to"))) if hard else ok


def meta_graph(edges: DataFrame) -> DataFrame:
    """Pairs of relations that meet at a node: count, and count times the log of how few relations
    follow the first.  Joins per-node relation counts, so a hub costs a row per pair of relations."""
    into = edges.groupBy(F.col("dst").alias("mid"), F.col("rel").alias("r1")).agg(F.count("*").alias("n1"))
    out = edges.groupBy(F.col("src").alias("mid"), F.col("rel").alias("r2")).agg(F.count("*").alias("n2"))
    pairs = into.join(out, "mid").groupBy("r1", "r2").agg(F.sum(F.col("n1") * F.col("n2")).alias("cnt"))
    totals = pairs.groupBy(F.col("r2")).agg(F.count("*").alias("df"))
    total = pairs.select("r1").distinct().agg(F.count("*").alias("n"))
    return pairs.join(totals, "r2").crossJoin(total).select("r1", "r2", "cnt", (F.col("cnt") * F.log((F.col("n") + 1.0) / F.col("df"))).alias("weight"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text."""
    low = F.lower(text)
    n = F.length(low) - 2
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))))


def trigram_index(nodes: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Inverted index of trigrams: gram, id, and the node's number of trigrams."""
    text = F.concat_ws(" ", F.col(label_col), F.col(id_col).cast("string"))
    return nodes.select(F.col(id_col).alias("id"), trigrams(text).alias("grams")).select("id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))


def trigram_search(index: DataFrame, query: str, top_k: int) -> DataFrame:
    """Nodes by shared trigrams over the sum of both trigram counts; ties by id."""
    wanted = index.sparkSession.range(1).select(trigrams(F.lit(query)).alias("q")).select(F.size("q").alias("n"), F.explode("q").alias("gram"))
    hits = index.join(F.broadcast(wanted), "gram")  # the trigrams of one query
    scored = hits.groupBy("id").agg((F.count("*") / (F.max("n") + F.max("size"))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(top_k)


def find_entities(nodes: DataFrame, query: str, top_k: int) -> DataFrame:
    """An exact id first, then trigram matches."""
    exact = nodes.where(F.col("id") == query).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("tier"))
    fuzzy = trigram_search(trigram_index(nodes), query, top_k).where(F.col("id") != query).select("id", "score", F.lit(1).alias("tier"))
    return exact.unionByName(fuzzy).orderBy("tier", F.desc("score"), "id").limit(top_k)


def vector_search(vectors: DataFrame, queries: DataFrame, top_k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact cosine top-k of each query vector over all vectors, itself excluded.

    The queries are a stated set, sent to the workers part by part; irregular vectors are compared pair by pair."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = lambda scored: scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if nearest.numbered(v, "id") and nearest.regular(v) and nearest.regular(q):
        kind = v.schema["id"].dataType
        found = (top(part.select(F.col("a").cast(kind).alias("query_id"), F.col("b").cast(kind).alias("id"), "score")) for part in nearest.nearest(v, q.withColumn("k", F.lit(top_k))))
        return materialize_parts(found, v.sparkSession, "nearest")
    pairs = v.join(q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), F.col("id") != F.col("query_id"))
    return top(pairs.select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score")))


def similarities(vectors: DataFrame, queries: str) -> DataFrame:
    """Cosine of each vector that meets the condition with every other (id, v, group): u, w, cu, cv, sim."""
    q = vectors.where(queries)
    if nearest.numbered(vectors, "id", "group") and nearest.regular(vectors) and nearest.regular(q):
        return nearest.all_pairs(vectors, q)
    pairs = vectors.select(F.col("id").alias("w"), F.col("v").alias("ev"), F.col("group").alias("cv")).join(q.select(F.col("id").alias("u"), F.col("v").alias("eu"), F.col("group").alias("cu")), F.col("u") != F.col("w"))
    return pairs.select("u", "w", "cu", "cv", cosine(F.col("eu"), F.col("ev")).alias("sim"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges replace those of equal (src, rel, dst)."""
    return edges.join(new, ["src", "rel", "dst"], "left_anti").unionByName(new, allowMissingColumns=True)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "rel", "dst"], "left_anti")


def update_weights(edges: DataFrame, deltas: DataFrame, low: float = 0.0, high: float = 10.0, column: str = "weight") -> DataFrame:
    """Add summed deltas to a column of the matching edges, within bounds."""
    sums = deltas.groupBy("src", "rel", "dst").agg(F.sum("delta").alias("_delta"))
    moved = F.when(F.col("_delta").isNull(), F.col(column)).otherwise(F.least(F.greatest(F.col(column) + F.col("_delta"), F.lit(low)), F.lit(high)))
    return edges.join(sums, ["src", "rel", "dst"], "left").withColumn(column, moved).drop("_delta")


def normalise(
    rows: DataFrame,
    namespace: str = "",
    aliases: DataFrame | None = None,
    relation_map: dict[str, str] | None = None,
    strict_provenance: bool = False,
) -> DataFrame:
    """Clean raw triples: trim, resolve aliases, prefix, map and upper-case relations, bound
    confidences, cast weights.  Rows without both ends go; with ``strict_provenance`` a row without a source
    keeps a confidence of at most 0.1."""
    out = rows
    for end in ("src", "dst"):
        out = out.withColumn(end, F.nullif(F.trim(F.col(end)), F.lit("")))
        if aliases is not None:
            out = out.join(aliases.select(F.col("alias").alias(end), F.col("canonical").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        if namespace:
            out = out.withColumn(end, F.concat(F.lit(f"{namespace}:"), F.col(end)))
    rel = F.upper(F.regexp_replace(F.coalesce(F.nullif(F.trim("rel"), F.lit("")), F.lit("RELATED_TO")), r"\s+", "_"))
    for name, to in (relation_map or {}).items():
        rel = F.when(F.upper(F.trim("rel")) == name.upper(), F.lit(to)).otherwise(rel)
    confidence = F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    if strict_provenance:
        confidence = F.when(F.coalesce(F.trim("provenance"), F.lit("")) == "", F.least(confidence, F.lit(0.1))).otherwise(confidence)
    return out.where("src is not null and dst is not null").withColumns({"rel": rel, "confidence": confidence, "weight": F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0))})


def community_signatures(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", community_col: str = "label") -> DataFrame:
    """Centroid and size of each community; means are taken per dimension, with partial sums."""
    parts = vectors.select(F.col(community_col).alias("cid"), F.posexplode(vector_col).alias("pos", "x"))
    means = parts.groupBy("cid", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return means.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"), F.max("n").alias("size"))


def rank_by_centroid(signatures: DataFrame, query: list[float], top_k: int) -> DataFrame:
    score = cosine(F.col("centroid"), F.array(*[F.lit(float(x)) for x in query]))
    return signatures.select("cid", score.alias("score")).orderBy(F.desc("score"), "cid").limit(top_k)


def holders(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Sources that hold any of the ids: exact membership in place of a Bloom filter."""
    return members.join(ids, "id", "left_semi").select("source").distinct()


def all_entities(edges: DataFrame) -> DataFrame:
    return nodes_of(edges)
