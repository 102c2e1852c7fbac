"""Path search as joins: beams, exhaustive paths, schemas, recall.

A beam is a table with a row per path.  A hop joins the paths' tails with the edges, scores the
longer paths and keeps the best of each query by a window rank, for all queries at once.  Each hop is
written to the shared folder; the driver only counts hops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scoring as S
from graphloom.functions.vectors import cosine
from graphloom.operators.access import cap_per_node, valid_at
from graphloom.storage import discard, materialize, materialize_slices, plan_slices, slices


#: Seeds of a slice of ``execute_schemas``.
SCHEMA_SEEDS = 250_000


def path_text() -> Column:
    """The path as text: the tie order of equal scores."""
    return F.concat_ws("|", "path")


def seeds_to_paths(seeds: DataFrame) -> DataFrame:
    """Paths of no hops from (query_id, id)."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return seeds.select(
        "query_id",
        F.array("id").alias("path"),
        F.col("id").alias("tail"),
        F.lit(1.0).alias("score"),
        none("double").alias("w"),
        none("int").alias("cseq"),
        none("double").alias("conf"),
        none("string").alias("prov"),
        F.lit(1.0).alias("ba"),
        F.lit(1.0).alias("bb"),
    )


def with_relation_weights(edges: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Add ``rel_weight`` (0 for relations without one) by a join with a table of the weights, whose size the optimizer
    knows; there may be as many relations as the schema has.  Edges that have the column keep it."""
    if "rel_weight" in edges.columns:
        return edges
    if not weights:
        return edges.withColumn("rel_weight", F.lit(0.0))
    given = edges.sparkSession.createDataFrame(pa.table({"rel": pa.array(list(weights), pa.string()), "rel_weight": pa.array(map(float, weights.values()), pa.float64())}))
    return edges.join(given, "rel", "left").na.fill(0.0, ["rel_weight"])


def extend(paths: DataFrame, edges: DataFrame, hop: int, relation_weights: dict[str, float] | None = None, features: DataFrame | None = None, hub_strength: float = 0.0, terminal: bool = False) -> DataFrame:
    """All cycle-free extensions by one edge, scored.

    ``features`` may give id, community and degree of nodes.  An edge's weight is the logistic of its
    features; the path's score is multiplied by it and by the coherence of the communities passed."""
    edges = with_relation_weights(edges, relation_weights)
    out = paths.join(edges.withColumnsRenamed({"weight": "edge_weight"}), F.col("tail") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
    if features is not None:
        out = out.join(features.select(F.col("id").alias("dst"), "community", "degree"), "dst", "left")
    else:
        out = out.withColumns({"community": F.lit(-1), "degree": F.lit(0)})
    before = F.when(F.size("cseq") > 0, F.try_element_at("cseq", F.lit(-1))).otherwise(F.lit(-1))
    parts = {
        "cs": S.community_score(before, F.coalesce("community", F.lit(-1)), F.lit(None).cast("double"), F.lit(False)),
        "etw": F.col("rel_weight"),
        "hd": S.hop_decay(hop),
        "grounding": S.credibility(F.col("provenance")) * F.col("confidence"),
    }
    weight = S.edge_logit(parts)
    if hub_strength and not terminal:
        weight = weight * S.hub_penalty(F.coalesce("degree", F.lit(0)), hub_strength)
    cseq = F.concat("cseq", F.array(F.coalesce("community", F.lit(-1)).cast("int")))
    return out.withColumn("_w", weight).select(
        "query_id",
        F.concat("path", F.array("rel", "dst")).alias("path"),
        F.col("dst").alias("tail"),
        F.round(F.col("score") * F.col("_w") * S.coherence(cseq), 9).alias("score"),
        F.concat("w", F.array("_w")).alias("w"),
        cseq.alias("cseq"),
        F.concat("conf", F.array("confidence")).alias("conf"),
        F.concat("prov", F.array("provenance")).alias("prov"),
        (F.col("ba") + 0.5 * F.col("_w")).alias("ba"),
        (F.col("bb") + 0.5 * (1 - F.col("_w"))).alias("bb"),
    )


def lateral_inhibition(paths: DataFrame, ratio: float, community: Column | None = None) -> DataFrame:
    """Lower a path's score by its rank among the query's paths that end in the same community."""
    group = Window.partitionBy("query_id", community if community is not None else F.try_element_at("cseq", F.lit(-1)))
    rank = F.row_number().over(group.orderBy(F.desc("score"), path_text())) - 1
    return paths.withColumn("score", F.round(F.greatest(F.col("score") * (1 - ratio * rank / F.count("*").over(group)), F.lit(0.0)), 9))


def prune(paths: DataFrame, width: int, floor: float = 0.0, gap: float = 0.0, inhibition: float = 0.0) -> DataFrame:
    """The best ``width`` paths of each query, after a score floor, a floor relative to the query's
    best, and inhibition."""
    if floor:
        paths = paths.where(F.col("score") >= floor)
    if gap:
        best = F.max("score").over(Window.partitionBy("query_id"))
        paths = paths.withColumn("_best", best).where(F.col("score") >= gap * F.col("_best")).drop("_best")
    if inhibition:
        paths = lateral_inhibition(paths, inhibition)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), path_text())
    return paths.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= width).drop("_rank")


def hops(seeds: DataFrame, edges: DataFrame, max_hop: int = 3, width: int | list[int] = 10, neighbours: int = 100, at: float | None = None, penultimate_gap: float = 0.0, inhibition: float = 0.0, **scoring) -> Iterator[DataFrame]:
    """The beam after each hop; the last hop is neither pruned nor written (it is the widest, and most
    consumers aggregate it at once).  Neighbours are capped once, before."""
    edges = edges.where(valid_at(F.lit(at))) if at is not None else edges
    cap = lambda part: with_relation_weights(cap_per_node(part, neighbours), scoring.get("relation_weights")).select("src", "rel", "dst", "weight", "confidence", "provenance", "rel_weight")
    edges = materialize_slices(edges, "src", plan_slices(edges), "capped", cap)
    widths = width if isinstance(width, list) else [width] * max_hop
    beam = seeds_to_paths(seeds)
    for hop in range(1, max_hop + 1):
        if hop == 2:  # seeds that no edge leads to are not needed again
            ends = edges.select(F.col("dst").alias("src")).distinct()
            edges, done = materialize_slices(edges, "src", slices(edges.count()), "onward", lambda part: part.join(ends, "src", "left_semi")), edges
            discard(done)
        elif hop > 2:
            edges, done = materialize(edges.join(beam.select(F.col("tail").alias("src")).distinct(), "src", "left_semi"), "onward"), edges
            discard(done)
        if hop < max_hop:
            gap = penultimate_gap if hop == max_hop - 1 else 0.0
            step = lambda part: prune(extend(part, edges, hop, **scoring), widths[hop - 1], gap=gap, inhibition=inhibition)  # noqa: B023, E731
            beam = materialize_slices(beam, "query_id", slices(beam.count()) if hop > 1 else 1, f"beam{hop}", step)
        else:
            beam = extend(beam, edges, hop, terminal=True, **scoring)
        yield beam


def beam(seeds: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Survivors of all hops of the beam search from (query_id, id)."""
    out = None
    for paths in hops(seeds, edges, **options):
        out = paths if out is None else out.unionByName(paths)
    return out


def stitch(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Join parent paths with child paths that begin at their tails; score is the root of the
    product."""
    c = children.select("query_id", F.col("path")[0].alias("tail"), F.col("path").alias("more"), F.col("tail").alias("end"), F.col("score").alias("s2"))
    joined = parents.join(c, ["query_id", "tail"])
    return joined.select("query_id", F.concat("path", F.slice("more", F.lit(2), F.greatest(F.size("more") - 1, F.lit(0)))).alias("path"), F.col("end").alias("tail"), F.sqrt(F.col("score") * F.col("s2")).alias("score"))


def branch_barrier(paths: DataFrame, share: float = 0.5, guaranteed: int = 10) -> DataFrame:
    """Drop first-hop branches whose best path is below a share of the query's best; the first
    ``guaranteed`` branches by best score stay."""
    best = paths.withColumn("branch", F.try_element_at("path", F.lit(3))).groupBy("query_id", "branch").agg(F.max("score").alias("top"))
    q = Window.partitionBy("query_id")
    kept = best.withColumn("rank", F.row_number().over(q.orderBy(F.desc("top"), "branch"))).withColumn("most", F.max("top").over(q)).where((F.col("rank") <= guaranteed) | (F.col("top") >= share * F.col("most")))
    return paths.withColumn("branch", F.try_element_at("path", F.lit(3))).join(kept.select("query_id", "branch"), ["query_id", "branch"], "left_semi")


def branches(seeds: DataFrame, edges: DataFrame, max_hop: int, width: int) -> DataFrame:
    """An independent beam below each first-hop branch."""
    first = materialize(extend(seeds_to_paths(seeds), edges, 1), "branches")
    sub = first.select(F.concat_ws("#", F.col("query_id").cast("string"), "tail").alias("query_id"), F.col("tail").alias("id"), F.col("query_id").alias("parent")).distinct()
    below = beam(sub.select("query_id", "id"), edges, max_hop=max_hop - 1, width=width)
    below = below.join(sub.select("query_id", "parent"), "query_id").withColumn("query_id", F.col("parent")).drop("parent")
    return first.select("query_id", "path", "tail", "score").unionByName(stitch(first, below.select("query_id", "path", "tail", "score").distinct()))


def bounded_paths(seeds: DataFrame, edges: DataFrame, max_hop: int, targets: DataFrame | None = None) -> DataFrame:
    """All cycle-free paths of up to ``max_hop`` edges from (query_id, id): query_id, path, tail, w
    (edge weights).  With ``targets`` (id) only paths that end there, not passing through one."""
    step = edges.select("src", "rel", "dst", F.col("weight").alias("_w"))
    level = seeds.select("query_id", F.array("id").alias("path"), F.col("id").alias("tail"), F.array().cast("array<double>").alias("w"))
    out = None
    for _ in range(max_hop):
        level = level.join(step, F.col("tail") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        level = materialize(level.select("query_id", F.concat("path", F.array("rel", "dst")).alias("path"), F.col("dst").alias("tail"), F.concat("w", F.array("_w")).alias("w")), "paths")
        done = level if targets is None else level.join(targets.select(F.col("id").alias("tail")), "tail", "left_semi").select(*level.columns)
        out = done if out is None else out.unionByName(done)
        if targets is not None:
            level = level.join(targets.select(F.col("id").alias("tail")), "tail", "left_anti").select(*level.columns)
    return out


def reachable(seeds: DataFrame, edges: DataFrame, max_hop: int) -> DataFrame:
    """Nodes within ``max_hop`` edges with their least depth: query_id, id, depth (seeds: 0)."""
    step = materialize(edges.select("src", "dst").distinct(), "steps")
    level = materialize(seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0)), "reach")
    seen = level
    for depth in range(1, max_hop + 1):
        level = level.join(step, F.col("id") == F.col("src")).select("query_id", F.col("dst").alias("id")).distinct()
        level = materialize(level.join(seen, ["query_id", "id"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        seen = seen.unionByName(level)
    return seen


def mediator_collapse(edges: DataFrame, penalty: float = 0.85, most: int = 5) -> DataFrame:
    """Join the two edges around mediator nodes (ids that begin with /m/ or /g/) into one, scored by
    the lesser confidence times a penalty; a source keeps its best few."""
    mediator = lambda c: F.startswith(F.col(c), F.lit("/m/")) | F.startswith(F.col(c), F.lit("/g/"))
    into = edges.where(mediator("dst")).select(F.col("src").alias("a"), F.col("rel").alias("r1"), F.col("dst").alias("mid"), F.col("confidence").alias("c1"))
    out = edges.where(mediator("src")).select(F.col("src").alias("mid"), F.col("rel").alias("r2"), F.col("dst").alias("b"), F.col("confidence").alias("c2"))
    joined = into.join(out, "mid").where("a <> b").withColumn("score", F.least("c1", "c2") * penalty)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b", "r1", "r2", "mid")
    return joined.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("a", "r1", "mid", "r2", "b", "score")


def two_hop_schemas(edges: DataFrame, min_count: int = 1) -> DataFrame:
    """How many node pairs of edges each pair of relations joins: r1, r2, cnt."""
    into = edges.groupBy(F.col("dst").alias("mid"), F.col("rel").alias("r1")).agg(F.count("*").alias("a"))
    out = edges.groupBy(F.col("src").alias("mid"), F.col("rel").alias("r2")).agg(F.count("*").alias("b"))
    return into.join(out, "mid").groupBy("r1", "r2").agg(F.sum(F.col("a") * F.col("b")).alias("cnt")).where(F.col("cnt") >= min_count)


def predict_schemas(schemas: DataFrame, question: list[float], top_k: int, first: DataFrame | None = None, second: DataFrame | None = None, bonus: float = 0.3) -> DataFrame:
    """Schemas (r1, r2, v) nearest to a question vector; optionally only those that begin with a
    relation of ``first`` (r1), those that go on with one of ``second`` (r2) scored higher."""
    if first is not None:
        schemas = schemas.join(first, "r1", "left_semi")
    score = cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in question]))
    if second is not None:
        schemas = schemas.join(second.select("r2").distinct().withColumn("_seen", F.lit(1.0)), "r2", "left")
        score = score * (1 + bonus * F.coalesce("_seen", F.lit(0.0)))
    return schemas.withColumn("score", score).orderBy(F.desc("score"), "r1", "r2").limit(top_k).select("r1", "r2", "score")


def execute_schemas(seeds: DataFrame, schemas: DataFrame, edges: DataFrame, max_first: int | None = None) -> DataFrame:
    """Answers two hops along scored schemas: the best score of each, without seeds and mid nodes.

    Many seeds are done in slices, as a seed's answers are as many as its mid nodes' second edges."""
    if (n := slices(seeds.count(), SCHEMA_SEEDS)) > 1:
        usable = materialize(edges.join(F.broadcast(schemas.select(F.explode(F.array("r1", "r2")).alias("rel")).distinct()), "rel", "left_semi").select("src", "rel", "dst"), "schema_edges")
        return materialize_slices(seeds, "query_id", n, "schema_answers", lambda part: _execute_schemas(part, schemas, usable, max_first).sortWithinPartitions("query_id"))
    return _execute_schemas(seeds, schemas, edges, max_first)


def _execute_schemas(seeds: DataFrame, schemas: DataFrame, edges: DataFrame, max_first: int | None) -> DataFrame:
    s = schemas.select("r1", "r2", "score")
    first = seeds.join(edges.select(F.col("src").alias("id"), F.col("rel").alias("r1"), F.col("dst").alias("mid")), "id").join(s, "r1")
    if max_first:
        first = first.withColumn("n", F.dense_rank().over(Window.partitionBy("query_id", "r1", "r2").orderBy("mid"))).where(F.col("n") <= max_first)
    first = first.groupBy("query_id", "id", "mid", "r2").agg(F.max("score").alias("score"))
    second = first.join(edges.select(F.col("src").alias("mid"), F.col("rel").alias("r2"), F.col("dst").alias("answer")).distinct(), ["mid", "r2"])
    second = second.where(F.col("answer") != F.col("id")).select("query_id", "answer", "score")
    mids = first.select("query_id", F.col("mid").alias("answer"), F.lit(None).cast("double").alias("score"))
    both = second.unionByName(mids.withColumn("_mid", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("query_id", "answer").agg(F.max("score").alias("score"), F.max("_mid").alias("_mid")).where("_mid IS NULL").drop("_mid")


def meta_beam(seed: str, meta: DataFrame, max_hop: int = 2) -> DataFrame:
    """Paths over the graph of relations (r1, r2, weight): score times weight over 1 + hop."""
    spark = meta.sparkSession
    level = spark.createDataFrame([([seed], 1.0)], "path array<string>, score double")
    out = None
    for hop in range(1, max_hop + 1):
        level = level.join(meta, F.try_element_at("path", F.lit(-1)) == F.col("r1")).where(~F.array_contains("path", F.col("r2")))
        level = materialize(level.select(F.concat("path", F.array("r2")).alias("path"), (F.col("score") * F.col("weight") / (1 + hop)).alias("score")), "meta")
        out = level if out is None else out.unionByName(level)
    return out


def recall(facts: DataFrame, nodes: DataFrame, text: str, max_hops: int, now: float, relations: list[str] | None = None) -> DataFrame:
    """Facts within some hops of the nodes whose label holds the text, unexpired and of the given
    relations."""
    alive = facts.where(F.col("valid_to").isNull() | (F.col("valid_to") >= now))
    alive = alive.where(F.col("rel").isin(relations)) if relations else alive
    start = nodes.where(F.contains(F.lower("label"), F.lit(text.lower()))).select(F.lit(0).alias("query_id"), "id")
    near = reachable(start, alive, max_hops - 1)
    return alive.join(near.select(F.col("id").alias("src"), "depth"), "src")


def looped(seeds: DataFrame, edges: DataFrame, rounds: int = 3, keep: int = 5, stable: float = 0.8, **options) -> DataFrame:
    """Beam, then beam again from the best answers; ends when a round's answers hardly change."""
    best, names = None, None
    current = seeds
    for _ in range(rounds):
        found = beam(current, edges, **options)
        tails = found.groupBy("query_id", "tail").agg(F.max("score").alias("score"))
        best = tails if best is None else best.unionByName(tails).groupBy("query_id", "tail").agg(F.max("score").alias("score"))
        best = materialize(best, "best")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "tail")
        top = materialize(best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).select("query_id", F.col("tail").alias("id")), "top")
        if names is not None:
            both, total = top.intersect(names).count(), top.union(names).distinct().count()
            if total and both / total >= stable:
                break
        names, current = top, seeds.select("query_id", "id").union(top).distinct()
    return best


def trace(paths: DataFrame, width: int) -> DataFrame:
    """Rank and fate of every candidate of a hop, instead of dropping the losers."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), path_text())
    return paths.select("query_id", "path", "score", F.row_number().over(order).alias("rank")).withColumn("kept", F.col("rank") <= width)


def engram_prune(paths: DataFrame, patterns: DataFrame, strength: float, width: int) -> DataFrame:
    """Beam pruning by score times one plus the affinity of the path's relations, which
    ``patterns`` (rels as text, affinity) gives."""
    rels = F.concat_ws(">", F.filter("path", lambda _, i: i % 2 == 1))
    joined = paths.withColumn("rels", rels).join(patterns.select("rels", "affinity"), "rels", "left")
    key = F.col("score") * (1 + strength * F.coalesce("affinity", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(key, 9)), path_text())
    return joined.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= width).drop("_rank", "affinity", "rels")


def sampled_scores(paths: DataFrame, seed: int = 1) -> DataFrame:
    """A draw of each path's Beta posterior, fixed by the path and the seed."""
    @F.pandas_udf("double")
    def draw(a: pd.Series, b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(abs(int(k))).beta(x, y) for x, y, k in zip(a, b, h)])

    return paths.withColumn("sample", draw("ba", "bb", F.xxhash64(path_text(), F.lit(seed))))
