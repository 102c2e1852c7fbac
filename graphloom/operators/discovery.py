"""Discovery of missing links and maintenance of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scoring as S
from graphloom.functions.vectors import cosine
from graphloom.operators import nearest
from graphloom.operators.access import update_weights
from graphloom.operators.components import connected_components
from graphloom.operators.rules import noisy_or
from graphloom.operators.traversal import reachable
from graphloom.storage import materialize, materialize_parts

KEY = ["src", "rel", "dst"]


def hypotheses(paths: DataFrame, contradiction: Column | None = None, max_overlap: float = 0.5) -> DataFrame:
    """Proposals from paths (source, target, path, score): a greedy independent subset of a pair's
    paths, noisy-or of their scores, less the contradiction.

    Paths are taken best first; one is independent if its mid nodes overlap with none taken by more
    than ``max_overlap`` (Jaccard)."""
    nodes = F.filter("path", lambda _, i: i % 2 == 0)
    mids = F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 2, F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.concat_ws("|", "path").alias("text"), mids.alias("mids"))))
    overlap = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    none = F.array().cast("array<struct<k: double, text: string, mids: array<string>>>")
    taken = F.aggregate("rows", none, lambda acc, x: F.when(F.exists(acc, lambda y: overlap(y["mids"], x["mids"]) > max_overlap), acc).otherwise(F.concat(acc, F.array(x))))
    out = paths.groupBy("source", "target").agg(rows.alias("rows"), F.count("*").alias("paths")).withColumn("taken", taken)
    value = noisy_or(F.transform("taken", lambda x: -x["k"]))
    return out.select("source", "target", "paths", F.size("taken").alias("independent"), (value * (1 - contradiction) if contradiction is not None else value).alias("confidence"))


def compose_chain(rels: Column, rules: dict[tuple[str, str], str], default: str = "RELATED_TO") -> Column:
    """Fold the composition table over a path's relations."""
    table = F.create_map(*[F.lit(x) for (a, b), c in rules.items() for x in (f"{a}|{b}", c)])
    return F.aggregate(F.slice(rels, F.lit(2), F.greatest(F.size(rels) - 1, F.lit(0))), rels[0], lambda s, x: F.coalesce(F.try_element_at(table, F.concat_ws("|", s, x)), F.lit(default)))


def independence(a: Column, b: Column) -> Column:
    """One less the Jaccard similarity of two paths' mid nodes."""
    return F.lit(1.0) - F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def intersection_nodes(paths: DataFrame, least: int = 2) -> DataFrame:
    """Mid nodes on several paths of a pair (source, target, path)."""
    nodes = F.filter("path", lambda _, i: i % 2 == 0)
    mids = F.array_distinct(F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 2, F.lit(0))))
    return paths.select("source", "target", F.explode(mids).alias("node")).groupBy("source", "target", "node").agg(F.count("*").alias("paths")).where(F.col("paths") >= least)


def unlinked_similar(vectors: DataFrame, queries: DataFrame, edges: DataFrame, low: float = 0.6, high: float = 0.95, top_k: int = 5) -> DataFrame:
    """Unlinked nodes whose cosine to a query node lies in a band: the best few of each query.

    ``vectors`` has id and v; ``queries`` is a stated set of their ids."""
    linked = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    linked = linked.union(linked.select("b", "a")).distinct()
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    top = lambda scored: scored.join(linked, ["a", "b"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    q = vectors.join(queries, "id", "left_semi")
    if nearest.numbered(vectors, "id") and nearest.regular(vectors) and nearest.regular(q):
        more = linked.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))  # a query's links may stand before its best others
        q = materialize(q.join(more, "id", "left").select("id", "v", (F.coalesce("n", F.lit(0)) + top_k).alias("k")), "queries")
        kind = vectors.schema["id"].dataType
        found = (top(part.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "score")) for part in nearest.nearest(vectors, q, low, high, 9))
        return materialize_parts(found, vectors.sparkSession, "unlinked")
    pairs = vectors.select(F.col("id").alias("b"), F.col("v").alias("bv")).join(q.select(F.col("id").alias("a"), F.col("v").alias("av")), F.col("a") != F.col("b"))
    return top(pairs.select("a", "b", F.round(cosine(F.col("av"), F.col("bv")), 9).alias("score")).where((F.col("score") >= low) & (F.col("score") <= high)))


def structural_holes(clustered: DataFrame, top: int) -> DataFrame:
    """Nodes with many neighbours that hardly know each other: degree times one less clustering."""
    return clustered.withColumn("hole", F.col("degree") * (1 - F.col("clustering"))).orderBy(F.desc("hole"), "id").limit(top)


def discovery_potential(gap: Column, density: Column, crossing: Column) -> Column:
    return 0.4 * gap + 0.4 * (1 - density) + 0.2 * crossing


def search_depth(density: Column) -> Column:
    return F.when(density < 0.1, 4).when(density < 0.4, 3).otherwise(2)


def auto_decision(features: dict[str, Column], weights: dict[str, float], bias: float, seen: Column, blocked: Column, cold: int = 20, approve: float = 0.8, reject: float = 0.2) -> Column:
    """Approve, reject or leave for review by a logistic score; few decisions so far mean review."""
    score = F.lit(bias)
    for name, value in weights.items():
        score = score + features[name] * value
    p = S.sigmoid(score)
    return F.when(seen < cold, "review").when(blocked, "reject").when(p >= approve, "approve").when(p <= reject, "reject").otherwise("review")


def finding_threads(findings: DataFrame) -> DataFrame:
    """Findings (finding, node) that share nodes, as threads: finding, thread (least member)."""
    hubs = findings.groupBy("node").agg(F.min("finding").alias("first"))
    links = findings.join(hubs, "node").select(F.col("finding").alias("src"), F.col("first").alias("dst"))
    return connected_components(links).select(F.col("node").alias("finding"), F.col("component").alias("thread"))


def register(candidates: DataFrame) -> DataFrame:
    """Candidates with how often and when last they were named, and the boost that gives."""
    g = candidates.groupBy("source", "target").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return g.withColumn("boost", nomination_boost(F.col("n")))


def nomination_boost(n: Column, cap: float = 3.0) -> Column:
    return F.least(1 + 0.5 * F.log2(n), F.lit(cap))


def recency_score(ages: Column, rate: float = 0.1) -> Column:
    """Mean exponential decay by age, an aggregate."""
    return F.avg(F.exp(-rate * ages))


def discovery_weights(rates: DataFrame, epsilon: float = 0.05, low: float = 0.2, high: float = 5.0, curiosity_share: float = 0.3) -> DataFrame:
    """How much to sample each community (cid, scans, finds, curiosity): the global rate over its
    own, mixed with curiosity; unseen ones get the most."""
    total = rates.agg((F.sum("finds") / F.greatest(F.sum("scans"), F.lit(1e-9))).alias("g"))
    own = F.col("finds") / F.col("scans")
    weight = (1 - curiosity_share) * F.col("g") / (own + epsilon) + curiosity_share * F.coalesce("curiosity", F.lit(0.0)) * high
    return rates.crossJoin(total).withColumn("weight", F.when(F.coalesce("scans", F.lit(0)) == 0, F.lit(high)).otherwise(F.least(F.greatest(weight, F.lit(low)), F.lit(high)))).drop("g")


def curiosity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Entropy of the relations that leave a community, over the most it can be for their number."""
    g = edges.join(communities.select(F.col("id").alias("src"), "cid"), "src").groupBy("cid", "rel").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("cid"))
    return g.withColumn("h", -p * F.log2(p)).groupBy("cid").agg((F.sum("h") / F.log2(F.count("*") + 1.0)).alias("curiosity"))


def confidence_prune(edges: DataFrame, least: float, bridges: DataFrame | None = None) -> DataFrame:
    """Drop edges below a confidence; those that touch a bridge node (id) stay."""
    weak = edges.where(F.col("confidence") < least)
    strong = edges.where(F.coalesce(F.col("confidence") >= least, F.lit(True)))
    if bridges is None:
        return strong
    touch = weak.join(bridges.select(F.col("id").alias("src")), "src", "left_semi").unionByName(weak.join(bridges.select(F.col("id").alias("src")), "src", "left_anti").join(bridges.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return strong.unionByName(touch.select(*strong.columns))


def synthesise(pairs: DataFrame, edges: DataFrame, threshold: float, far_threshold: float, max_hop: int, cap: int) -> DataFrame:
    """New edges for similar pairs (a, b, score) that are near in the graph, or far but very similar;
    the best ``cap``."""
    near = reachable(pairs.select(F.col("a").alias("query_id"), F.col("a").alias("id")).distinct(), edges, max_hop).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "depth")
    joined = pairs.join(near, ["a", "b"], "left")
    ok = (F.col("depth").isNotNull() & (F.col("score") >= threshold)) | (F.col("score") >= far_threshold)
    new = joined.where(ok & F.coalesce(F.col("depth") > 1, F.lit(True)))
    return new.orderBy(F.desc("score"), "a", "b").limit(cap)


def utility(confidence: Column, age_share: Column, uses: Column) -> Column:
    return confidence * (1 - 0.5 * age_share) + F.least(F.lit(0.5), 0.05 * uses)


def utility_prune(edges: DataFrame, least: float, ratio: float) -> DataFrame:
    """Keep edges (with ``utility``) above a least value, and not among the lowest share.

    The cut is the exact quantile of the distinct utilities' counts, found without a global sort of
    the edges."""
    value = F.round("utility", 6)
    hist = edges.groupBy(value.alias("u")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("u"))  # a row per distinct rounded utility
    total = edges.agg(F.count("*").alias("total"))
    cut = hist.withColumn("upto", upto).crossJoin(total).where(F.col("upto") <= F.col("total") * ratio).agg(F.max("u").alias("cut"))
    return edges.crossJoin(cut).where((value >= least) & (F.col("cut").isNull() | (value > F.col("cut")))).drop("cut")


def weight_decay(edges: DataFrame, uses: DataFrame, rate: float = 0.1, baseline: float = 1.0, resistance: float = 5.0, least: float = 0.0) -> DataFrame:
    """Move weights toward a baseline, the slower the more an edge was used (src, rel, dst, uses)."""
    n = F.coalesce("uses", F.lit(0))
    step = rate * (1 - n / (n + resistance)) * (baseline - F.col("weight"))
    return edges.join(uses, KEY, "left").withColumn("weight", F.greatest(F.col("weight") + step, F.lit(least))).drop("uses")


def hebbian(edges: DataFrame, memories: DataFrame, top: int, scale: float, most: float = 10.0) -> DataFrame:
    """Strengthen the edges of the best memories (score, path as array of structs src, rel, dst)."""
    best = memories.orderBy(F.desc("score"), "id").limit(top)
    steps = best.select("score", F.explode("path").alias("e")).select("e.*", (F.col("score") * scale).alias("delta"))
    return update_weights(edges, steps, 0.0, most)


def shortcuts(paths: DataFrame, least: int) -> DataFrame:
    """Shortcut edges for paths (path) seen often."""
    g = paths.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.select(F.col("path")[0].alias("src"), F.lit("SHORTCUT").alias("rel"), F.try_element_at("path", F.lit(-1)).alias("dst"), "n")


def bridge_crossings(crossings: DataFrame, centroids: DataFrame, least: int, similarity: float) -> DataFrame:
    """Nodes that often cross into a community (node, cu, cv) whose centroid is near their own's."""
    g = crossings.groupBy("node", "cu", "cv").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = centroids.select(F.col("cid").alias("cu"), F.col("centroid").alias("ca")), centroids.select(F.col("cid").alias("cv"), F.col("centroid").alias("cb"))
    return g.join(a, "cu").join(b, "cv").withColumn("similarity", cosine(F.col("ca"), F.col("cb"))).where(F.col("similarity") >= similarity).select("node", "cu", "cv", "n", "similarity")


def validate_insight(events: DataFrame, edges: DataFrame, max_hop: int = 3) -> DataFrame:
    """Status of proposed links (source, target): whether the target leads back to the source."""
    back = reachable(events.select(F.col("target").alias("query_id"), F.col("target").alias("id")).distinct(), edges, max_hop).select(F.col("query_id").alias("target"), F.col("id").alias("source"), "depth")
    other = edges.groupBy(F.col("dst").alias("target")).agg(F.countDistinct("src").alias("support"))
    joined = events.join(back, ["source", "target"], "left").join(other, "target", "left")
    status = F.when(F.col("depth").isNotNull() & (F.col("support") > 1), "confirmed").when(F.col("depth").isNotNull(), "circular").when(F.coalesce("support", F.lit(0)) > 1, "supported").otherwise("open")
    return joined.withColumn("status", status)


def most_relevant(memories: DataFrame, seeds: list[str], now: float, rate: float, k: int) -> DataFrame:
    """Memories (id, nodes, at) by decayed Jaccard overlap with the seeds."""
    s = F.array(*map(F.lit, seeds))
    score = F.exp(-rate * (F.lit(now) - F.col("at"))) * F.size(F.array_intersect("nodes", s)) / F.size(F.array_union("nodes", s))
    return memories.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def breaker(decisions: DataFrame, window: int, least_share: float) -> DataFrame:
    """Whether the share of approvals over the last decisions of a source (source, at, approved)
    fell too low."""
    order = Window.partitionBy("source").orderBy("at", "id").rowsBetween(-(window - 1), 0)
    share = F.avg(F.col("approved").cast("double")).over(order)
    return decisions.withColumn("share", share).withColumn("stop", (F.count("*").over(order) >= window) & (share < least_share))


def materialise_findings(edges: DataFrame, findings: DataFrame, provenance: str = "hypothesis") -> DataFrame:
    """Add findings (src, rel, dst, confidence) that are not there yet."""
    new = findings.select(*KEY, "confidence").join(edges, KEY, "left_anti").withColumns({"weight": F.lit(1.0), "provenance": F.lit(provenance)})
    return edges.unionByName(new, allowMissingColumns=True)


def mine_candidates(sources: dict[str, DataFrame], cap: int) -> DataFrame:
    """Candidates (a, b, score) of several finders, each pair once with its best score and finder."""
    out = None
    for name, df in sources.items():
        part = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", F.lit(name).alias("finder"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("a", "b").agg(F.min(F.struct((-F.col("score")).alias("k"), "finder")).alias("m"), F.countDistinct("finder").alias("finders"))
    return best.select("a", "b", (-F.col("m.k")).alias("score"), F.col("m.finder").alias("finder"), "finders").orderBy(F.desc("score"), "a", "b").limit(cap)


def triangulate(forward: DataFrame, backward: DataFrame, agreement: DataFrame, least: float = 0.5) -> DataFrame:
    """Evidence from both directions and several strategies: source, target, score, bridge."""
    back = backward.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("confidence").alias("back"))
    joined = forward.join(back, ["source", "target"], "left").join(agreement, ["source", "target"], "left")
    score = 0.5 * F.col("confidence") + 0.3 * F.coalesce("back", F.lit(0.0)) + 0.2 * F.coalesce("agree", F.lit(0.0))
    return joined.select("source", "target", score.alias("score"), (score >= least).alias("bridge"))


def ttl_prune(rows: DataFrame, now: float, most: float, at: str = "at") -> DataFrame:
    return rows.where(F.lit(now) - F.col(at) <= most)


def boundary_scan(vectors: DataFrame, pairs: DataFrame, threshold: float, top_k: int = 3, discount: float = 0.7) -> DataFrame:
    """Similar nodes (id, cid, v) across adjacent communities (cu, cv), discounted: the best few of
    each pair of communities."""
    order = Window.partitionBy("cu", "cv").orderBy(F.desc("score"), "a", "b")
    top = lambda scored: scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    a = pairs.join(vectors.select(F.col("cid").alias("cu"), "id", "v"), "cu")
    if nearest.numbered(vectors, "id", "cid") and nearest.regular(vectors) and nearest.regular(a):
        kinds = {"cu": pairs.schema["cu"], "cv": pairs.schema["cv"], "a": vectors.schema["id"], "b": vectors.schema["id"]}
        a = materialize(a.where("cv IS NOT NULL"), "queries")
        found = (top(part.withColumns({c: F.col(c).cast(kind.dataType) for c, kind in kinds.items()})) for part in nearest.nearest_of_groups(vectors.where("cid IS NOT NULL"), a, top_k, threshold, 9))
        best = materialize_parts(found, vectors.sparkSession, "boundary").drop("rank")
    else:
        both = a.withColumnsRenamed({"id": "a", "v": "av"}).join(vectors.select(F.col("cid").alias("cv"), F.col("id").alias("b"), F.col("v").alias("bv")), "cv")
        best = both.select("cu", "cv", "a", "b", F.round(cosine(F.col("av"), F.col("bv")), 9).alias("score")).where(F.col("score") >= threshold)
    return top(best).withColumn("potential", F.col("score") * discount)


def self_audit(edges: DataFrame, now: float, old: float) -> DataFrame:
    """Five counts over the graph: weak, unsourced, stale, self-linked and duplicated edges."""
    per = edges.groupBy(*KEY).agg(F.count("*").alias("n"))
    counts = edges.agg(
        F.count(F.when(F.col("confidence") < 0.5, 1)).alias("weak"),
        F.count(F.when(F.coalesce("provenance", F.lit("")).isin("", "triples", "manual", "unknown"), 1)).alias("unsourced"),
        F.count(F.when(F.lit(now) - F.coalesce("valid_to", "valid_from") > old, 1)).alias("stale"),
        F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"),
    )
    return counts.crossJoin(per.agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicated")))


def maintenance(edges: DataFrame, uses: DataFrame, least: float, now: float, old: float) -> DataFrame:
    """The maintenance cycle in order: drop stale, drop weak, decay weights."""
    fresh = edges.where(F.coalesce("valid_to", "valid_from").isNull() | (F.lit(now) - F.coalesce("valid_to", "valid_from") <= old))
    return weight_decay(confidence_prune(fresh, least), uses)


def potentiate_sessions(edges: DataFrame, turns: DataFrame, delta: float, min_turns: int, min_follow: float) -> DataFrame:
    """Strengthen the edges (session, src, rel, dst in ``turns``) of sessions that went on: enough
    turns, enough of them follow-ups."""
    good = turns.groupBy("session").agg(F.count("*").alias("n"), F.avg(F.col("follow_up").cast("double")).alias("f")).where((F.col("n") >= min_turns) & (F.col("f") >= min_follow))
    steps = turns.join(good, "session", "left_semi").select(*KEY, F.lit(delta).alias("delta"))
    return update_weights(edges, steps)
