"""Graph analytics: centrality, communities, modularity, distances, coarsening.

Iterations are joins and partial aggregates over the edge table.  Each round is written to the
shared folder (``materialize``), so lineage stays short and a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import symmetrised
from graphloom.operators.access import degrees
from graphloom.operators.components import connected_components
from graphloom.storage import discard, materialize, materialize_slices, plan_slices, slices

#: Links of a slice of a round of label propagation.
VOTES = 30_000_000
#: Bytes of the tables read for a slice of the pairs that are numbered.
CODED_BYTES = 1 << 29


def profile(edges: DataFrame, hub_percent: int = 1) -> DataFrame:
    """One row: nodes, degree share of the top hubs, variation of degrees, regime and beam width.

    The least degree among the hubs comes from a histogram of degrees, so no global sort is needed."""
    deg = degrees(edges)
    hist = deg.groupBy("degree").agg(F.count("*").alias("n"))
    total = hist.agg(F.sum("n").alias("nodes"), F.sum(F.col("n") * F.col("degree")).alias("ends"))
    above = F.sum("n").over(Window.orderBy(F.desc("degree")))  # a row per distinct degree
    hubs = hist.withColumn("upto", above).crossJoin(total).withColumn("k", F.greatest(F.lit(1), F.expr(f"nodes * {hub_percent} div 100")))
    taken = F.greatest(F.least(F.col("n"), F.col("k") - (F.col("upto") - F.col("n"))), F.lit(0))
    hub = hubs.agg((F.sum(taken * F.col("degree")) / F.max("ends")).alias("hub"), F.max("nodes").alias("nodes"))
    cv = deg.agg((F.stddev_pop("degree") / F.avg("degree")).alias("cv"))
    regime = F.when(F.col("hub") > 0.4, "hub").when(F.col("cv") > 1.5, "skewed").otherwise("flat")
    return hub.crossJoin(cv).select("nodes", "hub", "cv", regime.alias("regime"), F.when(F.col("hub") > 0.4, 20).otherwise(10).alias("width"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, restart: DataFrame | None = None) -> DataFrame:
    """Ranks (id, rank) after a fixed number of rounds; sinks' rank returns by the restart vector.

    ``restart`` (id) makes it personal: all restarts go there."""
    pairs = materialize(edges.groupBy("src", "dst").agg(F.sum(F.lit(1.0)).alias("w")), "pairs")
    out = pairs.groupBy("src").agg(F.sum("w").alias("out"))
    links = materialize(pairs.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), "links")
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    starts = nodes.withColumn("p", F.lit(1.0)) if restart is None else nodes.join(restart.select("id").distinct().withColumn("p", F.lit(1.0)), "id", "left").fillna(0.0, ["p"])
    total = starts.agg(F.sum("p")).first()[0] or 1.0
    sinks = nodes.join(out, F.col("id") == F.col("src"), "left").select("id", F.col("out").isNull().alias("sink"))
    state = materialize(starts.withColumn("p", F.col("p") / total).join(sinks, "id").withColumn("rank", F.col("p")), "ranks")
    for _ in range(rounds):
        lost = state.where("sink").agg(F.sum("rank")).first()[0] or 0.0
        gained = links.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = damping * (F.coalesce("got", F.lit(0.0)) + F.lit(float(lost)) * F.col("p")) + (1 - damping) * F.col("p")
        state = materialize(state.join(gained, F.col("id") == F.col("dst"), "left").select("id", "p", "sink", new.alias("rank")), "ranks")
    return state.select("id", "rank")


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, n) with numbers in the order of their ids, and links (src, dst, w) of numbers, both directions, without
    loops; w counts the edges of either direction.  Numbers are sorted, compared and moved faster than texts."""
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = materialize_slices(ends, "a", plan_slices(ends, CODED_BYTES), "pairs", lambda part: part.groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    nodes = materialize(ids.orderBy("id").withColumn("n", F.monotonically_increasing_id()), "nodes")
    numbers = pairs.join(nodes.toDF("a", "src"), "a").join(nodes.toDF("b", "dst"), "b").select("src", "dst", "w")
    one = materialize(numbers, "coded")
    discard(pairs)
    links = materialize(symmetrised(one).repartition("src").sortWithinPartitions("src"), "links")
    discard(one)
    return nodes, links


def decoded(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Communities (id, cid) of numbers as those of ids."""
    names = communities.join(nodes.toDF("name", "id"), "id").select("name", "cid")
    return names.join(nodes.toDF("to", "cid"), "cid").select(F.col("name").alias("id"), F.col("to").alias("cid"))


def label_propagation(edges: DataFrame, rounds: int = 5, weight_col: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Synchronous label propagation (id, label): the heaviest label among neighbours and the node
    itself, ties to the least label, so that the result does not depend on order."""
    weight = (F.sum(weight_col) if weight_col else F.count("*")).cast("double").alias("w")
    both = symmetrised(edges).where("src <> dst")
    links = materialize_slices(both, "src", plan_slices(both), "links", lambda part: part.groupBy("src", "dst").agg(weight).sortWithinPartitions("src"))
    return propagate(links, rounds, initial)


def propagate(links: DataFrame, rounds: int, initial: DataFrame | None = None) -> DataFrame:
    """Rounds of label propagation over written links (src, dst, w) that hold both directions: id, label."""
    n = slices(links.count(), VOTES)
    state = initial or links.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        own = state.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))

        def best(part: DataFrame, state: DataFrame = state) -> DataFrame:
            votes = part.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
            return votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("id", "b.label")

        state = materialize_slices(links.unionByName(own), "src", n, "labels", best)
    return state


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Newman-Girvan modularity of a partition (id, cid) of an undirected edge table: one row."""
    cu, cv = communities.select(F.col("id").alias("src"), F.col("cid").alias("cu")), communities.select(F.col("id").alias("dst"), F.col("cid").alias("cv"))
    placed = edges.join(cu, "src").join(cv, "dst")
    inside = placed.where("cu = cv").groupBy(F.col("cu").alias("cid")).agg(F.count("*").alias("inner"))
    ends = placed.select(F.explode(F.array("cu", "cv")).alias("cid")).groupBy("cid").agg(F.count("*").alias("ends"))
    total = placed.agg(F.count("*").alias("m"))
    share = F.coalesce("inner", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("ends") / (2 * F.col("m")), 2)
    return ends.join(inside, "cid", "left").crossJoin(total).agg(F.sum(share).alias("q"))


def soft_membership(edges: DataFrame, communities: DataFrame, self_weight: float = 0.1) -> DataFrame:
    """Share of each community among a node's neighbours, its own raised by ``self_weight`` of the
    degree: id, cid, p."""
    links = symmetrised(edges.select("src", "dst"))
    votes = links.join(communities.select(F.col("id").alias("dst"), "cid"), "dst").groupBy(F.col("src").alias("id"), "cid").agg(F.count("*").cast("double").alias("w"))
    own = links.groupBy(F.col("src").alias("id")).agg((F.count("*") * self_weight).alias("w")).join(communities, "id").select("id", "cid", "w")
    sums = votes.unionByName(own).groupBy("id", "cid").agg(F.sum("w").alias("w"))
    total = sums.groupBy("id").agg(F.sum("w").alias("t"))
    return sums.join(total, "id").select("id", "cid", (F.col("w") / F.col("t")).alias("p"))


def community_graph(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Links between different communities with the number of edges: cu < cv, n."""
    cu, cv = communities.select(F.col("id").alias("src"), F.col("cid").alias("a")), communities.select(F.col("id").alias("dst"), F.col("cid").alias("b"))
    placed = edges.join(cu, "src").join(cv, "dst").where("a <> b")
    return placed.groupBy(F.least("a", "b").alias("cu"), F.greatest("a", "b").alias("cv")).agg(F.count("*").alias("n"))


def community_distances(pairs: DataFrame, most: int = 5) -> DataFrame:
    """Hops between communities up to ``most``: cu, cv, d (both directions)."""
    step = pairs.select("cu", "cv").union(pairs.select("cv", "cu")).distinct()
    found = materialize(step.withColumn("d", F.lit(1)), "distances")
    edge = found
    for d in range(2, most + 1):
        new = edge.select("cu", F.col("cv").alias("mid")).join(step.select(F.col("cu").alias("mid"), "cv"), "mid").where("cu <> cv").select("cu", "cv").distinct()
        new = materialize(new.join(found, ["cu", "cv"], "left_anti").withColumn("d", F.lit(d)), "distances")
        if new.isEmpty():
            break
        found, edge = materialize(found.unionByName(new), "distances"), new
    return found


def merge_small(edges: DataFrame, communities: DataFrame, min_size: int, rounds: int = 3) -> DataFrame:
    """Communities below ``min_size`` join the neighbour with most shared edges (then the least id).

    All small ones move at once; one that would join another small one does so only toward a
    greater community or, of equal ones, the lesser id, so moves cannot swap."""
    for _ in range(rounds):
        sizes = communities.groupBy("cid").agg(F.count("*").alias("size"))
        links = community_graph(edges, communities)
        both = links.select("cu", "cv", "n").union(links.select("cv", "cu", "n")).toDF("cid", "to", "n")
        options = both.join(sizes, "cid").where(F.col("size") < min_size).join(sizes.toDF("to", "to_size"), "to")
        options = options.where((F.col("to_size") > F.col("size")) | ((F.col("to_size") == F.col("size")) & (F.col("to") < F.col("cid"))))
        moves = options.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("n"), "to")).alias("b")).select("cid", F.col("b.to").alias("to"))
        communities = materialize(communities.join(moves, "cid", "left").select("id", F.coalesce("to", "cid").alias("cid")), "communities")
    return communities


def split_disconnected(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Connected parts inside each community become communities of their own, named by their least
    node."""
    cu, cv = communities.select(F.col("id").alias("src"), F.col("cid").alias("a")), communities.select(F.col("id").alias("dst"), F.col("cid").alias("b"))
    inner = edges.join(cu, "src").join(cv, "dst").where("a = b").select("src", "dst")
    parts = connected_components(inner)
    return communities.join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cid"))


def partition_metrics(communities: DataFrame) -> DataFrame:
    sizes = communities.groupBy("cid").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("communities"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"))


def consensus_step(links: DataFrame, deg: DataFrame, m2: float, state: DataFrame, temperature: float, n: int = 1) -> DataFrame:
    """One synchronous move by three votes: neighbour labels, modularity gain and central
    neighbours, each divided by its most at the node; ties to the least label.

    ``links`` (src, dst, w, far, deg) hold the weight, the weight times the neighbour's rank and the node's degree, none of which
    change between rounds; ``deg`` (id, deg) the degrees, ``m2`` their sum.  The round runs in ``n`` slices."""
    volume = deg.join(state, "id").groupBy("label").agg(F.sum("deg").alias("vol"))
    near = materialize(state.join(volume, "label").select(F.col("id").alias("dst"), "label", "vol"), "volumes")
    node = Window.partitionBy("id")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(node)), F.lit(0.0))

    def best(some: DataFrame) -> DataFrame:
        # by node at once: the sums, the most at the node and the best label need no shuffle of their own
        around = some.join(near, "dst").select(F.col("src").alias("id"), "label", "w", "far", "deg", "vol").repartition("id")
        votes = around.groupBy("id", "label").agg(F.sum("w").alias("near"), F.sum("far").alias("far"), F.max("deg").alias("deg"), F.max("vol").alias("vol"))
        votes = votes.withColumn("gain", F.greatest(F.col("near") - F.col("deg") * F.col("vol") / F.lit(m2), F.lit(0.0)))
        score = part("near") * temperature + part("gain") * (2 - temperature) + 0.2 * part("far")
        return votes.withColumn("score", F.round(score, 9)).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("b")).select("id", "b.label")

    out = materialize_slices(links, "src", n, "labels", best)
    discard(near)
    return out


def consensus_communities(edges: DataFrame, rounds: int = 6, start: float = 1.0, cooling: float = 0.8, ranks: DataFrame | None = None) -> DataFrame:
    """Communities (id, cid) by annealed synchronous consensus; disconnected ones are split.

    All rounds run on numbers in the order of the ids, so ties go to the least id."""
    nodes, pairs = coded(edges)
    central = ranks.join(nodes, "id").select(F.col("n").alias("id"), "rank") if ranks is not None else pagerank(pairs, 5)
    deg = materialize(pairs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")), "degrees")
    m2 = deg.agg(F.sum("deg")).first()[0] or 1.0
    ranked = pairs.join(central.select(F.col("id").alias("dst"), "rank"), "dst").join(deg.withColumnRenamed("id", "src"), "src")
    links = materialize(ranked.select("src", "dst", "w", (F.col("w") * F.col("rank")).alias("far"), "deg").sortWithinPartitions("src"), "links")
    n = slices(links.count(), VOTES)
    state = materialize(deg.select("id", F.col("id").alias("label")), "labels")
    heat = start
    for _ in range(rounds):
        state = consensus_step(links, deg, m2, state, heat, n)
        heat *= cooling
    once = pairs.where("src < dst")
    return decoded(nodes, split_disconnected(once, state.select("id", F.col("label").alias("cid"))))


def contract(links: DataFrame, communities: DataFrame) -> DataFrame:
    """The graph of communities from links (src, dst, w) in both directions: links between different communities in both
    directions, with the edges summed to weights."""
    cu, cv = communities.toDF("src", "cu"), communities.toDF("dst", "cv")
    placed = links.where("src < dst").join(cu, "src").join(cv, "dst").where("cu <> cv")
    sums = placed.groupBy(F.least("cu", "cv").alias("src"), F.greatest("cu", "cv").alias("dst")).agg(F.sum("w").alias("w"))
    return symmetrised(sums)


def hierarchical(edges: DataFrame, target: int, rounds: int = 4, levels: int = 4) -> DataFrame:
    """Communities of communities until there are at most ``target``.

    All rounds run on numbers in the order of the ids, so ties go to the least id; a level's graph is contracted from the
    links of the level below, not from all edges."""
    nodes, links = coded(edges)
    state = materialize(propagate(links, rounds).select("id", F.col("label").alias("cid")), "level")
    last = state
    for _ in range(levels):
        if state.select("cid").distinct().count() <= target:
            break
        links = materialize(contract(links, last), "upper")
        if links.isEmpty():
            break
        last = propagate(links, rounds).toDF("id", "cid")
        above = last.toDF("cid", "up")
        state = materialize(state.join(above, "cid", "left").select("id", F.coalesce("up", "cid").alias("cid")), "level")
    return decoded(nodes, state)


def best_of(edges: DataFrame, candidates: dict[str, DataFrame]) -> tuple[str, float]:
    """Name and modularity of the best partition; ties to the first name."""
    scores = {name: modularity(edges, c).first()[0] or 0.0 for name, c in candidates.items()}
    return max(sorted(scores.items()), key=lambda x: x[1])


def recency(edges: DataFrame, now: float, horizon: float) -> DataFrame:
    """1 for a node whose latest edge end is now, 0 beyond the horizon: id, recency."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), F.coalesce("valid_to", "valid_from").alias("at"))
    age = F.greatest(F.lit(now) - F.max("at"), F.lit(0.0))
    return ends.groupBy("id").agg(F.coalesce(F.lit(1.0) - F.least(age / horizon, F.lit(1.0)), F.lit(0.0)).alias("recency"))


def clustering(edges: DataFrame) -> DataFrame:
    """Degree and local clustering of each node of a simple undirected graph: id, degree, triangles,
    clustering.  Edges point from the lesser to the greater degree, so hubs pair few neighbours."""
    simple = materialize(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct(), "simple")
    deg = materialize(simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")), "degree")
    da, db = deg.toDF("a", "da"), deg.toDF("b", "db")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    turned = simple.join(da, "a").join(db, "b").select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))
    turned = materialize(turned, "turned")
    wedges = turned.join(turned.toDF("u", "w"), "u").where("v < w").select("u", "v", "w")
    closed = wedges.join(simple, (F.col("v") == F.col("a")) & (F.col("w") == F.col("b")))
    tri = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(tri, "id", "left").select("id", "degree", t.cast("bigint").alias("triangles"), F.when(pairs > 0, t / pairs).otherwise(F.lit(0.0)).alias("clustering"))


def betweenness(edges: DataFrame, sources: DataFrame, depth: int = 4) -> DataFrame:
    """Betweenness from a stated set of sources, by shortest paths up to ``depth`` hops: id, score.

    Counts of shortest paths go out level by level and dependencies come back, as joins."""
    links = materialize(symmetrised(edges.select("src", "dst")).where("src <> dst").distinct(), "links")
    levels = [materialize(sources.select(F.col("id").alias("s"), "id").distinct().withColumn("sigma", F.lit(1.0)), "level")]
    seen = levels[0].select("s", "id")
    for _ in range(depth):
        nxt = levels[-1].join(links, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        levels.append(materialize(nxt.join(seen, ["s", "id"], "left_anti"), "level"))
        seen = materialize(seen.unionByName(levels[-1].select("s", "id")), "seen")
    delta = None
    parts = []
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k] if delta is None else levels[k].join(delta, ["s", "id"], "left")
        here = here.withColumn("d", F.coalesce(F.col("delta"), F.lit(0.0)) if delta is not None else F.lit(0.0))
        parts.append(here.select("s", "id", "d"))
        back = here.join(links, F.col("id") == F.col("src")).select("s", F.col("dst").alias("up"), ((1 + F.col("d")) / F.col("sigma")).alias("c"))
        up = levels[k - 1].withColumnRenamed("sigma", "sig")
        delta = back.join(up.select("s", F.col("id").alias("up"), "sig"), ["s", "up"]).groupBy("s", F.col("up").alias("id")).agg(F.sum(F.col("c") * F.col("sig")).alias("delta"))
        delta = materialize(delta, "delta")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("d").alias("score"))


def local_moves(edges: DataFrame, initial: DataFrame | None = None, rounds: int = 6, resolution: float = 1.0, weight_col: str | None = None) -> DataFrame:
    """Communities (id, cid) by moves toward the greatest gain of modularity.

    Half of the nodes (by hash and round) may move in a round, so neighbours do not swap for ever.
    Without ``weight_col`` an edge weighs 1 and loops are left out; with it, a loop is what lies inside a
    node of a contracted graph and adds twice its weight to the node's degree."""
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    ends = symmetrised(edges.select("src", "dst", weight.cast("double").alias("w")))
    ends = materialize((ends if weight_col else ends.where("src <> dst")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "links")
    links = ends.where("src <> dst")
    deg = materialize(ends.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")), "degrees")
    m2 = deg.agg(F.sum("deg")).first()[0] or 1.0
    state = deg.select("id", F.col("id").cast("string").alias("cid")) if initial is None else deg.join(initial, "id").select("id", F.col("cid").cast("string").alias("cid"))
    state = materialize(state, "state")
    for k in range(rounds):
        volume = deg.join(state, "id").groupBy("cid").agg(F.sum("deg").alias("vol"))
        near = links.join(state.select(F.col("id").alias("dst"), "cid"), "dst").groupBy(F.col("src").alias("id"), "cid").agg(F.sum("w").alias("w"))
        own = state.withColumn("own", F.lit(True))
        options = near.unionByName(state.select("id", "cid", F.lit(0.0).alias("w"))).groupBy("id", "cid").agg(F.sum("w").alias("w"))
        scored = options.join(volume, "cid").join(deg, "id").join(own, ["id", "cid"], "left")
        rest = F.col("vol") - F.when(F.col("own"), F.col("deg")).otherwise(F.lit(0.0))
        gain = F.round(F.col("w") - resolution * F.col("deg") * rest / m2, 9)
        best = scored.withColumn("g", gain).groupBy("id").agg(F.min(F.struct((-F.col("g")).alias("g"), "cid")).alias("b"))
        turn = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0
        state = materialize(state.join(best, "id").select("id", F.when(turn, F.col("b.cid")).otherwise(F.col("cid")).alias("cid")), "state")
    return state


def louvain(edges: DataFrame, initial: DataFrame | None = None, levels: int = 2, rounds: int = 6, resolution: float = 1.0) -> DataFrame:
    """Local moves, then local moves of the contracted graph; communities stay connected.

    Contracted links and loops keep the whole number of edges as their weight."""
    state = split_disconnected(edges, local_moves(edges, initial, rounds, resolution))
    state = materialize(state, "level")
    for _ in range(levels - 1):
        cu, cv = state.toDF("src", "cu"), state.toDF("dst", "cv")
        placed = edges.select("src", "dst").where("src <> dst").join(cu, "src").join(cv, "dst")
        upper = materialize(placed.groupBy(F.col("cu").alias("src"), F.col("cv").alias("dst")).agg(F.count("*").cast("double").alias("w")), "upper")
        if upper.where("src <> dst").isEmpty():
            break
        above = local_moves(upper, None, rounds, resolution, "w").toDF("cid", "up")
        state = materialize(state.join(above, "cid", "left").select("id", F.coalesce("up", "cid").alias("cid")), "level")
    return state


def resolution_search(edges: DataFrame, target: int, steps: int = 4, low: float = 0.2, high: float = 4.0, rounds: int = 4) -> tuple[float, int]:
    """The resolution at which local moves give about ``target`` communities, by bisection."""
    best = (low, 0)
    for _ in range(steps):
        mid = (low + high) / 2
        n = local_moves(edges, None, rounds, mid).select("cid").distinct().count()
        if best[1] == 0 or abs(n - target) < abs(best[1] - target):
            best = (mid, n)
        low, high = (mid, high) if n < target else (low, mid)
    return best


def query_merge(communities: DataFrame, centroids: DataFrame, query: list[float], top: int = 5, threshold: float = 0.7) -> DataFrame:
    """Merge the communities nearest to a query whose centroid is near enough into the best one."""
    from graphloom.functions.vectors import cosine

    q = F.array(*[F.lit(float(x)) for x in query])
    near = centroids.select("cid", F.round(cosine(F.col("centroid"), q), 9).alias("s")).where(F.col("s") >= threshold).orderBy(F.desc("s"), "cid").limit(top)
    best = near.agg(F.min(F.struct((-F.col("s")).alias("s"), "cid")).alias("b")).select(F.col("b.cid").alias("best"))
    moved = near.select("cid").crossJoin(best)
    return communities.join(F.broadcast(moved), "cid", "left").select("id", F.coalesce("best", "cid").alias("cid"))  # at most ``top`` rows


def project_features(features: DataFrame, columns: list[str], dim: int) -> DataFrame:
    """Column-wise maximum scaling, then a fixed random matrix: id, v."""
    top = features.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    scaled = [F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_{c}").cast("double")), F.lit(0.0)) for c in columns]
    weight = lambda i, j: (((i * 2654435761 + j * 40503 + 12345) % 2001) / 1000.0 - 1.0)
    v = F.array(*[sum((s * weight(i, j) for i, s in enumerate(scaled)), F.lit(0.0)) for j in range(dim)])
    return features.crossJoin(top).select("id", v.alias("v"))


def component_bridges(edges: DataFrame, vectors: DataFrame, per_component: int = 3, threshold: float = 0.0, cap: int = 100) -> DataFrame:
    """Links between components: the best-connected nodes of each, by cosine; the best ``cap``."""
    from graphloom.functions.vectors import cosine

    comps = connected_components(edges)
    front = comps.join(degrees(edges), F.col("node") == F.col("id")).select("component", "id", "degree")
    order = Window.partitionBy("component").orderBy(F.desc("degree"), "id")
    front = front.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_component).join(vectors, "id")
    front = materialize(front.select("component", "id", "v"), "frontier")
    # a few nodes per component; each component is matched with the least one, which joins them all
    hub = front.agg(F.min("component").alias("other"))
    pairs = front.select("component").distinct().crossJoin(hub).where("component <> other")
    found = pairs.join(front.toDF("component", "a", "av"), "component").join(front.toDF("other", "b", "bv"), "other")
    scored = found.select("a", "b", F.round(cosine(F.col("av"), F.col("bv")), 9).alias("score")).where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "a", "b").limit(cap)


def partial_rebalance(edges: DataFrame, communities: DataFrame, hot: DataFrame, rounds: int = 3) -> DataFrame:
    """New communities inside the hot ones (cid) only."""
    inside = communities.join(hot, "cid", "left_semi").select("id")
    sub = edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    fresh = label_propagation(sub, rounds).select("id", F.col("label").alias("_new"))
    return communities.join(fresh, "id", "left").select("id", F.coalesce("_new", "cid").alias("cid"))


def incremental_communities(edges: DataFrame, communities: DataFrame, changed: DataFrame, radius: int = 2, rounds: int = 3) -> DataFrame:
    """Communities after changes at some nodes (id): labels are propagated again within ``radius`` hops
    of them, starting from the present ones."""
    from graphloom.operators.traversal import reachable

    near = reachable(changed.select(F.lit(0).alias("query_id"), "id"), symmetrised(edges.select("src", "dst")), radius).select("id").distinct()
    near = materialize(near, "ego")
    sub = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    start = near.join(communities, "id", "left").select("id", F.coalesce("cid", "id").alias("label"))
    fresh = label_propagation(sub, rounds, initial=start).select("id", F.col("label").alias("_new"))
    return communities.join(fresh, "id", "full").select("id", F.coalesce("_new", "cid").alias("cid"))
