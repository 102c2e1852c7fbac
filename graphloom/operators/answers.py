"""From paths to ranked, explained answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scoring as S


def path_text() -> Column:
    """The path as text."""
    return F.concat_ws("|", "path")


def extract(paths: DataFrame, top_k: int = 10, min_hop: int = 1, vote_weight: float = 0.45, branch_bonus: float = 0.0, degrees: DataFrame | None = None, degree_penalty: float = 0.0, semantic: Column | None = None) -> DataFrame:
    """Answers of each query: paths are scored, grouped by their end, and an end's best path score is
    mixed with its share of votes, raised for independent first branches and lowered for hubs."""
    valid = paths.where(F.size("path") >= 2 * min_hop + 1)
    branch = F.when(F.size("path") >= 5, F.col("path")[2]).otherwise(F.col("path")[0])
    scored = valid.select(
        "query_id",
        F.col("tail").alias("entity"),
        F.round(S.path_score(F.col("w"), F.col("cseq"), F.col("conf"), F.col("prov"), semantic), 9).alias("ps"),
        branch.alias("branch"),
        "path",
        S.path_confidence(F.col("conf")).alias("confidence"),
        S.posterior_variance(F.col("ba"), F.col("bb")).alias("uncertainty"),
    ).repartition("query_id")  # the only shuffle; what a caller does not select is not in it
    best = F.min(F.struct((-F.col("ps")).alias("ps"), path_text().alias("text"), "path", "confidence", "uncertainty")).alias("best")
    ends = scored.groupBy("query_id", "entity").agg(F.max("ps").alias("path_score"), best, F.sum("ps").alias("votes"), F.countDistinct("branch").alias("branches"), F.count("*").alias("paths"))
    query = Window.partitionBy("query_id")
    path_score = F.col("path_score")
    consensus = F.col("votes") / F.max("votes").over(query)
    score = (1 - vote_weight) * path_score + vote_weight * consensus
    if branch_bonus:
        score = score * F.when(F.col("branches") > 1, 1 + branch_bonus * F.log1p(F.col("branches") - 1)).otherwise(F.lit(1.0))
    if degrees is not None and degree_penalty:
        ends = ends.join(degrees.select(F.col("id").alias("entity"), "degree"), "entity", "left")
        score = score * S.hub_penalty(F.coalesce("degree", F.lit(0)), degree_penalty)
    out = ends.withColumn("raw", F.round(score, 8)).withColumn("consensus", consensus)
    ranked = out.withColumn("rank", F.row_number().over(query.orderBy(F.desc("raw"), "entity"))).where(F.col("rank") <= top_k)
    return ranked.select(
        "query_id",
        "rank",
        "entity",
        F.least("raw", F.lit(1.0)).alias("score"),
        "path_score",
        "consensus",
        "branches",
        "paths",
        F.col("best.path").alias("path"),
        F.col("best.confidence").alias("confidence"),
        F.col("best.uncertainty").alias("uncertainty"),
    )


def relations_of(path: Column) -> Column:
    return F.filter(path, lambda _, i: i % 2 == 1)


def _relations(answers: DataFrame) -> Column:
    """The relations of the answers' best paths, from ``rels`` where they have it."""
    return F.col("rels") if "rels" in answers.columns else relations_of(F.col("path"))


def answer_conflicts(answers: DataFrame, opposing: DataFrame) -> DataFrame:
    """Pairs of a query's answers whose best paths hold opposing relations (a, b).  A query's answers are brought together once;
    their pairs are found among them."""
    rules = opposing.where("a IS NOT NULL AND b IS NOT NULL").agg(F.collect_set(F.struct("a", "b")).alias("_rules"))
    rels = F.filter(F.array_distinct(_relations(answers)), lambda r: F.exists("_rules", lambda x: (x.a == r) | (x.b == r)))
    some = answers.crossJoin(F.broadcast(rules)).select("query_id", "rank", "entity", rels.alias("rels"), "_rules").where(F.size("rels") > 0)
    one = some.groupBy("query_id").agg(F.collect_list(F.struct("rank", "entity", "rels")).alias("l"), F.first("_rules").alias("_rules"))
    pair = lambda x, y: F.transform(F.filter("_rules", lambda r: F.array_contains(x.rels, r.a) & F.array_contains(y.rels, r.b)), lambda r: F.struct(x.entity.alias("entity"), y.entity.alias("entity2"), r.a.alias("rel"), r.b.alias("other")))
    pairs = F.flatten(F.transform("l", lambda x: F.flatten(F.transform(F.filter("l", lambda y: x["rank"] < y["rank"]), lambda y: pair(x, y)))))
    return one.select("query_id", F.explode(F.array_distinct(pairs)).alias("p")).select("query_id", "p.*")


def consensus(paths: DataFrame, trust: dict[str, float] | None = None) -> DataFrame:
    """Identical paths of several agents: trust-weighted mean of scores, a tenth more for each further
    finder, within [0, 1], and whether the finders' trust differs much."""
    weight = F.lit(1.0)
    for agent, value in (trust or {}).items():
        weight = F.when(F.col("agent") == agent, F.lit(value)).otherwise(weight)
    g = paths.withColumn("t", weight).groupBy("query_id", "path").agg(F.sum(F.col("score") * F.col("t")).alias("s"), F.sum("t").alias("t"), F.count("*").alias("agents"), F.var_pop("t").alias("variance"))
    mean = F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(F.lit(0.0))
    return g.select("query_id", "path", "agents", F.least(F.greatest(mean + 0.1 * (F.col("agents") - 1), F.lit(0.0)), F.lit(1.0)).alias("score"), (F.col("variance") > 0.09).alias("conflict"))


def assess(answers: DataFrame, min_score: float = 0.3, min_consensus: float = 0.05) -> DataFrame:
    """Per query: margin of the best answer over the second, its uncertainty and corroboration, and
    whether it shows a gap of knowledge."""
    order = Window.partitionBy("query_id").orderBy("rank")
    margin = F.when(F.col("score") > 0, (F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))) / F.col("score")).otherwise(F.lit(0.0))
    return answers.withColumn("margin", margin).where("rank = 1").select("query_id", "entity", "margin", "uncertainty", "branches", ((F.col("score") < min_score) | (F.col("consensus") < min_consensus)).alias("gap"))


def epistemic_decision(margin: Column, gap: Column, accept: float = 0.3) -> Column:
    return F.when(gap, F.lit("abstain")).when(margin >= accept, F.lit("answer")).otherwise(F.lit("verify"))


def hub_flooded(paths: DataFrame, branches: int = 50, tails: int = 3) -> DataFrame:
    """Whether at least ``tails`` ends of a query are each reached through more than ``branches``
    first branches."""
    per = paths.groupBy("query_id", "tail").agg(F.countDistinct(F.try_element_at("path", F.lit(3))).alias("b"))
    return per.groupBy("query_id").agg((F.count(F.when(F.col("b") > branches, 1)) >= tails).alias("flooded"))


def calibration_error(rows: DataFrame, bins: int = 10, p: str = "p", hit: str = "hit") -> DataFrame:
    """Expected calibration error over bins of equal width: one row."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(hit).cast("double")).alias("acc"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def fit_platt(rows: DataFrame, score: str = "score", hit: str = "hit", steps: int = 20) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps; each step is one aggregate of the rows."""
    a, b = 0.0, 0.0
    s = F.col(score).cast("double")
    for _ in range(steps):
        p = S.sigmoid(F.lit(a) * s + F.lit(b))
        err, var = p - F.col(hit).cast("double"), p * (1 - p) + 1e-9
        g = rows.agg(F.sum(err * s).alias("ga"), F.sum(err).alias("gb"), F.sum(var * s * s).alias("haa"), F.sum(var * s).alias("hab"), F.sum(var).alias("hbb")).first()
        if g.ga is None:
            return 0.0, 0.0
        haa, hbb = g.haa + 1e-3, g.hbb + 1e-3
        det = haa * hbb - g.hab**2
        if abs(det) < 1e-12:
            break
        da, db = (hbb * g.ga - g.hab * g.gb) / det, (haa * g.gb - g.hab * g.ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def rerank_by_frequency(answers: DataFrame, frequency: DataFrame, weight: float = 0.5, valid: DataFrame | None = None, cross_type: float = 0.1) -> DataFrame:
    """Penalise answers by how often they answer anything, and those outside a valid set."""
    joined = answers.join(frequency.select("entity", "freq"), "entity", "left")
    score = F.col("score") / (1 + weight * F.log1p(F.coalesce("freq", F.lit(0))))
    if valid is not None:
        joined = joined.join(valid.select("entity").distinct().withColumn("_ok", F.lit(True)), "entity", "left")
        score = score * F.when(F.col("_ok"), F.lit(1.0)).otherwise(F.lit(cross_type))
    return joined.withColumn("score", score).drop("freq", "_ok")


def community_fingerprints(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """The most frequent incoming relation of each community and its share."""
    g = edges.join(communities.select(F.col("id").alias("dst"), "cid"), "dst").groupBy("cid", "rel").agg(F.count("*").alias("n"))
    top = g.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("n"), "rel")).alias("b"), F.sum("n").alias("total"))
    return top.select("cid", F.col("b.rel").alias("rel"), (-F.col("b.n") / F.col("total")).alias("purity"))


def community_consensus(answers: DataFrame, boost: float = 1.2, penalty: float = 0.9, least_share: float = 0.65) -> DataFrame:
    """Score-weighted vote on the last relation; where one has a clear share, agreeing answers gain
    and others lose."""
    rel = F.try_element_at(_relations(answers), F.lit(-1))
    votes = answers.withColumn("last", rel)
    total = F.sum("score").over(Window.partitionBy("query_id"))
    share = votes.withColumn("share", F.sum("score").over(Window.partitionBy("query_id", "last")) / total)
    top = F.max(F.struct("share", "last")).over(Window.partitionBy("query_id"))
    out = share.withColumn("top", top)
    factor = F.when(F.col("top.share") < least_share, F.lit(1.0)).when(F.col("last") == F.col("top.last"), F.lit(boost)).otherwise(F.lit(penalty))
    return out.withColumn("score", F.col("score") * factor).drop("top", "share", "last")


def deductive_rerank(answers: DataFrame, reached: DataFrame, boost: float = 1.3, penalty: float = 0.9) -> DataFrame:
    """Boost answers that a causal path reaches (query_id, entity), penalise the others."""
    r = reached.select("query_id", "entity").distinct().withColumn("_ok", F.lit(True))
    return deductive_scores(answers.join(r, ["query_id", "entity"], "left"), F.col("_ok"), boost, penalty).drop("_ok")


def deductive_scores(answers: DataFrame, reached: Column, boost: float = 1.3, penalty: float = 0.9) -> DataFrame:
    """``deductive_rerank`` of answers that know whether a causal path reaches them."""
    return answers.withColumn("score", F.col("score") * F.when(reached, boost).otherwise(penalty))


def robustness_rerank(answers: DataFrame, deltas: DataFrame, weight: float = 0.2) -> DataFrame:
    """Raise answers whose effect changes little when mid nodes are blocked (query_id, entity, delta)."""
    out = answers.join(deltas, ["query_id", "entity"], "left")
    return out.withColumn("score", F.col("score") * (1 + weight * (1 - F.abs(F.coalesce("delta", F.lit(0.0)))))).drop("delta")


def dissonant(answers: DataFrame, high: float = 0.6, low: float = 0.2) -> DataFrame:
    """Answers with a high score that few paths agree on."""
    return answers.where((F.col("score") >= high) & (F.col("consensus") <= low))


def verbalise(path: Column, confidence: Column) -> Column:
    """A sentence for a path with its confidence."""
    said = F.transform(path, lambda x, i: F.when(i % 2 == 1, F.lower(F.translate(x, "_", " "))).otherwise(x))
    return F.concat(F.array_join(said, " "), F.lit(" ("), F.format_number(confidence, 2), F.lit(")."))


def escalate(levels: list[DataFrame], least_margin: float) -> DataFrame:
    """The answers of the first level that is sure of a query, else those of the last."""
    out, open_queries = None, None
    for i, found in enumerate(levels):
        found = found if open_queries is None else found.join(open_queries, "query_id", "left_semi")
        found = found.withColumn("level", F.lit(i + 1))
        if i == len(levels) - 1:
            part, open_queries = found, None
        else:
            sure = assess(found).where(F.col("margin") >= least_margin).select("query_id")
            part = found.join(sure, "query_id", "left_semi")
            open_queries = found.select("query_id").distinct().join(sure, "query_id", "left_anti")
        out = part if out is None else out.unionByName(part)
    return out


def with_direct(answers: DataFrame, seeds: DataFrame, edges: DataFrame, base: float = 0.1, bonus: float = 1.2, diversity: float = 0.1) -> DataFrame:
    """Answers (query_id, entity, score) with all direct neighbours of the seeds put in, a bonus for
    those that lead back to the seed, and one for several relations to it."""
    links = seeds.join(edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("entity")), "id")
    direct = links.groupBy("query_id", "id", "entity").agg(F.countDistinct("rel").alias("kinds"))
    back = edges.select(F.col("src").alias("entity"), F.col("dst").alias("id")).distinct().withColumn("back", F.lit(True))
    direct = direct.join(back, ["entity", "id"], "left").groupBy("query_id", "entity").agg(F.max("kinds").alias("kinds"), F.max(F.coalesce("back", F.lit(False))).alias("back"))
    both = answers.select("query_id", "entity", "score").join(direct, ["query_id", "entity"], "full")
    score = F.coalesce("score", F.lit(base)) * F.when(F.col("back"), bonus).otherwise(1.0) * (1 + diversity * F.log1p(F.coalesce("kinds", F.lit(1)) - 1))
    return both.select("query_id", "entity", score.alias("score"))
