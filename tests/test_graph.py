"""Operators on small graphs whose answers are known."""

import pytest
from pyspark.sql import functions as F

from graphloom.api import Graph
from graphloom.functions import scoring, text
from graphloom.operators import access, analytics, answers, causal, discovery, embedding, rules, traversal
from graphloom.operators.components import connected_components
from graphloom.sources.files import from_triples

TRIANGLES = [("alice", "KNOWS", "bob"), ("bob", "KNOWS", "carol"), ("carol", "KNOWS", "alice"), ("dave", "WORKS_WITH", "eve"), ("eve", "WORKS_WITH", "frank"), ("frank", "WORKS_WITH", "dave"), ("carol", "INTRODUCED_BY", "dave")]


@pytest.fixture(scope="module")
def triangles(spark):
    return from_triples(spark, TRIANGLES)


def ids(spark, *names):
    return spark.createDataFrame([(0, n) for n in names], "query_id int, id string")


def test_components_and_communities(spark, triangles):
    apart = triangles.where("rel <> 'INTRODUCED_BY'")
    got = {r.node: r.component for r in connected_components(apart).collect()}
    assert got == dict.fromkeys(["alice", "bob", "carol"], "alice") | dict.fromkeys(["dave", "eve", "frank"], "dave")
    labels = {r.id: r.label for r in analytics.label_propagation(triangles, 4).collect()}
    assert labels["alice"] == labels["bob"] and labels["eve"] == labels["frank"] and labels["alice"] != labels["eve"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src bigint, dst bigint")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_ranks_sum_to_one(triangles):
    ranks = analytics.pagerank(triangles, 15)
    assert abs(ranks.agg(F.sum("rank")).first()[0] - 1.0) < 1e-9


def test_clustering_and_betweenness(spark, triangles):
    c = {r.id: r for r in analytics.clustering(triangles).collect()}
    assert c["alice"].clustering == 1.0 and c["carol"].triangles == 1 and abs(c["carol"].clustering - 1 / 3) < 1e-9
    b = {r.id: r.score for r in analytics.betweenness(triangles, ids(spark, "alice").select("id")).collect()}
    assert b["carol"] == 3.0 and b["dave"] == 2.0 and b["bob"] == 0.0


def test_beam_reaches_and_avoids_cycles(spark, triangles):
    paths = traversal.beam(ids(spark, "alice"), triangles, max_hop=3, width=5)
    rows = paths.collect()
    assert {r.tail for r in rows} == {"bob", "carol", "dave"}
    assert all(len(set(r.path[::2])) == len(r.path[::2]) for r in rows)
    best = answers.extract(paths, 10).collect()
    assert [r.rank for r in best] == [1, 2, 3] and best[0].score >= best[1].score >= best[2].score


def test_beam_width_and_time(spark):
    e = from_triples(spark, [("s", "R", f"n{i}", {"confidence": i / 10, "valid_from": 100.0 * i}) for i in range(10)] + [(f"n{i}", "R", "end") for i in range(10)])
    two = traversal.beam(ids(spark, "s"), e, max_hop=2, width=3)
    assert two.where("size(path) = 3").count() == 3 and two.where("tail = 'end'").count() == 3
    assert {r.tail for r in traversal.beam(ids(spark, "s"), e, max_hop=1, at=250.0).collect()} == {"n0", "n1", "n2"}


def test_bounded_paths_and_reach(spark, triangles):
    p = traversal.bounded_paths(ids(spark, "alice"), triangles, 5, spark.createDataFrame([("frank",)], "id string"))
    assert [r.path[::2] for r in p.collect()] == [["alice", "bob", "carol", "dave", "eve", "frank"]]
    assert {r.id: r.depth for r in traversal.reachable(ids(spark, "alice"), triangles, 3).collect()} == {"alice": 0, "bob": 1, "carol": 2, "dave": 3}


def test_rules_and_contradictions(spark):
    e = from_triples(spark, [("aspirin", "INHIBITS", "COX2", {"confidence": 0.9}), ("COX2", "PROMOTES", "inflammation", {"confidence": 0.8}), ("A", "ACTIVATES", "B", {"confidence": 0.9}), ("B", "INHIBITS", "A", {"confidence": 0.7}), ("A", "KNOWS", "C")])
    new = rules.transitive_inference(e, rules.composition_table(spark)).collect()
    assert [(r.src, r.rel, r.dst) for r in new] == [("aspirin", "INDIRECTLY_REDUCES", "inflammation")]
    assert abs(new[0].confidence - 0.9 * 0.8 * 0.70) < 1e-9
    found = rules.direct_contradictions(e, rules.opposing_table(spark)).collect()
    assert [(r.src, r.dst, r.kind, r.severity) for r in found] == [("A", "B", "opposite", 0.7)]
    assert rules.inverse_rule(e, "KNOWS", "KNOWN_BY").count() == 1
    assert len(rules.COMPOSITIONS.strip().splitlines()) == 64


def test_confounder_and_counterfactual(spark):
    e = from_triples(spark, [("X", "CAUSES", "A", {"weight": 0.85}), ("X", "CAUSES", "B", {"weight": 0.80}), ("A", "CAUSES", "B", {"weight": 0.75})])
    pairs = spark.createDataFrame([("A", "B")], "source string, target string")
    r = causal.proof(pairs, e).first()
    assert (r.effect, r.confounders, r.paths) == (0.75, 1, 1) and abs(r.confidence - 0.75 * 0.75) < 1e-9
    cut = causal.intervene(e, blocked_edges=spark.createDataFrame([("A", None, "B")], "src string, rel string, dst string"))
    c = causal.counterfactual(pairs, e, cut).first()
    assert (c.factual, c.intervened, c.surviving) == (0.75, 0.0, 0)


def test_validity_window(spark):
    e = from_triples(spark, [("a", "R", "b", {"valid_from": 1000.0, "valid_to": 2000.0})])
    assert [e.where(access.valid_at(F.lit(t))).count() for t in (500.0, 1000.0, 1500.0, 2000.0, 2001.0)] == [0, 1, 1, 1, 0]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.coherence(F.array(*map(F.lit, [1, 1, 2]))).alias("coh"),
        scoring.coherence(F.array(F.lit(-1))).alias("alone"),
        scoring.grounding(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit("triples"), F.lit("pubmed:1"))).alias("grd"),
        scoring.temporal_decay(F.lit("BORN_IN"), F.lit(0.0), 10.0).alias("never"),
        scoring.community_score(F.lit(1), F.lit(-1), F.lit(None).cast("double"), F.lit(False)).alias("unknown"),
        scoring.credibility(F.lit("pubmed:12")).alias("trust"),
    ).first()
    assert (row.coh, row.alone, row.grd, row.never, row.unknown, row.trust) == (0.75, 1.0, 0.25 * 0.9, 1.0, 0.5, 0.95)


def test_hypothesis_takes_independent_paths(spark):
    rows = [("s", "t", ["s", "r", "a", "r", "t"], 0.5), ("s", "t", ["s", "r", "b", "r", "t"], 0.4), ("s", "t", ["s", "q", "a", "q", "t"], 0.3)]
    r = discovery.hypotheses(spark.createDataFrame(rows, "source string, target string, path array<string>, score double")).first()
    assert (r.paths, r.independent) == (3, 2) and abs(r.confidence - (1 - 0.5 * 0.6)) < 1e-9


def test_text_functions(spark):
    row = spark.range(1).select(
        text.question_type(F.lit("Who made it?")).alias("kind"),
        text.infer_hops(F.lit("a two-hop question")).alias("hops"),
        text.sentences(F.lit("One. Two! Three")).alias("s"),
        text.sentence_chunks(F.lit("Aa. Bb. Cc."), 7).alias("chunks"),
        text.sliding_chunks(F.lit("abcdefghij"), 4, 1).alias("slide"),
        text.parse_linearised(F.lit("<triplet> a <subj> b <obj> knows")).alias("t"),
        text.known_mentions(F.lit("The MIT License text"), ["License", "MIT License"]).alias("m"),
    ).first()
    assert (row.kind, row.hops, row.s) == ("person", 2, ["One.", "Two!", "Three"])
    assert row.chunks == ["Aa. Bb.", "Cc."] and row.slide == ["abcd", "defg", "ghij"]
    assert [(x.src, x.rel, x.dst) for x in row.t] == [("a", "knows", "b")] and row.m == ["MIT License"]


def test_public_api(spark, triangles, tmp_path):
    g = Graph(triangles).build()
    assert g.stats().first().asDict() == {"edges": 7, "relations": 3, "nodes": 6}
    found, aware = g.query_aware(ids(spark, "alice"))
    assert {r.entity for r in found.collect()} == {"bob", "carol", "dave"} and aware.count() == 1
    said = g.ask("who does Alice know?").first()
    assert said.entity == "bob" and said.said.startswith("alice knows bob")
    done = g.complete(lambda e: rules.inverse_rule(e, "KNOWS", "KNOWN_BY"))
    assert done.edges.where("rel = 'KNOWN_BY'").count() == 3
    g.save(str(tmp_path / "g"))
    assert Graph.open(spark, str(tmp_path / "g")).query(ids(spark, "alice")).count() == found.count()


def repeated(spark, rows):
    """Edges (src, dst), each as often as the third column says."""
    return spark.createDataFrame(rows, "src string, dst string, n int").selectExpr("src", "dst", "explode(sequence(1, n))").select("src", "dst")


def communities(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.cid, set()).add(r.id)
    return sorted(map(sorted, by.values()))


def test_louvain_upper_level_keeps_weights_and_loops(spark):
    pairs = [(f"{x}1", f"{x}2", 6000) for x in "abcd"]
    links = [("a1", "d1", 5000), ("b1", "c1", 5000), ("a2", "b2", 1200), ("c2", "d2", 1200)]
    got = communities(analytics.louvain(repeated(spark, pairs + links), None, 2, 6))
    assert got == [["a1", "a2", "d1", "d2"], ["b1", "b2", "c1", "c2"]]  # the heavier links, though all are above 1000
    cliques = [(f"{x}{i}", f"{x}{j}", 1) for x in "ab" for i in range(5) for j in range(i)]
    got = communities(analytics.louvain(repeated(spark, [*cliques, ("a0", "b0", 1)]), None, 2, 6))
    assert got == [[f"{x}{i}" for i in range(5)] for x in "ab"]  # one link does not join two cliques


def test_translation_is_trained_on_all_edges(spark):
    kinds = spark.range(60_000).selectExpr("concat('a', id) AS src", "'R' AS rel", "concat('hub', id % 3) AS dst")
    ent, rel = embedding.fit_translation(kinds, 4, 2)
    assert ent.count() == 60_003 and rel.count() == 1
    assert ent.where("exists(v, x -> isnan(x) OR x IS NULL) OR size(v) <> 4").isEmpty()
    small = spark.createDataFrame([(f"a{i}", "R", f"hub{i % 2}") for i in range(40)], "src string, rel string, dst string")
    ent, rel = embedding.fit_translation(small, 8, 40)
    heads = ent.where("id LIKE 'a%'").selectExpr("id AS head", "v AS hv", "'R' AS rel")
    best = embedding.predict_links(heads, rel.selectExpr("rel", "v AS rv"), ent.where("id LIKE 'hub%'"), 1).collect()
    assert sum(r.id == f"hub{int(r.head[1:]) % 2}" for r in best) >= 36


def test_beam_takes_thousands_of_relations(spark):
    from graphloom.operators import traversal

    weights = {f"R{i}": i / 5000 for i in range(5000)}
    edges = spark.createDataFrame([("a", f"R{i}", f"b{i % 50}", 1.0, 0.9, "x", None, None) for i in range(5000)], "src string, rel string, dst string, weight double, confidence double, provenance string, valid_from double, valid_to double")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, id string")
    got = traversal.extend(traversal.seeds_to_paths(seeds), edges, 1, weights)
    best = got.orderBy("score", ascending=False).first()
    assert got.count() == 5000 and best.path == ["a", "R4999", "b49"]


def test_components_of_long_chains(spark):
    from graphloom.operators.components import connected_components

    chain = [(i, i + 1) for i in range(3000)] + [(10_000, 10_001), (20_000, 20_000), (None, 5)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(chain, "src bigint, dst bigint")).collect())
    assert all(got[i] == 0 for i in range(3001))
    assert (got[10_001], got[20_000]) == (10_000, 20_000)
