"""Queries of graph analytics, discovery and maintenance (G, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scoring as S
from graphloom.graph import edge_view, nodes_of, table
from graphloom.operators import access as A
from graphloom.operators import analytics as G
from graphloom.operators import discovery as J
from graphloom.plans.registry import query
from graphloom.storage import materialize


def r6(c):
    return F.round(c, 6)


_S = ", s AS (SELECT * FROM edges)"


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf)


def _kinds(edges: DataFrame) -> DataFrame:
    """Communities by the last digit of the id, within the node type."""
    return nodes_of(edges).select("id", F.concat("type", F.substring("id", -1, 1)).alias("cid"))


_CID = ", n AS (SELECT src AS id FROM s UNION SELECT dst FROM s), c AS (SELECT id, split_part(id, ':', 1) || right(id, 1) AS cid FROM n)"


def _rank_sql(rounds: int, restart: str | None = None) -> str:
    start = "1.0::DOUBLE / (SELECT count(*) FROM n)" if restart is None else f"CASE WHEN id LIKE '{restart}' THEN 1.0::DOUBLE / (SELECT count(*) FROM n WHERE id LIKE '{restart}') ELSE 0.0 END"
    out = f""", pairs AS (SELECT src, dst, count(*) AS w FROM s GROUP BY ALL), o AS (SELECT src, sum(w) AS t FROM pairs GROUP BY src), l AS (SELECT p.src, dst, w / t::DOUBLE AS share FROM pairs p JOIN o ON p.src = o.src),
    n AS (SELECT src AS id FROM s UNION SELECT dst FROM s), p0 AS (SELECT id, {start} AS p, id NOT IN (SELECT src FROM o) AS sink FROM n), r0 AS (SELECT id, p, sink, p AS rank FROM p0)"""
    for k in range(1, rounds + 1):
        out += f", g{k} AS (SELECT dst, sum(rank * share) AS got FROM l JOIN r{k - 1} ON src = id GROUP BY dst), r{k} AS (SELECT id, p, sink, 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE sink) * p) + 0.15::DOUBLE * p AS rank FROM r{k - 1} LEFT JOIN g{k} ON id = dst)"
    return out


@query("G17_pagerank_10", _S + _rank_sql(10) + " SELECT id, round(rank, 8) AS rank FROM r10", edges=True)
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return G.pagerank(_all(spark, sf), 10).withColumn("rank", F.round("rank", 8))


@query("Q1_personal_pagerank", _S + _rank_sql(5, "user:1") + " SELECT id, round(rank, 8) AS rank FROM r5 WHERE id <> 'user:1' ORDER BY r5.rank DESC, id LIMIT 10", edges=True)
def personal_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.baselines import personal_rank

    seed = spark.createDataFrame([("user:1",)], "id string")
    return personal_rank(_all(spark, sf), seed, 10, 5).withColumn("rank", F.round("rank", 8))


def _lpa_sql(rounds: int, start: str = "SELECT DISTINCT src AS id, src AS label FROM l") -> str:
    out = f", b AS (SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s), l AS (SELECT src, dst, count(*) AS w FROM b WHERE src <> dst GROUP BY ALL), l0 AS ({start})"
    for k in range(1, rounds + 1):
        out += f", v{k} AS (SELECT id, label, sum(w) AS w FROM (SELECT src AS id, label, w FROM l JOIN l{k - 1} ON dst = id UNION ALL SELECT id, label, 1 FROM l{k - 1}) GROUP BY ALL), l{k} AS (SELECT id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1)"
    return out


@query("G8_G24_label_propagation", _S + _lpa_sql(4) + " SELECT id, label FROM l4", edges=True)
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_propagation(_all(spark, sf), 4)


@query("G10_modularity", _S + _CID + ", p AS (SELECT a.cid AS cu, b.cid AS cv FROM s JOIN c a ON src = a.id JOIN c b ON dst = b.id), m AS (SELECT count(*) AS m FROM p), i AS (SELECT cu AS cid, count(*) AS n FROM p WHERE cu = cv GROUP BY cu), e AS (SELECT cid, count(*) AS d FROM (SELECT cu AS cid FROM p UNION ALL SELECT cv FROM p) GROUP BY cid) SELECT round(sum(coalesce(n, 0) / m::DOUBLE - pow(d / (2.0::DOUBLE * m), 2)), 6) AS q FROM e LEFT JOIN i USING (cid), m", edges=True)
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    return G.modularity(e, _kinds(e)).select(r6(F.col("q")).alias("q"))


@query("G14_soft_membership", _S + _CID + ", b AS (SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s), v AS (SELECT src AS id, cid, count(*)::DOUBLE AS w FROM b JOIN c ON dst = c.id GROUP BY ALL UNION ALL SELECT src, cid, count(*) * 0.1::DOUBLE FROM b JOIN c ON src = c.id GROUP BY ALL), g AS (SELECT id, cid, sum(w) AS w FROM v GROUP BY ALL) SELECT id, cid, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM g", edges=True)
def soft_membership(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    return G.soft_membership(e, _kinds(e)).withColumn("p", r6(F.col("p")))


_PAIRS = ", p AS (SELECT DISTINCT least(a.cid, b.cid) AS cu, greatest(a.cid, b.cid) AS cv FROM s JOIN c a ON src = a.id JOIN c b ON dst = b.id WHERE a.cid <> b.cid)"


@query("G22_G23_community_pairs", _S + _CID + ", q AS (SELECT least(a.cid, b.cid) AS cu, greatest(a.cid, b.cid) AS cv, count(*) AS n FROM s JOIN c a ON src = a.id JOIN c b ON dst = b.id WHERE a.cid <> b.cid GROUP BY ALL) SELECT * FROM q", edges=True)
def community_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    return G.community_graph(e, _kinds(e))


@query(
    "G21_E6_community_distances",
    _S + _CID + _PAIRS + ", t AS (SELECT cu, cv FROM p UNION SELECT cv, cu FROM p), d2 AS (SELECT DISTINCT a.cu, b.cv FROM t a JOIN t b ON a.cv = b.cu WHERE a.cu <> b.cv), d3 AS (SELECT DISTINCT a.cu, b.cv FROM d2 a JOIN t b ON a.cv = b.cu WHERE a.cu <> b.cv), d AS (SELECT cu, cv, 1 AS d FROM t UNION ALL SELECT cu, cv, 2 FROM d2 UNION ALL SELECT cu, cv, 3 FROM d3) SELECT cu, cv, min(d)::INT AS d FROM d GROUP BY ALL",
    edges=True,
)
def community_distances(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    return G.community_distances(G.community_graph(e, _kinds(e)), 3)


@query("G16_partition_metrics", _S + _CID + ", z AS (SELECT cid, count(*) AS size FROM c GROUP BY cid) SELECT count(*) AS communities, min(size) AS least, max(size) AS most, round(avg(size), 6) AS mean FROM z", edges=True)
def partition_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return G.partition_metrics(_kinds(_all(spark, sf))).withColumn("mean", r6(F.col("mean")))


@query(
    "G28_C26_components",
    ", s AS (SELECT src, dst FROM edges WHERE rel = 'LOCATED_IN'), x AS (SELECT dst AS nation, min(least(src, dst)) AS component FROM s GROUP BY dst) SELECT src AS node, component FROM s JOIN x ON dst = nation UNION SELECT nation, component FROM x",
    edges=True,
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.components import connected_components

    return connected_components(edge_view(spark, sf, ["LOCATED_IN"]))


@query(
    "G28_split_disconnected",
    ", s AS (SELECT src, dst FROM edges WHERE rel = 'LOCATED_IN'), x AS (SELECT dst AS nation, min(least(src, dst)) AS cid FROM s GROUP BY dst) SELECT src AS id, cid FROM s JOIN x ON dst = nation UNION SELECT nation, cid FROM x",
    edges=True,
)
def split_disconnected(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["LOCATED_IN"])
    return G.split_disconnected(e, nodes_of(e).select("id", F.lit("all").alias("cid")))


@query("G18_node_recency", _S + ", e AS (SELECT src AS id, coalesce(valid_to, valid_from) AS t FROM s UNION ALL SELECT dst, coalesce(valid_to, valid_from) FROM s) SELECT id, round(coalesce(1 - least(greatest(1707000000.0::DOUBLE - max(t), 0) / 1e7, 1), 0), 6) AS recency FROM e GROUP BY id", edges=True)
def node_recency(spark: SparkSession, sf: str) -> DataFrame:
    return G.recency(_all(spark, sf), 1707000000.0, 1e7).withColumn("recency", r6(F.col("recency")))


_SIM = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), k AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) <= 40)"


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from the query vectors to their 40 nearest."""
    v = table(spark, sf, "embeddings")
    got = A.vector_search(v, v.where("vec_id % 20 = 0"), 40)
    return got.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")


_TRI = "WITH " + _SIM + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM k), d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id), both_ways AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
t AS (SELECT x.a AS id, count(*) AS triangles FROM both_ways x JOIN both_ways y ON x.a = y.a AND x.b < y.b JOIN u ON u.a = x.b AND u.b = y.b GROUP BY x.a), cl AS (SELECT d.id, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2.0::DOUBLE) ELSE 0 END AS c FROM d LEFT JOIN t ON d.id = t.id) """


@query("J8_clustering_holes", _TRI + "SELECT id, degree, triangles, round(degree * (1 - c), 6) AS hole FROM cl ORDER BY degree * (1 - c) DESC, id LIMIT 20")
def holes(spark: SparkSession, sf: str) -> DataFrame:
    got = J.structural_holes(G.clustering(_similar(spark, sf)), 20)
    return got.select("id", "degree", "triangles", r6(F.col("hole")).alias("hole"))


@query("G17_clustering", _TRI + "SELECT id, degree, triangles, round(c, 6) AS clustering FROM cl")
def clustering(spark: SparkSession, sf: str) -> DataFrame:
    return G.clustering(_similar(spark, sf)).withColumn("clustering", r6(F.col("clustering")))


@query("J9_J10_discovery_potential", _TRI + "SELECT id, round(0.4::DOUBLE * 0.5 + 0.4::DOUBLE * (1 - c) + 0.2::DOUBLE * (id % 2), 6) AS potential, CASE WHEN c < 0.1 THEN 4 WHEN c < 0.4 THEN 3 ELSE 2 END AS depth FROM cl")
def potential(spark: SparkSession, sf: str) -> DataFrame:
    c = G.clustering(_similar(spark, sf))
    return c.select("id", r6(J.discovery_potential(F.lit(0.5), F.col("clustering"), F.col("id") % 2)).alias("potential"), J.search_depth(F.col("clustering")).alias("depth"))


@query(
    "J7_unlinked_similar",
    "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0) SELECT a, b, round(score, 5) AS score FROM p WHERE score BETWEEN 0.2 AND 0.95 AND abs(a - b) <> 1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY p.score DESC, b) <= 5",
)
def unlinked(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    links = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = J.unlinked_similar(v, v.where("id % 20 = 0").select("id"), links, 0.2, 0.95)
    return got.select("a", "b", F.round("score", 5).alias("score"))


@query(
    "J1_J3_J4_hypotheses",
    ", p AS (SELECT a.src AS source, c.dst AS target, a.confidence * 0.5 AS s, a.dst AS m1, b.dst AS m2 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.rel = 'FULFILLED_BY' AND b.rel = 'LOCATED_IN' AND c.rel = 'IN_REGION'), m AS (SELECT source, target, unnest([m1, m2]) AS node FROM p) SELECT source, target, node, count(*) AS paths FROM m GROUP BY ALL HAVING count(*) >= 2",
    edges=True,
)
def intersections(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.plans.access_queries import chain_paths

    p = chain_paths(spark, sf).select(F.col("n0").alias("source"), F.col("n3").alias("target"), F.array("n0", F.lit("FULFILLED_BY"), "n1", F.lit("LOCATED_IN"), "n2", F.lit("IN_REGION"), "n3").alias("path"))
    return J.intersection_nodes(p)


@query("J1_hypothesis_confidence", ", p AS (SELECT DISTINCT a.src AS source, c.dst AS target, a.dst, b.dst FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.rel = 'FULFILLED_BY' AND b.rel = 'LOCATED_IN' AND c.rel = 'IN_REGION') SELECT source, target, count(*) AS paths, count(*)::INT AS independent, round(1 - pow(0.6::DOUBLE, count(*)), 6) AS confidence FROM p GROUP BY ALL", edges=True)
def hypothesis_confidence(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.plans.access_queries import chain_paths

    p = chain_paths(spark, sf).select(F.col("n0").alias("source"), F.col("n3").alias("target"), F.array("n0", F.lit("FULFILLED_BY"), "n1", F.lit("LOCATED_IN"), "n2", F.lit("IN_REGION"), "n3").alias("path"), (F.col("conf")[0] * 0.5).alias("score"))
    return J.hypotheses(p).withColumn("confidence", r6(F.col("confidence")))


@query("J2_compose_chain", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'LOOKED' ELSE 'RELATED_TO' END AS rel FROM events")
def chain(spark: SparkSession, sf: str) -> DataFrame:
    rules = {("click", "x"): "LOOKED", ("view", "x"): "LOOKED"}
    return table(spark, sf, "events").select("event_id", J.compose_chain(F.array("event_type", F.lit("x")), rules).alias("rel"))


@query("J13_auto_approve", "WITH e AS (SELECT event_id, 1 / (1 + exp(-(value / 20 - 2.0::DOUBLE))) AS p, event_type = 'error' AS bad, event_id < 20 AS cold FROM events) SELECT event_id, CASE WHEN cold THEN 'review' WHEN bad THEN 'reject' WHEN p >= 0.8 THEN 'approve' WHEN p <= 0.2 THEN 'reject' ELSE 'review' END AS decision FROM e")
def auto_approve(spark: SparkSession, sf: str) -> DataFrame:
    d = J.auto_decision({"v": F.col("value")}, {"v": 0.05}, -2.0, F.col("event_id"), F.col("event_type") == "error")
    return table(spark, sf, "events").select("event_id", d.alias("decision"))


@query("J12_finding_threads", ", x AS (SELECT DISTINCT split_part(src, ':', 2)::BIGINT AS finding, dst AS node FROM edges WHERE rel = 'LOCATED_IN' AND src LIKE 'customer:%') SELECT finding, min(finding) OVER (PARTITION BY node) AS thread FROM x", edges=True)
def threads(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "customer").select(F.col("c_custkey").alias("finding"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node"))
    return J.finding_threads(f)


@query("J18_J19_candidate_register", "SELECT user_id AS source, event_type AS target, count(*) AS n, max(ts) AS last, round(least(1 + 0.5::DOUBLE * log2(count(*)), 3), 6) AS boost FROM events GROUP BY ALL")
def register(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("target"), F.col("ts").alias("at"))
    return J.register(e).withColumn("boost", r6(F.col("boost")))


@query("J17_literature_recency", "SELECT user_id, round(avg(exp(-0.1::DOUBLE * (value / 10))), 6) AS recency FROM events GROUP BY user_id")
def literature_recency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(r6(J.recency_score(F.col("value") / 10)).alias("recency"))


@query(
    "J21_J22_discovery_weights",
    _S + _CID + ", g AS (SELECT cid, rel, count(*) AS n FROM s JOIN c ON src = c.id GROUP BY ALL), p AS (SELECT cid, n / sum(n) OVER (PARTITION BY cid) AS p FROM g), k AS (SELECT cid, sum(-p * log2(p)) / log2(count(*) + 1) AS cur FROM p GROUP BY cid), r AS (SELECT cid, count(*) AS scans, sum(CASE WHEN rel = 'purchase' THEN 1 ELSE 0 END) AS finds FROM s JOIN c ON src = c.id GROUP BY cid), t AS (SELECT sum(finds) / sum(scans)::DOUBLE AS g FROM r) SELECT cid, round(least(greatest(0.7::DOUBLE * g / (finds / scans::DOUBLE + 0.05::DOUBLE) + 0.3::DOUBLE * cur * 5, 0.2), 5), 5) AS weight FROM r JOIN k USING (cid), t",
    edges=True,
)
def discovery_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    c = _kinds(e)
    rates = e.join(c.select(F.col("id").alias("src"), "cid"), "src").groupBy("cid").agg(F.count("*").alias("scans"), F.sum(F.when(F.col("rel") == "purchase", 1).otherwise(0)).alias("finds"))
    got = J.discovery_weights(rates.join(J.curiosity(e, c), "cid"))
    return got.select("cid", F.round("weight", 5).alias("weight"))


@query("J23_J24_confidence_prune", ", x AS (SELECT 1) SELECT src, rel, dst, confidence FROM edges WHERE src LIKE 'user:%' AND (confidence >= 0.75 OR src = 'user:1' OR dst = 'k:3')", edges=True)
def confidence_prune(spark: SparkSession, sf: str) -> DataFrame:
    bridges = spark.createDataFrame([("user:1",), ("k:3",)], "id string")
    return J.confidence_prune(edge_view(spark, sf, ["EVENTS"]), 0.75, bridges).select("src", "rel", "dst", "confidence")


@query(
    "J25_synthesise_links",
    "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0), q AS (SELECT *, CASE WHEN b - a IN (1, 2, 3) THEN b - a END AS depth FROM p) SELECT a, b FROM q WHERE (depth IS NOT NULL AND score >= 0 OR score >= 0.3) AND (depth IS NULL OR depth > 1) ORDER BY score DESC, a, b LIMIT 100",
)
def synthesise(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    links = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    pairs = J.unlinked_similar(v, v.where("id % 20 = 0").select("id"), links.where("false"), -1.0, 1.0, 1 << 30)
    return J.synthesise(pairs.select("a", "b", "score"), links, 0.0, 0.3, 3, 100).select("a", "b")


@query("J27_utility_prune", "WITH e AS (SELECT event_id, round(0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE * (1 - 0.5::DOUBLE * (event_id / 100000.0::DOUBLE)) + least(0.5::DOUBLE, 0.05::DOUBLE * (user_id % 10)), 6) AS u FROM events), h AS (SELECT u, count(*) AS n FROM e GROUP BY u), c AS (SELECT max(u) AS cut FROM (SELECT u, sum(n) OVER (ORDER BY u) AS upto FROM h) WHERE upto <= 0.2::DOUBLE * (SELECT count(*) FROM e)) SELECT event_id, u FROM e, c WHERE u >= 0.6 AND (cut IS NULL OR u > cut)")
def utility_prune(spark: SparkSession, sf: str) -> DataFrame:
    u = F.lit(0.5) + J.utility((F.col("event_id") % 50) / 100.0, F.col("event_id") / 100000.0, F.col("user_id") % 10)
    e = table(spark, sf, "events").select("event_id", r6(u).alias("utility"))
    return J.utility_prune(e, 0.6, 0.2).select("event_id", F.col("utility").alias("u"))


@query("J28_weight_decay", ", u AS (SELECT src, rel, dst, count(*) AS uses FROM edges WHERE rel = 'CONTAINS' GROUP BY ALL) SELECT e.src, e.rel, e.dst, round(greatest(weight + 0.1::DOUBLE * (1 - uses / (uses + 5.0::DOUBLE)) * (1 - weight), 0), 6) AS weight FROM edges e JOIN u USING (src, rel, dst)", edges=True)
def weight_decay(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["CONTAINS"])
    uses = e.groupBy("src", "rel", "dst").agg(F.count("*").alias("uses"))
    return J.weight_decay(e, uses).select("src", "rel", "dst", r6(F.col("weight")).alias("weight"))


@query(
    "J29_hebbian_replay",
    ", m AS (SELECT event_id AS id, value AS score, 'user:' || user_id AS src, event_type AS rel, 'k:' || json_extract_string(props, '$.k') AS dst FROM events ORDER BY value DESC, event_id LIMIT 500), d AS (SELECT src, rel, dst, sum(score * 0.001) AS delta FROM m GROUP BY ALL) SELECT e.src, e.rel, e.dst, round(least(greatest(weight + coalesce(delta, 0), 0), 10), 6) AS weight FROM edges e LEFT JOIN d USING (src, rel, dst) WHERE e.src LIKE 'user:%'",
    edges=True,
)
def hebbian(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    step = F.struct(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("rel"), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("dst"))
    memories = ev.select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.array(step).alias("path"))
    return J.hebbian(edge_view(spark, sf, ["EVENTS"]), memories, 500, 0.001).select("src", "rel", "dst", r6(F.col("weight")).alias("weight"))


@query("J30_shortcuts", "SELECT 'user:' || user_id AS src, 'SHORTCUT' AS rel, 'k:' || json_extract_string(props, '$.k') AS dst, count(*) AS n FROM events GROUP BY user_id, event_type, json_extract_string(props, '$.k') HAVING count(*) >= 3")
def shortcuts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").select(F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), "event_type", F.concat(F.lit("k:"), F.get_json_object("props", "$.k"))).alias("path"))
    return J.shortcuts(p, 3)


@query(
    "J31_J33_bridge_crossings",
    "WITH p AS (SELECT label AS cid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT cid, list(x ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS x FROM p GROUP BY ALL) GROUP BY cid), g AS (SELECT user_id AS node, (user_id % 10)::INT AS cu, (event_id % 10)::INT AS cv, count(*) AS n FROM events WHERE user_id % 10 <> event_id % 10 GROUP BY ALL HAVING count(*) >= 5) SELECT node, cu, cv, n, round(list_cosine_similarity(a.c, b.c), 5) AS similarity FROM g JOIN m a ON cu = a.cid JOIN m b ON cv = b.cid WHERE list_cosine_similarity(a.c, b.c) >= 0",
)
def crossings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("node"), (F.col("user_id") % 10).cast("int").alias("cu"), (F.col("event_id") % 10).cast("int").alias("cv")).where("cu <> cv")
    got = J.bridge_crossings(e, A.community_signatures(table(spark, sf, "embeddings")), 5, 0.0)
    return got.withColumn("similarity", F.round("similarity", 5))


@query(
    "J35_validate_insight",
    ", i AS (SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target FROM orders), u AS (SELECT dst AS target, count(DISTINCT src) AS support FROM edges WHERE rel = 'PLACED_BY' GROUP BY dst) SELECT source, i.target, CASE WHEN support > 1 THEN 'supported' ELSE 'open' END AS status FROM i JOIN u ON i.target = u.target",
    edges=True,
)
def insight(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["PLACED_BY"])
    return J.validate_insight(e.select(F.col("src").alias("source"), F.col("dst").alias("target")), e, 2).select("source", "target", "status")


@query("J43_working_memory", "WITH m AS (SELECT user_id AS id, list(DISTINCT event_type ORDER BY event_type) AS nodes, max(epoch(ts)) AS t FROM events GROUP BY user_id) SELECT id, round(exp(-1e-6::DOUBLE * (1707000000.0 - t)) * len(list_intersect(nodes, ['click', 'x'])) / (len(nodes) + 2 - len(list_intersect(nodes, ['click', 'x']))), 6) AS score FROM m ORDER BY exp(-1e-6::DOUBLE * (1707000000.0 - t)) * len(list_intersect(nodes, ['click', 'x'])) / (len(nodes) + 2 - len(list_intersect(nodes, ['click', 'x']))) DESC, id LIMIT 10")
def working_memory(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.graph import epoch

    m = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("event_type")).alias("nodes"), F.max(epoch(F.col("ts"))).alias("at"))
    return J.most_relevant(m, ["click", "x"], 1707000000.0, 1e-6, 10).select("id", r6(F.col("score")).alias("score"))


@query("J38_circuit_breaker", "WITH d AS (SELECT event_id, user_id, avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) OVER w AS share, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, round(share, 6) AS share, n >= 10 AND share < 0.1 AS stop FROM d")
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").cast("int").alias("approved"))
    return J.breaker(d, 10, 0.1).select(F.col("id").alias("event_id"), r6(F.col("share")).alias("share"), "stop")


@query("G31_hot_communities", "WITH h AS (SELECT user_id % 10 AS cid, list(value::DOUBLE ORDER BY event_id) AS l FROM events GROUP BY 1) SELECT cid FROM h WHERE list_reduce(list_prepend(0.0::DOUBLE, l), lambda s, x: 0.9::DOUBLE * s + 0.1::DOUBLE * x) > 20")
def hot(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("cid")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    ema = F.aggregate("l", F.lit(0.0), lambda s, x: 0.9 * s + 0.1 * x.value)
    return h.where(ema > 20).select("cid")


@query("G1_G2_G3_G25_consensus_communities", None)
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    return G.consensus_communities(_all(spark, sf), 4)


@query("G5_G4_hierarchical", None)
def hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    return G.hierarchical(_all(spark, sf), 10)


def _merge_sql(least: int, rounds: int) -> str:
    """Rounds of merging from ``c0`` (id, cid) over ``s``; the last is ``c{rounds}``."""
    out = ""
    for k in range(rounds):
        out += f""", z{k} AS MATERIALIZED (SELECT cid, count(*) AS size FROM c{k} GROUP BY cid), h{k} AS MATERIALIZED (SELECT cid, dst FROM s JOIN c{k} ON id = src), p{k} AS MATERIALIZED (SELECT h.cid, c.cid AS goal FROM h{k} h JOIN c{k} c ON id = dst WHERE h.cid <> c.cid),
t{k} AS MATERIALIZED (SELECT cid, goal, count(*) AS n FROM (SELECT cid, goal FROM p{k} UNION ALL SELECT goal, cid FROM p{k}) GROUP BY ALL),
m{k} AS (SELECT t.cid, goal FROM t{k} t JOIN z{k} x ON x.cid = t.cid JOIN z{k} y ON y.cid = goal WHERE x.size < {least} AND (y.size > x.size OR (y.size = x.size AND goal < t.cid)) QUALIFY row_number() OVER (PARTITION BY t.cid ORDER BY n DESC, goal) = 1),
c{k + 1} AS MATERIALIZED (SELECT id, coalesce(goal, cid) AS cid FROM c{k} LEFT JOIN m{k} USING (cid))"""
    return out


@query("G11_G20_merge_small", ", s AS MATERIALIZED (SELECT src, dst FROM edges), c0 AS MATERIALIZED (SELECT id, split_part(id, ':', 1) || right(id, 1) AS cid FROM (SELECT src AS id FROM s UNION SELECT dst FROM s))" + _merge_sql(50, 3) + " SELECT id, cid FROM c3", edges=True)
def merge_small(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    return G.merge_small(e, materialize(_kinds(e), "kinds"), 50)


def _q_sql(name: str, cid: str) -> str:
    return f"p{name} AS (SELECT {cid.format('src')} AS cu, {cid.format('dst')} AS cv FROM s), e{name} AS (SELECT cid, count(*) AS d FROM (SELECT cu AS cid FROM p{name} UNION ALL SELECT cv FROM p{name}) GROUP BY cid), i{name} AS (SELECT cu AS cid, count(*) AS n FROM p{name} WHERE cu = cv GROUP BY cu), q{name} AS (SELECT sum(coalesce(n, 0) / m::DOUBLE - pow(d / (2.0::DOUBLE * m), 2)) AS q FROM e{name} LEFT JOIN i{name} USING (cid), (SELECT count(*) AS m FROM s))"


@query("G12_G26_G27_best_of", _S + ", " + _q_sql("d", "split_part({0}, ':', 1) || right({0}, 1)") + ", " + _q_sql("t", "split_part({0}, ':', 1)") + " SELECT CASE WHEN qd.q >= qt.q THEN 'digits' ELSE 'types' END AS best, round(greatest(qd.q, qt.q), 6) AS q FROM qd, qt", edges=True)
def best_of(spark: SparkSession, sf: str) -> DataFrame:
    e = _all(spark, sf)
    name, q = G.best_of(e, {"digits": _kinds(e), "types": nodes_of(e).select("id", F.col("type").alias("cid"))})
    return spark.createDataFrame([(name, round(q, 6))], "best string, q double")


@query("G17_betweenness", ", l AS (SELECT src, dst FROM edges WHERE rel = 'LOCATED_IN') SELECT src AS id, 0.0::DOUBLE AS score FROM l UNION ALL SELECT n.src, (SELECT count(*) FROM l WHERE l.dst = n.src)::DOUBLE FROM edges n WHERE n.rel = 'IN_REGION'", edges=True)
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return G.betweenness(edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"]), sources, 3).withColumn("score", r6(F.col("score")))


@query("E21_E22_strategy", "SELECT 20 AS width, 'hybrid' AS strategy")
def strategy(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(S.adaptive_width(10, 0.6), S.strategy(0.5))], "width int, strategy string")
