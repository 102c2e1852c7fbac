"""Queries of rules, contradictions and causal operators (H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import edge_view, table
from graphloom.operators import causal as C
from graphloom.operators import rules as R
from graphloom.plans.registry import query

OPPOSING = {"CLICK": ["ERROR"], "PURCHASE": ["ERROR", "VIEW"]}
_OPP = "o AS (SELECT * FROM (VALUES ('CLICK', 'ERROR'), ('ERROR', 'CLICK'), ('PURCHASE', 'ERROR'), ('ERROR', 'PURCHASE'), ('PURCHASE', 'VIEW'), ('VIEW', 'PURCHASE')) t(a, b))"


def r6(c):
    return F.round(c, 6)


@query("H1_inverse_rule", ", x AS (SELECT DISTINCT dst AS src, 'SUPPLIES' AS rel, src AS dst FROM edges WHERE rel = 'SUPPLIED_BY') SELECT * FROM x", edges=True)
def inverse(spark: SparkSession, sf: str) -> DataFrame:
    return R.inverse_rule(edge_view(spark, sf, ["SUPPLIED_BY"]), "SUPPLIED_BY", "SUPPLIES").select("src", "rel", "dst")


@query(
    "H2_composition_rule",
    ", a AS (SELECT src, dst AS mid, max(confidence) AS ca FROM edges WHERE rel = 'CONTAINS' GROUP BY ALL), b AS (SELECT src AS mid, dst, confidence AS cb FROM edges WHERE rel = 'SUPPLIED_BY'), j AS (SELECT src, dst, count(DISTINCT mid) AS support, max(least(ca, cb)) AS confidence FROM a JOIN b USING (mid) GROUP BY ALL), y AS (SELECT src, dst FROM edges WHERE rel = 'FULFILLED_BY') SELECT src, dst, support, round(confidence, 6) AS confidence FROM j ANTI JOIN y USING (src, dst) WHERE support >= 2",
    edges=True,
)
def composition(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["CONTAINS", "SUPPLIED_BY", "FULFILLED_BY"])
    got = R.composition_rule(e, "CONTAINS", "SUPPLIED_BY", "FULFILLED_BY", 2)
    return got.select("src", "dst", "support", r6(F.col("confidence")).alias("confidence"))


@query(
    "H3_generalised_composition",
    ", e AS (SELECT src, rel, dst, max(confidence) AS c FROM edges WHERE rel IN ('PLACED_BY', 'FULFILLED_BY', 'LOCATED_IN', 'IN_REGION') GROUP BY ALL), j AS (SELECT a.src, a.rel AS r1, b.rel AS r2, b.dst, least(a.c, b.c) AS c FROM e a JOIN e b ON a.dst = b.src), p AS (SELECT r1, r2 FROM j GROUP BY ALL HAVING count(*) >= 1000) SELECT src, r1 || '__' || r2 AS rel, dst, max(c) AS confidence FROM j JOIN p USING (r1, r2) GROUP BY ALL",
    edges=True,
)
def generalised(spark: SparkSession, sf: str) -> DataFrame:
    return R.generalised_composition(edge_view(spark, sf, ["PLACED_BY", "FULFILLED_BY", "LOCATED_IN", "IN_REGION"]), 1000)


_RULES = "PLACED_BY LOCATED_IN SOLD_IN 0.8\nFULFILLED_BY LOCATED_IN SHIPPED_FROM 0.7\nLOCATED_IN IN_REGION LOCATED_IN 0.9"


@query(
    "H4_transitive_rules",
    ", r AS (SELECT * FROM (VALUES ('PLACED_BY', 'LOCATED_IN', 'SOLD_IN', 0.8::DOUBLE), ('FULFILLED_BY', 'LOCATED_IN', 'SHIPPED_FROM', 0.7), ('LOCATED_IN', 'IN_REGION', 'LOCATED_IN', 0.9)) t(r1, r2, rc, f)) SELECT a.src, rc AS rel, b.dst, round(max(a.confidence * b.confidence * f), 6) AS confidence FROM edges a JOIN r ON a.rel = r1 JOIN edges b ON b.src = a.dst AND b.rel = r2 GROUP BY ALL",
    edges=True,
)
def transitive(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["PLACED_BY", "FULFILLED_BY", "LOCATED_IN", "IN_REGION"])
    got = R.transitive_inference(e, R.composition_table(spark, _RULES))
    return got.select("src", "rel", "dst", r6(F.col("confidence")).alias("confidence"))


@query("H5_inference_rollback", ", x AS (SELECT 1) SELECT rel, count(*) AS n FROM edges WHERE rel IN ('LOCATED_IN', 'IN_REGION') GROUP BY rel", edges=True)
def inference_rollback(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["LOCATED_IN", "IN_REGION"])
    run = R.transitive_inference(e, R.composition_table(spark, "LOCATED_IN IN_REGION PLACED_IN 0.9"))
    added = e.unionByName(run.drop("mid"), allowMissingColumns=True)
    return R.rollback(added, run).groupBy("rel").agg(F.count("*").alias("n"))


@query(
    "H6_holdout_validation",
    """, k AS (SELECT DISTINCT src, rel, dst, ('0x' || substr(md5(src || '|' || rel || '|' || dst), 1, 8))::BIGINT % 100 < 20 AS hidden FROM edges WHERE rel IN ('CONTAINS', 'SUPPLIED_BY', 'FULFILLED_BY')), f AS (SELECT DISTINCT a.src, 'FULFILLED_BY' AS rel, b.dst FROM k a JOIN k b ON a.dst = b.src WHERE a.rel = 'CONTAINS' AND b.rel = 'SUPPLIED_BY' AND NOT a.hidden AND NOT b.hidden),
    g AS (SELECT * FROM f ANTI JOIN (SELECT * FROM k WHERE NOT hidden) s USING (src, rel, dst)), h AS (SELECT rel, count(*) AS hidden FROM k WHERE hidden GROUP BY rel), i AS (SELECT rel, count(*) AS inferred FROM g GROUP BY rel), t AS (SELECT rel, count(*) AS hits FROM g SEMI JOIN (SELECT * FROM k WHERE hidden) s USING (src, rel, dst) GROUP BY rel),
    o AS (SELECT rel, coalesce(inferred, 0) AS inferred, coalesce(hidden, 0) AS hidden, coalesce(hits, 0) AS hits FROM h FULL JOIN i USING (rel) LEFT JOIN t USING (rel)) SELECT *, round(CASE WHEN inferred > 0 THEN hits / inferred::DOUBLE END, 6) AS precision, round(CASE WHEN hidden > 0 THEN hits / hidden::DOUBLE END, 6) AS recall FROM o""",
    edges=True,
)
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["CONTAINS", "SUPPLIED_BY", "FULFILLED_BY"])
    got = R.holdout_validation(e, R.composition_table(spark, "CONTAINS SUPPLIED_BY FULFILLED_BY 0.9"))
    return got.select("rel", "inferred", "hidden", "hits", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query(
    "H7_H14_direct_contradiction",
    ", "
    + _OPP
    + ", e AS (SELECT src, rel, dst, max(confidence) AS c FROM edges WHERE src LIKE 'user:%' GROUP BY ALL) SELECT x.src, x.dst, x.rel AS r1, y.rel AS r2, 'parallel' AS kind, round(least(x.c, y.c), 6) AS severity FROM e x JOIN o ON upper(x.rel) = a JOIN e y ON x.src = y.src AND x.dst = y.dst AND upper(y.rel) = b WHERE a < b",
    edges=True,
)
def direct(spark: SparkSession, sf: str) -> DataFrame:
    got = R.direct_contradictions(edge_view(spark, sf, ["EVENTS"]), R.opposing_table(spark, OPPOSING))
    return got.withColumn("severity", r6(F.col("severity")))


@query(
    "H8_temporal_contradiction",
    ", " + _OPP + ", e AS (SELECT src, rel, dst, min(valid_from) AS f, max(valid_to) AS t FROM edges WHERE src LIKE 'user:%' GROUP BY ALL) SELECT x.src, x.dst, x.rel AS r1, y.rel AS r2, round(y.f - x.t, 3) AS gap FROM e x JOIN o ON upper(x.rel) = a JOIN e y ON x.src = y.src AND x.dst = y.dst AND upper(y.rel) = b WHERE x.t < y.f",
    edges=True,
)
def temporal(spark: SparkSession, sf: str) -> DataFrame:
    got = R.temporal_contradictions(edge_view(spark, sf, ["EVENTS"]), R.opposing_table(spark, OPPOSING))
    return got.withColumn("gap", F.round("gap", 3))


@query("H9_provenance_contradiction", ", x AS (SELECT src, rel, dst, count(DISTINCT provenance) AS sources, max(confidence) - min(confidence) AS spread FROM edges WHERE src LIKE 'user:%' GROUP BY ALL) SELECT src, rel, dst, sources, round(spread, 6) AS spread FROM x WHERE sources >= 2 AND spread > 0.1", edges=True)
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    return R.provenance_contradictions(edge_view(spark, sf, ["EVENTS"])).withColumn("spread", r6(F.col("spread")))


@query(
    "H10_cross_path_contradiction",
    ", " + _OPP + ", e AS (SELECT DISTINCT rel, dst, src FROM edges WHERE src LIKE 'user:%') SELECT DISTINCT x.dst AS tail, a, b FROM e x JOIN o ON upper(x.rel) = a JOIN e y ON x.dst = y.dst AND upper(y.rel) = b WHERE x.src LIKE 'user:1%' AND y.src LIKE 'user:2%'",
    edges=True,
)
def cross_path(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["EVENTS"])
    paths = lambda p: e.where(F.startswith("src", F.lit(p))).select(F.array("src", F.upper("rel"), "dst").alias("path"), F.col("dst").alias("tail"))
    return R.cross_path_contradictions(paths("user:1"), paths("user:2"), R.opposing_table(spark, OPPOSING))


@query("H11_in_path_contradiction", "WITH g AS (SELECT user_id, json_extract_string(props, '$.k') AS k, list(event_type) AS r FROM events GROUP BY ALL) SELECT user_id, k, list_contains(r, 'error') AND (list_contains(r, 'click') OR list_contains(r, 'purchase')) OR list_contains(r, 'purchase') AND list_contains(r, 'view') AS bad FROM g")
def in_path(spark: SparkSession, sf: str) -> DataFrame:
    rels = table(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.collect_set("event_type").alias("r"))
    path = F.flatten(F.transform("r", lambda x: F.array(F.lit("n"), x)))
    return rels.select("user_id", "k", R.path_contradicts(path, OPPOSING).alias("bad"))


@query(
    "H12_H13_contradiction_edges",
    ", "
    + _OPP
    + ", e AS (SELECT src, rel, dst, max(confidence) AS c FROM edges WHERE src LIKE 'user:%' GROUP BY ALL), n AS (SELECT DISTINCT x.src, x.dst, least(x.c, y.c) AS s FROM e x JOIN o ON upper(x.rel) = a JOIN e y ON x.src = y.src AND x.dst = y.dst AND upper(y.rel) = b WHERE a < b) SELECT (SELECT count(*) FROM edges WHERE src LIKE 'user:%') + count(*) AS n, count(*) AS added FROM n",
    edges=True,
)
def contradiction_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["EVENTS"])
    got = R.materialise_contradictions(e, R.direct_contradictions(e, R.opposing_table(spark, OPPOSING)))
    return got.agg(F.count("*").alias("n"), F.count(F.when(F.col("rel") == "CONTRADICTS", 1)).alias("added"))


@query(
    "H15_contested_findings",
    "WITH g AS (SELECT user_id, list((event_id % 50) / 100.0::DOUBLE ORDER BY event_id) FILTER (event_type = 'purchase') AS c, max((event_id % 40) / 40.0::DOUBLE) FILTER (event_type = 'error') AS worst FROM events GROUP BY user_id), n AS (SELECT user_id, coalesce(c, []) AS c, coalesce(worst, 0) AS worst, 1 - list_reduce(list_prepend(1.0::DOUBLE, coalesce(c, [])), lambda s, x: s * (1 - x)) AS nor FROM g) SELECT user_id, CASE WHEN len(c) = 0 OR worst < 0.3 THEN 'clean' WHEN nor - worst > 0.2 THEN 'revision_candidate' WHEN nor - worst < -0.2 THEN 'discardable' ELSE 'contested' END AS resolution FROM n",
)
def contested(spark: SparkSession, sf: str) -> DataFrame:
    value = lambda kind, mod: F.collect_list(F.when(F.col("event_type") == kind, F.col("event_id") % mod / (100.0 if mod == 50 else 40.0)))
    g = table(spark, sf, "events").groupBy("user_id").agg(value("purchase", 50).alias("c"), value("error", 40).alias("x"))
    return g.select("user_id", R.resolution(F.col("c"), F.col("x")).alias("resolution"))


@query("H16_step_constraints", ", x AS (SELECT 1) SELECT rel, count(*) AS n FROM edges WHERE rel = 'LOCATED_IN' AND src LIKE 'supplier:%' GROUP BY rel", edges=True)
def constraints(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame([("LOCATED_IN", "customer", "nation"), ("IN_REGION", "nation", "region")], "rel string, src_type string, dst_type string")
    return R.violations(edge_view(spark, sf, ["LOCATED_IN", "IN_REGION"]), allowed).groupBy("rel").agg(F.count("*").alias("n"))


@query(
    "H18_dead_end_repair",
    """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 20 = 0 AND b.id <> a.id + 1)
    SELECT id, other, round(score, 5) AS score, row_number() OVER (PARTITION BY id ORDER BY s.score DESC, other) AS rank FROM s QUALIFY rank <= 3""",
)
def dead_ends(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"), F.col("embedding").alias("v"))
    links = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = R.repair_dead_ends(v.where("id % 20 = 0").select("id"), v, links)
    return got.select("id", "other", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- causal

CAUSAL = ("PLACED_BY", "FULFILLED_BY", "LOCATED_IN", "IN_REGION")
_PAIRS = """, c AS (SELECT src, rel, dst, confidence AS w FROM edges WHERE rel IN ('PLACED_BY', 'FULFILLED_BY', 'LOCATED_IN', 'IN_REGION')), p1 AS (SELECT src AS source, [src, rel, dst] AS path, dst AS tail, w AS m FROM c WHERE src LIKE 'order:%'),
p2 AS (SELECT source, list_concat(path, [rel, dst]) AS path, dst AS tail, least(m, w) AS m FROM p1 JOIN c ON tail = src), p3 AS (SELECT source, list_concat(path, [rel, dst]) AS path, dst AS tail, least(m, w) AS m FROM p2 JOIN c ON tail = src WHERE dst LIKE 'region:%'),
eff AS (SELECT source, tail AS target, 1 - product(1 - m) AS effect, count(*) AS paths FROM p3 GROUP BY ALL) """


def _causal_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf, list(CAUSAL)).withColumn("weight", F.col("confidence"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source"))
    regions = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("target"))
    return orders.join(F.broadcast(regions))  # the question: each order to each of the five regions


@query("I1_I2_I6_causal_effect", _PAIRS + "SELECT source, target, round(effect, 6) AS effect, paths FROM eff", edges=True)
def causal_effect(spark: SparkSession, sf: str) -> DataFrame:
    got = C.effect(C.causal_paths(_pairs(spark, sf), _causal_edges(spark, sf), 3, CAUSAL))
    return got.select("source", "target", r6(F.col("effect")).alias("effect"), "paths")


_PART = """, c AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('CONTAINS', 'SUPPLIED_BY', 'FULFILLED_BY', 'LOCATED_IN')), """


@query(
    "I4_ancestors",
    ", c AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('LOCATED_IN', 'IN_REGION', 'PLACED_BY')), a1 AS (SELECT dst AS q, src AS id FROM c WHERE dst LIKE 'region:%'), a2 AS (SELECT DISTINCT q, src AS id FROM a1 JOIN c ON c.dst = a1.id), a3 AS (SELECT DISTINCT q, src AS id FROM a2 JOIN c ON c.dst = a2.id) SELECT q AS query_id, id, 1 AS depth FROM a1 UNION ALL SELECT q, id, 2 FROM a2 UNION ALL SELECT q, id, 3 FROM a3",
    edges=True,
)
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return C.ancestors(regions, edge_view(spark, sf, ["LOCATED_IN", "IN_REGION", "PLACED_BY"]), 3, ("LOCATED_IN", "IN_REGION", "PLACED_BY"))


@query(
    "I3_confounders",
    """, p AS (SELECT DISTINCT src AS source, dst AS target FROM edges WHERE rel = 'SUPPLIED_BY'), a AS (SELECT DISTINCT dst AS source, src AS confounder FROM edges WHERE rel = 'CONTAINS'), b AS (SELECT DISTINCT dst AS target, src AS confounder FROM edges WHERE rel = 'FULFILLED_BY') SELECT source, target, confounder FROM p JOIN a USING (source) JOIN b USING (target, confounder)""",
    edges=True,
)
def confounders(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["CONTAINS", "SUPPLIED_BY", "FULFILLED_BY"])
    rels = ("CONTAINS", "SUPPLIED_BY", "FULFILLED_BY")
    pairs = e.where("rel = 'SUPPLIED_BY'").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    paths = pairs.select("source", "target", F.array("source", F.lit("SUPPLIED_BY"), "target").alias("path"))
    return C.confounders(pairs, paths, e, 1, rels)


@query("I5_temporal_order", "WITH l AS (SELECT user_id, list(ts ORDER BY event_id) AS t FROM events WHERE event_id % 3 <> 0 GROUP BY user_id) SELECT user_id, t = list_sort(t) AS ordered FROM l")
def temporal_order(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("ts")))).alias("l"))
    got = t.select("user_id", F.transform("l", lambda x: x.ts).alias("t")).where(F.exists("t", lambda x: x.isNotNull()))
    return got.select("user_id", C.in_order(F.col("t")).alias("ordered"))


@query(
    "I7_I8_counterfactual",
    _PAIRS
    + """, q AS (SELECT source, tail AS target, m FROM p3 WHERE NOT list_has_any(path, ['nation:3', 'nation:7']) AND NOT list_contains(path, 'PLACED_BY')), aft AS (SELECT source, target, 1 - product(1 - m) AS effect, count(*) AS n FROM q GROUP BY ALL)
    SELECT e.source, e.target, round(e.effect, 6) AS factual, round(coalesce(aft.effect, 0), 6) AS intervened, paths, coalesce(n, 0) AS surviving FROM eff e LEFT JOIN aft USING (source, target)""",
    edges=True,
)
def counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    e = _causal_edges(spark, sf)
    gone = spark.createDataFrame([("nation:3",), ("nation:7",)], "id string")
    cut = e.where("rel = 'PLACED_BY'").select("src", "rel", "dst")
    got = C.counterfactual(_pairs(spark, sf), e, C.intervene(e, gone, cut), 3, CAUSAL).where("paths > 0")
    return got.select("source", "target", r6(F.col("factual")).alias("factual"), r6(F.col("intervened")).alias("intervened"), "paths", "surviving")


@query(
    "I9_I10_causal_discovery",
    """, g AS (SELECT rel, count(DISTINCT src)::DOUBLE AS s, count(DISTINCT dst)::DOUBLE AS t FROM edges GROUP BY rel), k AS (SELECT dst, count(DISTINCT rel) AS kinds FROM edges GROUP BY dst), c AS (SELECT rel, avg(CASE WHEN kinds > 1 THEN 1.0 ELSE 0 END) AS collider FROM edges JOIN k USING (dst) GROUP BY rel)
    SELECT rel, round(abs(t / s - s / t) / (t / s + s / t + 1e-9), 6) AS asymmetry, round(collider, 6) AS collider FROM g JOIN c USING (rel)""",
    edges=True,
)
def discovery(spark: SparkSession, sf: str) -> DataFrame:
    got = C.discover(edge_view(spark, sf))
    return got.select("rel", r6(F.col("asymmetry")).alias("asymmetry"), r6(F.col("collider")).alias("collider"))
