"""Queries over the edge view: sources, lookups, expansion, statistics, search (A, C) and the
scalar scores of edges and paths (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scoring as S
from graphloom.functions.vectors import normalized
from graphloom.graph import edge_view, nodes_of, table
from graphloom.operators import access as A
from graphloom.plans.registry import query


def r6(c):
    return F.round(c, 6)


@query("A8_A21_edge_view", ", x AS (SELECT 1) SELECT rel, count(*) AS n, round(sum(weight), 4) AS weight, round(min(confidence), 6) AS least, count(valid_from) AS dated FROM edges GROUP BY rel", edges=True)
def edge_view_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf)
    return e.groupBy("rel").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), r6(F.min("confidence")).alias("least"), F.count("valid_from").alias("dated"))


@query(
    "A10_A11_pruned_scan",
    "SELECT l_orderkey::VARCHAR AS src, l_returnflag AS rel, l_partkey::VARCHAR AS dst, l_quantity AS weight FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 45",
)
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.sources.files import from_parquet

    e = from_parquet(spark, f"{sf}/lineitem.parquet", "l_orderkey", "l_partkey", "l_returnflag", where="l_shipdate >= timestamp_ntz'1998-01-01' and l_quantity > 45", weight_col="l_quantity")
    return e.select("src", "rel", "dst", "weight")


@query("A13_A14_sql_source", "SELECT 'c' || o_custkey AS src, 'ORDERED_' || o_orderstatus AS rel, 'o' || o_orderkey AS dst FROM orders WHERE o_totalprice > 1000")
def sql_source(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.sources.files import from_sql

    table(spark, sf, "orders").createOrReplaceTempView("a13_orders")
    text = "SELECT concat('c', o_custkey) AS Source, concat('o', o_orderkey) AS TARGET, concat('ORDERED_', o_orderstatus) AS relation FROM a13_orders WHERE o_totalprice > 1000"
    return from_sql(spark, text).select("src", "rel", "dst")


@query("B15_edge_statistics", ", x AS (SELECT 1) SELECT count(*) AS n, round(avg(confidence), 6) AS mean, min(valid_from) AS first, max(valid_from) AS last FROM edges", edges=True)
def edge_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf).agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))


@query("C1_C10_entities", ", n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT split_part(id, ':', 1) AS type, count(*) AS n FROM n GROUP BY 1", edges=True)
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return nodes_of(edge_view(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "C2_C3_expand_capped",
    """, f AS (SELECT 'customer:' || c_custkey AS id FROM customer), s AS (SELECT src, rel, dst, valid_from, weight, confidence FROM edges UNION ALL SELECT dst, rel, src, valid_from, weight, confidence FROM edges),
    r AS (SELECT src, rel, dst, row_number() OVER (PARTITION BY src ORDER BY dst, rel, valid_from NULLS FIRST, weight, confidence) AS n FROM s SEMI JOIN f ON s.src = f.id) SELECT src, rel, dst FROM r WHERE n <= 5""",
    edges=True,
)
def expand_capped(spark: SparkSession, sf: str) -> DataFrame:
    frontier = table(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return A.expand(frontier, edge_view(spark, sf, ["LOCATED_IN", "PLACED_BY"]), most=5, directed=False).select("src", "rel", "dst")


@query("C2_collapse_parallel", ", x AS (SELECT 1) SELECT src, dst, 'RELATED_TO' AS rel, count(*) AS parallel FROM edges WHERE src LIKE 'user:%' GROUP BY src, dst", edges=True)
def collapse(spark: SparkSession, sf: str) -> DataFrame:
    return A.collapse_parallel(edge_view(spark, sf, ["EVENTS"]))


@query("C4_relation_types", ", x AS (SELECT 1) SELECT src, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels FROM edges WHERE src LIKE 'user:%' OR src LIKE 'order:%' GROUP BY src", edges=True)
def relation_types(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["EVENTS", "PLACED_BY", "CONTAINS", "FULFILLED_BY"])
    return A.relation_types(e).select("src", F.concat_ws(",", "rels").alias("rels"))


_GRAMS = """g AS (SELECT p_partkey AS id, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substring(t, i::INT, 3))) AS grams FROM (SELECT p_partkey, lower(p_name || ' ' || p_partkey) AS t FROM part)),
q AS (SELECT list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i::INT, 3))) AS grams FROM (SELECT lower('{}') AS t))"""


@query("C6_C7_trigram_search", "WITH " + _GRAMS.format("part 77 green") + ", s AS (SELECT id, len(list_intersect(g.grams, q.grams)) / (len(g.grams) + len(q.grams))::DOUBLE AS score FROM g, q) SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 10")
def trigram_search(spark: SparkSession, sf: str) -> DataFrame:
    index = A.trigram_index(table(spark, sf, "part"), "p_partkey", "p_name")
    return A.trigram_search(index, "part 77 green", 10).select("id", r6(F.col("score")).alias("score"))


@query("C5_C8_find_entities", "WITH n AS (SELECT DISTINCT 'part:' || l_partkey AS id FROM lineitem) SELECT id FROM n WHERE id = 'part:17'")
def find_entities(spark: SparkSession, sf: str) -> DataFrame:
    nodes = nodes_of(edge_view(spark, sf, ["CONTAINS"])).where("type = 'part'")
    return A.find_entities(nodes, "part:17", 5).limit(1).select("id")


@query(
    "C9_E8_vector_topk",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    got = A.vector_search(v, v.where("vec_id % 20 = 0"), 10)
    return got.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("C11_edge_types", ", x AS (SELECT 1) SELECT DISTINCT rel FROM edges", edges=True)
def edge_types(spark: SparkSession, sf: str) -> DataFrame:
    return A.edge_types(edge_view(spark, sf))


@query("C13_distinct_edges", ", x AS (SELECT 1) SELECT src, rel, dst FROM edges WHERE rel = 'CONTAINS' GROUP BY ALL", edges=True)
def distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf, ["CONTAINS"]).select("src", "rel", "dst").dropDuplicates()


@query("C14_degree", ", x AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT id, count(*) AS degree FROM x GROUP BY id", edges=True)
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return A.degrees(edge_view(spark, sf))


_STATS = """, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id),
stats AS (SELECT rel, count(*) AS freq, count(DISTINCT dst) AS targets, count(DISTINCT src) AS sources, sum(degree)::BIGINT AS degree_sum FROM edges JOIN deg ON dst = id GROUP BY rel) """


@query("C15_relation_stats", _STATS + "SELECT * FROM stats", edges=True)
def relation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.relation_statistics(edge_view(spark, sf))


@query("C16_adaptive_resolution", ", n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT count(*) AS n, CASE WHEN count(*) < 100 THEN 0.5::DOUBLE WHEN count(*) < 1000 THEN 1.0 WHEN count(*) < 10000 THEN 1.5 ELSE 2.0 END AS resolution FROM n", edges=True)
def resolution(spark: SparkSession, sf: str) -> DataFrame:
    return nodes_of(edge_view(spark, sf)).agg(F.count("*").alias("n")).select("n", A.adaptive_resolution(F.col("n")).alias("resolution"))


@query("C17_upsert_edges", ", o AS (SELECT src, rel, dst, confidence FROM edges WHERE rel = 'SUPPLIED_BY') SELECT src, rel, dst, CASE WHEN src LIKE '%7' THEN 0.5 ELSE confidence END::DOUBLE AS confidence FROM o", edges=True)
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["SUPPLIED_BY"])
    new = e.where(F.col("src").endswith("7")).withColumn("confidence", F.lit(0.5))
    return A.upsert_edges(e, new).select("src", "rel", "dst", "confidence")


@query("C18_remove_edges", ", x AS (SELECT 1) SELECT src, rel, dst FROM edges WHERE rel = 'SUPPLIED_BY' AND NOT (src LIKE '%7')", edges=True)
def remove(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["SUPPLIED_BY"])
    return A.remove_edges(e, e.where(F.col("src").endswith("7"))).select("src", "rel", "dst")


@query(
    "C19_update_weights",
    ", d AS (SELECT src, rel, dst, sum(weight) - 20 AS delta FROM edges WHERE rel = 'CONTAINS' GROUP BY ALL) SELECT e.src, e.rel, e.dst, least(greatest(weight + delta, 0), 10)::DOUBLE AS weight FROM edges e JOIN d USING (src, rel, dst)",
    edges=True,
)
def update_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["CONTAINS"])
    deltas = e.groupBy("src", "rel", "dst").agg((F.sum("weight") - 20).alias("delta"))
    return A.update_weights(e, deltas).select("src", "rel", "dst", "weight")


@query("C20_J39_update_valence", ", d AS (SELECT src, rel, dst, sum(CASE WHEN confidence >= 0.75 THEN 0.3 ELSE -0.3 END)::DOUBLE AS v FROM edges WHERE src LIKE 'user:%' GROUP BY ALL) SELECT src, rel, dst, round(least(greatest(v, -1), 1), 6) AS valence FROM d", edges=True)
def update_valence(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["EVENTS"])
    outcome = e.select("src", "rel", "dst", F.when(F.col("confidence") >= 0.75, 0.3).otherwise(-0.3).alias("delta"))
    base = e.select("src", "rel", "dst").distinct().withColumn("valence", F.lit(0.0))
    return A.update_weights(base, outcome, -1.0, 1.0, "valence").select("src", "rel", "dst", r6(F.col("valence")).alias("valence"))


@query(
    "C21_temporal_filter",
    ", t AS (SELECT (min(valid_from) + max(valid_from)) / 2 AS moment FROM edges WHERE src LIKE 'user:%') SELECT src, rel, dst, valid_from FROM edges, t WHERE (valid_from IS NULL OR valid_from <= moment) AND (valid_to IS NULL OR moment <= valid_to) AND rel <> 'CONTAINS'",
    edges=True,
)
def temporal_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["IN_REGION", "LOCATED_IN", "PLACED_BY", "SUPPLIED_BY", "FULFILLED_BY", "EVENTS"])
    at = edge_view(spark, sf, ["EVENTS"]).agg(((F.min("valid_from") + F.max("valid_from")) / 2).alias("at"))
    return e.join(F.broadcast(at)).where(A.valid_at(F.col("at"))).select("src", "rel", "dst", "valid_from")


@query(
    "C22_C23_D20_meta_graph",
    """, i AS (SELECT dst AS mid, rel AS r1, count(*) AS n1 FROM edges GROUP BY ALL), o AS (SELECT src AS mid, rel AS r2, count(*) AS n2 FROM edges GROUP BY ALL),
    p AS (SELECT r1, r2, sum(n1 * n2)::BIGINT AS cnt FROM i JOIN o USING (mid) GROUP BY r1, r2), d AS (SELECT r2, count(*) AS df FROM p GROUP BY r2), n AS (SELECT count(DISTINCT r1) AS n FROM p)
    SELECT r1, p.r2, cnt, round(cnt * ln((n + 1.0::DOUBLE) / df), 4) AS weight FROM p JOIN d ON p.r2 = d.r2, n""",
    edges=True,
)
def meta_graph(spark: SparkSession, sf: str) -> DataFrame:
    return A.meta_graph(edge_view(spark, sf)).withColumn("weight", F.round("weight", 4))


@query(
    "C24_credibility",
    """, x AS (SELECT 1) SELECT provenance, CASE WHEN provenance LIKE 'pubmed%' THEN 0.95::DOUBLE WHEN provenance LIKE 'wikidata%' THEN 0.90 WHEN provenance LIKE 'freebase%' THEN 0.88 WHEN provenance LIKE 'openkg%' OR provenance LIKE 'dbpedia%' THEN 0.85
    WHEN provenance LIKE 'inferred%' THEN 0.50 WHEN provenance LIKE 'hypothesis%' THEN 0.40 WHEN provenance LIKE 'synthetic%' THEN 0.30 WHEN provenance LIKE 'rem%' THEN 0.25 ELSE 0.70 END AS trust, count(*) AS n FROM edges GROUP BY provenance""",
    edges=True,
)
def credibility(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf).groupBy("provenance").agg(F.count("*").alias("n")).withColumn("trust", S.credibility(F.col("provenance")))


@query(
    "C25_normalise_edges",
    """SELECT 'kg:user ' || user_id AS src, CASE WHEN event_type = 'view' THEN 'SAW' ELSE upper(event_type) END AS rel, 'kg:k' || json_extract_string(props, '$.k') AS dst, round(least(greatest(value / 50, 0), 1), 6) AS weight_ok,
    round(CASE WHEN event_id % 3 = 0 THEN least(least(greatest(value / 50, 0), 1), 0.1) ELSE least(greatest(value / 50, 0), 1) END, 6) AS confidence FROM events WHERE event_id % 7 <> 0""",
)
def normalise_edges(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        F.concat(F.lit("  user "), F.col("user_id").cast("string"), F.lit(" ")).alias("src"),
        F.concat(F.lit(" "), "event_type").alias("rel"),
        F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("dst"),
        (F.col("value") / 50).cast("string").alias("confidence"),
        F.lit("x").alias("weight"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("log")).alias("provenance"),
        F.round(F.least(F.greatest(F.col("value") / 50, F.lit(0)), F.lit(1)), 6).alias("weight_ok"),
    )
    got = A.normalise(raw, "kg", relation_map={"view": "SAW"}, strict_provenance=True)
    return got.where("weight = 1.0").select("src", "rel", "dst", "weight_ok", r6(F.col("confidence")).alias("confidence"))


@query(
    "C30_community_signatures",
    "WITH p AS (SELECT label AS cid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT cid, pos, avg(x) AS x, count(*) AS n FROM p GROUP BY cid, pos) SELECT cid, round(sum(x * pos), 5) AS mark, max(n) AS size FROM m GROUP BY cid",
)
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    got = A.community_signatures(table(spark, sf, "embeddings"))
    mark = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return got.select("cid", F.round(mark, 5).alias("mark"), "size")


@query("C32_holders", "SELECT source FROM documents WHERE lang = 'es' GROUP BY source")
def holders(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return A.holders(docs.select(F.col("doc_id").alias("id"), "source"), docs.where("lang = 'es'").select(F.col("doc_id").alias("id")))


# ---------------------------------------------------------------- scalar scores

_SIMILAR = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT q.vec_id AS u, v.vec_id AS w, q.label AS cu, v.label AS cv, list_cosine_similarity(q.e, v.e) AS sim FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) """


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    return A.similarities(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("group")), "id % 20 = 0")


@query(
    "E1_E2_E3_E5_edge_logit",
    _SIMILAR
    + """, f AS (SELECT *, CASE WHEN cu = cv THEN 1.0::DOUBLE WHEN abs(cu - cv) = 1 THEN 0.5 ELSE exp(-0.5::DOUBLE * least(abs(cu - cv), 5.0)) END AS cs FROM s)
    SELECT u, w, round(cs, 6) AS cs, round(1 / (1 + exp(-(0.4::DOUBLE * sim + 0.4::DOUBLE * cs + 0.1::DOUBLE * 0.3 + 0.05::DOUBLE / 2 + 1.0 * 0.9))), 6) AS weight FROM f""",
)
def edge_logit(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.abs(F.col("cu") - F.col("cv"))
    s = _similar(spark, sf).withColumn("cs", S.community_score(F.col("cu"), F.col("cv"), gap.cast("double"), gap == 1))
    features = {"sim": F.col("sim"), "cs": F.col("cs"), "etw": F.lit(0.3), "hd": S.hop_decay(1), "grounding": S.credibility(F.lit("wikidata:vec"))}
    return s.select("u", "w", r6(F.col("cs")).alias("cs"), r6(S.edge_logit(features)).alias("weight"))


@query("E4_batch_logit_by_hop", _SIMILAR + ", h AS (SELECT unnest([1, 2, 3]) AS hop) SELECT u, w, hop, round(1 / (1 + exp(-(0.4::DOUBLE / (1 + hop) * sim + 0.05::DOUBLE / (1 + hop)))), 6) AS weight FROM s, h")
def batch_logit(spark: SparkSession, sf: str) -> DataFrame:
    s = _similar(spark, sf).withColumn("hop", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    decay = S.hop_decay(F.col("hop"))
    weight = S.edge_logit({"sim": F.col("sim"), "hd": decay}, {"sim": F.lit(S.WEIGHTS["sim"]) * decay})
    return s.select("u", "w", "hop", r6(weight).alias("weight"))


@query(
    "E7_community_parameters",
    _SIMILAR + ", p AS (SELECT * FROM (VALUES (0, 0.8::DOUBLE), (3, 0.1), (5, 0.6)) t(cid, alpha)) SELECT u, w, round(1 / (1 + exp(-(coalesce(alpha, 0.4::DOUBLE) * sim))), 6) AS weight FROM s LEFT JOIN p ON cu = cid",
)
def community_parameters(spark: SparkSession, sf: str) -> DataFrame:
    params = spark.createDataFrame([(0, 0.8), (3, 0.1), (5, 0.6)], "cu int, alpha double")
    s = _similar(spark, sf).join(F.broadcast(params), "cu", "left")
    return s.select("u", "w", r6(S.edge_logit({"sim": F.col("sim")}, {"sim": F.coalesce("alpha", F.lit(0.4))})).alias("weight"))


@query("E9_homeostatic_scale", "WITH h AS (SELECT user_id, list(value::DOUBLE ORDER BY event_id) AS l FROM events GROUP BY user_id) SELECT user_id, round(0.5 / greatest(list_reduce(list_prepend(0.5::DOUBLE, l), lambda s, x: s * 0.9::DOUBLE + x * 0.1::DOUBLE), 1e-6), 6) AS scale FROM h")
def homeostatic(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    return h.select("user_id", r6(S.homeostatic_scale(F.transform("l", lambda x: x.value))).alias("scale"))


_PATHS = """, served AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), paths AS (SELECT 'order:' || l_orderkey AS n0, 'supplier:' || l_suppkey AS n1, 'nation:' || n_nationkey AS n2, 'region:' || n_regionkey AS n3, [0.8::DOUBLE, 0.95::DOUBLE, 1.0::DOUBLE] AS conf, ['hypothesis:lineitem', 'dbpedia:supplier', 'wikidata:nation'] AS prov, n_nationkey::INT AS nation, n_regionkey::INT AS region
FROM served JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) """


def chain_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths order - supplier - nation - region with their edge attributes."""
    e = edge_view(spark, sf, ["FULFILLED_BY", "LOCATED_IN", "IN_REGION"])
    hop = lambda rel, i: e.where(F.col("rel") == rel).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"), F.col("confidence").alias(f"c{i}"), F.col("provenance").alias(f"p{i}"))
    joined = hop("FULFILLED_BY", 0).join(hop("LOCATED_IN", 1), "n1").join(hop("IN_REGION", 2), "n2")
    return joined.select("n0", "n1", "n2", "n3", F.array("c0", "c1", "c2").alias("conf"), F.array("p0", "p1", "p2").alias("prov"), F.split("n2", ":")[1].cast("int").alias("nation"), F.split("n3", ":")[1].cast("int").alias("region"))


@query(
    "E10_E11_E12_E14_path_scores",
    _PATHS
    + """, g AS (SELECT *, [nation % 3, nation % 2, region % 2, -1] AS cseq, list_filter(prov, lambda p: p IN ('', 'triples', 'manual', 'unknown')) AS bare FROM paths),
    h AS (SELECT *, exp((ln(conf[1]) + ln(conf[2]) + ln(conf[3])) / 3) AS attn, (CASE WHEN cseq[1] = cseq[2] THEN 1.0::DOUBLE ELSE 0.5 END + CASE WHEN cseq[2] = cseq[3] THEN 1.0::DOUBLE ELSE 0.5 END) / 2 AS coh, conf[1] * conf[2] * conf[3] * pow(0.9::DOUBLE, len(bare)) AS grd FROM g)
    SELECT n0, n1, list_min(conf) AS least, round(coh, 6) AS coh, round(grd, 6) AS grd, round((0.4::DOUBLE * attn + 0.3::DOUBLE * coh + 0.2::DOUBLE * grd) / (0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE), 6) AS score FROM h""",
    edges=True,
)
def path_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = chain_paths(spark, sf).withColumn("cseq", F.array(F.col("nation") % 3, F.col("nation") % 2, F.col("region") % 2, F.lit(-1)))
    return p.select(
        "n0",
        "n1",
        S.path_confidence(F.col("conf")).alias("least"),
        r6(S.coherence(F.col("cseq"))).alias("coh"),
        r6(S.grounding(F.col("conf"), F.col("prov"))).alias("grd"),
        r6(S.path_score(F.col("conf"), F.col("cseq"), F.col("conf"), F.col("prov"))).alias("score"),
    )


@query(
    "E13_path_specificity",
    _PATHS
    + """, f AS (SELECT src, rel, count(*) AS n FROM edges GROUP BY ALL) SELECT n0, n1, round(exp((ln(1.0::DOUBLE / a.n) + ln(1.0::DOUBLE / b.n) + ln(1.0::DOUBLE / c.n)) / 3), 6) AS pss FROM paths JOIN f a ON a.src = n0 AND a.rel = 'FULFILLED_BY' JOIN f b ON b.src = n1 AND b.rel = 'LOCATED_IN' JOIN f c ON c.src = n2 AND c.rel = 'IN_REGION'""",
    edges=True,
)
def path_specificity(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["FULFILLED_BY", "LOCATED_IN", "IN_REGION"])
    fan = e.groupBy("src", "rel").agg(F.count("*").alias("n"))
    p = chain_paths(spark, sf)
    for i, rel in enumerate(("FULFILLED_BY", "LOCATED_IN", "IN_REGION")):
        p = p.join(fan.where(F.col("rel") == rel).select(F.col("src").alias(f"n{i}"), F.col("n").alias(f"f{i}")), f"n{i}")
    return p.select("n0", "n1", r6(S.specificity(F.array("f0", "f1", "f2"))).alias("pss"))


@query("E15_E16_posterior", "SELECT user_id, round((1 + sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)) / (2.0::DOUBLE + count(*)), 6) AS mean, round((1.0::DOUBLE + sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)) * (1 + sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END)) / ((2.0::DOUBLE + count(*)) * (2 + count(*)) * (3 + count(*))), 9) AS var FROM events GROUP BY user_id")
def posterior(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    g = table(spark, sf, "events").groupBy("user_id").agg((F.lit(1.0) + F.sum(hit)).alias("a"), (F.lit(1.0) + F.sum(1 - hit)).alias("b"))
    return g.select("user_id", r6(S.posterior_mean(F.col("a"), F.col("b"))).alias("mean"), F.round(S.posterior_variance(F.col("a"), F.col("b")), 9).alias("var"))


@query("E17_mean_features", _PATHS + "SELECT n0, n1, round((conf[1] + conf[2] + conf[3]) / 3, 6) AS m FROM paths", edges=True)
def mean_features(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.functions.vectors import mean_rows

    p = chain_paths(spark, sf).withColumn("rows", F.transform("conf", lambda c: F.array(c, c * 2)))
    return p.select("n0", "n1", r6(mean_rows(F.col("rows"))[0]).alias("m"))


@query(
    "E18_E19_entropy",
    "WITH g AS (SELECT user_id, event_type, sum(value) AS w FROM events GROUP BY ALL), p AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM g), h AS (SELECT user_id, CASE WHEN max(n) <= 1 THEN 0 ELSE sum(-p * log2(p)) / log2(max(n)) END AS h FROM p GROUP BY user_id) SELECT user_id, round(h, 5) AS entropy, round(least(greatest(1 - h * h, 0.1::DOUBLE), 1), 5) AS mult FROM h",
)
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("w"))
    share = g.select("user_id", S.entropy_share(F.col("w"), Window.partitionBy("user_id")).alias("h")).groupBy("user_id").agg(F.max("h").alias("h"))
    return share.select("user_id", F.round("h", 5).alias("entropy"), F.round(S.entropy_multiplier(F.col("h")), 5).alias("mult"))


@query(
    "E20_beam_conflict",
    "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, round(stddev_pop(value) / avg(value), 5) AS conflict FROM r WHERE n <= 5 GROUP BY user_id",
)
def beam_conflict(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = table(spark, sf, "events").withColumn("n", F.row_number().over(order)).where("n <= 5")
    return top.groupBy("user_id").agg(F.round(F.stddev_pop("value") / F.avg("value"), 5).alias("conflict"))


@query(
    "E30_E31_E32_fan_out",
    ", f AS (SELECT rel, count(*) / count(DISTINCT src)::DOUBLE AS fan_out FROM edges GROUP BY rel), s AS (SELECT max(fan_out) AS mx, avg(fan_out) AS mean, count(*) / sum(1 / fan_out) AS hm, count(*) AS n FROM f) SELECT rel, round(fan_out, 6) AS fan_out, round(1.5::DOUBLE * pow(fan_out, 0.5), 6) AS boost, round(mx, 6) AS mx, round(mean, 6) AS mean, round(hm, 6) AS hm, n FROM f, s",
    edges=True,
)
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    f = edge_view(spark, sf).groupBy("rel").agg((F.count("*") / F.countDistinct("src")).alias("fan_out"))
    s = f.agg(F.max("fan_out").alias("mx"), F.avg("fan_out").alias("mean"), (F.count("*") / F.sum(1 / F.col("fan_out"))).alias("hm"), F.count("*").alias("n"))
    return f.crossJoin(s).select("rel", r6(F.col("fan_out")).alias("fan_out"), r6(S.boost(F.col("fan_out"), 1.5, 0.5)).alias("boost"), r6(F.col("mx")).alias("mx"), r6(F.col("mean")).alias("mean"), r6(F.col("hm")).alias("hm"), "n")


@query(
    "E33_E35_relation_specificity",
    _STATS
    + ", p AS (SELECT rel, targets / freq::DOUBLE / (1 + ln(1 + degree_sum / freq::DOUBLE)) AS spec FROM stats), m AS (SELECT min(spec) AS lo, max(spec) AS hi FROM p) SELECT rel, round(spec, 6) AS spec, round(1 + 4 * (spec - lo) / (hi - lo), 6) AS boost FROM p, m",
    edges=True,
)
def relation_specificity(spark: SparkSession, sf: str) -> DataFrame:
    s = A.relation_statistics(edge_view(spark, sf))
    p = s.select("rel", S.relation_specificity(F.col("freq"), F.col("targets"), F.col("degree_sum") / F.col("freq")).alias("spec"))
    m = p.agg(F.min("spec").alias("lo"), F.max("spec").alias("hi"))
    return p.crossJoin(m).select("rel", r6(F.col("spec")).alias("spec"), r6(1 + 4 * (F.col("spec") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("boost"))


@query(
    "E34_rank_terminal_relations",
    _STATS
    + """, p AS (SELECT rel, targets / freq::DOUBLE / (1 + ln(1 + degree_sum / freq::DOUBLE)) AS spec FROM stats), l AS (SELECT src, rel, count(*) AS n FROM edges WHERE src LIKE 'user:%' GROUP BY ALL),
    t AS (SELECT src, l.rel, 0.7::DOUBLE * spec + 0.3::DOUBLE * (1 - n / (sum(n) OVER (PARTITION BY src))::DOUBLE) AS score FROM l JOIN p ON l.rel = p.rel), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM t WINDOW w AS (PARTITION BY src ORDER BY score DESC, rel))
    SELECT src, rel, round(score, 6) AS score FROM r WHERE rank = 1 AND (next IS NULL OR score >= 1.02::DOUBLE * next)""",
    edges=True,
)
def rank_terminal(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf)
    s = A.relation_statistics(e)
    spec = s.select("rel", S.relation_specificity(F.col("freq"), F.col("targets"), F.col("degree_sum") / F.col("freq")).alias("spec"))
    local = e.where(F.col("src").startswith("user:")).groupBy("src", "rel").agg(F.count("*").alias("n"))
    seed = Window.partitionBy("src")
    scored = local.join(spec, "rel").withColumn("score", 0.7 * F.col("spec") + 0.3 * (1 - F.col("n") / F.sum("n").over(seed)))
    order = seed.orderBy(F.desc("score"), "rel")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    return ranked.where("rank = 1 and (next is null or score >= 1.02D * next)").select("src", "rel", r6(F.col("score")).alias("score"))


@query("E26_graph_relation_prior", ", c AS (SELECT rel, count(*) AS n FROM edges GROUP BY rel) SELECT rel, round(ln(1 + n) / ln(1 + max(n) OVER ()), 6) AS prior FROM c", edges=True)
def relation_prior(spark: SparkSession, sf: str) -> DataFrame:
    c = edge_view(spark, sf).groupBy("rel").agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("top"))
    return c.crossJoin(top).select("rel", r6(F.log1p("n") / F.log1p("top")).alias("prior"))


_SEQ = "WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS l, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS hits FROM events GROUP BY user_id), p AS (SELECT user_id, hits, list_aggregate(l[1:k::INT], 'string_agg', '>') AS prefix, k AS len FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE len(l) >= k) "


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("hits")
    s = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("l"), hits)
    p = s.select("user_id", "hits", F.transform("l", lambda x: x.event_type).alias("l"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("len")).where("size(l) >= len")
    return p.select("user_id", "hits", "len", F.concat_ws(">", F.slice("l", F.lit(1), F.col("len"))).alias("prefix"))


@query("E24_E23_E25_path_prior", _SEQ + ", u AS (SELECT prefix, len, sum(hits)::BIGINT AS hits, count(*) AS n FROM p GROUP BY ALL) SELECT prefix, hits, n, round((hits + 1) / (n + 2)::DOUBLE, 6) AS rate FROM u ORDER BY (hits + 1) / (n + 2)::DOUBLE DESC, prefix LIMIT 20")
def path_prior(spark: SparkSession, sf: str) -> DataFrame:
    u = _sequences(spark, sf).groupBy("prefix", "len").agg(F.sum("hits").alias("hits"), F.count("*").alias("n"))
    rate = S.smoothed_rate(F.col("hits"), F.col("n"))
    return u.withColumn("raw", rate).orderBy(F.desc("raw"), "prefix").limit(20).select("prefix", "hits", "n", r6(F.col("raw")).alias("rate"))


@query("E28_E29_engrams", _SEQ + ", c AS (SELECT prefix, len, count(*) AS n FROM p GROUP BY ALL) SELECT prefix, n, round(least(1, n / (max(n) OVER ())::DOUBLE * len / 3), 6) AS affinity FROM c")
def engrams(spark: SparkSession, sf: str) -> DataFrame:
    c = _sequences(spark, sf).groupBy("prefix", "len").agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("top"))
    return c.crossJoin(top).select("prefix", "n", r6(F.least(F.lit(1.0), F.col("n") / F.col("top") * F.col("len") / 3)).alias("affinity"))


@query(
    "E37_E39_bridge_relations",
    """, b AS (SELECT split_part(src, ':', 1) AS cu, split_part(dst, ':', 1) AS cv, rel, count(*) AS n FROM edges WHERE split_part(src, ':', 1) <> split_part(dst, ':', 1) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cu, cv ORDER BY n DESC, rel) AS rank, max(n) OVER (PARTITION BY cu) AS top FROM b) SELECT cu, cv, rel, n, round(1 + 0.5::DOUBLE * n / top, 6) AS boost FROM r WHERE rank <= 3""",
    edges=True,
)
def bridge_relations(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda c: F.split(c, ":")[0]
    b = edge_view(spark, sf).select(kind("src").alias("cu"), kind("dst").alias("cv"), "rel").where("cu <> cv").groupBy("cu", "cv", "rel").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy("cu"))
    rank = F.row_number().over(Window.partitionBy("cu", "cv").orderBy(F.desc("n"), "rel"))
    return b.select("cu", "cv", "rel", "n", r6(1 + 0.5 * F.col("n") / top).alias("boost"), rank.alias("rank")).where("rank <= 3").drop("rank")


@query(
    "E42_E41_graph_profile",
    """, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), deg AS (SELECT id, count(*) AS d FROM ends GROUP BY id), r AS (SELECT d, row_number() OVER (ORDER BY d DESC, id) AS n, count(*) OVER () AS total FROM deg),
    s AS (SELECT sum(CASE WHEN n <= greatest(1, total // 100) THEN d ELSE 0 END) / sum(d)::DOUBLE AS hub, stddev_pop(d) / avg(d) AS cv FROM r) SELECT round(hub, 6) AS hub, round(cv, 5) AS cv, CASE WHEN hub > 0.4 THEN 'hub' WHEN cv > 1.5 THEN 'skewed' ELSE 'flat' END AS regime, CASE WHEN hub > 0.4 THEN 20 ELSE 10 END AS width FROM s""",
    edges=True,
)
def graph_profile(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.analytics import profile

    return profile(edge_view(spark, sf)).select(r6(F.col("hub")).alias("hub"), F.round("cv", 5).alias("cv"), "regime", "width")


@query("K8_blend_embeddings", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT vec_id, list_transform(e, lambda x, i: 0.7::DOUBLE * x + 0.3::DOUBLE * e[65 - i]) AS b FROM v), n AS (SELECT vec_id, b, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS n FROM b) SELECT vec_id, round(b[1] / n, 5) AS first, round(b[64] / n, 5) AS last FROM n")
def blend(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.functions.vectors import blend as mix

    v = table(spark, sf, "embeddings").withColumn("b", mix(F.col("embedding"), F.reverse("embedding"), 0.3))
    return v.select("vec_id", F.round(F.col("b")[0], 5).alias("first"), F.round(F.col("b")[63], 5).alias("last"))


_UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
_LAYER = "{out} AS (SELECT id, n, " + _UNIT.format(v="m") + " AS v FROM (SELECT a.id, a.n, list_transform(range(1, 65), lambda i: 0.5::DOUBLE * a.v[i] + 0.5::DOUBLE * b.v[i]) AS m FROM {src} a JOIN {src} b ON b.id = a.n))"


@query("K3_graphsage_smoothing", "WITH e AS (SELECT vec_id AS id, (vec_id * 7 + 1) % 500 AS n, embedding::DOUBLE[] AS w FROM embeddings), l0 AS (SELECT id, n, " + _UNIT.format(v="w") + " AS v FROM e), " + _LAYER.format(out="l1", src="l0") + ", " + _LAYER.format(out="l2", src="l1") + " SELECT id::VARCHAR AS id, round(v[1], 5) AS first, round(v[64], 5) AS last FROM l2")
def graphsage(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.embedding import smooth

    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), normalized(F.col("embedding")).alias("v"))
    links = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("src"), F.pmod(F.col("vec_id") * 7 + 1, F.lit(500)).cast("string").alias("dst"))
    got = smooth(v, links, layers=2)
    return got.select("id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[63], 5).alias("last"))
