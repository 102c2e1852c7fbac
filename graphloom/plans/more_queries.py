"""Further queries: file round trips, persistence, remaining traversal, analytics, discovery and API forms."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.api import Graph
from graphloom.functions import scoring as S
from graphloom.functions import text as L
from graphloom.graph import edge_view, nodes_of, table
from graphloom.operators import access as A
from graphloom.operators import analytics as G
from graphloom.operators import answers as N
from graphloom.operators import discovery as J
from graphloom.operators import embedding as K
from graphloom.operators import federation as FED
from graphloom.operators import support as R
from graphloom.operators import traversal as T
from graphloom.plans.analytics_queries import _kinds, _lpa_sql
from graphloom.plans.registry import query
from graphloom.plans.traversal_queries import _SCORED, _answers, _seeds
from graphloom.sources import files, sinks
from graphloom.storage import materialize, shared_path


def r6(c):
    return F.round(c, 6)


_LOC = ", x AS (SELECT 1) SELECT src, rel, dst FROM edges WHERE rel = 'LOCATED_IN'"


def _loc(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf, ["LOCATED_IN"])


# ---------------------------------------------------------------- files and persistence


@query("A1_A3_A16_csv_round_trip", _LOC, edges=True)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "edges.csv")
    _loc(spark, sf).selectExpr("src as source", "dst as target", "rel as relation").write.option("header", True).csv(path)
    return files.from_csv(spark, path, directed=True).select("src", "rel", "dst")


@query("A2_A4_json_round_trip", _LOC, edges=True)
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "edges.jsonl")
    _loc(spark, sf).selectExpr("src as source", "dst as target", "rel as relation").write.json(path)
    return files.load(spark, path, directed=True).select("src", "rel", "dst")


@query("A15_kb_lines", _LOC, edges=True)
def kb_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "kb")
    _loc(spark, sf).select(F.concat_ws("|", "src", "rel", "dst").alias("value")).write.text(path)
    return files.from_kb(spark, path).select("src", "rel", "dst")


@query("A17_A20_conceptnet", ", x AS (SELECT 1) SELECT replace(src, ':', ' ') AS src, 'LOCATED_IN' AS rel, replace(dst, ':', ' ') AS dst, 0.3::DOUBLE AS confidence FROM edges WHERE rel = 'LOCATED_IN'", edges=True)
def conceptnet(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "conceptnet")
    term = lambda c: F.concat(F.lit("/c/en/"), F.translate(c, ":", "_"), F.lit("/n"))
    _loc(spark, sf).select(F.concat_ws("\t", F.lit("/a/x"), F.concat(F.lit("/r/"), "rel"), term("src"), term("dst"), F.lit('{"weight": 3.0}')).alias("value")).write.text(path)
    return files.from_conceptnet(spark, path).select("src", "rel", "dst", "confidence")


@query("A12_A18_A19_A23_facades", ", l AS (SELECT rel, count(*) AS n FROM edges WHERE rel = 'LOCATED_IN' GROUP BY rel) SELECT unnest(['feather', 'frame', 'parquet', 'sql', 'table', 'table where']) AS source, rel, n FROM l", edges=True)
def facades(spark: SparkSession, sf: str) -> DataFrame:
    """The same edges through every tabular loader: a parquet file, a frame, a Feather file, SQL and a table."""
    import pyarrow.feather

    rows = _loc(spark, sf).selectExpr("src as source", "dst as target", "rel as relation")
    path = shared_path(spark, "edges.parquet")
    rows.write.parquet(path)
    rows.createOrReplaceTempView("facade_edges")
    sites = rows.toArrow()
    with tempfile.NamedTemporaryFile(suffix=".feather") as f:  # read on the driver, at once
        pyarrow.feather.write_feather(sites, f.name)
        feather = files.from_arrow(spark, f.name, directed=True)
    found = {
        "parquet": Graph.load(spark, path).edges,
        "frame": files.from_parquet(spark, rows, "source", "target", "relation"),
        "feather": feather,
        "sql": files.from_sql(spark, "SELECT source, target, relation FROM facade_edges"),
        "table": files.from_sql_table(spark, "facade_edges", "source", "target", "relation"),
        "table where": files.from_sql_table(spark, "facade_edges", "source", "target", "relation", where="relation = 'LOCATED_IN'"),
    }
    out = [e.groupBy("rel").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "rel", "n") for name, e in found.items()]
    return functools.reduce(DataFrame.unionByName, out)


@query("A5_A6_A7_markup_files", ", l AS (SELECT src, rel, dst FROM edges WHERE rel = 'IN_REGION') SELECT unnest(['gexf', 'gml', 'graphml']) AS kind, * FROM l", edges=True)
def markup_files(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written as GraphML, GEXF and GML and loaded again."""
    rows = edge_view(spark, sf, ["IN_REGION"]).select("src", "rel", "dst")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = {
        "graphml": F.concat(F.lit("<edge source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit('><data key="relation">'), "rel", F.lit("</data></edge>")),
        "gexf": F.concat(F.lit("<edge source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(" label="), quoted("rel"), F.lit("/>")),
        "gml": F.concat(F.lit("edge [ source "), "src", F.lit(" target "), "dst", F.lit(" label "), quoted("rel"), F.lit(" ]")),
    }
    around = {"graphml": ("<graphml><graph>\n", "\n</graph></graphml>"), "gexf": ("<gexf><graph><edges>\n", "\n</edges></graph></gexf>"), "gml": ("graph [\n", "\n]")}
    out = []
    for kind, text in line.items():
        path = shared_path(spark, f"edges.{kind}")
        inside = F.array_join(F.sort_array(F.collect_list(text)), "\n")  # 25 nations
        rows.agg(F.concat(F.lit(around[kind][0]), inside, F.lit(around[kind][1])).alias("value")).write.text(path)
        out.append(files.load(spark, path, directed=True).select(F.lit(kind).alias("kind"), "src", "rel", "dst"))
    return functools.reduce(DataFrame.unionByName, out)


@query("A21_A22_triples", ", l AS (SELECT src, rel, dst FROM edges WHERE rel = 'IN_REGION' UNION ALL SELECT src, 'NEAR', dst FROM edges WHERE rel = 'IN_REGION'), w AS (SELECT src, 'NEAR' AS rel, dst FROM edges WHERE rel = 'IN_REGION') SELECT 'all' AS kept, * FROM l UNION ALL SELECT 'last', * FROM w", edges=True)
def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Triples held in memory: all, and the last of each pair of ends."""
    rows = [tuple(r) for r in edge_view(spark, sf, ["IN_REGION"]).select("src", "rel", "dst").collect()]  # 25 nations
    rows += [(s, "NEAR", d) for s, _, d in rows]
    every, last = files.from_triples(spark, rows), files.from_triples(spark, rows, last_wins=True)
    return every.select(F.lit("all").alias("kept"), "src", "rel", "dst").unionByName(last.select(F.lit("last").alias("kept"), "src", "rel", "dst"))


@query("A22_last_wins", "SELECT 'user:' || user_id AS src, 'k:' || json_extract_string(props, '$.k') AS dst, arg_max(event_type, event_id) AS rel FROM events GROUP BY ALL")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("dst"), "event_type")
    return e.groupBy("src", "dst").agg(F.max_by("event_type", "event_id").alias("rel"))


@query("A24_A29_external_neighbours", ", x AS (SELECT 1) SELECT src, rel, dst FROM edges WHERE src = 'nation:3'", edges=True)
def external_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.createDataFrame([("nation:3",)], "id string")
    return A.expand(ids, edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"]), most=100).select("src", "rel", "dst")


@query("A30_B10_B11_sorted_store", _LOC, edges=True)
def sorted_store(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "sorted")
    sinks.write_sorted_by_source(_loc(spark, sf), path)
    return spark.read.parquet(path).select("src", "rel", "dst")


@query("A33_text_files", "SELECT page_id % 8 AS bucket, count(*) AS files, sum(coalesce(length(html), 0) + 1)::BIGINT AS chars, count(DISTINCT page_id) AS names FROM pages GROUP BY ALL")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """A text file for every page, read whole: the name gives the page again."""
    path = shared_path(spark, "texts")
    pages = table(spark, sf, "pages")
    pages.select("page_id", "html").repartition("page_id").write.partitionBy("page_id").text(path)
    got = files.from_text_files(spark, f"{path}/page_id=*").select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), "text")
    return got.groupBy((F.col("page_id") % 8).alias("bucket")).agg(F.count("*").alias("files"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.countDistinct("page_id").alias("names"))


@query("A35_frame_relations", "WITH d AS (SELECT l_orderkey AS frame, l_linenumber AS item, l_partkey % 100 AS x FROM lineitem) SELECT a.frame, a.item AS a, b.item AS b, CASE WHEN a.x < b.x THEN 'LEFT_OF' ELSE 'RIGHT_OF' END AS rel FROM d a JOIN d b ON a.frame = b.frame AND a.item < b.item AND a.x <> b.x")
def frame_relations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("a"), (F.col("l_partkey") % 100).alias("ax"))
    pairs = d.join(d.toDF("frame", "b", "bx"), "frame").where("a < b and ax <> bx")
    return pairs.select("frame", "a", "b", F.when(F.col("ax") < F.col("bx"), "LEFT_OF").otherwise("RIGHT_OF").alias("rel"))


@query("A36_J16_vetted_candidates", "WITH c AS (SELECT user_id AS a, event_type AS b, max(value) / 100 AS score, count(*) AS hits FROM events GROUP BY ALL) SELECT a, b, hits FROM c WHERE score >= 0.9 AND hits >= 10 AND b <> 'error'")
def vetted(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("a"), F.col("event_type").alias("b")).agg((F.max("value") / 100).alias("score"), F.count("*").alias("hits"))
    return c.where("score >= 0.9 and hits >= 10 and b <> 'error'").select("a", "b", "hits")


@query("B1_B2_state", _LOC, edges=True)
def state(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "state")
    sinks.save_state(path, {"version": 1}, edges=_loc(spark, sf))
    return sinks.load_state(spark, path)[1]["edges"].select("src", "rel", "dst")


@query("B3_B4_snapshot", _LOC, edges=True)
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path, e = shared_path(spark, "snapshot"), _loc(spark, sf)
    sinks.save_snapshot(e, path)
    back = spark.read.schema(e.schema).json(path)
    return sinks.restore_snapshot(back, e.where(F.startswith("src", F.lit("customer:")))).select("src", "rel", "dst")


@query("B5_snapshot_diff", ", x AS (SELECT 1) SELECT src, rel, dst, CASE WHEN src LIKE 'customer:%' THEN 'removed' ELSE 'added' END AS change FROM edges WHERE rel = 'LOCATED_IN'", edges=True)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    e, old = _loc(spark, sf), F.startswith("src", F.lit("customer:"))
    return sinks.diff_snapshots(e.where(old), e.where(~old))


@query("B6_B7_write_ahead_log", _LOC, edges=True)
def wal(spark: SparkSession, sf: str) -> DataFrame:
    path, e = shared_path(spark, "wal"), _loc(spark, sf)
    sinks.append_log(e.select("src", "rel", "dst"), path)
    sinks.append_log(e.select("src", "rel", "dst"), path, "noop")
    return sinks.replay_log(spark.read.json(path), e.where("dst = 'nation:3'")).select("src", "rel", "dst")


@query("B8_B9_query_log", _SCORED + "SELECT split_part(entity, ':', 1) AS pattern, count(*) AS n FROM ans WHERE least(raw, 1) >= 0.9 GROUP BY 1", edges=True)
def query_log(spark: SparkSession, sf: str) -> DataFrame:
    log = sinks.query_log(_answers(spark, sf, "score"), 0.9).withColumn("pattern", F.split("entity", ":")[0])
    return sinks.patterns_of(log, "pattern")


@query("B13_B14_audit", _SCORED + "SELECT count(*) AS n, round(avg(least(raw, 1)), 5) AS mean, round(max(least(raw, 1)), 5) AS most FROM ans WHERE rank = 1", edges=True)
def audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf, "score", "path").where("rank = 1").select(sinks.audit_row(F.col("query_id"), F.col("entity"), F.col("score"), F.col("path")).alias("a")).select("a.*")
    return sinks.audit_statistics(rows).select("n", F.round("mean", 5).alias("mean"), F.round("most", 5).alias("most"))


@query("B16_B17_B18_ledger_rollback", ", x AS (SELECT 1) SELECT src, rel, dst FROM edges WHERE rel = 'LOCATED_IN' AND dst NOT LIKE '%3'", edges=True)
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = _loc(spark, sf)
    book = e.select("src", "rel", "dst", F.right("dst", F.lit(1)).cast("int").alias("cycle"))
    return sinks.rollback(e, book, "cycle = 3").select("src", "rel", "dst")


# ---------------------------------------------------------------- access, traversal, scores


@query("C12_first_edges", ", x AS (SELECT 1) SELECT src, rel, dst FROM edges WHERE rel = 'LOCATED_IN' ORDER BY src, dst LIMIT 100", edges=True)
def first_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _loc(spark, sf).select("src", "rel", "dst").orderBy("src", "dst").limit(100)


@query("C31_rank_by_centroid", "WITH p AS (SELECT label AS cid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT cid, list(x ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS x FROM p GROUP BY ALL) GROUP BY cid), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT cid, round(list_cosine_similarity(c, q), 5) AS score FROM m, q ORDER BY list_cosine_similarity(c, q) DESC, cid LIMIT 5")
def rank_centroids(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 7").first().embedding
    return A.rank_by_centroid(A.community_signatures(v), q, 5).withColumn("score", F.round("score", 5))


@query("D8_hop_stream", ", e AS (SELECT * FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN')), h1 AS (SELECT src AS id, dst FROM e WHERE src LIKE 'customer:%'), h2 AS (SELECT id, e.dst FROM h1 JOIN e ON h1.dst = e.src) SELECT 1 AS hop, count(*) AS paths FROM h1 UNION ALL SELECT 2, count(*) FROM h2", edges=True)
def hop_stream(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    counts = [(i + 1, b.count()) for i, b in enumerate(T.hops(seeds, edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"]), max_hop=2, width=5))]
    return spark.createDataFrame(counts, "hop int, paths bigint")


@query("D17_N5_federated_beam", ", e AS (SELECT * FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN')) SELECT b.dst AS tail, count(*) AS n FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'customer:%' GROUP BY 1", edges=True)
def federated_beam(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    one = FED.federated_union({"a": edge_view(spark, sf, ["LOCATED_IN"]), "b": edge_view(spark, sf, ["IN_REGION"])})
    e = one.select("src", "rel", "dst", F.lit(1.0).alias("weight"), "confidence", F.lit("").alias("provenance"), F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"))
    return T.beam(seeds, e, max_hop=2, width=5).where("size(path) = 5").groupBy("tail").agg(F.count("*").alias("n"))


@query("D25_reasoning_branches", None)
def reasoning_branches(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([(0, "nation:3")], "query_id int, id string")
    got = T.branches(seeds, edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"]), 2, 5)
    return got.select("query_id", F.to_json(F.struct("path", "score")).alias("json"))


@query("D16_L9_L10_L11_relation_detect", None)
def relation_detect(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text")
    rels = spark.createDataFrame([("of_the",), ("that_is",), ("in_nicht",)], "rel string")
    return L.detect_relations(q, rels, "tail").withColumn("part", F.lit("tail")).unionByName(L.detect_relations(q, rels, "head").withColumn("part", F.lit("head")))


@query("D19_coded_patterns", "WITH c AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS code FROM events GROUP BY event_type) SELECT event_id, code FROM events JOIN c USING (event_type)")
def coded(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    codes = L.frequency_codes(e, "event_type").select(F.col("value").alias("event_type"), F.col("code").cast("bigint").alias("code"))
    return e.join(F.broadcast(codes), "event_type").select("event_id", "code")  # a code per relation


@query("E27_decayed_prior", "SELECT event_id, round((value / 100 + 0.8::DOUBLE * 0.5 + 0.64::DOUBLE * 0.25) / (1 + 0.8::DOUBLE + 0.64::DOUBLE), 6) AS prior FROM events")
def decayed_prior(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", r6(S.decayed_mean(F.array(F.col("value") / 100, F.lit(0.5), F.lit(0.25)))).alias("prior"))


@query("E36_semantic_boost", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM v, q), m AS (SELECT min(s) AS lo, max(s) AS hi FROM s) SELECT vec_id, round(CASE WHEN s < 0.1 THEN 1 ELSE 1 + 2 * (s - lo) / (hi - lo) END, 5) AS boost FROM s, m")
def semantic_boost(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.functions.vectors import cosine

    v = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 7").first().embedding])
    s = v.select("vec_id", cosine(F.col("embedding"), q).alias("s"))
    m = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return s.crossJoin(m).select("vec_id", F.round(S.soft_boost(F.col("s"), F.col("lo"), F.col("hi"), 3.0, 0.1), 5).alias("boost"))


@query("E38_typed_hop_boost", ", b AS (SELECT split_part(src, ':', 1) AS cu, rel, count(*) AS n FROM edges WHERE split_part(dst, ':', 1) = 'supplier' GROUP BY ALL) SELECT cu, rel, round(1 + 0.5::DOUBLE * n / max(n) OVER (PARTITION BY cu), 6) AS boost FROM b", edges=True)
def typed_boost(spark: SparkSession, sf: str) -> DataFrame:
    b = edge_view(spark, sf).where(F.split("dst", ":")[0] == "supplier").groupBy(F.split("src", ":")[0].alias("cu"), "rel").agg(F.count("*").alias("n"))
    return b.select("cu", "rel", r6(1 + 0.5 * F.col("n") / F.max("n").over(Window.partitionBy("cu"))).alias("boost"))


@query("O9_uniform_scorer", "SELECT event_id, 0.5::DOUBLE AS weight FROM events")
def uniform_scorer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.lit(0.5).alias("weight"))


# ---------------------------------------------------------------- answers


@query("F2_answer_conflicts", _SCORED + """, b AS (SELECT query_id, tail AS entity, path FROM s QUALIFY row_number() OVER (PARTITION BY query_id, tail ORDER BY ps DESC, array_to_string(path, '|')) = 1),
r AS (SELECT DISTINCT query_id, rank, entity, unnest(list_filter(path, lambda x, i: i % 2 = 0)) AS rel FROM ans JOIN b USING (query_id, entity))
SELECT DISTINCT x.query_id, x.entity, y.entity AS entity2, x.rel, y.rel AS other FROM r x JOIN r y ON x.query_id = y.query_id AND x.rank < y.rank
WHERE (x.rel = 'CONTAINS' AND y.rel = 'PLACED_BY') OR (x.rel = 'PLACED_BY' AND y.rel = 'CONTAINS')""", edges=True)
def answer_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    opposing = spark.createDataFrame([("CONTAINS", "PLACED_BY"), ("PLACED_BY", "CONTAINS")], "a string, b string")
    return N.answer_conflicts(_answers(spark, sf, "rels"), opposing)


@query("F3_robustness_rerank", _SCORED + "SELECT query_id, entity, round(least(raw, 1) * (1 + 0.2::DOUBLE * (1 - CASE WHEN entity LIKE 'region:%' THEN 0.5::DOUBLE ELSE 0 END)), 5) AS score FROM ans", edges=True)
def robustness(spark: SparkSession, sf: str) -> DataFrame:
    ans = _answers(spark, sf, "score")
    deltas = ans.where(F.startswith("entity", F.lit("region:"))).select("query_id", "entity", F.lit(0.5).alias("delta"))
    return N.robustness_rerank(ans, deltas).select("query_id", "entity", F.round("score", 5).alias("score"))


@query("F10_escalation", _SCORED + ", l AS (SELECT *, lead(least(raw, 1)) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM ans), m AS (SELECT query_id, (least(raw, 1) - coalesce(nxt, 0)) / least(raw, 1) AS margin FROM l WHERE rank = 1) SELECT CASE WHEN margin >= 0.02::DOUBLE THEN 1 ELSE 2 END AS level, count(*) AS n FROM m GROUP BY 1", edges=True)
def escalation(spark: SparkSession, sf: str) -> DataFrame:
    ans = _answers(spark, sf, "score", "consensus", "branches", "uncertainty")
    return N.escalate([ans, ans], 0.02).where("rank = 1").groupBy("level").agg(F.count("*").alias("n"))


@query("F22_direct_answers", ", d AS (SELECT o_orderkey AS query_id, dst AS entity, count(DISTINCT rel) AS kinds FROM orders JOIN edges ON src = 'order:' || o_orderkey WHERE rel IN ('PLACED_BY', 'CONTAINS', 'FULFILLED_BY') GROUP BY ALL) SELECT query_id, entity, round(0.1::DOUBLE * (1 + 0.1::DOUBLE * ln(kinds)), 6) AS score FROM d", edges=True)
def direct_answers(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], "query_id bigint, entity string, score double")
    got = N.with_direct(none, _seeds(spark, sf), edge_view(spark, sf, ["PLACED_BY", "CONTAINS", "FULFILLED_BY"]))
    return got.withColumn("score", r6(F.col("score")))


# ---------------------------------------------------------------- analytics


def _small(spark: SparkSession, sf: str) -> DataFrame:
    return edge_view(spark, sf, ["IN_REGION", "LOCATED_IN", "EVENTS"])


@query("G6_G7_G9_louvain", None)
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    e = _small(spark, sf)
    start = G.label_propagation(e, 2).select("id", F.col("label").alias("cid"))
    return G.louvain(e, start, 2, 4)


@query("G13_resolution_search", None)
def resolution_search(spark: SparkSession, sf: str) -> DataFrame:
    best = G.resolution_search(edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"]), 20, 2)
    return spark.createDataFrame([best], "resolution double, communities bigint")


@query("G15_query_merge", "WITH p AS (SELECT label AS cid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT cid, list(x ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS x FROM p GROUP BY ALL) GROUP BY cid), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), n AS (SELECT cid, round(list_cosine_similarity(c, q), 9) AS s FROM m, q WHERE round(list_cosine_similarity(c, q), 9) >= 0.0 ORDER BY s DESC, cid LIMIT 3), b AS (SELECT cid AS best FROM n ORDER BY s DESC, cid LIMIT 1) SELECT vec_id AS id, CASE WHEN label IN (SELECT cid FROM n) THEN best ELSE label END AS cid FROM embeddings, b")
def query_merge(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 7").first().embedding
    return G.query_merge(v.select(F.col("vec_id").alias("id"), F.col("label").alias("cid")), A.community_signatures(v), q, 3, 0.0)


@query("G19_feature_projection", ", s AS (SELECT * FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN') OR src LIKE 'user:%'), d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s) GROUP BY id) SELECT id, round(d / (max(d) OVER ())::DOUBLE * ((12345 % 2001) / 1000.0::DOUBLE - 1), 6) AS first, round(d / (max(d) OVER ())::DOUBLE * (((7 * 40503 + 12345) % 2001) / 1000.0::DOUBLE - 1), 6) AS last FROM d", edges=True)
def feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    got = G.project_features(A.degrees(_small(spark, sf)), ["degree"], 8)
    return got.select("id", r6(F.col("v")[0]).alias("first"), r6(F.col("v")[7]).alias("last"))


@query("G29_P5_component_bridges", None)
def component_bridges(spark: SparkSession, sf: str) -> DataFrame:
    e = _loc(spark, sf)
    return G.component_bridges(e, K.seeded_vectors(nodes_of(e), 8), 2, -1.0, 50)


@query("G32_partial_rebalance", None)
def partial_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    e = _small(spark, sf)
    c = materialize(nodes_of(e).select("id", F.col("type").alias("cid")), "types")
    return G.partial_rebalance(e, c, spark.createDataFrame([("user",), ("k",)], "cid string"))


_NEAR = """, u AS (SELECT src, dst FROM edges WHERE rel = 'LOCATED_IN' UNION SELECT dst, src FROM edges WHERE rel = 'LOCATED_IN'), c AS (SELECT DISTINCT src AS id, split_part(src, ':', 1) || right(src, 1) AS cid FROM u),
near AS (SELECT 'supplier:3' AS id UNION SELECT dst FROM u WHERE src = 'supplier:3' UNION SELECT y.dst FROM u x JOIN u y ON x.dst = y.src WHERE x.src = 'supplier:3'),
s AS (SELECT src, dst FROM edges WHERE rel = 'LOCATED_IN' AND src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near))"""


@query("M13_M14_incremental_communities", _NEAR + _lpa_sql(3, "SELECT id, cid AS label FROM c JOIN near USING (id)") + " SELECT id, coalesce(label, cid) AS cid FROM c LEFT JOIN l3 USING (id)", edges=True)
def incremental(spark: SparkSession, sf: str) -> DataFrame:
    e = _loc(spark, sf)
    c = materialize(_kinds(e), "old")
    return G.incremental_communities(e, c, spark.createDataFrame([("supplier:3",)], "id string"), 2)


@query("G30_quality_drift", ", s AS (SELECT * FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN')), p AS (SELECT split_part(src, ':', 1) AS cu, split_part(dst, ':', 1) AS cv FROM s), m AS (SELECT count(*) AS m FROM p), i AS (SELECT cu AS cid, count(*) AS n FROM p WHERE cu = cv GROUP BY cu), e AS (SELECT cid, count(*) AS d FROM (SELECT cu AS cid FROM p UNION ALL SELECT cv FROM p) GROUP BY cid) SELECT sum(coalesce(n, 0) / m::DOUBLE - pow(d / (2.0::DOUBLE * m), 2)) < 0.1 AS rerun FROM e LEFT JOIN i USING (cid), m", edges=True)
def drift(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"])
    return G.modularity(e, nodes_of(e).select("id", F.col("type").alias("cid"))).select((F.col("q") < 0.1).alias("rerun"))


# ---------------------------------------------------------------- discovery and maintenance


@query("J5_J11_J40_materialise_findings", ", f AS (SELECT DISTINCT a.src, 'SOLD_IN' AS rel, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'PLACED_BY' AND b.rel = 'LOCATED_IN') SELECT rel, count(*) AS n FROM (SELECT src, rel, dst FROM edges WHERE rel IN ('PLACED_BY', 'LOCATED_IN') UNION ALL SELECT * FROM f) GROUP BY rel", edges=True)
def materialise(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.rules import composition_rule

    e = edge_view(spark, sf, ["PLACED_BY", "LOCATED_IN"])
    return J.materialise_findings(e, composition_rule(e, "PLACED_BY", "LOCATED_IN", "SOLD_IN")).groupBy("rel").agg(F.count("*").alias("n"))


@query("J6_candidate_mining", "WITH a AS (SELECT user_id AS a, user_id + 1 AS b, value / 100 AS score, 'near' AS finder FROM events UNION ALL SELECT user_id + 1, user_id, value / 200, 'far' FROM events), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score, count(DISTINCT finder) AS finders FROM a GROUP BY 1, 2) SELECT a, b, round(score, 6) AS score, finders FROM p ORDER BY p.score DESC, a, b LIMIT 20")
def mining(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    near = e.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"), (F.col("value") / 100).alias("score"))
    far = e.select((F.col("user_id") + 1).alias("a"), F.col("user_id").alias("b"), (F.col("value") / 200).alias("score"))
    return J.mine_candidates({"near": near, "far": far}, 20).select("a", "b", r6(F.col("score")).alias("score"), "finders")


@query("J15_triangulation", "WITH f AS (SELECT user_id AS s, user_id + 1 AS t, max(value) / 100 AS c FROM events GROUP BY ALL) SELECT s AS source, t AS target, round(0.5::DOUBLE * c + 0.3::DOUBLE * c + 0.2::DOUBLE * 0.5, 6) AS score, 0.5::DOUBLE * c + 0.3::DOUBLE * c + 0.2::DOUBLE * 0.5 >= 0.5 AS bridge FROM f")
def triangulation(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").groupBy(F.col("user_id").alias("source"), (F.col("user_id") + 1).alias("target")).agg((F.max("value") / 100).alias("confidence"))
    b = f.select(F.col("target").alias("source"), F.col("source").alias("target"), "confidence")
    return J.triangulate(f, b, f.select("source", "target", F.lit(0.5).alias("agree"))).withColumn("score", r6(F.col("score")))


@query("J20_J32_ttl_prune", "SELECT event_id FROM events WHERE 1706659200.0::DOUBLE - epoch(ts) <= 864000")
def ttl_prune(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.graph import epoch

    return J.ttl_prune(table(spark, sf, "events").select("event_id", epoch(F.col("ts")).alias("at")), 1706659200.0, 864000.0).select("event_id")


@query("J26_rem_rollback", _LOC, edges=True)
def rem_rollback(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.rules import rollback

    e = _loc(spark, sf)
    added = e.select(F.col("dst").alias("src"), F.lit("REM").alias("rel"), F.col("src").alias("dst")).distinct()
    return rollback(e.select("src", "rel", "dst").unionByName(added), added)


@query("J34_boundary_scan", "WITH v AS (SELECT vec_id AS id, label AS cid, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.cid AS cu, b.cid AS cv, a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON b.cid = a.cid + 1) SELECT cu, cv, a, b, round(score * 0.7::DOUBLE, 5) AS potential FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY cu, cv ORDER BY score DESC, a, b) <= 3")
def boundary_scan(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cid"), F.col("embedding").alias("v"))
    pairs = v.select(F.col("cid").alias("cu"), (F.col("cid") + 1).alias("cv")).distinct()
    got = J.boundary_scan(v, pairs, 0.0)
    return got.select("cu", "cv", "a", "b", F.round("potential", 5).alias("potential"))


@query("J36_meta_insight", "SELECT c_custkey AS finding, min(c_custkey) OVER (PARTITION BY c_nationkey) AS thread FROM customer")
def meta_insight(spark: SparkSession, sf: str) -> DataFrame:
    return J.finding_threads(table(spark, sf, "customer").select(F.col("c_custkey").alias("finding"), F.col("c_nationkey").alias("node")))


@query("J37_J44_maintenance_cycle", ", u AS (SELECT src, rel, dst, count(*) AS uses FROM edges WHERE src LIKE 'user:%' GROUP BY ALL) SELECT e.src, e.rel, e.dst, e.confidence, round(weight + 0.1::DOUBLE * (1 - uses / (uses + 5.0::DOUBLE)) * (1 - weight), 6) AS weight FROM edges e JOIN u USING (src, rel, dst) WHERE confidence >= 0.6 AND 1706659200.0::DOUBLE - valid_to <= 864000", edges=True)
def maintenance(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["EVENTS"])
    uses = e.groupBy("src", "rel", "dst").agg(F.count("*").alias("uses"))
    return J.maintenance(e, uses, 0.6, 1706659200.0, 864000.0).select("src", "rel", "dst", "confidence", r6(F.col("weight")).alias("weight"))


@query("J41_J42_self_audit", ", p AS (SELECT src, rel, dst, count(*) AS n FROM edges GROUP BY ALL) SELECT (SELECT count(*) FROM edges WHERE confidence < 0.5) AS weak, (SELECT count(*) FROM edges WHERE provenance IN ('', 'triples', 'manual', 'unknown')) AS unsourced, (SELECT count(*) FROM edges WHERE 1706659200.0::DOUBLE - coalesce(valid_to, valid_from) > 864000) AS stale, (SELECT count(*) FROM edges WHERE src = dst) AS loops, (SELECT count(*) FROM p WHERE n > 1) AS duplicated", edges=True)
def self_audit(spark: SparkSession, sf: str) -> DataFrame:
    return J.self_audit(edge_view(spark, sf), 1706659200.0, 864000.0)


@query("L24_session_potentiation", "WITH t AS (SELECT conv_id, 'conv' AS src, 'SAID' AS rel, role AS dst, turn % 2 = 1 AS f FROM conversations), g AS (SELECT conv_id FROM t GROUP BY conv_id HAVING count(*) >= 4 AND avg(CASE WHEN f THEN 1.0 ELSE 0 END) >= 0.3) SELECT dst, round(least(greatest(1 + 0.01::DOUBLE * count(*), 0), 10), 6) AS weight FROM t JOIN g USING (conv_id) GROUP BY dst")
def potentiation(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.lit("conv").alias("src"), F.lit("SAID").alias("rel"), F.col("role").alias("dst"), (F.col("turn") % 2 == 1).alias("follow_up"))
    edges = turns.select("src", "rel", "dst").distinct().withColumn("weight", F.lit(1.0))
    return J.potentiate_sessions(edges, turns, 0.01, 4, 0.3).where("weight <> 1.0").select("dst", r6(F.col("weight")).alias("weight"))


# ---------------------------------------------------------------- embeddings and streams


@query("K2_O2_encode", "SELECT p_partkey, length(p_name)::DOUBLE AS first FROM part")
def encode(spark: SparkSession, sf: str) -> DataFrame:
    def lengths(texts):
        return [[len(t), 1.0] for t in texts]

    return table(spark, sf, "part").select("p_partkey", L.encode(F.col("p_name"), lengths, 2)[0].alias("first"))


@query("K5_rotation_distance", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(e[i] * cos(0.5::DOUBLE) - e[i + 32] * sin(0.5::DOUBLE) - e[i], 2) + pow(e[i] * sin(0.5::DOUBLE) + e[i + 32] * cos(0.5::DOUBLE) - e[i + 32], 2)))), 5) AS d FROM v")
def rotation(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    phase = F.array(*[F.lit(0.5)] * 32)
    return table(spark, sf, "embeddings").select("vec_id", F.round(K.rotation_distance(e, phase, e), 5).alias("d"))


@query("K10_K12_community_updates", "SELECT label AS cid, round(0.4::DOUBLE + 0.1::DOUBLE * avg(embedding[1]::DOUBLE), 5) AS alpha FROM embeddings GROUP BY label")
def community_updates(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return v.groupBy(F.col("label").alias("cid")).agg(F.round(0.4 + 0.1 * F.avg(F.col("embedding")[0].cast("double")), 5).alias("alpha"))


@query("M9_M23_M24_batch_merge", "SELECT event_type AS rel, count(*) AS n FROM events GROUP BY event_type")
def batch_merge(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.plans.text_queries import _stream
    from graphloom.streaming.events import merge_into

    path = shared_path(spark, "live")
    q = _stream(spark, sf).writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).groupBy("rel").agg(F.count("*").alias("n"))


@query("M2_O4_callback_source", "SELECT unnest(['a', 'b']) AS src, unnest([3, 3]) AS n")
def callback_source(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.streaming.events import register_callback_source, run_to_end

    def produce(batch: int) -> list[tuple]:
        return [("a" if i % 2 else "b", i) for i in range(6)] if batch == 0 else []

    register_callback_source(spark, "callback_rows", produce, "src string, i int")
    rows = run_to_end(spark.readStream.format("callback_rows").load(), "m2_callback_rows")
    return rows.groupBy("src").agg(F.count("*").cast("int").alias("n"))


@query("N8_masked_search", "SELECT 'b' AS source, 'part:' || p_partkey AS id, 'part' AS type, round(p_retailprice, 2) AS score FROM part ORDER BY p_retailprice DESC, 'part:' || p_partkey LIMIT 5")
def masked_search(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("type"), F.col("p_retailprice").alias("score"))
    return FED.masked_search({"a": p.where("false"), "b": p}, 5).withColumn("score", F.round("score", 2))


# ---------------------------------------------------------------- public API


@query("P1_P8_build_and_stats", ", n AS (SELECT src AS id FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN') UNION SELECT dst FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN')) SELECT (SELECT count(*) FROM edges WHERE rel IN ('IN_REGION', 'LOCATED_IN')) AS edges, 2 AS relations, count(*) AS nodes FROM n", edges=True)
def build_and_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"])).build(2)
    return g.stats().withColumn("relations", F.col("relations").cast("int"))


@query("P2_P3_P7_query", None)
def api_query(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(edge_view(spark, sf, ["IN_REGION", "LOCATED_IN"])).build(2)
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return g.query(seeds, 3).select("query_id", "rank", "entity", r6(F.col("score")).alias("score"))


@query("P4_O3_complete", ", x AS (SELECT rel, src, dst FROM edges WHERE rel = 'IN_REGION' UNION ALL SELECT 'HOLDS', dst, src FROM edges WHERE rel = 'IN_REGION') SELECT rel, src, dst FROM x", edges=True)
def api_complete(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.rules import inverse_rule

    g = Graph(edge_view(spark, sf, ["IN_REGION"])).complete(lambda e: inverse_rule(e, "IN_REGION", "HOLDS"))
    return g.edges.select("rel", "src", "dst")


@query("P6_ask", "SELECT 1 AS rank, 'region:' || n_regionkey AS entity, 'nation:3 in region region:' || n_regionkey || ' (1.00).' AS said FROM nation WHERE n_nationkey = 3")
def api_ask(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph(edge_view(spark, sf, ["IN_REGION"])).build(2)
    return g.ask("Where is nation 3?").select("rank", "entity", "said")


@query("R9_one_shot", "SELECT event_id, CASE WHEN value / 100 >= 0.8 AND event_id % 7 = 0 THEN 5.0::DOUBLE ELSE 1.0 END AS factor FROM events")
def one_shot(spark: SparkSession, sf: str) -> DataFrame:
    affinity = F.when(F.col("event_id") % 7 != 0, F.lit(1.0))
    return table(spark, sf, "events").select("event_id", R.one_shot(affinity, F.col("value") / 100).alias("factor"))
