"""Queries of text, streams, federation, embeddings, baselines and supporting state (L, M, N, K, Q, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as L
from graphloom.graph import edge_view, epoch, nodes_of, table
from graphloom.operators import baselines as Q
from graphloom.operators import embedding as K
from graphloom.operators import federation as N
from graphloom.operators import support as R
from graphloom.plans.registry import query
from graphloom.streaming import events as M


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- text

_QUESTIONS = "q AS (SELECT doc_id AS query_id, text FROM documents)"


@query("L3_relation_extraction", "WITH w AS (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS keyword FROM documents), n AS (SELECT * FROM (VALUES ('R1', 'the'), ('R1', 'of'), ('R2', 'der'), ('R2', 'die'), ('R3', 'le'), ('R3', 'the')) t(rel, keyword)), h AS (SELECT query_id, rel, count(*) AS hits FROM w JOIN n USING (keyword) GROUP BY ALL) SELECT query_id, rel, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, rel) AS rank FROM h QUALIFY rank <= 2")
def relation_extraction(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("R1", "the"), ("R1", "of"), ("R2", "der"), ("R2", "die"), ("R3", "le"), ("R3", "the")], "rel string, keyword string")
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return L.extract_relations(q, names, 2).withColumn("rank", F.col("rank").cast("bigint"))


_HOPS = r"CASE WHEN regexp_extract(low, '([0-9]+)[- ]hop', 1) <> '' THEN TRY_CAST(regexp_extract(low, '([0-9]+)[- ]hop', 1) AS INT) WHEN regexp_extract(low, '(one|two|three|four)[- ]hop', 1) <> '' THEN list_position(['one', 'two', 'three', 'four'], regexp_extract(low, '(one|two|three|four)[- ]hop', 1)) WHEN regexp_matches(low, '\bof the\b[^\n\r]*\bof the\b') THEN 3 WHEN n > 12 OR contains(low, 'of the') THEN 2 ELSE 1 END::INT"


@query("L4_L5_L1_question_parse", f"SELECT conv_id, turn, {_HOPS} AS hops, coalesce(map_extract(MAP {{'who': 'person', 'whom': 'person', 'where': 'place', 'when': 'time', 'why': 'reason', 'how': 'manner', 'which': 'choice', 'what': 'thing'}}, regexp_extract(low, '^[^a-z0-9_]*([a-z0-9_]+)', 1))[1], 'other') AS kind FROM (SELECT *, lower(coalesce(text, '')) AS low, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n FROM conversations)")
def question_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", L.infer_hops(F.col("text")).alias("hops"), L.question_type(F.col("text")).alias("kind"))


@query("L6_question_keywords", "SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'are', 'was', 'were', 'for', 'with', 'that', 'this')))) AS n FROM conversations")
def question_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(L.keywords(F.col("text"))).cast("bigint").alias("n"))


@query("L2_entity_link", "WITH w AS (SELECT doc_id AS query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS line FROM documents), l AS (SELECT * FROM (VALUES (1, 'of the'), (2, 'the'), (3, 'mit license'), (4, 'the of')) t(id, label)) SELECT query_id, id, label FROM w JOIN l ON contains(line, ' ' || label || ' ') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(label) DESC, id) = 1")
def entity_link(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.createDataFrame([(1, "of the"), (2, "the"), (3, "MIT License"), (4, "the of")], "id int, label string")
    return L.link_entities(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text"), labels)


@query("L7_L8_relation_names", "WITH e AS (SELECT DISTINCT event_type || '_of.' || event_type || '_item' AS rel, event_type FROM events) SELECT rel, round(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.2 ELSE 0 END, 6) AS score FROM e")
def relation_names(spark: SparkSession, sf: str) -> DataFrame:
    rels = table(spark, sf, "events").select(F.concat("event_type", F.lit("_of."), "event_type", F.lit("_item")).alias("rel")).distinct()
    score = L.relation_name_score(F.col("rel"), F.lit("Who made the first click and saw it?"), {"view": ["saw"]})
    return rels.select("rel", r6(score).alias("score"))


@query("L12_sentence_split", "SELECT doc_id, len(regexp_extract_all(text, '[.!?][ \\t\\n\\x0B\\f\\r]+[^ \\t\\n\\x0B\\f\\r]')) + CASE WHEN trim(text, chr(32) || chr(10) || chr(9) || chr(13)) = '' THEN 0 ELSE 1 END AS n FROM documents")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(L.sentences(F.col("text"))).cast("bigint").alias("n"))


@query("L13_known_mentions", "SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:Apache License|MIT License|License)\\b')) AS n FROM documents")
def known_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(L.known_mentions(F.col("text"), ["License", "MIT License", "Apache License"])).cast("bigint").alias("n"))


@query("L14_cap_mentions", "SELECT doc_id, len(m) AS n, m[1] AS first FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][A-Za-z]+(?:[ \\t\\n\\x0B\\f\\r]+[A-Z][A-Za-z]+)*') AS m FROM documents)")
def cap_mentions(spark: SparkSession, sf: str) -> DataFrame:
    m = L.capital_mentions(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").cast("bigint").alias("n"), F.try_element_at("m", F.lit(1)).alias("first"))


@query("L15_L16_verb_relation", "WITH e AS (SELECT DISTINCT event_type FROM events) SELECT event_type, CASE WHEN starts_with(event_type, 'pur') THEN 'BOUGHT' WHEN starts_with(event_type, 'cli') THEN 'TOUCHED' ELSE 'RELATED_TO' END AS rel FROM e")
def verb_relation(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type").distinct()
    verb = L.verb_phrase(F.concat(F.lit(" has been the "), "event_type", F.lit(" of")))
    return e.select("event_type", L.verb_relation(verb, {"pur": "BOUGHT", "cli": "TOUCHED"}).alias("rel"))


@query("L18_sliding_chunks", "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 WHEN length(text) <= 200 THEN 1 ELSE 1 + (length(text) - 50 - 1) // 150 END AS n, CASE WHEN length(text) > 0 THEN right(text, 20) END AS tail FROM documents")
def sliding_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", L.sliding_chunks(F.coalesce("text", F.lit("")), 200, 50).alias("c"))
    return d.select("doc_id", F.size("c").cast("bigint").alias("n"), F.right(F.try_element_at("c", F.lit(-1)), F.lit(20)).alias("tail"))


# The state of the fold: length of the open chunk, number and greatest length of those done.
@query("L17_sentence_chunks", r"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend([0, 0, 0]::BIGINT[], list_transform(s, lambda x: [length(x), 0, 0]::BIGINT[])), lambda a, x: CASE WHEN a[1] = 0 THEN [x[1], a[2], a[3]] WHEN a[1] + 1 + x[1] <= 400 THEN [a[1] + 1 + x[1], a[2], a[3]] ELSE [x[1], a[2] + 1, greatest(a[3], a[1])] END) AS a FROM t)
SELECT doc_id, a[2] + CASE WHEN a[1] > 0 THEN 1 ELSE 0 END AS n, CASE WHEN a[1] > 0 THEN greatest(a[3], a[1]) END AS longest FROM f""")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = L.sentence_chunks(F.col("text"), 400)
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("bigint").alias("n"), F.array_max(F.transform("c", F.length)).cast("bigint").alias("longest"))


@query("L19_L20_ensemble_merge", "SELECT user_id::VARCHAR AS src, event_type AS rel, json_extract_string(props, '$.k') AS dst, round(CASE WHEN count(DISTINCT event_id % 3) >= 2 THEN least(max(value / 200) + 0.1::DOUBLE, 1) ELSE max(value / 200) END, 6) AS confidence, count(DISTINCT event_id % 3) AS backends FROM events GROUP BY ALL")
def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").alias("dst"), (F.col("value") / 200).alias("confidence"), (F.col("event_id") % 3).alias("backend"))
    return L.merge_ensemble(t).withColumn("confidence", r6(F.col("confidence")))


@query("L21_fuzzy_label", "WITH p AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substring(lower(p_name), i::INT, 2))) AS g FROM part), q AS (SELECT list_distinct(list_transform(range(1, length('part 77 x')), lambda i: substring('part 77 x', i::INT, 2))) AS g) SELECT p_partkey, round(len(list_intersect(p.g, q.g)) / len(list_distinct(list_concat(p.g, q.g)))::DOUBLE, 6) AS score FROM p, q")
def fuzzy_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", r6(L.bigram_similarity(F.col("p_name"), F.lit("part 77 x"))).alias("score"))


@query("L22_L26_parse_triples", "SELECT event_id, 'u' || user_id AS src, event_type AS rel, 'k' || json_extract_string(props, '$.k') AS dst FROM events UNION ALL SELECT event_id, 'u' || user_id, event_type, 'k' || json_extract_string(props, '$.k') FROM events")
def parse_triples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("s"), F.col("event_type").alias("r"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("o"))
    one = e.select("event_id", F.explode(L.parse_linearised(F.concat(F.lit("<triplet> "), "s", F.lit(" <subj> "), "o", F.lit(" <obj> "), "r"))).alias("t"))
    two = e.select("event_id", F.explode(L.parse_pipes(F.concat("s", F.lit(" | "), "r", F.lit(" | "), "o", F.lit("\nnot a triple")))).alias("t"))
    return one.unionByName(two).select("event_id", "t.src", "t.rel", "t.dst")


@query(
    "L23_conversation_turns",
    "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['it', 'he', 'she', 'they', 'him', 'her', 'them', 'its', 'his', 'their']) AS refers, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 AS repeated FROM conversations",
)
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    return L.previous_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "previous", "refers", "repeated")


@query("L25_utterance_graph", "SELECT 'turn:' || conv_id || ':' || turn AS src, 'SAID_BY' AS rel, 'role:' || role AS dst FROM conversations UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'FOLLOWS', 'turn:' || conv_id || ':' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations QUALIFY lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL")
def utterances(spark: SparkSession, sf: str) -> DataFrame:
    return L.utterance_edges(table(spark, sf, "conversations"))


@query("L27_frequency_codes", ", x AS (SELECT rel AS value, count(*) AS n FROM edges GROUP BY rel) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS code FROM x", edges=True)
def frequency_codes(spark: SparkSession, sf: str) -> DataFrame:
    return L.frequency_codes(edge_view(spark, sf), "rel").withColumn("code", F.col("code").cast("bigint"))


@query("A31_A32_text_triples", None)
def text_triples(spark: SparkSession, sf: str) -> DataFrame:
    return L.triples_of(table(spark, sf, "documents"), {"auth": "AUTHORED", "licens": "LICENSED"})


# ---------------------------------------------------------------- streams


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").alias("dst"), F.col("ts").cast("timestamp").alias("ts"), "value", F.when(F.col("event_id") % 10 == 0, -1.0).otherwise(F.col("value") * 1000).alias("ttl"))


LABELS = ["click", "error", "purchase", "signup", "view"]


@query("M16_threshold_states", "WITH s AS (SELECT event_id AS id, user_id, ts, CASE WHEN value >= 90 THEN 'SPIKE' WHEN value >= 60 THEN 'HIGH' WHEN value < 10 THEN 'LOW' ELSE 'NORMAL' END AS state FROM events) SELECT id, state FROM s QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY ts, id)")
def threshold_states(spark: SparkSession, sf: str) -> DataFrame:
    return M.states(_events(spark, sf), 10, 60, 90).select("id", "state")


@query("M17_bins", "SELECT event_id AS id, least(greatest(floor((value - 0) / (100.0::DOUBLE / 8)), 0), 7)::INT AS bin FROM events")
def bins(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("id", M.bin_of(F.col("value"), 0.0, 100.0, 8).alias("bin"))


@query("M18_co_occurrence", "WITH o AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS frames FROM o a JOIN o b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def co_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return M.co_occurrence(_events(spark, sf), "src", "rel")


@query("M19_precedes", "WITH s AS (SELECT event_type AS rel, lead(event_type) OVER w AS next, epoch(lead(ts) OVER w) - epoch(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT rel, next, count(*) AS n FROM s WHERE next IS NOT NULL AND gap <= 20000 GROUP BY ALL")
def precedes(spark: SparkSession, sf: str) -> DataFrame:
    return M.precedes(_events(spark, sf), 20000)


_FIRES = "WITH l AS (SELECT user_id, event_type AS post, epoch(ts) AS t, " + ", ".join(f"last_value(CASE WHEN event_type = '{x}' THEN epoch(ts) END IGNORE NULLS) OVER w AS f{i}" for i, x in enumerate(LABELS)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), f AS (" + " UNION ALL ".join(f"SELECT '{x}' AS pre, post, t - f{i} AS dt FROM l WHERE f{i} IS NOT NULL AND post <> '{x}'" for i, x in enumerate(LABELS)) + ")"


@query("M20_co_activation", _FIRES + " SELECT pre, post, count(*) AS n FROM f WHERE dt <= 3600 GROUP BY ALL HAVING count(*) >= 3")
def co_activation(spark: SparkSession, sf: str) -> DataFrame:
    return M.co_activation(_events(spark, sf), LABELS, 3600.0, 3)


@query("M21_stdp", _FIRES + ", g AS (SELECT pre, post, sum(exp(-dt / 3600.0::DOUBLE)) AS x, count(*) AS n FROM f WHERE dt <= 14400 GROUP BY ALL) SELECT a.pre, a.post, a.n, round(0.1::DOUBLE * a.x - 0.12::DOUBLE * coalesce(b.x, 0), 5) AS weight FROM g a LEFT JOIN g b ON a.pre = b.post AND a.post = b.pre")
def stdp(spark: SparkSession, sf: str) -> DataFrame:
    return M.spike_timing(_events(spark, sf), LABELS, theta=-1e9).withColumn("weight", F.round("weight", 5))


@query("M22_uniformity", "WITH b AS (SELECT user_id, least(greatest(floor((epoch(ts) - 1704000000.0::DOUBLE) / 300000.0::DOUBLE), 0), 9)::INT AS bin FROM events), g AS (SELECT user_id, bin, count(*) AS n FROM b GROUP BY ALL) SELECT 'user:' || user_id AS src, sum(n)::BIGINT AS total, round(sum(n * n) * 10 / sum(n)::DOUBLE - sum(n), 6) AS chi2 FROM g GROUP BY user_id")
def uniformity(spark: SparkSession, sf: str) -> DataFrame:
    return M.uniformity(_events(spark, sf), 10, 1704000000.0, 1707000000.0).withColumn("chi2", r6(F.col("chi2")))


@query("M10_M12_alive_edges", "SELECT 'user:' || user_id AS src, event_type AS rel, json_extract_string(props, '$.k') AS dst, count(*) AS refs FROM events WHERE (event_id % 10 = 0 OR epoch(ts) + value * 1000 >= 1704900000) AND epoch(ts) <= 1704900000 GROUP BY ALL")
def alive(spark: SparkSession, sf: str) -> DataFrame:
    return M.alive_at(_events(spark, sf), F.lit(1704900000.0), 3600.0).select("src", "rel", "dst", "refs")


@query("M11_live_edges", "SELECT make_timestamp((floor(epoch(ts) / 21600) * 21600 * 1000000)::BIGINT) AS start, 'user:' || user_id AS src, event_type AS rel, json_extract_string(props, '$.k') AS dst, count(*) AS n FROM events GROUP BY ALL")
def live_edges(spark: SparkSession, sf: str) -> DataFrame:
    return M.live_edges(_events(spark, sf), "6 hours").select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "src", "rel", "dst", "n")


@query("M10_sliding_window_counts", "WITH o AS (SELECT unnest([0, 1]) AS k) SELECT rel, count(*) AS windows, sum(n)::BIGINT AS n FROM (SELECT event_type AS rel, floor(epoch(ts) / 10800) - k AS w, user_id, json_extract_string(props, '$.k') AS kk, count(*) AS n FROM events, o GROUP BY ALL) GROUP BY rel")
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    return M.live_edges(_events(spark, sf), "6 hours", "3 hours").groupBy("rel").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


_SESSIONS = "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT 'user:' || user_id AS src, count(*) AS n FROM s GROUP BY user_id, sid"


@query("M11_session_edges", _SESSIONS)
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return M.session_edges(_events(spark, sf), "6 hours").select("src", "n")


@query("M15_rates", "SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM events GROUP BY 1")
def rates(spark: SparkSession, sf: str) -> DataFrame:
    got = M.rates(_events(spark, sf), 3600)
    return got.select(F.expr("unix_seconds(start) div 3600").alias("hour"), F.round("rate", 9).alias("rate"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").alias("dst"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("M1_M8_stream_counts", "SELECT event_type AS rel, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.run_to_end(_stream(spark, sf).groupBy("rel").agg(F.count("*").alias("n")), "m1_stream_counts", "complete")


@query("M11_stream_live_edges", "SELECT count(*) AS edges, sum(n)::BIGINT AS n FROM (SELECT floor(epoch(ts) / 21600) AS w, user_id, event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL)")
def stream_live(spark: SparkSession, sf: str) -> DataFrame:
    got = M.run_to_end(M.live_edges(_stream(spark, sf), "6 hours", late="400 days"), "m11_stream_live", "update")
    return got.agg(F.count("*").alias("edges"), F.sum("n").alias("n"))


@query("M21_stream_stdp", _FIRES + " SELECT pre, post, count(*) AS n, round(0.1::DOUBLE * sum(exp(-dt / 3600.0::DOUBLE)), 5) AS weight FROM f WHERE dt <= 14400 GROUP BY ALL")
def stream_stdp(spark: SparkSession, sf: str) -> DataFrame:
    got = M.run_to_end(M.spike_timing_stream(_stream(spark, sf)), "m21_stream_stdp")
    return got.groupBy("pre", "post").agg(F.sum("n").alias("n"), F.round(F.sum("weight"), 5).alias("weight"))


# ---------------------------------------------------------------- federation


@query("C26_C27_N7_federated_union", "WITH c AS (SELECT DISTINCT 'nation:' || c_nationkey AS dst FROM customer), s AS (SELECT DISTINCT 'nation:' || s_nationkey AS dst FROM supplier) SELECT 'party' AS src, 'LOCATED_IN' AS rel, dst, 0.95::DOUBLE AS confidence, count(*) AS sources FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY dst")
def federated_union(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["LOCATED_IN"])
    kind = F.split("src", ":")[0]
    parts = {k: e.where(kind == k).withColumn("src", F.lit(k)) for k in ("customer", "supplier")}
    aliases = spark.createDataFrame([("customer", "party"), ("supplier", "party")], "alias string, canonical string")
    return N.federated_union(parts, aliases)


@query("C28_align_by_label", "WITH a AS (SELECT 'x' AS source, n_nationkey::VARCHAR AS id, lower(n_name) AS k FROM nation), b AS (SELECT 'y', 'y' || n_nationkey, lower(n_name) FROM nation) SELECT source, id, min(id) OVER (PARTITION BY k) AS canonical FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def align_by_label(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    b = n.select(F.concat(F.lit("y"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit(" "), F.lower("n_name")).alias("label"))
    return N.align_by_label({"x": a, "y": b})


@query("N1_N2_shards", "SELECT (('0x' || substr(md5(label::VARCHAR), 1, 8))::BIGINT % 4)::INT AS shard, count(*) AS n FROM embeddings GROUP BY 1")
def shards(spark: SparkSession, sf: str) -> DataFrame:
    return N.shard_sizes(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cid")), 4)


@query("N3_N4_stitch_hops", ", a AS (SELECT src, dst FROM edges WHERE rel = 'FULFILLED_BY'), b AS (SELECT src, dst FROM edges WHERE rel = 'LOCATED_IN') SELECT a.src AS query_id, a.dst AS mid, b.dst AS tail FROM a JOIN b ON a.dst = b.src QUALIFY row_number() OVER (PARTITION BY a.src ORDER BY a.dst || '|' || b.dst) <= 2", edges=True)
def stitch_hops(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["FULFILLED_BY", "LOCATED_IN"])
    one = e.where("rel = 'FULFILLED_BY'").select(F.col("src").alias("query_id"), F.array("src", "dst").alias("path"), F.col("dst").alias("tail"), F.lit(0.5).alias("score"))
    two = one.select("query_id", F.col("tail").alias("src")).join(e.where("rel = 'LOCATED_IN'").select("src", "dst"), "src").select("query_id", F.array("src", "dst").alias("path"), F.col("dst").alias("tail"), F.lit(0.5).alias("score"))
    return N.stitch_hops(one, two, 2).select("query_id", F.col("path")[1].alias("mid"), "tail")


@query("N6_community_delta", "SELECT vec_id AS id, CASE WHEN vec_id % 20 = 0 THEN 99 ELSE label END AS cid FROM embeddings")
def community_delta(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cid"))
    return N.apply_delta(c, c.where("id % 20 = 0").select("id", F.lit(99).alias("cid")))


# ---------------------------------------------------------------- embeddings


@query(
    "K1_seeded_vectors",
    ", n AS (SELECT src AS id FROM edges WHERE rel = 'LOCATED_IN' UNION SELECT dst FROM edges WHERE rel = 'LOCATED_IN'), r AS (SELECT id, list_transform(range(1, 9), lambda i: ('0x' || substr(md5(id || '|' || i), 1, 6))::BIGINT / 8388608.0::DOUBLE - 1) AS v FROM n) SELECT id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM r",
    edges=True,
)
def seeded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = K.seeded_vectors(nodes_of(edge_view(spark, sf, ["LOCATED_IN"])), 8)
    return v.select("id", r6(F.col("v")[0]).alias("first"), r6(F.col("v")[7]).alias("last"))


@query("K4_K6_K7_link_prediction", None)
def link_prediction(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["LOCATED_IN", "IN_REGION"])
    ent, rel = K.fit_translation(e, 8, 20)
    heads = ent.where(F.startswith("id", F.lit("nation:"))).select(F.col("id").alias("head"), F.col("v").alias("hv")).withColumn("rel", F.lit("IN_REGION"))
    return K.predict_links(heads, rel.select("rel", F.col("v").alias("rv")), ent.where(F.startswith("id", F.lit("region:"))), 3)


@query("K13_signal_statistics", "WITH s AS (SELECT user_id, list(value::DOUBLE - 50 ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_avg(v), 6) AS mean, round(list_max(v) - list_min(v), 6) AS range, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS energy, len(list_filter(range(1, len(v)), lambda i: sign(v[i]) * sign(v[i + 1]) < 0)) AS crossings FROM s")
def signal_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    s = s.select("user_id", K.signal_statistics(F.transform("l", lambda x: x.value - 50.0)).alias("s"))
    return s.select("user_id", r6(F.col("s.mean")).alias("mean"), r6(F.col("s.range")).alias("range"), F.round("s.energy", 4).alias("energy"), F.col("s.crossings").cast("bigint").alias("crossings"))


@query("K14_spectral_features", None)
def spectral(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x.value).alias("v"))
    return s.select("user_id", K.spectral_features()("v").alias("features"))


@query("C29_K15_procrustes", "SELECT vec_id AS id, round(embedding[len(embedding)]::DOUBLE, 6) AS first FROM embeddings")
def procrustes(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    anchors = v.select(F.col("v").alias("a"), F.reverse("v").alias("b"))
    return K.align(v, anchors, 64).select("id", r6(F.col("v")[0]).alias("first"))


@query("K9_K11_learn_weights", None)
def learn_weights(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("good"), F.slice(F.col("embedding").cast("array<double>"), 5, 4).alias("bad"))
    w = R.learn_weights(v, 4, 5)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(w)], "feature int, weight double")


# ---------------------------------------------------------------- baselines and metrics


def _two_hop(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seeds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return seeds, edge_view(spark, sf, ["PLACED_BY", "FULFILLED_BY", "LOCATED_IN"])


_REACH = ", st AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('PLACED_BY', 'FULFILLED_BY', 'LOCATED_IN')), r1 AS (SELECT DISTINCT o_orderkey AS query_id, dst AS id FROM orders JOIN st ON src = 'order:' || o_orderkey), r2 AS (SELECT DISTINCT query_id, dst AS id FROM r1 JOIN st ON src = id), r AS (SELECT query_id, id, 1 AS depth FROM r1 UNION ALL SELECT query_id, id, 2 FROM r2 ANTI JOIN r1 USING (query_id, id)) "


@query("Q2_shortest_path_bfs", _REACH + "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY depth, id) AS rank FROM r QUALIFY rank <= 5", edges=True)
def bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds, e = _two_hop(spark, sf)
    return Q.bfs_answers(seeds, e, 2, 5).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("Q3_degree_bfs", _REACH + ", ends AS (SELECT src AS id FROM edges WHERE rel IN ('PLACED_BY', 'FULFILLED_BY', 'LOCATED_IN') UNION ALL SELECT dst FROM edges WHERE rel IN ('PLACED_BY', 'FULFILLED_BY', 'LOCATED_IN')), d AS (SELECT id, count(*) AS degree FROM ends GROUP BY id) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, id) AS rank FROM r JOIN d USING (id) QUALIFY rank <= 5", edges=True)
def degree_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds, e = _two_hop(spark, sf)
    return Q.bfs_answers(seeds, e, 2, 5, "degree").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("Q4_uniform_bfs", _REACH + "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ('0x' || substr(md5(query_id || '|' || id), 1, 8))::BIGINT DESC, id) AS rank FROM r QUALIFY rank <= 5", edges=True)
def uniform_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds, e = _two_hop(spark, sf)
    return Q.bfs_answers(seeds, e, 2, 5, "hash").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("Q5_Q6_hits_mrr", _REACH + ", a AS (SELECT query_id, id AS entity, row_number() OVER (PARTITION BY query_id ORDER BY depth, id) AS rank FROM r QUALIFY rank <= 5), t AS (SELECT o_orderkey AS query_id, 'customer:' || o_custkey AS entity FROM orders), f AS (SELECT t.query_id, min(rank) AS first FROM t LEFT JOIN a USING (query_id, entity) GROUP BY t.query_id) SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS hits_1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS hits_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f", edges=True)
def hits_mrr(spark: SparkSession, sf: str) -> DataFrame:
    seeds, e = _two_hop(spark, sf)
    answers = Q.bfs_answers(seeds, e, 2, 5).withColumnRenamed("id", "entity")
    truth = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity"))
    got = Q.ranking_metrics(answers, truth)
    return got.select("queries", r6(F.col("hits_1")).alias("hits_1"), r6(F.col("hits_10")).alias("hits_10"), r6(F.col("mrr")).alias("mrr"))


@query("Q7_adjusted_rand", "WITH j AS (SELECT label AS x, vec_id % 7 AS y FROM embeddings), c AS (SELECT x, y, count(*) AS n FROM j GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS s FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM (SELECT x, sum(n) AS n FROM c GROUP BY x)), b AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT y, sum(n) AS n FROM c GROUP BY y)) SELECT round((i.s - a.s * b.s / (t * (t - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (t * (t - 1) / 2)), 6) AS ari FROM i, a, b")
def ari(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").withColumn("id", F.col("vec_id"))
    return Q.adjusted_rand(v.select("id", F.col("label").alias("cid")), v.select("id", (F.col("vec_id") % 7).alias("cid"))).select(r6(F.col("ari")).alias("ari"))


@query("Q8_type_purity", "WITH g AS (SELECT vec_id % 7 AS cid, label AS type, count(*) AS n FROM embeddings GROUP BY ALL) SELECT cid, sum(n) OVER (PARTITION BY cid)::BIGINT AS size, type, round(n / sum(n) OVER (PARTITION BY cid), 6) AS purity FROM g QUALIFY row_number() OVER (PARTITION BY cid ORDER BY n DESC, type) = 1")
def type_purity(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").withColumn("id", F.col("vec_id"))
    got = Q.type_purity(v.select("id", (F.col("vec_id") % 7).alias("cid")), v.select("id", F.col("label").alias("type")))
    return got.withColumn("purity", r6(F.col("purity")))


@query("Q9_planted_graph", "SELECT 'intra_rel' AS rel, 20 * 30 * 4 AS n UNION ALL SELECT 'inter_rel', 20 * 2")
def planted(spark: SparkSession, sf: str) -> DataFrame:
    return Q.planted_graph(spark, 20, 30, 4, 2).groupBy("rel").agg(F.count("*").cast("int").alias("n"))


@query("Q10_Q12_edge_split", ", x AS (SELECT src, rel, dst, ('0x' || substr(md5(src || '|' || rel || '|' || dst), 1, 8))::BIGINT % 100 AS b FROM edges WHERE rel = 'SUPPLIED_BY') SELECT src, rel, dst FROM x WHERE NOT (dst LIKE '%1' AND b < 30)", edges=True)
def incomplete(spark: SparkSession, sf: str) -> DataFrame:
    e = edge_view(spark, sf, ["SUPPLIED_BY"])
    return Q.incomplete(e, e.where(F.endswith("dst", F.lit("1"))).select(F.col("dst").alias("id")), 30).select("src", "rel", "dst")


@query("Q11_Q13_chain_questions", ", a AS (SELECT src AS seed, dst AS mid FROM edges WHERE rel = 'FULFILLED_BY'), b AS (SELECT src AS mid, dst AS answer FROM edges WHERE rel = 'LOCATED_IN') SELECT seed, 'FULFILLED_BY' AS r1, 'LOCATED_IN' AS r2, count(DISTINCT answer) AS answers FROM a JOIN b USING (mid) GROUP BY seed", edges=True)
def chain_questions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.chain_questions(edge_view(spark, sf, ["FULFILLED_BY", "LOCATED_IN"]), "FULFILLED_BY", "LOCATED_IN")


@query("Q14_keyword_relation", "SELECT doc_id, CASE WHEN list_contains(w, 'license') THEN 'LICENSE' WHEN list_has_any(w, ['the', 'der']) THEN 'ARTICLE' END AS rel FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM documents)")
def keyword_relation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", Q.keyword_relation(F.col("text"), {"LICENSE": ["license"], "ARTICLE": ["the", "der"]}).alias("rel"))


# ---------------------------------------------------------------- supporting state

_PAT = "WITH s AS (SELECT user_id, list_aggregate(list(event_type ORDER BY event_id)[1:2], 'string_agg', '>') AS rels, avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) AS success FROM events GROUP BY user_id), p AS (SELECT rels, sum(success) AS weight, count(*) AS n FROM s GROUP BY rels) "


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("l"), F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("success"))
    return s.select("user_id", F.concat_ws(">", F.slice(F.transform("l", lambda x: x.event_type), 1, 2)).alias("rels"), "success")


@query("R4_R6_R7_patterns", _PAT + "SELECT rels, round(weight, 6) AS weight, n FROM p ORDER BY round(p.weight, 9) DESC, rels LIMIT 5")
def patterns(spark: SparkSession, sf: str) -> DataFrame:
    s = _sequences(spark, sf)
    got = R.top_pattern(s.withColumn("success", F.col("success")), 1 << 20).withColumn("k", F.round("weight", 9)).orderBy(F.desc("k"), "rels").limit(5)
    return got.select("rels", r6(F.col("weight")).alias("weight"), "n")


@query("R10_pattern_prefix", _PAT + "SELECT rels, n FROM p WHERE rels = 'click' OR rels LIKE 'click>%'")
def pattern_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_prefix(R.top_pattern(_sequences(spark, sf), 1 << 20), "click").select("rels", "n")


@query("R8_pattern_transfer", _PAT + ", c AS (SELECT event_type AS value, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS code FROM events GROUP BY event_type) SELECT rels, a.code || '-' || b.code AS code FROM p JOIN c a ON string_split(rels, '>')[1] = a.value JOIN c b ON string_split(rels, '>')[2] = b.value")
def pattern_transfer(spark: SparkSession, sf: str) -> DataFrame:
    codes = L.frequency_codes(table(spark, sf, "events"), "event_type")
    return R.transfer(R.top_pattern(_sequences(spark, sf), 1 << 20), codes, 0.5, 1 << 20).select("rels", "code")


@query("R5_prediction_error", _PAT + "SELECT user_id, CASE WHEN rels IN ('click>view', 'view>view') THEN 0.0::DOUBLE WHEN string_split(rels, '>')[1] IN ('click', 'view') THEN 0.5 ELSE 1.0 END AS error FROM s")
def prediction_error(spark: SparkSession, sf: str) -> DataFrame:
    return _sequences(spark, sf).select("user_id", R.prediction_error(F.split("rels", ">"), ["click>view", "view>view"]).alias("error"))


@query("P14_usage", "SELECT user_id AS key_id, count(*) AS calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY user_id")
def usage(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("user_id").alias("key_id"), F.col("value").alias("elapsed_ms"))
    return R.usage(log).withColumn("mean_ms", r6(F.col("mean_ms")))


@query("R33_log_entries", "SELECT event_id AS id FROM events WHERE event_type = 'error' AND contains(props, '\"k\": 3') ORDER BY ts DESC, event_id DESC LIMIT 50")
def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("level"), F.col("props").alias("message"))
    return R.log_entries(log, "error", search='"k": 3', limit=50).select("id")


@query("R17_top_signals", "SELECT event_id AS id, value AS strength FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_signals(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_signals(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("strength")), 25)


@query("E40_temporal_grid", "WITH g AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)) t(eta, iota)), x AS (SELECT eta, iota, user_id, event_id, event_type = 'purchase' AS correct, row_number() OVER (PARTITION BY eta, iota, user_id ORDER BY round(value / 100 + eta * ((event_id % 7) / 7.0::DOUBLE) + iota * ((event_id % 11) / 11.0::DOUBLE), 9) DESC, event_id) AS rank FROM events, g), h AS (SELECT eta, iota, user_id, max(CASE WHEN rank <= 5 AND correct THEN 1 ELSE 0 END) AS hit FROM x GROUP BY ALL) SELECT eta, iota, round(avg(hit), 6) AS recall FROM h GROUP BY ALL")
def temporal_grid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), ((F.col("event_id") % 7) / 7.0).alias("decay"), ((F.col("event_id") % 11) / 11.0).alias("recency"), (F.col("event_type") == "purchase").alias("correct"))
    return R.temporal_grid(e, [0.0, 1.0], [0.0, 1.0], 5).withColumn("recall", r6(F.col("recall")))


@query("R1_R2_R3_R29_modulators", "SELECT 0.4::DOUBLE AS sim, 10 AS width")
def modulators(spark: SparkSession, sf: str) -> DataFrame:
    m = R.Modulators().step()
    return spark.createDataFrame([(m.weights({"sim": 0.4, "cs": 0.4, "etw": 0.1})["sim"], m.width(10))], "sim double, width int")
