"""The property graph as DataFrames, and a graph view over relational tables.

``edges`` holds one row per edge: src, rel, dst, weight, confidence, provenance, valid_from and
valid_to (epoch seconds, null means unbounded).  Parallel edges are kept.  ``nodes`` is derived from
the edge ends where no node table is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _NUMBER = T.StringType(), T.DoubleType()
EDGE_SCHEMA = T.StructType([T.StructField(n, _TEXT if n in ("src", "rel", "dst", "provenance") else _NUMBER) for n in ("src", "rel", "dst", "weight", "confidence", "provenance", "valid_from", "valid_to")])
EDGE_COLUMNS = EDGE_SCHEMA.fieldNames()
DEFAULT_RELATION = "RELATED_TO"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / 1e6


def as_edges(df: DataFrame, src, rel, dst, weight=1.0, confidence=1.0, provenance="", valid_from=None, valid_to=None) -> DataFrame:
    """Project any rows to the edge schema; plain values become literals."""
    values = (src, rel, dst, weight, confidence, provenance, valid_from, valid_to)
    column = lambda v, f: (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name)
    return df.select(*[column(v, f) for v, f in zip(values, EDGE_SCHEMA)])


def _id(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def edge_view(spark: SparkSession, sf_dir: str, relations: list[str] | None = None) -> DataFrame:
    """Edges over the relational tables; ``relations`` names the parts that are read."""
    t = lambda n: table(spark, sf_dir, n)
    parts = {
        "IN_REGION": lambda: as_edges(t("nation"), _id("nation", "n_nationkey"), "IN_REGION", _id("region", "n_regionkey"), 1.0, 1.0, "wikidata:nation"),
        "LOCATED_IN": lambda: as_edges(t("customer"), _id("customer", "c_custkey"), "LOCATED_IN", _id("nation", "c_nationkey"), 1.0, 0.95, "wikidata:customer").unionByName(
            as_edges(t("supplier"), _id("supplier", "s_suppkey"), "LOCATED_IN", _id("nation", "s_nationkey"), 1.0, 0.95, "dbpedia:supplier")
        ),
        "PLACED_BY": lambda: as_edges(t("orders"), _id("order", "o_orderkey"), "PLACED_BY", _id("customer", "o_custkey"), 1.0, 0.9, "triples", epoch(F.col("o_orderdate"))),
        "CONTAINS": lambda: as_edges(t("lineitem"), _id("order", "l_orderkey"), "CONTAINS", _id("part", "l_partkey"), F.col("l_quantity"), F.lit(1.0) - F.col("l_discount"), "", epoch(F.col("l_shipdate"))),
        "SUPPLIED_BY": lambda: as_edges(t("lineitem").select("l_partkey", "l_suppkey").distinct(), _id("part", "l_partkey"), "SUPPLIED_BY", _id("supplier", "l_suppkey"), 1.0, 0.85, "inferred:lineitem"),
        "FULFILLED_BY": lambda: as_edges(t("lineitem").select("l_orderkey", "l_suppkey").distinct(), _id("order", "l_orderkey"), "FULFILLED_BY", _id("supplier", "l_suppkey"), 1.0, 0.8, "hypothesis:lineitem"),
        "EVENTS": lambda: as_edges(
            t("events"),
            _id("user", "user_id"),
            F.col("event_type"),
            F.concat(F.lit("k:"), F.get_json_object("props", "$.k")),
            1.0,
            F.lit(0.5) + F.pmod(F.col("event_id"), F.lit(50)) / 100.0,
            F.concat(F.element_at(F.array(*map(F.lit, ("pubmed:", "freebase:", "rem:", "synthetic:", "blog:"))), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int")), F.col("user_id").cast("string")),
            epoch(F.col("ts")),
            epoch(F.col("ts")) + 86400.0,
        ),
    }
    out = None
    for name in relations or parts:
        part = parts[name]()
        out = part if out is None else out.unionByName(part)
    return out


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct edge ends: id, label and type (the id's prefix)."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.select("id", F.col("id").alias("label"), F.split("id", ":")[0].alias("type"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    swapped = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(swapped)


#: The same view as DuckDB SQL, to begin a WITH clause: ``WITH {EDGES_SQL}, … SELECT``.
EDGES_SQL = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'IN_REGION' AS rel, 'region:' || n_regionkey AS dst, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence, 'wikidata:nation' AS provenance, NULL::DOUBLE AS valid_from, NULL::DOUBLE AS valid_to FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey, 1.0, 0.95, 'wikidata:customer', NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey, 1.0, 0.95, 'dbpedia:supplier', NULL, NULL FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'PLACED_BY', 'customer:' || o_custkey, 1.0, 0.9, 'triples', epoch(o_orderdate), NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey, l_quantity, 1.0::DOUBLE - l_discount, '', epoch(l_shipdate), NULL FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey, 1.0, 0.85, 'inferred:lineitem', NULL::DOUBLE, NULL::DOUBLE FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'FULFILLED_BY', 'supplier:' || l_suppkey, 1.0, 0.8, 'hypothesis:lineitem', NULL::DOUBLE, NULL::DOUBLE FROM lineitem
  UNION ALL SELECT 'user:' || user_id, event_type, 'k:' || json_extract_string(props, '$.k'), 1.0, 0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE, ['pubmed:', 'freebase:', 'rem:', 'synthetic:', 'blog:'][(event_id % 5 + 1)::INT] || user_id, epoch(ts), epoch(ts) + 86400.0 FROM events
)"""
