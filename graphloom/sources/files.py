"""Edge tables from files, SQL and memory.

Every loader gives the edge schema of ``graphloom.graph``.  Ends are trimmed; rows without both ends
and rows whose source starts with ``#`` are dropped; a missing relation becomes ``RELATED_TO``.  With
``directed=False`` the table holds each edge in both directions.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import DEFAULT_RELATION, EDGE_SCHEMA, as_edges, symmetrised

_ENDS = {"src": ("source", "src", "subject", "head", "from"), "dst": ("target", "dst", "object", "tail", "to"), "rel": ("relation", "relation_type", "rel", "predicate", "label", "type")}


def pick(df: DataFrame, name: str | None, role: str) -> Column | None:
    """A column by name without regard to case, else the first usual name of its role."""
    by = {c.lower(): c for c in df.columns}
    if name is not None and name.lower() in by:
        return F.col(f"`{by[name.lower()]}`")
    found = next((by[c] for c in _ENDS[role] if c in by), None)
    if found is not None:
        return F.col(f"`{found}`")
    if role == "rel":
        return None
    raise ValueError(f"no column for {role} among {df.columns}")


def clean(df: DataFrame, src: Column, dst: Column, rel: Column | None = None, directed: bool = True, **attributes) -> DataFrame:
    text = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    relation = F.lit(DEFAULT_RELATION) if rel is None else F.coalesce(text(rel), F.lit(DEFAULT_RELATION))
    edges = as_edges(df, text(src), relation, text(dst), **attributes)
    edges = edges.where("src is not null and dst is not null and not startswith(src, '#')")
    return edges if directed else symmetrised(edges)


def from_table(df: DataFrame, source_col: str | None = None, target_col: str | None = None, relation_col: str | None = None, directed: bool = True, **attributes) -> DataFrame:
    return clean(df, pick(df, source_col, "src"), pick(df, target_col, "dst"), pick(df, relation_col, "rel"), directed, **attributes)


def from_csv(spark: SparkSession, path: str, source_col="source", target_col="target", relation_col="relation", directed=False, sep=",", encoding="UTF-8") -> DataFrame:
    """A delimited file with a header; every column is read as text."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    return from_table(df, source_col, target_col, relation_col, directed)


def from_json(spark: SparkSession, path: str, source_col="source", target_col="target", relation_col="relation", directed=False) -> DataFrame:
    """An array of edge objects, an object with ``edges``, an array of triples, or a line per object."""
    multi = path.endswith(".json")
    reader = spark.read.option("multiLine", multi)
    df = reader.json(path)
    if "edges" in df.columns:
        kind = df.schema["edges"].dataType.elementType
        df = df.select(F.explode("edges").alias("e"))
        df = df.select("e.*") if kind.typeName() == "struct" else _triples(df, F.col("e"))
    elif set(df.columns) <= {"_corrupt_record"}:  # triples
        rows = spark.read.text(path, wholetext=multi).select(F.from_json("value", "array<array<string>>" if multi else "array<string>").alias("x"))
        df = _triples(rows.select(F.explode("x").alias("x")) if multi else rows, F.col("x"))
    return from_table(df, source_col, target_col, relation_col, directed)


def _triples(df: DataFrame, x: Column) -> DataFrame:
    return df.select(F.get(x, F.lit(0)).alias("source"), F.get(x, F.lit(1)).alias("relation"), F.get(x, F.lit(2)).alias("target"))


def from_graphml(spark: SparkSession, path: str, directed=False) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "edge").option("attributePrefix", "_").option("valueTag", "_text").load(path)
    rel = F.col("data._text").cast("string") if "data" in df.columns and df.schema["data"].dataType.typeName() == "struct" else F.get(F.col("data._text"), F.lit(0)).cast("string") if "data" in df.columns else None
    return clean(df, F.col("_source"), F.col("_target"), rel, directed)


def from_gexf(spark: SparkSession, path: str, directed=False) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "edge").option("attributePrefix", "_").load(path)
    return clean(df, F.col("_source"), F.col("_target"), F.col("_label") if "_label" in df.columns else None, directed)


def from_gml(spark: SparkSession, path: str, directed=False) -> DataFrame:
    """The bracketed text format; a file is one value, so it must fit a task."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"edge\s*\[([^\]]*)\]"), 1)).alias("b"), "value")
    names = F.map_from_entries(F.transform(F.regexp_extract_all("value", F.lit(r"node\s*\[([^\]]*)\]"), 1), lambda n: F.struct(F.regexp_extract(n, r"id\s+(\S+)", 1), F.coalesce(F.nullif(F.regexp_extract(n, r'label\s+"([^"]*)"', 1), F.lit("")), F.regexp_extract(n, r"id\s+(\S+)", 1)))))
    end = lambda key: F.coalesce(F.try_element_at(names, F.regexp_extract("b", rf"{key}\s+(\S+)", 1)), F.regexp_extract("b", rf"{key}\s+(\S+)", 1))
    rel = F.nullif(F.regexp_extract("b", r'(?:relation|label)\s+"([^"]*)"', 1), F.lit(""))
    return clean(blocks, end("source"), end("target"), rel, directed)


def from_parquet(spark: SparkSession, source, source_col=None, target_col=None, relation_col=None, directed=True, where: str | None = None, weight_col: str | None = None) -> DataFrame:
    """A path or DataFrame; only the needed columns are read and the filter reaches the scan."""
    df = source if isinstance(source, DataFrame) else spark.read.parquet(source)
    df = df.where(where) if where else df
    return from_table(df, source_col, target_col, relation_col, directed, **({"weight": F.col(weight_col)} if weight_col else {}))


def from_arrow(spark: SparkSession, source, **columns) -> DataFrame:
    """A Feather file (small: it is read on the driver) or an Arrow table."""
    if isinstance(source, str):
        import pyarrow.feather

        source = pyarrow.feather.read_table(source)
    return from_table(spark.createDataFrame(source), **columns)


def from_excel(spark: SparkSession, path: str, **columns) -> DataFrame:
    """A sheet of edges, where the optional reader library is present (small: read on the driver)."""
    import pandas as pd

    return from_table(spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda d: d.notna(), None)), **columns)


def from_sql(spark: SparkSession, text: str, source_col=None, target_col=None, relation_col=None, directed=True, url: str | None = None, **options) -> DataFrame:
    """A SELECT in this session, or through JDBC when ``url`` is given; names match without case."""
    df = spark.read.format("jdbc").options(url=url, query=text, **options).load() if url else spark.sql(text)
    return from_table(df, source_col, target_col, relation_col, directed)


def from_sql_table(spark: SparkSession, name: str, source_col: str, target_col: str, relation_col: str | None = None, where: str | None = None, directed=True) -> DataFrame:
    df = spark.table(name)
    return from_table(df.where(where) if where else df, source_col, target_col, relation_col, directed)


def from_kb(spark: SparkSession, path: str, sep: str = "|", directed=True) -> DataFrame:
    """A line per triple, ``head|relation|tail``; comma, then tab, where the separator gives fewer
    than three fields; comments and a header line are skipped."""
    line = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split("value", "\\Q" + sep + "\\E")
    commas, tabs = F.split("value", ","), F.split("value", "\t")
    line = line.select(F.when(F.size(parts) >= 3, parts).when(F.size(commas) >= 3, commas).otherwise(tabs).alias("x")).where("size(x) >= 3")
    header = F.lower(F.trim(F.col("x")[0])).isin("head", "source", "subject") & F.lower(F.trim(F.col("x")[2])).isin("tail", "target", "object")
    return clean(line.where(~header), F.col("x")[0], F.col("x")[2], F.col("x")[1], directed)


def from_conceptnet(spark: SparkSession, path: str, lang: str = "en", min_weight: float = 1.0, max_edges: int | None = None, exclude: tuple[str, ...] = ("ExternalURL",)) -> DataFrame:
    """Five tab-separated fields: assertion, relation, two concepts, JSON with a weight."""
    df = spark.read.option("sep", "\t").option("quote", "").schema("uri string, r string, s string, o string, info string").csv(path)
    term = lambda c: F.regexp_replace(F.regexp_extract(c, r"^/c/[^/]+/([^/]+)", 1), "_", " ")
    tongue = lambda c: F.regexp_extract(c, r"^/c/([^/]+)/", 1)
    weight = F.coalesce(F.get_json_object("info", "$.weight").try_cast("double"), F.lit(1.0))
    df = df.where(~F.col("uri").startswith("#") & (tongue("s") == lang) & (tongue("o") == lang) & (weight >= min_weight))
    rel = F.regexp_extract("r", r"^/r/(.+)$", 1)
    df = df.where(~rel.isin(*exclude))
    out = clean(df, term("s"), term("o"), rel, True, weight=weight, confidence=F.least(weight / 10.0, F.lit(1.0)), provenance="conceptnet")
    return out.limit(max_edges) if max_edges else out


def from_triples(spark: SparkSession, triples: list[tuple], last_wins: bool = False) -> DataFrame:
    """(src, rel, dst) or (src, rel, dst, attributes); optionally one edge per (src, dst), the last."""
    rows = [(i, s, r, o, *(dict(m[0]) if m else {}).items()) for i, (s, r, o, *m) in enumerate(triples)]
    names = [f for f in EDGE_SCHEMA.fieldNames() if f not in ("src", "rel", "dst")]
    defaults = {"weight": 1.0, "confidence": 1.0, "provenance": "triples"}
    data = [(i, s, r, o, *(dict(more).get(n, defaults.get(n)) for n in names)) for i, s, r, o, *more in rows]
    df = spark.createDataFrame(data, "seq bigint, src string, rel string, dst string, weight double, confidence double, provenance string, valid_from double, valid_to double")
    if last_wins:
        df = df.groupBy("src", "dst").agg(F.max_by(F.struct(*df.columns), "seq").alias("e")).select("e.*")
    return df.drop("seq")


def from_rdf(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """N-Triples whose object is an IRI: all of them, or a sample of ``limit`` for an export that asks for one."""
    line = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r"<([^>]*)>"), 1).alias("x"), "value").where("size(x) = 3 and trim(value) rlike '^<[^>]*>\\\\s*<[^>]*>\\\\s*<[^>]*>'")
    out = clean(line, F.col("x")[0], F.col("x")[2], F.col("x")[1])
    return out.limit(limit) if limit else out


def from_text_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Whole text files: path and text."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


_LOADERS = {"csv": from_csv, "json": from_json, "jsonl": from_json, "graphml": from_graphml, "gexf": from_gexf, "gml": from_gml, "parquet": from_parquet, "xlsx": from_excel, "xls": from_excel, "feather": from_arrow}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the loader by the path's suffix."""
    suffix = os.path.splitext(path.removesuffix(".gz"))[1].lstrip(".").lower()
    if suffix == "tsv":
        return from_csv(spark, path, sep="\t", **options)
    if suffix not in _LOADERS:
        raise ValueError(f"no loader for .{suffix}")
    return _LOADERS[suffix](spark, path, **options)
