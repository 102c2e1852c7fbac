"""Writing graphs: state, snapshots, logs, ledgers and answer texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["src", "rel", "dst"]


def save_state(path: str, manifest: dict, **tables: DataFrame) -> None:
    """A parquet table per name and a manifest of one JSON row."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(manifest | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_state(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return manifest, {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def save_snapshot(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").json(path)


def restore_snapshot(snapshot: DataFrame, edges: DataFrame | None = None, skip_existing: bool = True) -> DataFrame:
    """Put a snapshot's edges back; those already there are skipped or stand twice."""
    if edges is None:
        return snapshot
    new = snapshot.join(edges, KEY, "left_anti") if skip_existing else snapshot
    return edges.unionByName(new, allowMissingColumns=True)


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edge keys of only one snapshot: key and ``change`` (added or removed)."""
    ka, kb = a.select(*KEY).distinct(), b.select(*KEY).distinct()
    return kb.join(ka, KEY, "left_anti").withColumn("change", F.lit("added")).unionByName(ka.join(kb, KEY, "left_anti").withColumn("change", F.lit("removed")))


def append_log(edges: DataFrame, path: str, op: str = "add") -> None:
    """One JSON line per edge of a write-ahead log."""
    edges.withColumn("op", F.lit(op)).write.mode("append").json(path)


def replay_log(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Edges that a log adds, with defaults; not those that ``base`` has."""
    added = log.where("op = 'add'").drop("op")
    for name, default in (("confidence", 1.0), ("weight", 1.0), ("provenance", "wal")):
        added = added.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in added.columns else F.lit(default))
    return restore_snapshot(added, base)


def write_sorted_by_source(edges: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by source, so that scans of a node's edges skip row groups."""
    edges.repartitionByRange("src").sortWithinPartitions("src").write.mode("overwrite").parquet(path)


def query_log(answers: DataFrame, min_score: float) -> DataFrame:
    return answers.where(F.col("score") >= min_score)


def patterns_of(log: DataFrame, sequence_col: str = "rels") -> DataFrame:
    """How often each relation sequence of a query log succeeded."""
    return log.groupBy(sequence_col).agg(F.count("*").alias("n"))


def audit_row(query: Column, answer: Column, confidence: Column, trace: Column) -> Column:
    return F.struct(query.alias("query"), answer.alias("answer"), confidence.alias("confidence"), F.to_json(trace).alias("trace"))


def audit_statistics(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def rollback(edges: DataFrame, ledger: DataFrame, where: str) -> DataFrame:
    """Remove the edges that the chosen ledger rows (a batch or a cycle) recorded."""
    return edges.join(ledger.where(where).select(*KEY).distinct(), KEY, "left_anti")


def structured(answers: DataFrame) -> DataFrame:
    """A JSON object per answer."""
    return answers.select("query_id", F.to_json(F.struct(*[c for c in answers.columns if c != "query_id"])).alias("json"))


def prompt(answers: DataFrame, instruction: str, max_paths: int = 5) -> DataFrame:
    """Prompt text per query from its first answers: rank, entity and path."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("entity"), F.lit(" ("), F.concat_ws(" -> ", "path"), F.lit(")"))
    rows = answers.where(F.col("rank") <= max_paths).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.concat_ws("\n", F.lit(instruction), F.transform("l", lambda x: x.line)).alias("prompt"))
