"""The graph engine's public face: build, query, ask, complete, explain.

    graph = Graph(edges)                       # a DataFrame of the edge schema
    graph = graph.build()                      # communities, degrees, relation statistics
    answers = graph.query(seeds, top_k=10)     # seeds: query_id, id
    graph.ask("who ships part 17?")            # text to answer and sentence

Every result is a DataFrame; many queries run at once, keyed by ``query_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.graph import EDGE_COLUMNS, nodes_of
from graphloom.operators import access, analytics, answers, rules, traversal
from graphloom.sources import files, sinks
from graphloom.storage import materialize

#: A completion rule: edges in, new edges (src, rel, dst, confidence) out.
Rule = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    nodes: DataFrame | None = None
    features: DataFrame | None = None
    relation_weights: dict[str, float] = field(default_factory=dict)
    max_hop: int = 3
    width: int = 10
    neighbours: int = 100
    branch_bonus: float = 0.25

    # ------------------------------------------------------------ making

    @staticmethod
    def load(spark: SparkSession, path: str, **options) -> Graph:
        return Graph(files.load(spark, path, **options))

    @staticmethod
    def from_triples(spark: SparkSession, triples: list[tuple], **options) -> Graph:
        return Graph(files.from_triples(spark, triples, **options))

    @staticmethod
    def from_sql(spark: SparkSession, query: str, **options) -> Graph:
        return Graph(files.from_sql(spark, query, **options))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def node_table(self) -> DataFrame:
        return self.nodes if self.nodes is not None else nodes_of(self.edges)

    def build(self, rounds: int = 4) -> Graph:
        """Write the edges, find communities and degrees, set width and relation weights from the
        graph's own statistics."""
        edges = materialize(self.edges, "edges")
        labels = analytics.label_propagation(edges, rounds).withColumn("community", F.pmod(F.xxhash64("label"), F.lit(1 << 30)).cast("int"))
        features = materialize(labels.join(access.degrees(edges), "id").select("id", "community", "degree"), "features")
        shape = analytics.profile(edges).first()
        weights = {r.rel: r.spec for r in self._specificity(edges).collect()}  # a row per relation
        return replace(self, edges=edges, nodes=materialize(self.node_table(), "nodes"), features=features, relation_weights=self.relation_weights or weights, width=int(shape.width) if shape and shape.width else self.width)

    @staticmethod
    def _specificity(edges: DataFrame) -> DataFrame:
        from graphloom.functions.scoring import relation_specificity

        s = access.relation_statistics(edges)
        return s.select("rel", relation_specificity(F.col("freq"), F.col("targets"), F.col("degree_sum") / F.col("freq")).alias("spec"))

    # ------------------------------------------------------------ asking

    def paths(self, seeds: DataFrame, max_hop: int | None = None, at: float | None = None, **options) -> DataFrame:
        """Survivors of the beam search from (query_id, id)."""
        options = {"width": self.width, "neighbours": self.neighbours, "relation_weights": self.relation_weights, "features": self.features} | options
        return traversal.beam(seeds, self.edges, max_hop=max_hop or self.max_hop, at=at, **options)

    def query(self, seeds: DataFrame, top_k: int = 10, min_hop: int = 1, **options) -> DataFrame:
        """Ranked answers of each query.  Where the beam floods through hubs, the query is asked again with
        half the width, and the drier result stands."""
        found = materialize(self.paths(seeds, **options), "paths")
        flooded = answers.hub_flooded(found).where("flooded")
        if not flooded.isEmpty():
            again = self.paths(seeds.join(flooded, "query_id", "left_semi"), **(options | {"width": max(1, self.width // 2)}))
            found = found.join(flooded, "query_id", "left_anti").unionByName(again)
        return answers.extract(found, top_k, min_hop, branch_bonus=self.branch_bonus)

    def query_aware(self, seeds: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        """Answers, and per query what the engine makes of them."""
        found = materialize(self.query(seeds, **options), "answers")
        return found, answers.assess(found)

    def ask(self, question: str, top_k: int = 5, **options) -> DataFrame:
        """Answer a question in words: link its entity, infer the hops, query, say the paths."""
        q = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        seeds = text.link_entities(q, self.node_table().select("id", "label")).select("query_id", "id")
        hops = q.select(text.infer_hops(F.col("text"))).first()[0]
        found = self.query(seeds, top_k, max_hop=hops, **options)
        return found.select("rank", "entity", "score", "confidence", answers.verbalise(F.col("path"), F.col("confidence")).alias("said"), "path")

    def find(self, name: str, top_k: int = 5) -> DataFrame:
        return access.find_entities(self.node_table(), name, top_k)

    def neighbours_of(self, ids: DataFrame, **options) -> DataFrame:
        return access.expand(ids, self.edges, **options)

    def stats(self) -> DataFrame:
        nodes = self.node_table().agg(F.count("*").alias("nodes"))
        return self.edges.agg(F.count("*").alias("edges"), F.countDistinct("rel").alias("relations")).crossJoin(nodes)

    # ------------------------------------------------------------ changing

    def complete(self, *steps: Rule) -> Graph:
        """Apply completion rules one after another; each sees what the ones before it added."""
        out = self.edges.select(*EDGE_COLUMNS)
        for step in steps:
            new = step(out)
            extra = [F.lit(v).alias(c) for c, v in (("weight", 1.0), ("provenance", "inferred")) if c not in new.columns]
            out = out.unionByName(new.select("*", *extra).select(*[c for c in EDGE_COLUMNS if c in new.columns or c in ("weight", "provenance")]), allowMissingColumns=True)
        return replace(self, edges=out)

    def infer(self, table: str = rules.COMPOSITIONS) -> DataFrame:
        """Edges that the composition rules derive."""
        return rules.transitive_inference(self.edges, rules.composition_table(self.spark, table))

    def contradictions(self) -> DataFrame:
        return rules.direct_contradictions(self.edges, rules.opposing_table(self.spark))

    def save(self, path: str) -> None:
        tables = {"edges": self.edges, "nodes": self.node_table()} | ({"features": self.features} if self.features is not None else {})
        sinks.save_state(path, {"relation_weights": self.relation_weights, "width": self.width, "max_hop": self.max_hop}, **tables)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Graph:
        manifest, tables = sinks.load_state(spark, path)
        return Graph(tables["edges"], tables["nodes"], tables.get("features"), manifest["relation_weights"], manifest["max_hop"], manifest["width"])
